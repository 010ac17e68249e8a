"""Contracts over JSON text: a schema becomes one column that names every broken rule by its path.

``errors(json, schema)`` compiles a subset of JSON Schema to one SQL expression over VARIANT, without a
Python worker: type, enum, const, required, properties, additionalProperties, minProperties, items,
minItems, maxItems, uniqueItems, minLength, maxLength, pattern, format (``uri``, ``date-time``),
minimum, maximum, allOf, anyOf, oneOf, not, if, then, else and ``$ref`` into ``$defs`` of the same
schema.  As in JSON Schema a rule speaks only of values of its own type, and of a property only
where it stands.  Any other keyword is refused when the column is built, as is a ``$ref`` to what
holds it.

An error reads ``path: rule``: the steps to the value joined by dots, ``$`` for the whole, and the
keyword with what it asks for, never the value.  Errors are sorted by path, step by step as text.

Text that is no single JSON value has the error ``invalid JSON``, or, where these are the reason,
``repeated key`` and ``non-finite number`` with their paths; a number too large for a double is
such a number too.  Only these rows are read token by token.  A null has ``invalid JSON``.

Patterns are Java's; lengths are in code points; 2.0 is an integer; numbers are compared with
bounds as doubles; items are compared for uniqueness, and values with constants, as JSON text with
sorted keys.
"""

from __future__ import annotations

import itertools
import json as plain

from pyspark.sql import Column
from pyspark.sql import functions as F

ERRORS = "array<struct<path:array<string>,rule:string>>"
#: Keywords that say nothing of a value.
_SILENT = frozenset("$schema $id $defs title description".split())
_SCALAR = frozenset("type minLength maxLength pattern format minimum maximum".split())
_OBJECT = frozenset("required properties additionalProperties minProperties".split())
_ARRAY = frozenset("items minItems maxItems uniqueItems".split())
_LOGIC = frozenset("enum const allOf anyOf oneOf not if then else $ref".split())
#: A web address: a host, no blanks, a port of digits.  A time with a zone.
_URI = r"^(?i:https?)://(?:[^\s/?#@]*@)?(?:\[[0-9A-Fa-f:.]+\]|[^\s/?#@:\[\]]+)(?::[0-9]{0,5})?(?:[/?#]\S*)?$"
_PORT, _TIME = r"^[^/]*//[^/?#]*:([0-9]{1,5})(?:[/?#]|$)", r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$"

_NONE = f"CAST(array() AS {ERRORS})"
_NUMBERS = "'BIGINT', 'DOUBLE', 'FLOAT'"


def errors(json: str, schema: dict, *meaning: tuple[str, Column, str]) -> Column:
    """Array of ``path: rule`` of everything wrong with the JSON text of a column, given by name.

    ``meaning`` are rules over other columns, (path, broken, rule), which are asked only where the
    schema holds; a null condition counts as broken.
    """
    text = F.col(json)
    parsed = F.try_parse_json(text)
    single = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    sound = F.coalesce(parsed.isNotNull() & single, F.lit(False))
    found = F.expr(_bound(f"try_parse_json(`{json}`)", lambda v: _Compiler(schema).check(v, schema, ())))
    if meaning:
        each = [F.when(F.coalesce(broken, F.lit(True)), F.struct(F.array(*map(F.lit, path.split("."))).alias("path"), F.lit(rule).alias("rule"))) for path, broken, rule in meaning]
        later = F.filter(F.array(*each), lambda e: e.isNotNull()).cast(ERRORS)
        found = F.flatten(F.transform(F.array(found), lambda first: F.when(F.size(first) > 0, first).otherwise(later)))
    none, invalid = F.expr(_NONE), F.expr(_error([], "invalid JSON"))
    read = F.when(~sound | text.rlike(r"[:\[,]\s*-?[0-9]+(?:\.[0-9]+)?[eE]\+?0*[1-9][0-9]{2}|^\s*-?[0-9]"), malformed(json)).otherwise(none)
    chosen = F.transform(F.array(read), lambda bad: F.when(text.isNull(), invalid).when(F.size(bad) > 0, bad).when(~sound, invalid).otherwise(found))
    shown = lambda e: F.concat(F.when(F.size(e["path"]) > 0, F.array_join(e["path"], ".")).otherwise("$"), F.lit(": "), e["rule"])
    return F.transform(F.array_sort(F.flatten(chosen)), shown)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_names = itertools.count()


def _bound(value: str, body) -> str:
    """``body(name)``, an array, where ``name`` is ``value`` computed once."""
    name = f"_b{next(_names)}"
    return f"flatten(transform(array({value}), {name} -> {body(name)}))"


def _error(path: list[str] | tuple[str, ...], rule: str, more: str = "") -> str:
    """An array of one error; ``path`` and ``more``, which ends the rule, are SQL."""
    steps = f"array({', '.join(path)})" if path else "CAST(array() AS array<string>)"
    said = f"concat({_quoted(rule)}, {more})" if more else _quoted(rule)
    return f"CAST(array(struct({steps} AS path, {said} AS rule)) AS {ERRORS})"


def _joined(parts: list[str]) -> str:
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0] if parts else _NONE


class _Compiler:
    """SQL of the errors of VARIANT values under the parts of one schema."""

    def __init__(self, root: dict) -> None:
        self.root = root

    def check(self, v: str, schema: dict, path: tuple[str, ...], within: tuple[str, ...] = ()) -> str:
        """Errors of ``v``, not sorted; a null is an absent value and has none."""
        unknown = set(schema) - _SILENT - _SCALAR - _OBJECT - _ARRAY - _LOGIC
        if unknown:
            raise ValueError(f"unsupported keywords: {sorted(unknown)}")
        if "$ref" in schema:
            name = schema["$ref"]
            if not name.startswith("#/$defs/") or set(schema) - {"$ref"} - _SILENT or name in within:
                raise ValueError(f"unsupported reference: {schema}")
            return self.check(v, self.root["$defs"][name.removeprefix("#/$defs/")], path, (*within, name))
        parts = [*self._scalar(v, schema, path), *self._logic(v, schema, path, within), *self._object(v, schema, path, within), *self._array(v, schema, path, within)]
        return f"IF({v} IS NULL, {_NONE}, {_joined(parts)})" if parts else _NONE

    def _scalar(self, v: str, schema: dict, path: tuple[str, ...]) -> list[str]:
        text, number = f"try_variant_get({v}, '$', 'string')", f"try_variant_get({v}, '$', 'double')"

        def rules(kind: str) -> str:
            numeric, string = f"({kind} IN ({_NUMBERS}) OR startswith({kind}, 'DECIMAL'))", f"{kind} = 'STRING'"
            fits = {
                "string": string, "boolean": f"{kind} = 'BOOLEAN'", "null": f"{kind} = 'VOID'", "object": f"startswith({kind}, 'OBJECT')", "array": f"startswith({kind}, 'ARRAY')",
                "number": numeric, "integer": f"({kind} = 'BIGINT' OR {numeric} AND {number} % 1 = 0)",
            }
            types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])
            found = [(f"NOT ({' OR '.join(fits[t] for t in types)})", f"type {' or '.join(types)}")] if types else []
            for keyword, broken in (("minLength", f"length({text}) < %s"), ("maxLength", f"length({text}) > %s")):
                if keyword in schema:
                    found.append((f"{string} AND {broken % schema[keyword]}", f"{keyword} {schema[keyword]}"))
            if "pattern" in schema:
                found.append((f"{string} AND NOT {text} RLIKE {_quoted(schema['pattern'])}", "pattern"))
            if "format" in schema:
                well = {
                    "uri": f"{text} RLIKE {_quoted(_URI)} AND coalesce(try_cast(regexp_extract({text}, {_quoted(_PORT)}, 1) AS int), 0) <= 65535",
                    "date-time": f"{text} RLIKE {_quoted(_TIME)} AND try_to_timestamp({text}) IS NOT NULL",
                }[schema["format"]]
                found.append((f"{string} AND NOT ({well})", f"format {schema['format']}"))
            for keyword, sign in (("minimum", "<"), ("maximum", ">")):
                if keyword in schema:
                    found.append((f"{numeric} AND {number} {sign} {float(schema[keyword])!r}D", f"{keyword} {schema[keyword]}"))
            return _joined([f"IF({broken}, {_error(path, rule)}, {_NONE})" for broken, rule in found])

        if not _SCALAR & set(schema):
            return []
        if schema.get("type") == "object" and not (_SCALAR - {"type"}) & set(schema):  # cheaper than the schema of all it holds
            return [f"IF(try_variant_get({v}, '$', 'map<string,variant>') IS NULL, {_error(path, 'type object')}, {_NONE})"]
        if schema.get("type") == "array" and not (_SCALAR - {"type"}) & set(schema):
            return [f"IF(try_variant_get({v}, '$', 'array<variant>') IS NULL, {_error(path, 'type array')}, {_NONE})"]
        return [_bound(f"schema_of_variant({v})", rules)]

    def _logic(self, v: str, schema: dict, path: tuple[str, ...], within: tuple[str, ...]) -> list[str]:
        holds = lambda part: f"size({self.check(v, part, (), within)}) = 0"
        broken = lambda condition, rule: f"IF({condition}, {_error(path, rule)}, {_NONE})"
        parts = []
        if "const" in schema:
            parts.append(broken(f"to_json({v}) <> {_quoted(_json(schema['const']))}", "const"))
        if "enum" in schema:
            parts.append(broken(f"to_json({v}) NOT IN ({', '.join(_quoted(_json(x)) for x in schema['enum'])})", "enum"))
        parts += [self.check(v, part, path, within) for part in schema.get("allOf", ())]
        for name, least in (("anyOf", ">= 1"), ("oneOf", "= 1")):
            if name in schema:
                parts.append(broken(f"NOT ({' + '.join(f'CAST({holds(part)} AS int)' for part in schema[name])} {least})", name))
        if "not" in schema:
            parts.append(broken(holds(schema["not"]), "not"))
        if "if" in schema:
            then, other = (self.check(v, schema.get(name, {}), path, within) for name in ("then", "else"))
            parts.append(f"IF({holds(schema['if'])}, {then}, {other})")
        return parts

    def _object(self, v: str, schema: dict, path: tuple[str, ...], within: tuple[str, ...]) -> list[str]:
        own, rest, parts = {k: p for k, p in schema.get("properties", {}).items() if p}, schema.get("additionalProperties", True), []
        if own:
            members = lambda s: _joined([self.check(f"{s}.`{k}`", p, (*path, _quoted(k)), within) for k, p in own.items()])
            parts.append(_bound(f"try_variant_get({v}, '$', 'struct<{','.join(f'`{k}`:variant' for k in own)}>')", members))
        if not {"required", "additionalProperties", "minProperties"} & set(schema):
            return parts
        names = ", ".join(map(_quoted, schema.get("properties", {}))) or "''"

        def keyed(held: str) -> str:
            found = [f"transform(array_except(array({', '.join(map(_quoted, schema['required']))}), map_keys({held})), k -> {_error(path, 'required: ', 'k')}[0])"] if schema.get("required") else []
            if "minProperties" in schema:
                found.append(f"IF(size({held}) < {schema['minProperties']}, {_error(path, 'minProperties ' + str(schema['minProperties']))}, {_NONE})")
            strange = f"filter(map_keys({held}), k -> k NOT IN ({names}))" if schema.get("properties") else f"map_keys({held})"
            if rest is False:
                found.append(f"transform({strange}, k -> {_error(path, 'unknown key: ', 'k')}[0])")
            elif isinstance(rest, dict):
                key = f"_k{next(_names)}"
                found.append(f"flatten(transform({strange}, {key} -> {_bound(f'element_at({held}, {key})', lambda x: self.check(x, rest, (*path, key), within))}))")
            return f"IF({held} IS NULL, {_NONE}, {_joined(found)})"

        return [*parts, _bound(f"try_variant_get({v}, '$', 'map<string,variant>')", keyed)]

    def _array(self, v: str, schema: dict, path: tuple[str, ...], within: tuple[str, ...]) -> list[str]:
        def listed(values: str) -> str:
            found = [f"IF(size({values}) {sign} {schema[k]}, {_error(path, f'{k} {schema[k]}')}, {_NONE})" for k, sign in (("minItems", "<"), ("maxItems", ">")) if k in schema]
            if schema.get("uniqueItems"):
                found.append(f"IF(size(array_distinct(transform({values}, x -> to_json(x)))) < size({values}), {_error(path, 'uniqueItems')}, {_NONE})")
            if schema.get("items"):
                x, i = f"_x{next(_names)}", f"_i{next(_names)}"
                found.append(f"flatten(transform({values}, ({x}, {i}) -> {self.check(x, schema['items'], (*path, f'CAST({i} AS string)'), within)}))")
            return f"IF({values} IS NULL, {_NONE}, {_joined(found)})"

        return [_bound(f"try_variant_get({v}, '$', 'array<variant>')", listed)] if _ARRAY & set(schema) else []


def _json(value: object) -> str:
    return plain.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


_FRAME = "array<struct<object:boolean,key:string,keys:array<string>,at:int>>"
_STATE = f"struct<stack:{_FRAME},last:string,found:{ERRORS}>"
_TOP = "get(s.stack, size(s.stack) - 1)"
_FRAMES = f"CAST(array(named_struct('object', t = '{{{{', 'key', '', 'keys', array(), 'at', 0)) AS {_FRAME})"
_NAMED = f"CAST(array(named_struct('object', true, 'key', s.last, 'keys', concat({_TOP}.keys, array(s.last)), 'at', 0)) AS {_FRAME})"
_MOVED = f"CAST(array(named_struct('object', false, 'key', '', 'keys', array(), 'at', {_TOP}.at + 1)) AS {_FRAME})"


def _way(stack: str) -> str:
    return f"transform({stack}, f -> IF(f.object, f.key, CAST(f.at AS string)))"


#: Stand-ins for an escape and an escaped quote, so that a string ends at its next quote.
_ESCAPE, _QUOTE = "\ue000", "\ue001"


#: One step of the fold: what a token opens, closes or names, and what it repeats or can't count.
_STEP = f"""
  CAST(named_struct(
    'stack', CASE
      WHEN t IN ('{{{{', '[') THEN concat(s.stack, {_FRAMES})
      WHEN t IN ('}}}}', ']') THEN slice(s.stack, 1, greatest(size(s.stack) - 1, 0))
      WHEN t = ':' AND coalesce(get(s.stack, size(s.stack) - 1).object, false) THEN concat(slice(s.stack, 1, size(s.stack) - 1), {_NAMED})
      WHEN t = ',' AND NOT coalesce(get(s.stack, size(s.stack) - 1).object, true) THEN concat(slice(s.stack, 1, size(s.stack) - 1), {_MOVED})
      ELSE s.stack END,
    'last', t,
    'found', CASE
      WHEN t = ':' AND coalesce(get(s.stack, size(s.stack) - 1).object, false) AND array_contains(get(s.stack, size(s.stack) - 1).keys, s.last)
        THEN concat(s.found, array(named_struct('path', concat({_way("slice(s.stack, 1, size(s.stack) - 1)")}, array(s.last)), 'rule', 'repeated key')))
      WHEN t IN ('NaN', 'Infinity', '-Infinity', '+Infinity') OR t RLIKE '^-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$' AND coalesce(abs(try_cast(t AS double)) = double('Infinity'), false)
        THEN concat(s.found, array(named_struct('path', {_way("s.stack")}, 'rule', 'non-finite number')))
      ELSE s.found END) AS {_STATE})"""


def malformed(json: str) -> Column:
    """Repeated keys and non-finite numbers of a JSON column with their paths, by a fold over its tokens."""
    marked = rf"replace(regexp_replace(`{json}`, '(?s)\\\\(.)', '{_ESCAPE}$1'), '{_ESCAPE}\"', '{_QUOTE}')"
    tokens = rf"regexp_extract_all({marked}, '\"[^\"]*\"|[{{}}\\[\\],:]|[^\\s{{}}\\[\\],:\"]+', 0)"
    start = f"CAST(named_struct('stack', array(), 'last', '', 'found', array()) AS {_STATE})"
    key = rf"replace(replace(IF(startswith(p, '\"'), substring(p, 2, length(p) - 2), p), '{_QUOTE}', '\\\"'), '{_ESCAPE}', '\\')"
    return F.expr(f"CAST(transform(aggregate({tokens}, {start}, (s, t) -> {_STEP.format()}, s -> s.found), e -> struct(transform(e.path, p -> {key}) AS path, e.rule AS rule)) AS {ERRORS})")
