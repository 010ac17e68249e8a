"""Contracts as columns, against a plain recursive check in Python."""

import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quernstone import documents
from quernstone.functions import rules

HEX = "a" * 64
PROOF = {"evidence_id": "e1", "document_id": "d1", "source_url": "https://example.org/x", "published_at": "2024-01-02T03:04:05Z", "author_hash": "h", "community": "c", "evidence_group_id": "g", "kind": "loss", "quote": "q", "interpretation": "i", "confidence": 0.5}
CARD = {
    **{name: "x" for name in ("card_id", "cluster_id", "observed_actor", "problem_statement", "model_version", "prompt_version", "policy_version")}, **{name: 20 for name in ("independent_author_count", "independent_evidence_group_count", "recent_case_count")},
    **{name: [PROOF | {"kind": kind, "evidence_id": f"{name}{i}"} for i in range(3)] for name, kind in (("loss_evidence", "loss"), ("money_evidence", "money"), ("current_solution_evidence", "alternative"), ("customer_channel_evidence", "customer_channel"), ("solution_gap_evidence", "solution_gap"), ("supporting_evidence", "problem"), ("counter_evidence", "counter"))},
    "known_blockers": [], "inferred_customer_segment": None, "evidence_status": "EVIDENCE_BACKED", "actionability_status": "ACTIONABLE", "review_value_score": 70.5, "growth_status": "KNOWN", "current_alternatives": ["a"], "uncertainties": [], "automatic_decision": "REVIEW",
    "decision_reasons": ["r", "r"], "generated_at": "2024-01-02T03:04:05.25+01:00", "productizable_scope": {"status": "PRODUCTIZABLE", "delivery_mode": "SOFTWARE", "summary": "s"}, "blocker_assessment": {"status": "NONE_FOUND", "reasons": ["r"]},
    "counter_assessment": {"status": "NONE_CRITICAL", "reasons": ["r"]}, "source_versions": {"a": "1"}, "human_audit": None,
}
LABEL = {"label_id": "abc", "document_id": "s:1", "source": "s", "reviewer_id": "r", "assignment_split": "holdout", "review_round": "primary", "problem_signal": True, "money_signal": True, "money_signal_type": "loss", "structural_money_signal": False, "usable_evidence": True, "noise": False, "label_reason": "r" * 20, "labeled_at": "2024-01-02T03:04:05Z", "guide_version": "1.0.2"}
ITEM = {
    "document_id": "s:1", "source": "s", "source_item_id": "1", "source_url": "http://example.org", "item_type": "issue", "author_hash": HEX, "community": "c", "thread_id": "t", "parent_id": None, "title": None, "text": "é" * 40, "text_fingerprint": HEX, "text_length": 40, "original_text_length": 40.0,
    "text_truncated": False, "published_at": "2024-01-02T03:04:05Z", "updated_at": None, "language": "en-GB", "engagement": {"score": -3, "votes": 0}, "source_metadata": {"a": {"b": [1]}}, "collected_at": "2024-01-02T03:04:05Z", "collector_version": "1", "fetch_run_id": "f",
}


def run(spark, texts, schema):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    return [r.e for r in rows.select("i", rules.errors("j", schema).alias("e")).orderBy("i").collect()]


def kind(v):
    return "null" if v is None else {bool: "boolean", str: "string", dict: "object", list: "array"}.get(type(v), "number")


def plain(v, schema, root, path=()):
    """Errors as (path, rule) of a value."""
    if "$ref" in schema:
        return plain(v, root["$defs"][schema["$ref"].split("/")[-1]], root, path)
    out, k, text = [], kind(v), lambda x: json.dumps(x, sort_keys=True)
    types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type")
    if types and not (k in types or k == "number" and "integer" in types and v == int(v)):
        out.append((path, "type " + " or ".join(types)))
    out += [(path, "const")] * ("const" in schema and text(v) != text(schema.get("const"))) + [(path, "enum")] * ("enum" in schema and text(v) not in [text(x) for x in schema.get("enum", [])])
    if k == "string":
        out += [(path, f"minLength {schema.get('minLength')}")] * (len(v) < schema.get("minLength", 0)) + [(path, f"maxLength {schema.get('maxLength')}")] * (len(v) > schema.get("maxLength", 1e9))
        out += [(path, "pattern")] * ("pattern" in schema and not re.search(schema["pattern"], v))
        if "format" in schema and not re.match(r"https?://[^\s/]+" if schema["format"] == "uri" else r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\S*(Z|[+-]\d\d:\d\d)$", v):
            out.append((path, f"format {schema['format']}"))
    if k == "number":
        out += [(path, f"minimum {schema.get('minimum')}")] * (v < schema.get("minimum", v)) + [(path, f"maximum {schema.get('maximum')}")] * (v > schema.get("maximum", v))
    if k == "object":
        own = schema.get("properties", {})
        for name, part in own.items():
            if name in v:
                out += plain(v[name], part, root, (*path, name))
        out += [(path, f"required: {x}") for x in schema.get("required", ()) if x not in v] + [(path, f"minProperties {schema.get('minProperties')}")] * (len(v) < schema.get("minProperties", 0))
        rest = schema.get("additionalProperties", True)
        for name in v.keys() - own.keys():
            out += [(path, f"unknown key: {name}")] if rest is False else plain(v[name], rest, root, (*path, name)) if rest is not True else []
    if k == "array":
        out += [(path, f"minItems {schema.get('minItems')}")] * (len(v) < schema.get("minItems", 0)) + [(path, f"maxItems {schema.get('maxItems')}")] * (len(v) > schema.get("maxItems", 1e9))
        out += [(path, "uniqueItems")] * (schema.get("uniqueItems", False) and len({text(x) for x in v}) < len(v))
        for i, x in enumerate(v):
            out += plain(x, schema.get("items", {}), root, (*path, str(i)))
    for part in schema.get("allOf", ()):
        out += plain(v, part, root, path)
    good = lambda part: not plain(v, part, root)
    out += [(path, "oneOf")] * ("oneOf" in schema and sum(map(good, schema["oneOf"])) != 1) + [(path, "anyOf")] * ("anyOf" in schema and not any(map(good, schema["anyOf"]))) + [(path, "not")] * ("not" in schema and good(schema.get("not")))
    if "if" in schema:
        out += plain(v, schema.get("then" if good(schema["if"]) else "else", {}), root, path)
    return out


def expected(v, schema):
    return [f"{'.'.join(p) or '$'}: {r}" for p, r in sorted(plain(v, schema, schema))]


def changed(rng, v):
    """A copy with a value, a key or an item somewhere replaced, dropped or added."""
    v = copy.deepcopy(v)
    for _ in range(rng.randint(1, 3)):
        at, spots = v, []
        while isinstance(at, (dict, list)) and at:
            key = rng.choice(list(at)) if isinstance(at, dict) else rng.randrange(len(at))
            spots.append((at, key))
            at = at[key]
        place, key = rng.choice(spots)
        what = rng.random()
        if what < 0.2:
            del place[key]
        elif what < 0.3 and isinstance(place, dict):
            place[rng.choice(["extra", "kind", "é key"])] = 1
        elif what < 0.45 and isinstance(place, list):
            place.append(copy.deepcopy(place[0]))
        else:
            place[key] = rng.choice([None, True, False, 0, -1, 3, 2.5, 7.0, 10**25, "", "x", "loss", "counter", HEX, "é" * 39, "y" * 20_001, [], ["a", "a"], {}, {"status": "UNKNOWN"}, "2024-01-02T03:04:05", "ACTIONABLE", "EVIDENCE_BACKED", "ftp://x"])
        if not isinstance(v, dict) or not v:
            break
    return v


@pytest.mark.parametrize("good, schema", [(CARD, documents.CARD), (LABEL, documents.LABEL), (ITEM, documents.ITEM)])
def test_contracts_equal_a_plain_check(spark, good, schema):
    rng = random.Random(len(good))
    values = [good, {}, [], None, 3, "x"] + [changed(rng, good) for _ in range(250)]
    assert expected(good, schema) == [] and len({str(expected(v, schema)) for v in values}) > 40
    assert run(spark, [json.dumps(v, ensure_ascii=rng.random() < 0.5) for v in values], schema) == [expected(v, schema) for v in values]


def test_conditional_minimums(spark):
    few = CARD | {"independent_author_count": 4, "independent_evidence_group_count": 2, "recent_case_count": 9, "loss_evidence": CARD["loss_evidence"][:1], "money_evidence": [], "supporting_evidence": CARD["supporting_evidence"][:2], "counter_assessment": {"status": "CRITICAL", "reasons": ["r"]}}
    idle = CARD | {"current_alternatives": [], "current_solution_evidence": [], "customer_channel_evidence": [], "known_blockers": [PROOF | {"kind": "blocker"}], "solution_gap_evidence": [], "productizable_scope": CARD["productizable_scope"] | {"status": "UNKNOWN"}, "blocker_assessment": {"status": "BLOCKED", "reasons": ["r"]}}
    got = run(spark, [json.dumps(x) for x in (few, few | {"evidence_status": "NEEDS_REVIEW"}, idle, idle | {"actionability_status": "UNKNOWN"})], documents.CARD)
    assert len(got[0]) == 7 and got[1] == [] and len(got[2]) == 7 and got[3] == []
    assert got[0][0] == "counter_assessment.status: const" and "known_blockers: maxItems 0" in got[2]


def test_malformed_texts(spark):
    texts = [
        None, "", "  ", "{", '{"a":1} x', '{"a":1} {"b":2}', '{"a":1,"a":2}', '{"x":[{"b":{}},{"b":1,"c":"\\"","b":{"d":NaN}}]}', "[1,Infinity,-Infinity]", '{"t":"NaN \\" {\\\\","n":1e999}', '{"t":"1e999"}', '{"a\\n":1,"a\\t":2,"a\\n":3}', '{"a":01}', '{"a":{"a":{"a":1}},"b":[{"a":1},{"a":1}]}',
        '{"a":"' + "x\\\\\\\"" * 50_000 + '","a":0}',
    ]
    got = run(spark, texts, {"type": "object"})
    bad = ["$: invalid JSON"]
    assert got[:6] == [bad] * 6 and got[6] == ["a: repeated key"] and got[7] == ["x.1.b: repeated key", "x.1.b.d: non-finite number"] and got[8] == ["1: non-finite number", "2: non-finite number"]
    assert got[9] == ["n: non-finite number"] and got[10] == [] and got[11] == ["a\\n: repeated key"] and got[12] == bad and got[13] == [] and got[14] == ["a: repeated key"]


def test_meaning_is_asked_where_the_schema_holds(spark):
    rows = spark.createDataFrame([('{"a":1}', 1), ('{"a":1}', 2), ('{"a":"x"}', 2), ('{"a":1}', None)], "j string, path int")
    got = rows.select(rules.errors("j", {"properties": {"a": {"type": "integer"}}}, ("a", F.col("path") > 1, "a differs")).alias("e")).collect()
    assert [r.e for r in got] == [[], ["a: a differs"], ["a: type integer"], ["a: a differs"]]


def test_what_is_not_supported_is_refused(spark):
    for schema in ({"dependentRequired": {}}, {"properties": {"a": {"multipleOf": 2}}}, {"$ref": "other.json"}, {"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"b": {"$ref": "#/$defs/a"}}}}}, {"type": "string", "format": "email"}):
        with pytest.raises((ValueError, KeyError)):
            rules.errors("j", schema)


def test_no_python_worker(spark):
    plan = spark.createDataFrame([("{}",)], "j string").select(rules.errors("j", documents.CARD))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
