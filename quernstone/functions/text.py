"""Text functions.  Only NFKC, case folding, HTML and canonical JSON run in Python, on Arrow arrays."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..schemas import IDENTITY_KEYS

#: White space as Python's ``re`` and ``str.strip`` see it: Java's Unicode class lacks the separators.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


#: Texts that are Python objects at once: Spark's batches hold thousands.
PIECE = 128


def _each(x: pa.Array, function: Callable[[str], str]) -> pa.Array:
    """``function`` of every value, a piece of the batch at a time; nulls stay."""
    pieces = [pa.array([None if v is None else function(v) for v in x.slice(at, PIECE).to_pylist()], pa.string()) for at in range(0, len(x), PIECE)]
    return pa.concat_arrays(pieces) if pieces else pa.array([], pa.string())


def _nfkc(v: str) -> str:
    return v if v.isascii() else unicodedata.normalize("NFKC", v)


def _folded(v: str) -> str:
    return " ".join(_nfkc(v).split()).casefold()


@F.arrow_udf(StringType())
def nfkc(x: pa.Array) -> pa.Array:
    return _each(x, _nfkc)


@F.arrow_udf(StringType())
def casefold(x: pa.Array) -> pa.Array:
    return _each(x, str.casefold)


def collapse(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, BLANKS, " "))


@F.arrow_udf(StringType())
def folded_nfkc(x: pa.Array) -> pa.Array:
    """Case-folded, collapsed NFKC: what a fingerprint is taken of, in one pass over the text."""
    return _each(x, _folded)


@F.arrow_udf(StringType())
def text_fingerprint(x: pa.Array) -> pa.Array:
    """``fingerprint`` of a text that is not normalised yet; only digests leave the worker."""
    return _each(x, lambda v: hashlib.sha256(_folded(v).encode()).hexdigest())


def normalize_text(x: Column) -> Column:
    return collapse(nfkc(x))


def fingerprint(normalized: Column) -> Column:
    """SHA-256 of the case-folded text, which must be normalised already."""
    return F.sha2(casefold(normalized), 256)


def canonical_key(key: Column) -> Column:
    """camelCase and punctuation to snake_case."""
    words = F.regexp_replace(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.array_join(F.regexp_extract_all(F.lower(words), F.lit("[a-z0-9]+"), F.lit(0)), "_")


#: Elements that stand on lines of their own, and those whose text is no text.
LINE_TAGS = {"p", "div", "br", "li", "pre", "blockquote", *(f"h{n}" for n in range(1, 7))}
HIDDEN_TAGS = {"script", "style"}


class _Events(HTMLParser):
    """What a fragment consists of, in order: (nesting change, tag), or (None, text)."""

    def reset(self) -> None:
        super().reset()
        self.events: list[tuple[int | None, str]] = []

    def handle_data(self, data: str) -> None:
        self.events.append((None, data))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.events.append((1, tag))

    def handle_endtag(self, tag: str) -> None:
        self.events.append((-1, tag))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.events.append((0, tag))


def _html_lines(html: str) -> str:
    parser = _Events()
    parser.feed(html)
    parser.close()
    lines, depth = [""], 0
    for change, value in parser.events:
        if change is None:
            lines[-1] += "" if depth else value
        elif value in HIDDEN_TAGS:
            depth = max(0, depth + change)
        elif value in LINE_TAGS and not depth:
            lines.append("")
    flat = (" ".join(unicodedata.normalize("NFKC", x).split()) for line in lines for x in line.splitlines())
    return "\n".join(filter(None, flat))


@F.arrow_udf(StringType())
def html_body_to_text(x: pa.Array) -> pa.Array:
    """Lines of a page's text: block elements end a line, scripts and styles go, references are decoded."""
    return pa.array([None if v is None else _html_lines(v) for v in x.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def html_title_to_text(x: pa.Array) -> pa.Array:
    """A title on one line, decoded twice as titles are escaped twice."""
    return pa.array([None if v is None else " ".join(unicodedata.normalize("NFKC", unescape(_html_lines(v))).split()) for v in x.to_pylist()], pa.string())


#: What an e-mail address and a phone number look like, and what replaces them.
EMAIL = r"(?iU)(?<![\w.+-])[\w.!#$%&'*+/=?^`{|}~-]+@[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?\.[a-z]{2,}(?![\w.-])"
PHONE = (
    r"(?U)(?<!\w)(?:\+\d(?:[\d ()-]{5,}\d)|\(0\d{1,2}\)[ -]?\d{3,4}[ -]?\d{4}|0\d{1,2}[ -]\d{3,4}[ -]\d{4}|"
    r"(?:0(?:10|11|16|17|18|19)\d{7,8}|02\d{7,8}|0[3-6]\d\d{7,8}|1[568]\d{6,7}|\d{10,15}))(?!\w)"
)
PLACEHOLDER = "[REDACTED_CONTACT]"


def redact_contacts(x: Column) -> Column:
    """Struct of the text without contacts and how many were replaced."""
    no_mail = F.regexp_replace(x, EMAIL, r"\[REDACTED_CONTACT\]")
    return F.struct(
        F.regexp_replace(no_mail, PHONE, r"\[REDACTED_CONTACT\]").alias("text"),
        (F.regexp_count(x, F.lit(EMAIL)) + F.regexp_count(no_mail, F.lit(PHONE))).cast("bigint").alias("count"),
    )


def residual_contacts(x: Column) -> Column:
    rest = F.replace(x, F.lit(PLACEHOLDER), F.lit(""))
    return (F.regexp_count(rest, F.lit(EMAIL)) + F.regexp_count(rest, F.lit(PHONE))).cast("bigint")


def first_text(json_text: Column) -> Column:
    """First non-blank string of a JSON string or array; null for any other shape."""
    several = F.from_json(json_text, "array<string>")
    one = F.when(F.startswith(json_text, F.lit('"')), F.from_json(F.concat(F.lit("["), json_text, F.lit("]")), "array<string>"))
    clean = F.filter(F.transform(F.coalesce(one, several), collapse_ends), lambda v: v != "")
    return F.get(clean, F.lit(0))


def collapse_ends(x: Column) -> Column:
    """``strip()``."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def select_language(json_text: Column) -> Column:
    """Direct text, else English, else that of the first language in byte order that has one; '' if none."""
    json_text = collapse_ends(json_text)
    by_language = F.from_json(F.when(F.startswith(json_text, F.lit("{")), json_text), "map<string,string>")
    entries = F.transform(
        F.map_entries(by_language),
        lambda e: F.struct(
            F.when(F.lower(e["key"]) == "eng", 0).when(F.lower(e["key"]) == "en", 1).otherwise(2).alias("place"),
            e["key"].alias("key"),
            first_text(F.when(e["value"].rlike(r"^\s*\["), e["value"]).otherwise(F.to_json(F.array(e["value"])))).alias("text"),
        ),
    )
    best = F.get(F.array_sort(F.filter(entries, lambda e: e["text"].isNotNull())), F.lit(0))["text"]
    return F.coalesce(first_text(json_text), best, F.lit(""))


def key_paths(json_text: Column) -> Column:
    """Every key path of a JSON document, as array of strings."""
    return _paths(json_text)


@F.arrow_udf(ArrayType(StringType()))
def _paths(x: pa.Array) -> pa.Array:
    import json

    def walk(value: object, at: str) -> list[str]:
        if isinstance(value, dict):
            return [p for k, v in value.items() for name in [f"{at}.{k}" if at else str(k)] for p in (name, *walk(v, name))]
        if isinstance(value, list):
            return [p for i, v in enumerate(value) for p in walk(v, f"{at}[{i}]")]
        return []

    return pa.array([[] if v is None else walk(json.loads(v), "") for v in x.to_pylist()], pa.list_(pa.string()))


def identity_paths(paths: Column) -> Column:
    """The paths whose last key names a person."""
    return F.filter(paths, lambda p: canonical_key(F.regexp_replace(F.element_at(F.split(p, r"\."), -1), r"(\[\d+\])+$", "")).isin(*IDENTITY_KEYS))
