"""Scans of recorded payloads: JSON lines and page envelopes, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ISSUE, NOTICE, NOTICE_FIELDS, QUESTION, REVIEW


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line (``.gz`` too); a malformed line fails the scan."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def text_records(spark: SparkSession, path: str, schema: str, lenient: bool = True) -> DataFrame:
    """Lines as ``record`` with ``raw``; with ``lenient`` a malformed line is a null record instead of a failure."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE" if lenient else "FAILFAST"}).alias("record"), F.col("value").alias("raw"))


#: Page envelopes of each source: where the payloads are, and what tells that more pages follow.
ENVELOPES = {
    "github": ("items", ISSUE, "page int, items array<struct<{}>>, has_next boolean"),
    "stackexchange": ("items", QUESTION, "page int, items array<struct<{}>>, has_more boolean, quota_remaining bigint, backoff bigint"),
    "steam": ("reviews", REVIEW, "page int, reviews array<struct<{}>>, cursor string"),
}


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}:{t}" for n, t in (x.strip().split(" ", 1) for x in _split(ddl)))


def _split(ddl: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]


def pages(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Recorded pages of a source, one JSON envelope a line, with their signature."""
    items, payload, envelope = ENVELOPES[source]
    rows = json_lines(spark, path, envelope.format(_fields(payload)))
    return rows.withColumn("signature", page_signature(F.col(items)))


def payloads(page_rows: DataFrame, source: str) -> DataFrame:
    """The payloads of pages in order: page and place with the payload's own columns."""
    items = ENVELOPES[source][0]
    return page_rows.select("page", F.posexplode(items).alias("place", "payload")).select("page", "place", "payload.*")


def notice_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of notices, whose fields keep their JSON because their shape varies.

    A page that the service cut short by its time limit fails the read: a run must not take it for
    a whole one.
    """
    wrapper = "notices array<string>, totalNoticeCount bigint, timedOut boolean, iterationNextToken string"
    rows = spark.read.text(path).select(F.from_json("value", wrapper, {"mode": "FAILFAST"}).alias("page"))
    late = F.when(F.coalesce("timedOut", F.lit(False)), F.raise_error(F.lit("a page of notices has timed out")).cast("boolean")).otherwise(F.lit(True))
    return rows.select("page.*").where(late)


def notices(page_rows: DataFrame) -> DataFrame:
    payload = F.explode("notices").alias("notice")
    return page_rows.select(payload).select(F.from_json("notice", NOTICE).alias("n")).select(*[F.col(f"n.`{f}`") for f in NOTICE_FIELDS])


def page_signature(items: Column) -> Column:
    """SHA-256 of a page's payloads."""
    return F.sha2(F.to_json(items), 256)


def more_pages(source: str, page: Column, size: int) -> Column:
    """Whether a page says that another follows."""
    if source == "github":
        return F.coalesce(F.col("has_next"), F.lit(False))
    if source == "stackexchange":
        return F.coalesce(F.col("has_more"), F.lit(False))
    if source == "steam":  # an empty page, or a cursor that stays, ends the iteration
        return (F.size("reviews") > 0) & F.coalesce(F.col("cursor") != F.col("previous_cursor"), F.col("cursor").isNotNull())
    return page * size < F.col("totalNoticeCount")


def notice_query(cpv_prefix: str, from_day: str, before_day: str, form_type: str, notice_types: tuple[str, ...]) -> str:
    """Expert query that pushes the window, form, types and CPV prefix to the service."""
    types = " ".join(notice_types)
    return f"publication-date >= {from_day} AND publication-date < {before_day} AND form-type = {form_type} AND notice-type IN ({types}) AND classification-cpv = {cpv_prefix}* SORT BY publication-date DESC"


def query_set(strata: dict[str, str], from_day: str, before_day: str, form_type: str, notice_types: tuple[str, ...]) -> list[dict[str, str]]:
    """Each stratum's query with its digest, and the digest of the set in ``set_sha256``."""
    import hashlib

    from ..functions.ids import content_sha256

    found = [{"stratum": s, "query": q, "query_sha256": hashlib.sha256(q.encode()).hexdigest()} for s, p in strata.items() for q in [notice_query(p, from_day, before_day, form_type, notice_types)]]
    whole = content_sha256(found)
    return [x | {"set_sha256": whole} for x in found]
