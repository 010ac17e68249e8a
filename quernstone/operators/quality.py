"""Record checks: every violated rule as an array of messages, and predicates over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import documents
from ..functions import rules, text
from ..schemas import ALLOWED_METADATA, MAX_TEXT, MIN_TEXT, MONEY_SIGNALS


def violations(*rules: tuple[Column, str | Column]) -> Column:
    """Messages of the rules that hold, in order; a rule that is null counts as broken."""
    each = [F.when(F.coalesce(c, F.lit(True)), m if isinstance(m, Column) else F.lit(m)) for c, m in rules]
    return F.filter(F.array(*each), lambda m: m.isNotNull())


def item_json() -> Column:
    """A record's columns as the JSON document they stand for; metadata that can't be read is null."""
    open_parts = {"engagement": F.parse_json(F.to_json("engagement")), "source_metadata": F.try_parse_json("source_metadata")}  # absent counters stay absent
    return F.to_json(F.struct(*[open_parts.get(c, F.col(c)).alias(c) for c in documents.ITEM["properties"]]), {"ignoreNullFields": "false"})


def with_errors(items: DataFrame) -> DataFrame:
    """``items`` with ``errors``: the contract's, by path, and the rules of meaning only where it holds.

    Metadata whose text is no JSON is named for what it repeats or can't count.
    """
    items = items.withColumn("_normal", text.normalize_text(F.col("text"))).withColumn("_print", text.fingerprint(F.col("_normal"))).withColumn("_paths", text.key_paths(F.col("source_metadata"))).withColumn("_json", item_json())
    unread = F.transform(F.when(F.try_parse_json("source_metadata").isNull(), rules.malformed("source_metadata")), lambda e: F.concat(F.lit("source_metadata."), F.array_join(e["path"], "."), F.lit(": "), e["rule"]))
    shape = F.sort_array(F.concat(rules.errors("_json", documents.ITEM), F.coalesce(unread, F.array().cast("array<string>"))))
    named = text.identity_paths(F.col("_paths"))
    keys = F.transform("_paths", lambda p: text.canonical_key(F.regexp_replace(p, r"\[\d+\]", "")))
    allowed = F.lit(None).cast("array<string>")
    for source, names in ALLOWED_METADATA.items():
        allowed = F.when(F.col("source") == source, F.array(*map(F.lit, names))).otherwise(allowed)
    strange = F.array_distinct(F.filter(keys, lambda k: ~F.coalesce(F.array_contains(allowed, k), F.lit(False))))
    meaning = violations(
        (F.col("document_id") != F.concat_ws(":", "source", "source_item_id"), "document_id must be source:source_item_id"), (F.length("_normal") < MIN_TEXT, "text is too short once normalised"),
        (F.col("text") != F.col("_normal"), "text is not normalised"), (F.col("text_length") != F.length("text"), "text_length differs from the text"), (F.col("text_fingerprint") != F.col("_print"), "text_fingerprint differs from the text"),
        (F.when(F.col("text_truncated"), (F.length("text") != MAX_TEXT) | (F.col("original_text_length") <= F.length("text"))).otherwise(F.col("original_text_length") != F.length("text")), "original_text_length contradicts text_truncated"),
    )
    meaning = F.concat(meaning, F.transform(named, lambda p: F.concat(F.lit("identity key: "), p)), F.when(F.size(named) == 0, F.transform(strange, lambda k: F.concat(F.lit("key not allowed: "), k))).otherwise(F.array().cast("array<string>")))
    items = items.withColumn("_shape", shape)
    return items.withColumn("errors", F.when(F.size("_shape") > 0, F.col("_shape")).otherwise(meaning)).drop("_normal", "_print", "_paths", "_json", "_shape")


def in_window(ts: Column, after: Column | str, before: Column | str) -> Column:
    """``after <= ts < before``."""
    return (ts >= after) & (ts < before)


def privacy_violations(rows: DataFrame, secrets: tuple[str, ...] = ()) -> DataFrame:
    """Rows in whose serialised form an identity key or a secret stands, with what was found."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    rows = rows.withColumn("_json", whole).withColumn("_paths", text.identity_paths(text.key_paths(F.col("source_metadata"))))
    found = F.concat(F.transform("_paths", lambda p: F.concat(F.lit("identity key: "), p)), violations(*[(F.contains(F.col("_json"), F.lit(s)), "secret in data") for s in secrets]) if secrets else F.array().cast("array<string>"))
    return rows.withColumn("found", found).where(F.size("found") > 0).drop("_json", "_paths")


#: What a reviewer's free text must not hold: addresses, handles, profile pages.
HANDLES = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|(?<!\w)@[a-z0-9_-]+|https?://github\.com/[a-z0-9_.-]+(?=/|\s|$)"


def submission_errors() -> Column:
    """Broken rules of a blind submission."""
    return violations(
        (F.coalesce("assignment_id", F.lit("")) == "", "assignment_id: required"), (F.coalesce("reviewer_id", F.lit("")) == "", "reviewer_id: required"), (~F.coalesce("reviewer_independence_asserted", F.lit(False)), "independence not asserted"),
        (F.col("money_signal") != F.col("money_signal_type").isNotNull(), "money_signal_type must stand with money_signal"), (F.coalesce(~F.col("money_signal_type").isin(*MONEY_SIGNALS), F.lit(False)), "money_signal_type: unknown"), (F.length(F.coalesce("label_reason", F.lit(""))) < 20, "label_reason: too short"),
        (F.coalesce(F.col("label_reason").rlike(HANDLES), F.lit(False)), "label_reason: names a person"), (F.col("labeled_at").isNull(), "labeled_at: required"),
    )


def segment_errors(json: str) -> Column:
    """What is wrong with the counters of a segment, a JSON column by name: the contract, then their arithmetic."""
    n = lambda name: F.try_variant_get(F.try_parse_json(json), f"$.{name}_item_count", "bigint")
    quota = F.try_variant_get(F.try_parse_json(json), "$.quota", "bigint")
    return rules.errors(
        json, documents.SEGMENT, ("accepted_item_count", n("accepted") > quota, "exceeds the quota"), ("processed_item_count", n("processed") != n("accepted") + n("rejected"), "must be accepted plus rejected"),
        ("processed_item_count", n("processed") > n("fetched"), "exceeds fetched"),
    )


def label_errors(json: str) -> Column:
    """What is wrong with a label, a JSON column by name."""
    return rules.errors(json, documents.LABEL)


def invalid_item_errors(json: str) -> Column:
    """What is wrong with the note of a rejected record, a JSON column by name."""
    return rules.errors(json, documents.INVALID_ITEM)


def wrapper_errors(json: str) -> Column:
    """What is wrong with a page of notices as it was received, a JSON column by name."""
    return rules.errors(json, documents.WRAPPER)
