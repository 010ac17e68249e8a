"""Collection results as rows: their broken invariants, their status, and what a report may show of them.

A result row has the columns of ``RESULT``; nothing here collects it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EVENT_CATEGORIES, LIMIT_NUMBERS, LIMIT_RESOURCES, RUNNER_CODES, SAFE_REFERENCE, TERMINATIONS
from .quality import violations

_COUNTS = ("request_count", "response_bytes", "retry_count", "rate_limit_events", "successful_request_count", "http_attempt_count", "fetched_item_count", "processed_item_count", "accepted_item_count", "rejected_item_count")
_SEGMENT_COUNTS = ("accepted", "fetched", "processed", "rejected")
LIMIT = ", ".join(f"{c}: bigint" for c in LIMIT_NUMBERS)
EVENT = f"struct<sequence: bigint, category: string, attempt: bigint, status_code: bigint, retryable: boolean, rate_limit: struct<{LIMIT}, resource: string>>"
SEGMENT = "struct<segment_type: string, segment_id: string, quota: bigint, accepted: bigint, fetched: bigint, processed: bigint, rejected: bigint>"
RESULT = (
    "source string, run_id string, manifest_version string, adapter_version string, started_at timestamp, finished_at timestamp, target_valid_count bigint, "
    + ", ".join(f"{c} bigint" for c in _COUNTS)
    + f", transport_events array<{EVENT}>, n_items bigint, n_invalid_items bigint, segments array<{SEGMENT}>, manifest_hash string, compliance_hash string, termination_reason string, status string, error_code string, error_message string"
)


def expected_status(n_items: Column, target: Column, quotas_met: Column, termination: Column) -> Column:
    """Success only with the target and all quotas reached; partial with some items, unless a prerequisite failed."""
    whole = (n_items == target) & quotas_met & (termination == "target_reached")
    return F.when(whole, "success").when((n_items > 0) & (termination != "prerequisite_failed"), "partial").otherwise("failed")


def error_code(termination: Column, status: Column) -> Column:
    """The termination names the error of a result that is no success."""
    return F.when(status != "success", termination)


def metrics_observed(code: Column) -> Column:
    """Whether a result's metrics were observed: not where the runner had to stand in for an adapter."""
    return ~F.coalesce(code.isin(*RUNNER_CODES), F.lit(False))


def quota_reserve_reached(remaining: Column, reserve: Column, max_requests: Column, requests: Column) -> Column:
    """Whether a source's quota no longer covers the reserve and the requests that may still follow."""
    return remaining < reserve + (max_requests - requests)


def event_errors(event: Column) -> Column:
    """Whether a transport event says anything but what it may."""
    limit = event["rate_limit"]
    code = event["status_code"]
    rules = [
        F.coalesce(event["sequence"] < 1, F.lit(True)), F.coalesce(event["attempt"] < 1, F.lit(True)), code.isNotNull() & ~code.between(100, 599), event["retryable"].isNull(), ~F.coalesce(event["category"].isin(*EVENT_CATEGORIES), F.lit(False)),
        *[F.coalesce(limit[c] < 0, F.lit(False)) for c in LIMIT_NUMBERS], F.coalesce(~limit["resource"].isin(*LIMIT_RESOURCES, "unknown"), F.lit(False)),
    ]
    broken = rules[0]
    for x in rules[1:]:
        broken = broken | x
    return broken


def safe_event(event: Column) -> Column:
    """A transport event's allow-listed part; categories and resources out of the lists become ``unknown``."""
    limit = event["rate_limit"]
    known = lambda x, values: F.when(x.isin(*values), x).otherwise("unknown")
    safe_limit = F.struct(*[limit[c].alias(c) for c in LIMIT_NUMBERS], known(limit["resource"], LIMIT_RESOURCES).alias("resource"))
    return F.struct(
        event["sequence"].alias("sequence"), known(event["category"], EVENT_CATEGORIES).alias("category"), event["attempt"].alias("attempt"), event["status_code"].alias("status_code"), event["retryable"].alias("retryable"),
        F.when(limit.isNotNull(), safe_limit).alias("rate_limit"),
    )


def events_of(events: Column, category: str) -> Column:
    return F.size(F.filter(events, lambda e: e["category"] == category)).cast("bigint")


def _total(segments: Column, name: str) -> Column:
    return F.aggregate(segments, F.lit(0).cast("bigint"), lambda acc, s: acc + s[name])


def result_errors() -> Column:
    """Broken invariants of a result row, as messages in a fixed order."""
    c, segments = F.col, F.col("segments")
    keys = F.transform(segments, lambda s: F.struct(s["segment_type"], s["segment_id"]))
    quotas_met = F.forall(segments, lambda s: s["accepted"] == s["quota"])
    status = expected_status(c("n_items"), c("target_valid_count"), quotas_met, c("termination_reason"))
    digest = lambda x: x.rlike("^[0-9a-f]{64}$")
    bad_segment = lambda s: (F.least(s["quota"], *[s[x] for x in _SEGMENT_COUNTS]) < 0) | (s["accepted"] > s["quota"]) | (s["processed"] != s["accepted"] + s["rejected"]) | (s["processed"] > s["fetched"])
    failed = c("status") != "success"
    return violations(
        *[(F.coalesce(c(x), F.lit("")) == "", f"{x}: required") for x in ("source", "run_id", "manifest_version", "adapter_version")],
        (c("finished_at") < c("started_at"), "finished before it started"), (c("target_valid_count") < 1, "target_valid_count: must be positive"), *[(c(x) < 0, f"{x}: negative") for x in _COUNTS],
        (c("successful_request_count") > c("request_count"), "more successes than requests"), (c("request_count") > c("http_attempt_count"), "more requests than attempts"),
        (c("retry_count") != c("http_attempt_count") - c("request_count"), "retries must be attempts beyond requests"), (F.size("transport_events") > c("http_attempt_count"), "more events than attempts"),
        (F.exists("transport_events", event_errors), "a transport event is out of its lists"), (c("accepted_item_count") != c("n_items"), "accepted must be the items"), (c("rejected_item_count") != c("n_invalid_items"), "rejected must be the invalid items"),
        (c("processed_item_count") != c("accepted_item_count") + c("rejected_item_count"), "processed must be accepted plus rejected"), (c("processed_item_count") > c("fetched_item_count"), "processed exceeds fetched"),
        (c("accepted_item_count") > c("target_valid_count"), "accepted exceeds the target"), (F.size(segments) < 1, "segments: required"), (F.size(F.array_distinct(keys)) != F.size(keys), "segments repeat"), (F.exists(segments, bad_segment), "a segment doesn't add up"),
        *[(_total(segments, x) != c(f"{x}_item_count"), f"segments' {x} must total the result's") for x in _SEGMENT_COUNTS],
        (~digest(c("manifest_hash")), "manifest_hash: not a digest"), (F.coalesce(~digest(c("compliance_hash")), F.lit(False)), "compliance_hash: not a digest"), (~c("termination_reason").isin(*TERMINATIONS), "termination_reason: unknown"),
        ((c("termination_reason") == "prerequisite_failed") & (c("n_items") > 0), "a failed prerequisite keeps no items"), (c("status") != status, F.concat(F.lit("status must be "), status)),
        (~failed & (c("error_code").isNotNull() | c("error_message").isNotNull()), "a success has no error"), (failed & ~F.coalesce(c("error_code").rlike("^[a-z][a-z0-9_]{0,63}$"), F.lit(False)), "error_code: required in lower snake case"),
        (F.coalesce(~F.length("error_message").between(1, 500), F.lit(False)), "error_message: length out of bounds"),
    )


def smoke_report(items: DataFrame, results: DataFrame) -> DataFrame:
    """What a smoke report may show: each run's result with safe events, and its items by safe references only."""
    references = items.groupBy(F.col("fetch_run_id").alias("run_id")).agg(F.sort_array(F.collect_list(F.struct(*SAFE_REFERENCE))).alias("accepted_references"))  # a smoke run has ten items
    return results.withColumn("transport_events", F.transform("transport_events", safe_event)).drop("error_message").join(references, "run_id", "left")


def stratum_of(item_id: Column) -> Column:
    """The stratum that the id of a rejected item starts with."""
    return F.substring_index(item_id, ":", 1)


def rejections_by_stratum(rejections: DataFrame, strata: DataFrame) -> DataFrame:
    """Counts of reasons for each of ``strata`` (stratum), by the stratum that rejected ids name; all strata stay."""
    counts = rejections.groupBy(stratum_of(F.col("source_item_id")).alias("stratum"), "reason").agg(F.count(F.lit(1)).alias("n"))
    return strata.select("stratum").join(counts, "stratum", "left").select("stratum", "reason", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
