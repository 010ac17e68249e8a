"""A collection run from payloads to a named bundle: parse, select, count, qualify, publish."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..operators import parse, qualify, quality, sampling
from ..schemas import RUNNER_CODES
from ..operators.select import observation_keys, segment_counters, select_strata
from ..sources import sinks


@dataclass
class Result:
    """Everything a run leaves: records, reasons, segments and how it ended."""

    items: DataFrame
    rejections: DataFrame
    segments: DataFrame
    termination: str
    error: str | None = None
    #: What the adapter says of its run: the names of ``MISMATCHES``.
    stated: dict = field(default_factory=dict)


def collect(parsed: DataFrame, quotas: dict[str, int], order: Column, max_per_author: int = 2) -> Result:
    """Independent observations of each stratum up to its quota, strata in the order of ``quotas``."""
    parsed = tables.written(parsed.withColumn("_place", order), "parsed")
    checked = tables.written(quality.with_errors(parse.accepted(parsed)), "checked")
    picked = select_strata(checked.where(F.size("errors") == 0), "community", quotas, F.col("_place"), observation_keys(max_per_author))
    picked = tables.written(picked, "picked")
    rejections = (
        parse.rejected(parsed)
        .unionByName(checked.where(F.size("errors") > 0).select("source_item_id", F.lit("invalid_item").alias("reason")))
        .unionByName(picked.where("NOT accepted").select("source_item_id", "reason"))
    )
    segments = segment_counters(picked, "community")
    full = {r["community"] for r in segments.collect() if r["accepted"] >= quotas[r["community"]]}
    items = picked.where("accepted").drop("accepted", "reason", "errors", "_place")
    return Result(items, rejections, segments, "target_reached" if full == set(quotas) else "source_exhausted")


def isolated(run: Callable[[], Result], empty: Callable[[], Result], bound: dict | None = None) -> Result:
    """A source that fails leaves an empty, failed result and stops no other; interrupts pass through.

    So does one whose result isn't a result, borrows one of the runner's own codes, or differs from what
    was asked for: ``bound`` maps names of ``MISMATCHES`` to the values it must state.
    """
    try:
        result = run()
        code = mismatch(result, bound or {})
    except Exception:
        code = "runner_adapter_exception"
    if code is None:
        return result
    failed = empty()
    failed.termination, failed.error = "prerequisite_failed", code
    return failed


#: What a result states of its run, with the code for another value, in the order of the checks.
MISMATCHES = {
    "source": "runner_source_mismatch", "adapter_version": "runner_adapter_version_mismatch", "run_id": "runner_run_id_mismatch", "manifest_version": "runner_manifest_version_mismatch", "target": "runner_target_mismatch",
    "manifest_hash": "runner_manifest_hash_mismatch", "compliance_hash": "runner_compliance_hash_mismatch",
}


def mismatch(result: object, bound: dict) -> str | None:
    """The code of the first thing by which a result isn't the one that was asked for."""
    if not isinstance(result, Result) or result.error in RUNNER_CODES:
        return "runner_invalid_adapter_result"
    return next((code for name, code in MISMATCHES.items() if name in bound and result.stated.get(name) != bound[name]), None)


def publish(result: Result, root: str, run_id: str, quotas: dict[str, int], url_ok: Column, seed: int, secrets: tuple[str, ...] = ()) -> dict:
    """Qualify, sample only what qualifies, and write the bundle; a privacy failure writes counts instead of data."""
    spark = result.items.sparkSession
    found = quality.privacy_violations(result.items, secrets)
    if found.take(1):
        sinks.privacy_receipt(spark, root, run_id, found)
        return {"qualified": False, "failures": ["privacy_violation"]}
    row = qualify.qualify(result.items, quotas, url_ok, success=result.termination == "target_reached", secrets=secrets).first()
    report = {"qualified": row["qualified"], "failures": list(row["failures"]), "termination": result.termination}
    out = {"items": result.items, "rejections": parse.reason_counts(result.rejections), "segments": result.segments}
    if row["qualified"]:
        out["assignments"] = sampling.stratified_assignments(result.items, seed)
    sinks.write_bundle(root, run_id, out, {"qualification": report}, row["qualified"])
    return report
