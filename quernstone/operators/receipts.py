"""Receipts of capacity runs as rows, and the rules they must keep: what a receipt contradicts is a table.

A run has one row of totals and a row for each stratum.  Verdicts that rows state are never taken
over: each is held against the counts beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .qualify import THRESHOLDS

BUDGETED = ("logical_requests", "http_attempts", "response_bytes")


def _all(*conditions: Column) -> Column:
    """Whether every condition holds; an unknown one doesn't."""
    return F.forall(F.array(*[F.coalesce(c, F.lit(False)) for c in conditions]), lambda c: c)


def stratum_rules(required: int) -> dict[str, Column]:
    c = F.col
    shares = [c(f"{x}_completeness").between(THRESHOLDS[x], 1.0) for x in ("procedure", "buyer", "text")]  # no share is not a number
    reached = _all(c("accepted") >= required, c("processed") <= THRESHOLDS["processed"], c("acceptance_yield").between(THRESHOLDS["yield"], 1.0), *shares)
    by_reason = F.aggregate(F.coalesce(F.map_values("reasons"), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return {"counts": _all(c("processed") == c("accepted") + c("rejected"), c("rejected") == by_reason, c("processed") <= c("fetched"), F.least("accepted", "rejected") >= 0), "verdict": c("capacity_pass").eqNullSafe(reached)}


def run_rules(strata: list[str]) -> dict[str, Column]:
    c, passed = F.col, F.col("status") == "PASS"
    kept = _all(~c("deadline_exhausted"), *[c(x) <= c(f"max_{x}") for x in BUDGETED])
    return {
        "strata": F.coalesce(c("names") == F.array(*map(F.lit, sorted(strata))), F.lit(False)), "nothing is kept": F.coalesce(c("retained_items") == 0, F.lit(False)),
        "transport": _all(c("retries").between(0, c("http_attempts")), c("http_attempts") <= c("logical_requests") + c("retries"), c("deadline_seconds") > 0),
        "pages": _all(c("pages_observed") == c("unique_page_signatures") + c("repeated_page_signatures")), "verdict": passed.eqNullSafe(c("termination_reason") == "capacity_reached"),
        "a PASS has its strata": ~passed | F.coalesce("all_pass", F.lit(False)), "a PASS keeps its budgets": ~passed | kept, "a PASS has no page twice": ~passed | (c("repeated_page_signatures") == 0),
    }


def _broken(rules: dict[str, Column]) -> Column:
    return F.explode(F.filter(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]), lambda r: r.isNotNull())).alias("rule")


def contradictions(runs: DataFrame, strata: DataFrame, names: list[str], required: int) -> DataFrame:
    """(run_id, subject, rule): every rule that a run's totals (subject ``run``) or one of its strata break.

    A null count breaks the rules that ask for it.  A run without strata breaks those about them.
    """
    of_run = strata.groupBy("run_id").agg(F.array_sort(F.collect_list("stratum")).alias("names"), F.bool_and(F.coalesce("capacity_pass", F.lit(False))).alias("all_pass"))  # a few names a run
    return strata.select("run_id", F.col("stratum").alias("subject"), _broken(stratum_rules(required))).unionByName(runs.join(of_run, "run_id", "left").select("run_id", F.lit("run").alias("subject"), _broken(run_rules(names))))
