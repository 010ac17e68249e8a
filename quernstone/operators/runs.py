"""How collection runs end, read from their page logs: running totals without a task that holds a run.

A log has a row for each page that a run could ask for: run_id, stratum (its place in the run), page,
accepted (records it would add), attempts, bytes, millis, error (a code, or null), has_more,
quota_remaining (null where the source has none), private (a record that must not be kept), events.
A run asks for the pages of a stratum until its quota is met, strata in order, while requests,
attempts, bytes and time are shared; the first reason to stop wins.

Running totals come from a prefix scan: rows are dealt to ranges, each range sums its own, and the
sums of the ranges before are added.  A run of any length is spread over all ranges.

Cases: a null number counts as none, and a null has_more as the last page.  A run without a row in
the log, or with a stratum that has none, ends by an exhausted source.  Rows of a run or stratum
that isn't asked for are left out.  Pages of one number are told apart by no order, so must not
repeat.  Other columns of the log are kept, under their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables

#: What a run may spend; columns of ``runs``, beside run_id, ready, unreachable, target and reserve.
BUDGETS = ("max_requests", "max_pages", "max_attempts", "max_bytes", "max_millis")
#: Errors of a transport that end a run under their own name; any other is a transport error.
NAMED_ERRORS = ("rate_limit_exhausted", "smoke_deadline_exhausted", "backoff_budget_exhausted")


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the running totals of ``sums`` over ``order`` within ``by``, the row's own included."""
    held = rows.select("*", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(f"_own_{name}") for name, c in sums.items()])
    dealt = held.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    dealt = tables.written(dealt, "ranges")  # ranges are drawn from a sample: fixed from here on
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(f"_own_{name}").alias(f"_all_{name}") for name in sums])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_all_{name}").over(earlier), F.lit(0)).alias(f"_all_{name}") for name in sums])
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.select("*", *[F.sum(f"_own_{name}").over(within).alias(f"_sum_{name}") for name in sums])
    same = [local[c].eqNullSafe(before[c]) for c in (*by, "_range")]
    joined = local.join(before, same)
    return joined.select(*[local[c] for c in rows.columns], *[(F.col(f"_sum_{name}") + F.col(f"_all_{name}")).alias(name) for name in sums])


def asked(log: DataFrame, runs: DataFrame, quotas: DataFrame) -> DataFrame:
    """The pages that runs ask for, with their totals so far, and ``reason`` where a run ends.

    ``quotas`` has run_id, stratum and quota; ``runs`` the columns named above.  A page whose reason
    holds before the request isn't asked for any more: ``refused``.
    """
    known = log.join(quotas.select("run_id", "stratum", "quota"), ["run_id", "stratum"])
    so_far = running(known, ["run_id", "stratum"], ["page"], {"accepted_so_far": F.col("accepted")})
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    so_far = so_far.withColumn("left", F.col("quota") - (F.col("accepted_so_far") - n("accepted"))).where("left > 0")
    so_far = so_far.withColumn("taken", F.when(F.col("error").isNull(), F.least(n("accepted"), "left")).otherwise(0))
    paged = F.col("error").isNull().cast("int")
    total = running(so_far, ["run_id"], ["stratum", "page"], {"requests": F.lit(1), "pages": paged, "http_attempts": F.col("attempts"), "response_bytes": F.col("bytes"), "elapsed": F.col("millis"), "last_event": F.col("events")})
    rows = total.join(runs.where("ready").select("run_id", "unreachable", "reserve", *BUDGETS), "run_id")
    before = {"requests": F.col("requests") - 1, "pages": F.col("pages") - paged, "http_attempts": F.col("http_attempts") - n("attempts"), "response_bytes": F.col("response_bytes") - n("bytes"), "elapsed": F.col("elapsed") - n("millis")}
    refused = (
        F.when(before["requests"] >= F.col("max_requests"), "request_budget_exhausted").when(before["pages"] >= F.col("max_pages"), "page_budget_exhausted").when(before["http_attempts"] >= F.col("max_attempts"), "transport_error")
        .when(before["elapsed"] >= F.col("max_millis"), "smoke_deadline_exhausted").when(before["response_bytes"] >= F.col("max_bytes"), "transport_error")
    )
    met = F.col("taken") >= F.col("left")
    answered = (
        F.when(F.col("error").isin(*NAMED_ERRORS), F.col("error")).when(F.col("error").isNotNull() | (F.col("http_attempts") > F.col("max_attempts")) | (F.col("response_bytes") > F.col("max_bytes")), "transport_error")
        .when(F.coalesce("private", F.lit(False)), "privacy_failure").when(met, F.lit(None)).when(F.col("quota_remaining") < F.col("reserve") + F.col("max_requests") - F.col("requests"), "quota_budget_exhausted")
        .when(~F.coalesce("has_more", F.lit(False)), F.col("unreachable"))
    )
    return rows.withColumns({"refused": refused.isNotNull(), "met": met, "reason": F.coalesce(refused, answered)}).drop(*BUDGETS, "reserve", "unreachable", "quota")


def kept_pages(pages: DataFrame) -> DataFrame:
    """Of the pages of ``asked`` those that a run got before it ended, its last one included."""
    ends = pages.where("reason IS NOT NULL").groupBy("run_id").agg(F.min(F.struct("stratum", "page")).alias("end"))
    at = F.struct("stratum", "page")
    return pages.join(ends, "run_id", "left").where(F.col("end").isNull() | (at < F.col("end")) | ((at == F.col("end")) & ~F.col("refused"))).drop("end")


def terminations(log: DataFrame, runs: DataFrame, quotas: DataFrame) -> DataFrame:
    """run_id, termination and what the run had spent and accepted by then, for each of ``runs``.

    The target with all quotas ends a run well whatever else held; a run that isn't ready fails its
    prerequisites.
    """
    pages = tables.written(asked(log, runs, quotas), "asked")
    first = pages.where("reason IS NOT NULL").groupBy("run_id").agg(F.min_by("reason", F.struct("stratum", "page")).alias("reason"))
    spent = kept_pages(pages).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("attempts").alias("http_attempts"), F.sum("bytes").alias("response_bytes"), F.sum("taken").alias("accepted"), F.count_if("met").alias("n_met"), F.sum("events").alias("n_events")
    )
    strata = quotas.where("quota > 0").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_strata"))
    rows = runs.select("run_id", "ready", "target").join(first, "run_id", "left").join(spent, "run_id", "left").join(strata, "run_id", "left")
    counts = ("requests", "http_attempts", "response_bytes", "accepted", "n_events")
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    whole = (n("accepted") == F.col("target")) & (n("n_met") == n("n_strata"))
    ended = F.when(~F.coalesce("ready", F.lit(False)), "prerequisite_failed").when(whole, "target_reached").otherwise(F.coalesce("reason", F.lit("source_exhausted")))
    return rows.select("run_id", ended.alias("termination"), *[n(c).cast("bigint").alias(c) for c in counts])


def numbered_events(pages: DataFrame, events: DataFrame) -> DataFrame:
    """``events`` (run_id, stratum, page, sequence within its page) of the kept pages, numbered through each run from 1."""
    offsets = kept_pages(pages).select("run_id", "stratum", "page", (F.col("last_event") - F.coalesce("events", F.lit(0))).alias("_before"))
    return events.join(offsets, ["run_id", "stratum", "page"]).withColumn("sequence", F.col("sequence") + F.col("_before")).drop("_before")
