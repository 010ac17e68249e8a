"""Dataset gates, capacity receipts and page or budget logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .metrics import ratio
from .quality import with_errors
from .runs import running


def failures(**broken: Column) -> Column:
    """Sorted names of the conditions that hold; null counts as broken."""
    each = [F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in broken.items()]
    return F.array_sort(F.array_distinct(F.filter(F.array(*each), lambda f: f.isNotNull())))


def qualify(items: DataFrame, quotas: dict[str, int], url_ok: Column, *, success: bool = True, provenance: bool = True, max_per_author: int = 2, unique: tuple[str, ...] = ("document_id",), quota_name: str = "stratum", secrets: tuple[str, ...] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    """One row: whether a dataset qualifies, and the sorted codes of what it fails.

    ``extra`` adds codes with a per-row condition that must not hold for any row.
    """
    rows = with_errors(items).withColumn("_identity", text.identity_paths(text.key_paths(F.col("source_metadata"))))
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in items.columns]))
    secret = F.lit(False)
    for s in secrets:
        secret = secret | F.contains(whole, F.lit(s))
    authors = rows.groupBy("author_hash").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    strata = rows.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    wanted = items.sparkSession.createDataFrame(list(quotas.items()), "community string, quota int")
    uneven = strata.join(wanted, "community", "full").agg(F.bool_or(~F.col("n").eqNullSafe(F.col("quota"))).alias("uneven"))
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(f"distinct_{c}") for c in unique], F.bool_or(F.size("errors") > 0).alias("invalid"), F.bool_or(~F.coalesce(url_ok, F.lit(False))).alias("bad_url"),
        F.bool_or((F.size("_identity") > 0) | secret).alias("private"), *[F.bool_or(F.coalesce(c, F.lit(True))).alias(f"extra_{k}") for k, c in (extra or {}).items()],
    )
    one = facts.crossJoin(authors).crossJoin(uneven)  # three rows of totals
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    found = failures(
        collection_not_successful=F.lit(not success), accepted_count_mismatch=F.col("n") != sum(quotas.values()), **{f"{quota_name}_item_count_mismatch": F.col("uneven")}, raw_item_invalid=no("invalid"), canonical_url_mismatch=no("bad_url"),
        **{f"duplicate_{c}": F.col(f"distinct_{c}") != F.col("n") for c in unique}, author_quota_exceeded=F.col("most") > max_per_author, provenance_mismatch=F.lit(not provenance), privacy_violation=no("private"), **{k: no(f"extra_{k}") for k in extra or {}},
    )
    return one.select((F.size(found) == 0).alias("qualified"), found.alias("failures"), "n")


#: What a stratum must reach.
THRESHOLDS = {"procedure": 0.95, "buyer": 0.8, "text": 0.8, "yield": 0.25, "processed": 300}


def stratum_summary(rows: DataFrame, by: str, required: int, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Counters, completeness and whether capacity is proven, for each stratum.

    ``rows`` has accepted (null: unprocessed), procedure_present, buyer_present and text_present.
    """
    done = F.col("accepted").isNotNull()
    n = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(done).alias("processed"), F.count_if(done & F.col("accepted")).alias("accepted"),
        *[F.count_if(done & F.col(f"{x}_present")).alias(f"n_{x}") for x in ("procedure", "buyer", "text")],
    )
    shares = {f"{x}_completeness": ratio(F.col(f"n_{x}"), F.col("processed")) for x in ("procedure", "buyer", "text")}
    out = n.withColumns({"rejected": F.col("processed") - F.col("accepted"), **shares, "acceptance_yield": ratio(F.col("accepted"), F.col("processed"))})
    passed = (F.col("accepted") >= required) & (F.col("processed") <= thresholds["processed"]) & (F.col("acceptance_yield") >= thresholds["yield"])
    for x in ("procedure", "buyer", "text"):
        passed = passed & (F.col(f"{x}_completeness") >= thresholds[x])
    return out.withColumn("capacity_pass", passed).drop("n_procedure", "n_buyer", "n_text")


def capacity_receipt(strata: DataFrame, expected: list[str], required: int, by: str = "stratum") -> DataFrame:
    """One row over all strata: exactly the expected ones, all with enough accepted rows."""
    names = F.array_sort(F.collect_set(by))
    return strata.agg(
        F.count(F.lit(1)).alias("n_strata"), F.sum("fetched").alias("fetched"), F.sum("accepted").alias("accepted"), F.coalesce(F.bool_and(F.col("accepted") >= required), F.lit(False)).alias("all_pass"), names.alias("names")
    ).select("n_strata", "fetched", "accepted", (F.col("all_pass") & (F.col("names") == F.array(*map(F.lit, sorted(expected))))).alias("capacity_pass"), F.lit(0).cast("bigint").alias("retained_items"))


def with_reason_counts(segments: DataFrame, rejections: DataFrame, by: str) -> DataFrame:
    """Segments with a map of their rejection reasons; empty where nothing was rejected."""
    counts = rejections.groupBy(by, "reason").agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("rejection_reason_counts"))
    return segments.join(counts, by, "left").withColumn("rejection_reason_counts", F.coalesce("rejection_reason_counts", F.create_map().cast("map<string,bigint>")))


def pagination(pages: DataFrame, by: str, page: str = "page", signature: str = "signature", total: str = "total") -> DataFrame:
    """Continuity of each stratum's pages: gaps, repeated signatures and changes of the announced total."""
    order = Window.partitionBy(by).orderBy(page)
    rows = pages.withColumns({"_gap": F.col(page) != F.lag(page).over(order) + 1, "_changed": F.col(total) != F.lag(total).over(order)})
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("pages"), F.count_distinct(signature).alias("unique_pages"), (F.count(F.lit(1)) - F.count_distinct(signature)).alias("repeated_pages"), F.count_if("_gap").alias("gaps"), F.count_if("_changed").alias("total_changes")
    )


def pagination_totals(strata: DataFrame) -> DataFrame:
    """One row over the strata of ``pagination``: sums, and whether any stratum repeats or skips pages."""
    counts = ("pages", "unique_pages", "repeated_pages", "gaps", "total_changes")
    return strata.agg(F.count(F.lit(1)).alias("n_strata"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], F.coalesce(F.bool_or((F.col("repeated_pages") > 0) | (F.col("gaps") > 0)), F.lit(False)).alias("broken"))


def observed(rows: DataFrame, by: str, strata: list[str], measures: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``rows`` whose next action also counts where each of ``measures`` holds, for each stratum and in all.

    The counts come with the one job that writes or aggregates the rows, and keep none of them: see
    ``counters``.  Rows of other strata count in the totals alone.
    """
    seen = Observation()
    every = {"rows": F.lit(True)} | measures
    exprs = [F.count_if(F.coalesce(m, F.lit(False))).alias(f"all:{name}") for name, m in every.items()]
    exprs += [F.count_if(F.coalesce(m & (F.col(by) == s), F.lit(False))).alias(f"{n}:{name}") for n, s in enumerate(strata) for name, m in every.items()]
    return rows.observe(seen, *exprs), seen


def counters(seen: Observation, strata: list[str]) -> dict[str | None, dict[str, int]]:
    """What ``observed`` has counted, by stratum; the totals stand under None.  It waits for the action."""
    found: dict[str | None, dict[str, int]] = {s: {} for s in (*strata, None)}
    for key, value in seen.get.items():
        place, name = key.split(":", 1)
        found[None if place == "all" else strata[int(place)]][name] = value
    return found


def capacity_probe(rows: DataFrame, by: str, strata: list[str], required: int) -> dict:
    """A capacity report from one job over ``rows`` (accepted is null where unprocessed), which are not kept anywhere."""
    done = F.col("accepted").isNotNull()
    watched, seen = observed(rows, by, strata, {"processed": done, "accepted": done & F.col("accepted"), "rejected": done & ~F.col("accepted")})
    watched.write.format("noop").mode("overwrite").save()
    found = counters(seen, strata)
    total = found.pop(None)
    whole = sum(x["rows"] for x in found.values()) == total["rows"]
    return {"strata": found, "totals": total, "capacity_pass": whole and all(x["accepted"] >= required for x in found.values()), "retained_items": 0}


def run_budget(log: DataFrame, order: str, max_requests: int, max_attempts: int, max_bytes: int, run: str = "run_id", max_millis: int | None = None) -> DataFrame:
    """A request log with what each run has spent so far and the first budget that is then exceeded.

    ``max_millis`` is a deadline for the sum of the log's ``millis``.
    """
    sums = {"requests_used": F.lit(1), "attempts_used": F.col("attempts"), "bytes_used": F.col("bytes")} | ({"millis_used": F.col("millis")} if max_millis is not None else {})
    rows = running(log, [run], [order], sums)
    late = F.col("millis_used") >= max_millis if max_millis is not None else F.lit(False)
    exceeded = F.when(F.col("requests_used") > max_requests, "request_budget_exhausted").when(F.col("attempts_used") > max_attempts, "attempt_budget_exhausted").when(F.col("bytes_used") > max_bytes, "response_byte_budget_exhausted").when(late, "deadline_exhausted")
    return rows.withColumn("exceeded", exceeded)


def run_status(termination: Column, accepted: Column) -> Column:
    return F.when(termination == "target_reached", "success").when(accepted > 0, "partial").otherwise("failed")


def duplicates(rows: DataFrame, *by: str) -> DataFrame:
    """Keys that stand more than once."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)
