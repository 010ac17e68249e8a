"""Ends of runs against a loop that asks page by page."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators import metrics, qualify, runs
from quernstone.operators.select import segment_counters
from quernstone.schemas import TERMINATIONS

LOG = "run_id long, stratum int, page int, accepted long, attempts long, bytes long, millis long, error string, has_more boolean, quota_remaining long, private boolean, events long, extra string"
RUNS = "run_id long, ready boolean, unreachable string, target long, reserve long, max_requests long, max_pages long, max_attempts long, max_bytes long, max_millis long"


def loop(run, quotas, pages):
    """(termination, requests, attempts, bytes, accepted, events, kept pages) of one run, asked for page by page."""
    _, ready, unreachable, target, reserve, max_requests, max_pages, max_attempts, max_bytes, max_millis = run
    requests = answered = attempts = used = elapsed = total = events = met = 0
    kept, end = [], None
    for stratum, quota in sorted(quotas.items()) if ready else ():
        got = 0
        for page in sorted((p for p in pages if p[1] == stratum), key=lambda p: p[2]):
            if got >= quota:
                break
            _, _, number, accepted, tries, size, millis, error, has_more, remaining, private, seen, _ = page
            spent = ((requests >= max_requests, "request_budget_exhausted"), (answered >= max_pages, "page_budget_exhausted"), (attempts >= max_attempts, "transport_error"), (elapsed >= max_millis, "smoke_deadline_exhausted"), (used >= max_bytes, "transport_error"))
            end = next((reason for broken, reason in spent if broken), None)
            if end:
                break
            requests, attempts, used, elapsed, events = requests + 1, attempts + tries, used + size, elapsed + millis, events + seen
            kept.append((stratum, number))
            if error:
                end = error if error in runs.NAMED_ERRORS else "transport_error"
                break
            answered += 1
            got += accepted
            total += min(accepted, quota - got + accepted)
            end = "transport_error" if attempts > max_attempts or used > max_bytes else "privacy_failure" if private else None
            if end or got >= quota:
                met += got >= quota
                if end:
                    break
                continue
            end = "quota_budget_exhausted" if remaining is not None and reserve is not None and remaining < reserve + max_requests - requests else None if has_more else unreachable
            if end:
                break
        if end:
            break
    if not ready:
        return "prerequisite_failed", 0, 0, 0, 0, 0, []
    if total == target and met == sum(q > 0 for q in quotas.values()):
        end = "target_reached"
    return end or "source_exhausted", requests, attempts, used, total, events, kept


def made(rng, n):
    log, all_runs, quotas = [], [], {}
    for i in range(n):
        quotas[i] = {s: rng.choice([0, 3, 5, 8]) for s in range(rng.randint(1, 4))}
        wide = rng.random() < 0.5
        all_runs.append((i, rng.random() > 0.05, rng.choice(["source_exhausted", "repository_quota_unreachable"]), sum(quotas[i].values()), rng.choice([None, None, 20]), *[rng.randint(3, 9) * (9 if wide else 1) for _ in range(2)], rng.randint(5, 14) * (9 if wide else 1), rng.randint(30, 99) * (9 if wide else 1), rng.randint(40, 90) * (9 if wide else 1)))
        for s in quotas[i]:
            for p in range(1, rng.randint(0, 6) + 1):
                error = rng.choice(["rate_limit_exhausted", "backoff_budget_exhausted", "smoke_deadline_exhausted", "odd"]) if rng.random() < 0.06 else None
                log.append((i, s, p, rng.randint(0, 4), rng.randint(1, 3), rng.randint(1, 20), rng.randint(1, 15), error, rng.random() > 0.1, rng.choice([None, 20, 60, 300]), rng.random() < 0.03, rng.randint(0, 2), "x"))
    log.append((n + 5, 0, 1, 1, 1, 1, 1, None, True, None, False, 0, "x"))  # a run that nobody asked for
    return log, all_runs, quotas


def test_ends_equal_the_loop(spark):
    log, all_runs, quotas = made(random.Random(3), 300)
    shuffled = spark.createDataFrame(random.Random(1).sample(log, len(log)), LOG).repartition(6)
    r = spark.createDataFrame(all_runs, RUNS)
    q = spark.createDataFrame([(i, s, v) for i, of in quotas.items() for s, v in of.items()], "run_id long, stratum int, quota long")
    want = {run[0]: loop(run, quotas[run[0]], [p for p in log if p[0] == run[0]]) for run in all_runs}
    got = {x.run_id: tuple(x)[1:] for x in runs.terminations(shuffled, r, q).collect()}
    assert got == {i: w[:-1] for i, w in want.items()} and {w[0] for w in want.values()} == set(TERMINATIONS)
    pages = runs.asked(shuffled, r, q)
    kept = {(x.run_id, x.stratum, x.page) for x in runs.kept_pages(pages).collect()}
    assert kept == {(i, *k) for i, w in want.items() for k in w[-1]}
    events = spark.createDataFrame([(p[0], p[1], p[2], k + 1) for p in log for k in range(p[-2])], "run_id long, stratum int, page int, sequence long")
    numbers = {}
    for x in runs.numbered_events(pages, events).collect():
        numbers.setdefault(x.run_id, []).append(x.sequence)
    assert {i: sorted(v) for i, v in numbers.items()} == {i: list(range(1, w[5] + 1)) for i, w in want.items() if w[5]}


def test_running_totals_of_one_long_run(spark):
    rows = spark.range(5000).select(F.lit(None).cast("long").alias("run_id"), (F.col("id") * 7919 % 5000).alias("page"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("x")).unionAll(spark.createDataFrame([(1, 1, 5), (1, 0, 2)], "a long, b long, c long"))
    found = runs.running(rows, ["run_id"], ["page"], {"total": F.col("x")})
    plain = Window.partitionBy("run_id").orderBy("page")
    assert found.exceptAll(rows.withColumn("total", F.coalesce(F.sum("x").over(plain), F.lit(0)))).count() == 0 and found.count() == 5002
    assert runs.running(rows.where("false"), ["run_id"], ["page"], {"total": F.col("x")}).count() == 0


def test_budgets_are_exceeded_in_order(spark):
    log = spark.createDataFrame([("r", i, 2, 10, 1000) for i in range(1, 7)], "run_id string, seq int, attempts int, bytes int, millis int")
    found = {r.seq: r.exceeded for r in qualify.run_budget(log, "seq", 5, 9, 100, max_millis=3000).collect()}
    assert found == {1: None, 2: None, 3: "deadline_exhausted", 4: "deadline_exhausted", 5: "attempt_budget_exhausted", 6: "request_budget_exhausted"}
    assert {r.exceeded for r in qualify.run_budget(log, "seq", 9, 99, 35).collect()} == {None, "response_byte_budget_exhausted"}


def test_a_capacity_report_takes_one_job(spark):
    rows = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") % 10 == 0, "c").when(F.col("id") % 3 == 0, "a").otherwise("b").alias("stratum"), F.when(F.col("id") % 7 > 0, F.col("id") % 2 == 0).alias("accepted"))
    spark.sparkContext.setJobGroup("probe", "probe")
    try:
        report = qualify.capacity_probe(rows, "stratum", ["a", "b", "c"], 50)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("probe")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plain = {r.stratum: {"rows": r.fetched, "processed": r.processed, "accepted": r.accepted, "rejected": r.rejected} for r in segment_counters(rows, "stratum").collect()}
    assert len(jobs) == 1 and report["strata"] == plain and report["totals"] == {k: sum(x[k] for x in plain.values()) for k in plain["a"]} and report["capacity_pass"]
    assert not qualify.capacity_probe(rows, "stratum", ["a", "b"], 50)["capacity_pass"] and not qualify.capacity_probe(rows.where("false"), "stratum", ["a"], 1)["capacity_pass"]


def test_totals_over_strata(spark):
    pages = spark.createDataFrame([("a", 1, "x", 5), ("a", 2, "y", 5), ("b", 1, "z", 5), ("b", 3, "z", 6)], "s string, page int, signature string, total int")
    found = qualify.pagination_totals(qualify.pagination(pages, "s")).first()
    assert tuple(found) == (2, 4, 3, 1, 1, 1, True) and tuple(qualify.pagination_totals(qualify.pagination(pages.where("false"), "s")).first()) == (0, 0, 0, 0, 0, 0, False)
    sources = spark.createDataFrame([(f"s{i}", i / 10, "pass" if i > 5 else "provisional") for i in range(9)], "source string, score double, eligibility string")
    assert tuple(metrics.selection_succeeded(metrics.primary_sources(sources, "source")).first()) == (3, 6, True) and not metrics.selection_succeeded(metrics.primary_sources(sources.where("score < 0.7"), "source")).first().success
