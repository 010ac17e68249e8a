"""Queries of how collection runs end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs
from .catalog import query, table

_KINDS = ("click", "error", "purchase", "signup", "view")


@query(f"""
WITH e AS (SELECT user_id AS run, list_position({list(_KINDS)}, event_type) - 1 AS stratum, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS page, floor(value / 40)::BIGINT AS accepted, json_extract(props, '$.k')::BIGINT AS k, length(props) + floor(value)::BIGINT AS bytes FROM events),
l AS (SELECT *, 1 + (k % 5 = 0)::INT AS attempts, 10 + k AS millis, k % 3 AS events, CASE k WHEN 96 THEN 'rate_limit_exhausted' WHEN 97 THEN 'backoff_budget_exhausted' WHEN 98 THEN 'smoke_deadline_exhausted' WHEN 99 THEN 'timeout' END AS error,
  k % 37 > 0 AS has_more, k = 95 AS private, CASE WHEN run % 2 = 0 THEN 30 + bytes END AS remaining FROM e),
r AS (SELECT DISTINCT run, run % 23 > 0 AS ready, CASE WHEN run % 4 = 1 THEN 'repository_quota_unreachable' ELSE 'source_exhausted' END AS unreachable, 6 + run % 12 AS max_requests, 5 + run % 13 AS max_pages, 8 + run % 15 AS max_attempts, 900 + 40 * (run % 30) AS max_bytes, 250 + 50 * (run % 25) AS max_millis FROM l),
s AS (SELECT run, unnest([0, 1, 2, 3, 4]) AS stratum, 1 + run % 5 AS quota FROM r),
a AS (SELECT l.*, s.quota, coalesce(sum(accepted) OVER (PARTITION BY l.run, l.stratum ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM l JOIN s ON s.run = l.run AND s.stratum = l.stratum),
w AS (SELECT *, CASE WHEN error IS NULL THEN least(accepted, quota - earlier) ELSE 0 END AS taken, count(*) OVER o AS n, count_if(error IS NULL) OVER o AS n_pages, sum(attempts) OVER o AS tries, sum(bytes) OVER o AS used, sum(millis) OVER o AS elapsed
  FROM a WHERE earlier < quota WINDOW o AS (PARTITION BY run ORDER BY stratum, page)),
m AS (SELECT w.*, CASE WHEN n > max_requests THEN 'request_budget_exhausted' WHEN n_pages - (error IS NULL)::INT >= max_pages THEN 'page_budget_exhausted' WHEN tries - attempts >= max_attempts THEN 'transport_error' WHEN elapsed - millis >= max_millis THEN 'smoke_deadline_exhausted' WHEN used - bytes >= max_bytes THEN 'transport_error' END AS refused,
  CASE WHEN error = 'timeout' THEN 'transport_error' WHEN error IS NOT NULL THEN error WHEN tries > max_attempts OR used > max_bytes THEN 'transport_error' WHEN private THEN 'privacy_failure' WHEN earlier + taken >= quota THEN NULL WHEN remaining < 25 + max_requests - n THEN 'quota_budget_exhausted' WHEN NOT has_more THEN unreachable END AS answer
  FROM w JOIN r ON r.run = w.run WHERE ready),
f AS (SELECT run, min(n) AS last, arg_min(coalesce(refused, answer), n) AS reason FROM m WHERE refused IS NOT NULL OR answer IS NOT NULL GROUP BY run),
g AS (SELECT m.run, count(*) AS requests, sum(attempts) AS tries, sum(bytes) AS bytes, sum(taken) AS taken, sum(events) AS events, count_if(earlier + taken >= quota) AS met FROM m LEFT JOIN f ON f.run = m.run WHERE last IS NULL OR n < last OR n = last AND refused IS NULL GROUP BY 1)
SELECT r.run AS run_id, CASE WHEN NOT ready THEN 'prerequisite_failed' WHEN taken = 5 * (1 + r.run % 5) AND met = 5 THEN 'target_reached' ELSE coalesce(reason, 'source_exhausted') END AS termination,
  coalesce(requests, 0)::BIGINT AS requests, coalesce(tries, 0)::BIGINT AS http_attempts, coalesce(bytes, 0)::BIGINT AS response_bytes, coalesce(taken, 0)::BIGINT AS accepted, coalesce(events, 0)::BIGINT AS n_events
FROM r LEFT JOIN f ON f.run = r.run LEFT JOIN g ON g.run = r.run""")
def q_terminations(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as a run's pages, its types as strata: how each run ends, and with what."""
    e, k = table(spark, d, "events"), F.col("k")
    place = F.array_position(F.array(*map(F.lit, _KINDS)), F.col("event_type")).cast("int") - 1
    pages = runs.running(e.select("event_id", F.col("user_id").alias("run_id"), place.alias("stratum"), "value", "props"), ["run_id", "stratum"], ["event_id"], {"page": F.lit(1)})
    pages = pages.withColumns({"k": F.get_json_object("props", "$.k").cast("bigint"), "bytes": F.length("props") + F.floor("value")})
    error = F.when(k == 96, "rate_limit_exhausted").when(k == 97, "backoff_budget_exhausted").when(k == 98, "smoke_deadline_exhausted").when(k == 99, "timeout")
    log = pages.select(
        "run_id", "stratum", "page", F.floor(F.col("value") / 40).alias("accepted"), (1 + (k % 5 == 0).cast("int")).alias("attempts"), "bytes", (k + 10).alias("millis"), error.alias("error"), (k % 37 > 0).alias("has_more"),
        F.when(F.col("run_id") % 2 == 0, F.col("bytes") + 30).alias("quota_remaining"), (k == 95).alias("private"), (k % 3).alias("events"),
    )
    i = F.col("run_id")
    asked = e.select(F.col("user_id").alias("run_id")).distinct().select(
        i, (i % 23 > 0).alias("ready"), F.when(i % 4 == 1, "repository_quota_unreachable").otherwise("source_exhausted").alias("unreachable"), ((1 + i % 5) * 5).alias("target"), F.lit(25).alias("reserve"),
        (i % 12 + 6).alias("max_requests"), (i % 13 + 5).alias("max_pages"), (i % 15 + 8).alias("max_attempts"), (i % 30 * 40 + 900).alias("max_bytes"), (i % 25 * 50 + 250).alias("max_millis"),
    )
    quotas = asked.select("run_id", F.explode(F.array(*map(F.lit, range(len(_KINDS))))).alias("stratum"), (i % 5 + 1).alias("quota"))
    return runs.terminations(log, asked, quotas)
