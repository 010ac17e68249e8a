"""The catalogue of queries over the driver's tables, each with the SQL that must agree with it.

The tables stand in for the records' domain: documents are records (source, lang as community),
labels are review verdicts, conversations are threads, pages are HTML bodies, events are an
observation and request log, embeddings are problem vectors.  Columns the tables lack (author,
URL, thread) are derived by the same expression on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables
from ..functions import ids, text, values
from ..operators import metrics, opportunity, parse, qualify, quality, results, review, sampling
from ..operators import select as selection
from ..sources import sinks
from ..streaming import observations

FLAGSHIP = "q_rejection_counts"
SECRET = b"quernstone-catalogue-test-secret"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records with an author, a URL and a thread, each shared by some."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.col("source"), F.col("lang").alias("community"), "text", F.concat(F.col("source"), F.lit(":"), F.col("doc_id").cast("string")).alias("document_id"),
        F.concat(F.lit("https://example.org/"), (F.col("doc_id") % 997).cast("string")).alias("source_url"), (F.col("doc_id") % 613).cast("string").alias("thread_id"), (F.col("doc_id") % 211).cast("string").alias("author_hash"),
    )


def _norm(c: str = "text") -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


_FOLD = f"replace(lower({_norm()}), 'ß', 'ss')"


@query(f"SELECT doc_id, {_norm()} AS normalized, sha256({_FOLD}) AS fingerprint, length({_norm()})::BIGINT AS text_length FROM documents")
def q_normalize_fingerprint(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))
    return rows.withColumn("fingerprint", text.fingerprint(F.col("normalized"))).withColumn("text_length", F.length("normalized").cast("bigint"))


@query(f"""
WITH n AS (SELECT doc_id, source, {_norm()} AS t, sha256({_FOLD}) AS fp FROM documents),
r AS (SELECT source, CASE WHEN t = '' THEN 'missing_body' WHEN length(t) < 40 THEN 'short_text'
        WHEN row_number() OVER (PARTITION BY fp ORDER BY doc_id) > 1 THEN 'duplicate_text' END AS reason FROM n)
SELECT source, coalesce(reason, 'accepted') AS reason, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def q_rejection_counts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", text.normalize_text(F.col("text")).alias("t"))
    # written once, as rows meet their own minima below
    rows = tables.written(rows.withColumn("fp", text.fingerprint(F.col("t"))).select("doc_id", "source", "fp", F.length("t").alias("n_chars")), "prints")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))  # partial minima: a text that many share is no hot group
    rows = rows.join(first, "fp")
    reason = parse.first_reason((F.col("n_chars") == 0, "missing_body"), (F.col("n_chars") < 40, "short_text"), (F.col("doc_id") > F.col("first"), "duplicate_text"))
    return parse.reason_counts(rows.withColumn("reason", F.coalesce(reason, F.lit("accepted"))), "source")


@query(f"SELECT sha256({_FOLD}) AS fingerprint, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_duplicate_groups(spark, d):
    return qualify.duplicates(table(spark, d, "documents").select(text.text_fingerprint(F.col("text")).alias("fingerprint")), "fingerprint")


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def q_window_filter(spark, d):
    rows = table(spark, d, "events")
    return rows.where(quality.in_window(F.col("ts"), F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count_if(ts >= TIMESTAMP '2024-01-15')::BIGINT AS after_cutoff, count_if(ts < TIMESTAMP '2024-01-15')::BIGINT AS processed FROM events")
def q_cutoff(spark, d):
    return observations.cutoff_counts(table(spark, d, "events"), "ts", "2024-01-15")


_PADS = ["".join(f"{b ^ p:02x}" for b in SECRET.ljust(64, b"\0")) for p in (0x5C, 0x36)]


@query(f"""SELECT event_id, sha256(unhex('{_PADS[0]}') || unhex(sha256(unhex('{_PADS[1]}') || encode(event_type || chr(0) || user_id::VARCHAR)))) AS author_hash FROM events""")
def q_author_hash(spark, d):
    return table(spark, d, "events").select("event_id", ids.author_hash(F.col("event_type"), F.col("user_id").cast("string"), SECRET).alias("author_hash"))


@query()
def q_select_independent(spark, d):
    rows = _items(spark, d).withColumn("text_fingerprint", text.text_fingerprint(F.col("text"))).drop("text")
    return selection.select(rows, F.col("doc_id"), selection.observation_keys()).select("doc_id", "accepted", "reason")


@query()
def q_select_quota(spark, d):
    rows = _items(spark, d).withColumn("text_fingerprint", text.text_fingerprint(F.col("text"))).drop("text")
    picked = selection.select_strata(rows, "community", {"de": 60, "en": 100, "es": 40, "fr": 60}, F.col("doc_id"), selection.observation_keys())
    return selection.segment_counters(picked, "community")


@query()
def q_buyer_cap(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("buyer_ids"))
    notices = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = notices.select("o_orderkey", F.col("o_orderkey").cast("string").alias("notice_id"), F.concat_ws(":", "o_custkey", "o_orderpriority").alias("procedure_id"), "buyer_ids")
    return selection.select(rows, F.col("o_orderkey"), selection.notice_keys()).select("o_orderkey", "accepted", "reason")


def _score(purpose: str, source: str = "source", doc: str = "doc_id::VARCHAR", seed: int = 17) -> str:
    return f"sha256('{seed}' || chr(0) || {purpose} || chr(0) || {source} || chr(0) || {doc})"


@query(f"""
WITH s AS (SELECT source, doc_id::VARCHAR AS document_id, {_score("'sample'")} AS s, {_score("'split'")} AS p, {_score("'double-review'")} AS b FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s, document_id)::INT AS rank FROM s QUALIFY rank <= 20)
SELECT source, document_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY p, document_id) <= 10 THEN 'development' ELSE 'holdout' END AS assignment_split,
  row_number() OVER (PARTITION BY source ORDER BY b, document_id) <= 5 AS requires_second_review, rank FROM c""")
def q_sample_per_source(spark, d):
    return sampling.assignments(table(spark, d, "documents"), 17, document="doc_id")


@query(f"""
WITH s AS (SELECT source, doc_id::VARCHAR AS document_id, lang AS stratum, {_score("'stratum:' || lang")} AS o, {_score("'stratified-split'")} AS p,
  {_score("'stratified-double-review'")} AS b, {_score("'stratified-rank'")} AS r FROM documents),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source, stratum ORDER BY o, document_id) <= 5)
SELECT source, document_id, stratum, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY p, document_id) <= 10 THEN 'development' ELSE 'holdout' END AS assignment_split,
  row_number() OVER (PARTITION BY source ORDER BY b, document_id) <= 5 AS requires_second_review, row_number() OVER (PARTITION BY source ORDER BY r, document_id)::INT AS rank FROM c""")
def q_sample_stratified(spark, d):
    return sampling.stratified_assignments(table(spark, d, "documents"), 17, document="doc_id", stratum="lang")


@query("SELECT source, lang, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2 HAVING count(*) < 6")
def q_short_strata(spark, d):
    return sampling.short_strata(table(spark, d, "documents"), 6, "source", "lang")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Two reviewers' verdicts, the second one's derived."""
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    rows = table(spark, d, "labels").select("doc_id", q.alias("usable_evidence"), t.alias("noise"), (q & (F.col("doc_id") % 3 == 0)).alias("money_signal"), (F.col("doc_id") % 9 == 0).alias("structural_money_signal"))
    return rows.withColumn("problem_signal", F.col("usable_evidence") & (F.col("doc_id") % 2 == 0))


_LABELS = """l AS (SELECT doc_id, quality = 1 AS usable_evidence, toxic = 1 AS noise, quality = 1 AND doc_id % 3 = 0 AS money_signal, doc_id % 9 = 0 AS structural_money_signal,
  quality = 1 AND doc_id % 2 = 0 AS problem_signal FROM labels)"""
_FIELDS = ("problem_signal", "money_signal", "usable_evidence", "noise")
_LONG = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {f} AS v FROM l" for f in _FIELDS)


@query(f"""
WITH {_LABELS}, u AS ({_LONG}), n AS (SELECT field, count_if(v)::BIGINT AS positive, count(v)::BIGINT AS total FROM u GROUP BY 1),
p AS (SELECT *, positive / total AS estimate, 1.959963984540054 AS z FROM n),
q AS (SELECT *, z * sqrt(estimate * (1 - estimate) / total + z * z / (4.0 * total * total)) AS spread, 1 + z * z / total AS scale, estimate + z * z / (2 * total) AS middle FROM p)
SELECT field, positive, total, round(estimate, 9) AS estimate, round(greatest(0, (middle - spread) / scale), 9) AS wilson_low, round(least(1, (middle + spread) / scale), 9) AS wilson_high FROM q""")
def q_density_wilson(spark, d):
    found = metrics.signal_density(_labels(spark, d), _FIELDS)
    return found.select("field", "positive", "total", *[F.round(c, 9).alias(c) for c in ("estimate", "wilson_low", "wilson_high")])


@query(f"WITH {_LABELS} SELECT round(avg(money_signal::INT), 9) AS raw_density, round(avg((money_signal AND NOT structural_money_signal)::INT), 9) AS adjusted_density FROM l")
def q_money_density(spark, d):
    return metrics.money_density(_labels(spark, d)).select(F.round("raw_density", 9).alias("raw_density"), F.round("adjusted_density", 9).alias("adjusted_density"))


@query(f"""
WITH {_LABELS}, u AS ({_LONG}), p AS (SELECT field, v AS a, CASE WHEN doc_id % 11 = 0 THEN NOT v ELSE v END AS b FROM u),
n AS (SELECT field, count(*)::BIGINT AS sample_size, count_if(a = b) AS same, count_if(a) AS pa, count_if(b) AS pb FROM p GROUP BY 1),
k AS (SELECT *, same / sample_size AS raw, least(pa + pb, 2 * sample_size - pa - pb) < 2 AS rare, pa / sample_size * (pb / sample_size) + (1 - pa / sample_size) * (1 - pb / sample_size) AS chance FROM n)
SELECT field, sample_size, round(raw, 9) AS raw_agreement, CASE WHEN NOT rare THEN round((raw - chance) / (1 - chance), 9) END AS kappa, CASE WHEN rare THEN 'prevalence_limited' ELSE 'calculated' END AS kappa_status,
  round((pa + pb) / (2 * sample_size), 9) AS positive_prevalence, raw >= 0.8 AND (rare OR (raw - chance) / (1 - chance) >= 0.6) AS passed FROM k""")
def q_agreement_kappa(spark, d):
    first = _labels(spark, d).withColumn("reviewer_id", F.lit("a"))
    second = first.withColumn("reviewer_id", F.lit("b"))
    for f in _FIELDS:
        second = second.withColumn(f, F.when(F.col("doc_id") % 11 == 0, ~F.col(f)).otherwise(F.col(f)))
    pairs = metrics.paired(first, second, _FIELDS, "doc_id")
    found = metrics.agreement(pairs, "field")
    return found.select("field", "sample_size", F.round("raw_agreement", 9).alias("raw_agreement"), F.round("kappa", 9).alias("kappa"), "kappa_status", F.round("positive_prevalence", 9).alias("positive_prevalence"), "passed")


@query("""
SELECT doc_id AS assignment_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'repeated' FROM labels GROUP BY doc_id HAVING count(*) > 1""")
def q_label_coverage(spark, d):
    return review.coverage(table(spark, d, "labels").withColumnRenamed("doc_id", "assignment_id"), table(spark, d, "documents").withColumnRenamed("doc_id", "assignment_id"))


@query("""SELECT d.source, l.quality, count(*)::BIGINT AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2""")
def q_label_join(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT doc_id, doc_id % 5 AS reviewer, quality FROM labels), s AS (SELECT doc_id, doc_id % 7 AS reviewer, quality FROM labels)
SELECT r.doc_id, r.reviewer AS first_reviewer, s.reviewer AS second_reviewer FROM r JOIN s ON r.doc_id = s.doc_id AND r.reviewer <> s.reviewer""")
def q_rater_pairs(spark, d):
    l = table(spark, d, "labels")
    return review.rater_pairs(l.select("doc_id", (F.col("doc_id") % 5).alias("reviewer_id")), l.select("doc_id", (F.col("doc_id") % 7).alias("reviewer_id")), "doc_id")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'development' ELSE 'holdout' END AS assignment_split, count(*)::BIGINT AS n, sum(quality)::BIGINT AS n_usable FROM labels GROUP BY 1")
def q_dev_holdout_split(spark, d):
    root = f"{tables.shared_dir(spark)}/labels-{uuid.uuid4().hex}"
    sinks.write_labels(table(spark, d, "labels").withColumn("assignment_split", F.when(F.col("doc_id") % 2 == 0, "development").otherwise("holdout")), root)
    back = spark.read.schema("doc_id bigint, quality int, assignment_split string").json(root)
    return back.groupBy("assignment_split").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("bigint").alias("n_usable"))


def _observed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("stratum"), F.when(F.col("event_id") % 10 < 9, F.col("value") > 20).alias("accepted"), (F.col("user_id") % 20 != 0).alias("procedure_present"), (F.col("user_id") % 10 != 0).alias("buyer_present"), F.col("props").isNotNull().alias("text_present"))


_OBSERVED = "o AS (SELECT event_type AS stratum, CASE WHEN event_id % 10 < 9 THEN value > 20 END AS accepted, user_id % 20 <> 0 AS pp, user_id % 10 <> 0 AS bp, props IS NOT NULL AS tp FROM events)"


@query(f"""WITH {_OBSERVED}, n AS (SELECT stratum, count(*)::BIGINT AS fetched, count(accepted)::BIGINT AS processed, count_if(accepted)::BIGINT AS accepted, count_if(accepted IS NOT NULL AND pp) AS p, count_if(accepted IS NOT NULL AND bp) AS b,
  count_if(accepted IS NOT NULL AND tp) AS t FROM o GROUP BY 1)
SELECT stratum, fetched, processed, accepted, processed - accepted AS rejected, round(coalesce(p / processed, 0), 9) AS procedure_completeness, round(coalesce(b / processed, 0), 9) AS buyer_completeness, round(coalesce(t / processed, 0), 9) AS text_completeness,
  round(coalesce(accepted / processed, 0), 9) AS acceptance_yield, accepted >= 100 AND processed <= 300 AND accepted / processed >= 0.25 AND p / processed >= 0.95 AND b / processed >= 0.8 AND t / processed >= 0.8 AS capacity_pass FROM n""")
def q_stratum_summary(spark, d):
    found = qualify.stratum_summary(_observed(spark, d), "stratum", 100)
    return found.select("stratum", "fetched", "processed", "accepted", "rejected", *[F.round(c, 9).alias(c) for c in ("procedure_completeness", "buyer_completeness", "text_completeness", "acceptance_yield")], "capacity_pass")


@query(f"""WITH {_OBSERVED}, n AS (SELECT stratum, count(*) AS fetched, count_if(accepted) AS accepted FROM o GROUP BY 1)
SELECT count(*)::BIGINT AS n_strata, sum(fetched)::BIGINT AS fetched, sum(accepted)::BIGINT AS accepted, bool_and(accepted >= 100) AND list_sort(list(stratum)) = (SELECT list_sort(list(DISTINCT event_type)) FROM events) AS capacity_pass, 0::BIGINT AS retained_items FROM n""")
def q_capacity_receipt(spark, d):
    expected = [r[0] for r in table(spark, d, "events").select("event_type").distinct().collect()]
    return qualify.capacity_receipt(selection.segment_counters(_observed(spark, d), "stratum"), expected, 100)


@query(f"""WITH {_OBSERVED} SELECT stratum, count(*)::BIGINT AS fetched, count(accepted)::BIGINT AS processed, count_if(accepted)::BIGINT AS accepted, count_if(NOT accepted)::BIGINT AS rejected FROM o GROUP BY 1""")
def q_segment_counters(spark, d):
    return selection.segment_counters(_observed(spark, d), "stratum")


@query("""
WITH p AS (SELECT event_type, (event_id // 100)::BIGINT AS page, sum(user_id)::VARCHAR AS signature, count(*) // 5 AS total FROM events GROUP BY 1, 2),
r AS (SELECT *, page <> lag(page) OVER w + 1 AS gap, total <> lag(total) OVER w AS changed FROM p WINDOW w AS (PARTITION BY event_type ORDER BY page))
SELECT event_type, count(*)::BIGINT AS pages, count(DISTINCT signature)::BIGINT AS unique_pages, (count(*) - count(DISTINCT signature))::BIGINT AS repeated_pages, count_if(gap)::BIGINT AS gaps, count_if(changed)::BIGINT AS total_changes FROM r GROUP BY 1""")
def q_pagination_continuity(spark, d):
    pages = table(spark, d, "events").groupBy("event_type", F.floor(F.col("event_id") / 100).alias("page")).agg(F.sum("user_id").cast("string").alias("signature"), F.floor(F.count(F.lit(1)) / 5).alias("total"))
    return qualify.pagination(pages, "event_type")


@query("""
WITH l AS (SELECT event_type, event_id // 100 AS seq, count(*)::BIGINT AS attempts, sum(length(props))::BIGINT AS bytes FROM events GROUP BY 1, 2),
u AS (SELECT event_type, seq, count(*) OVER w::BIGINT AS requests_used, sum(attempts) OVER w::BIGINT AS attempts_used, sum(bytes) OVER w::BIGINT AS bytes_used FROM l WINDOW w AS (PARTITION BY event_type ORDER BY seq))
SELECT event_type, seq, requests_used, attempts_used, bytes_used, CASE WHEN requests_used > 40 THEN 'request_budget_exhausted' WHEN attempts_used > 500 THEN 'attempt_budget_exhausted' WHEN bytes_used > 7000 THEN 'response_byte_budget_exhausted' END AS exceeded FROM u""")
def q_run_budget(spark, d):
    log = table(spark, d, "events").groupBy("event_type", F.floor(F.col("event_id") / 100).alias("seq")).agg(F.count(F.lit(1)).alias("attempts"), F.sum(F.length("props")).alias("bytes"))
    return qualify.run_budget(log, "seq", 40, 500, 7000, "event_type").select("event_type", "seq", "requests_used", "attempts_used", "bytes_used", "exceeded")


@query("SELECT o_orderkey, least(0.5 * pow(2, o_orderkey % 9), 8.0) AS pause FROM orders")
def q_backoff_schedule(spark, d):
    return table(spark, d, "orders").select("o_orderkey", values.backoff_seconds(F.col("o_orderkey") % 9 + 1, 0.5, 8.0).alias("pause"))


@query("SELECT round(avg((length(c_name) > 0)::INT), 9) AS has_name, round(avg((c_acctbal > 0)::INT), 9) AS in_credit, round(avg((c_mktsegment IN ('BUILDING', 'MACHINERY'))::INT), 9) AS in_segment, count(*)::BIGINT AS n_rows FROM customer")
def q_completeness(spark, d):
    found = metrics.completeness(table(spark, d, "customer"), {"has_name": F.length("c_name") > 0, "in_credit": F.col("c_acctbal") > 0, "in_segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")})
    return found.select(*[F.round(c, 9).alias(c) for c in ("has_name", "in_credit", "in_segment")], "n_rows")


@query()
def q_contact_redaction(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.redact_contacts(F.col("text")).alias("r"))
    return rows.select("doc_id", F.col("r.count").alias("redacted"), text.residual_contacts(F.col("r.text")).alias("residual"), F.sha2("r.text", 256).alias("text_sha256"))


@query(r"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'identity key: userName' END AS a, CASE WHEN contains(text, 'token = ') THEN 'secret in data' END AS b FROM documents)
SELECT doc_id, concat_ws('|', a, b) AS found FROM f WHERE a IS NOT NULL OR b IS NOT NULL""")
def q_privacy_scan(spark, d):
    metadata = F.when(F.col("doc_id") % 5 == 0, F.lit('{"userName":"x","state":"open"}')).otherwise('{"state":"open"}')
    found = quality.privacy_violations(table(spark, d, "documents").select("doc_id", "text", metadata.alias("source_metadata")), ("token = ",))
    return found.select("doc_id", F.array_join("found", "|").alias("found"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}') OR regexp_matches(text, '(^|[^0-9A-Za-z_])@[A-Za-z0-9_-]+') OR regexp_matches(text, '(?i)https?://github\.com/[a-z0-9_.-]+(/|\s|$)') AS named FROM documents""")
def q_identity_patterns(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(quality.HANDLES).alias("named"))


@query()
def q_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_body_to_text(F.col("html")).alias("body"), text.html_title_to_text(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, starts_with(url, 'https://') AND regexp_extract(url, '^https?://([^/:?#]+)', 1) LIKE '%.example.net' AND regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) LIKE '/en/%' AS canonical FROM pages""")
def q_url_predicates(spark, d):
    host = F.try_parse_url("url", F.lit("HOST"))
    ok = values.canonical_url(F.col("url"), F.lower(host), F.lit("/en/")) & F.endswith(host, F.lit(".example.net"))
    return table(spark, d, "pages").select("page_id", host.alias("host"), F.coalesce(ok, F.lit(False)).alias("canonical"))


@query("SELECT json_keys(props)[1] AS key, count(*)::BIGINT AS n, count_if(json_keys(props)[1] IN ('state', 'labels', 'k')) = count(*) AS allowed FROM events GROUP BY 1")
def q_metadata_allowlist(spark, d):
    keys = F.json_object_keys("props")
    rows = table(spark, d, "events").select(text.canonical_key(F.get(keys, F.lit(0))).alias("key"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("key").isin("state", "labels", "k")).alias("allowed"))


@query("""
WITH s AS (SELECT source, avg(quality) AS score, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1),
e AS (SELECT source, round(score, 9) AS score, CASE WHEN score >= 0.85 THEN 'pass' WHEN score >= 0.8 THEN 'provisional' ELSE 'fail' END AS eligibility FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY eligibility ORDER BY score DESC, source)::INT AS place FROM e WHERE eligibility <> 'fail')
SELECT source, CASE WHEN eligibility = 'pass' THEN 'primary' ELSE 'fallback' END AS role, place, score FROM r WHERE eligibility = 'provisional' OR place <= 3""")
def q_top_sources(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("quality").alias("raw"))
    e = s.select("source", F.round("raw", 9).alias("score"), F.when(F.col("raw") >= 0.85, "pass").when(F.col("raw") >= 0.8, "provisional").otherwise("fail").alias("eligibility"))
    return metrics.primary_sources(e, "source")


@query("""
SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)
UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'distinct', count(*) FROM (SELECT DISTINCT source FROM documents)""")
def q_set_ops(spark, d):
    a, b = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id")
    i = a.select("doc_id")
    parts = {"union": i.unionAll(b), "except": i.exceptAll(b), "intersect": i.intersect(b), "distinct": a.select("source").distinct()}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("""WITH j AS (SELECT n_nationkey AS id, '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' AS json FROM nation) SELECT count(*)::BIGINT AS n_rows, sha256(string_agg(json, chr(10) ORDER BY id)) AS dataset_sha256 FROM j""")
def q_dataset_hash(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), ids.canonical_json_text(F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")))).alias("json"))
    return ids.dataset_sha256(rows, "id", "json")


@query("SELECT count(*)::BIGINT AS n_rows, sum(('0x' || substr(sha256(text), 1, 15))::BIGINT)::VARCHAR AS checksum FROM documents")
def q_dataset_checksum(spark, d):
    return ids.dataset_checksum(table(spark, d, "documents"), "text").withColumn("checksum", F.col("checksum").cast("string"))


@query("SELECT conv_id, count(*)::BIGINT AS n_turns, count_if(turn = 0)::BIGINT AS n_top, max(length(text)) FILTER (WHERE turn > 0)::BIGINT AS longest_reply FROM conversations GROUP BY 1")
def q_thread_top_level(spark, d):
    top = F.col("turn") == 0
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(top).alias("n_top"), F.max(F.when(~top, F.length("text"))).cast("bigint").alias("longest_reply"))


@query("""WITH m AS (SELECT conv_id, max(text) FILTER (WHERE role = 'user' AND turn = 0) AS en, max(text) FILTER (WHERE role = 'assistant' AND turn = 1) AS de FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN coalesce(trim(en), trim(de), '') ELSE coalesce(trim(de), '') END AS chosen FROM m""")
def q_language_select(spark, d):
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when((F.col("role") == "user") & (F.col("turn") == 0), F.col("text"))).alias("en"), F.max(F.when((F.col("role") == "assistant") & (F.col("turn") == 1), F.col("text"))).alias("de"))
    field = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.col("de").alias("deu"), F.array("en").alias("ENG")))).otherwise(F.to_json(F.array("de")))
    return m.select("conv_id", text.select_language(field).alias("chosen"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("loss", "money", "willingness_to_pay", "problem", "counter", "solution_gap")))
    e = table(spark, d, "events")
    return e.select(
        (F.col("user_id") % 40).alias("cluster"), F.col("user_id").cast("string").alias("author_hash"), (F.col("event_id") % 17).cast("string").alias("evidence_group_id"), F.col("ts").alias("published_at"),
        F.get(kinds, (F.col("event_id") % 6).cast("int")).alias("kind"), F.concat(F.lit("https://h/"), F.col("event_type")).alias("source_url"),
    )


@query("""
WITH e AS (SELECT user_id % 40 AS cluster, user_id, event_id % 17 AS g, ts, event_type, ['loss', 'money', 'willingness_to_pay', 'problem', 'counter', 'solution_gap'][event_id % 6 + 1] AS kind FROM events),
n AS (SELECT cluster, count(DISTINCT user_id)::BIGINT AS n_authors, count(DISTINCT g)::BIGINT AS n_groups, count_if(ts > TIMESTAMP '2024-01-31' - INTERVAL 90 DAYS AND ts <= TIMESTAMP '2024-01-31')::BIGINT AS n_recent, count_if(kind = 'loss')::BIGINT AS n_loss,
  count_if(kind IN ('money', 'willingness_to_pay'))::BIGINT AS n_money, count(DISTINCT CASE WHEN kind <> 'counter' THEN event_type END)::BIGINT AS n_links FROM e GROUP BY 1),
a AS (SELECT *, CASE WHEN cluster % 5 = 0 THEN 'NOT_ASSESSED' WHEN cluster % 7 = 1 THEN 'CRITICAL' ELSE 'NONE_CRITICAL' END AS counter_status FROM n)
SELECT *, n_authors >= 5 AND n_groups >= 3 AND n_recent >= 10 AND n_loss >= 2 AND n_money >= 2 AND n_links >= 3 AND counter_status = 'NONE_CRITICAL' AS evidence_backed FROM a""")
def q_evidence_gate(spark, d):
    assessed = spark.range(40).where("id % 5 > 0").select(F.col("id").alias("cluster"), F.when(F.col("id") % 7 == 1, "CRITICAL").otherwise("NONE_CRITICAL").alias("counter_status"))
    return opportunity.evidence_gate(_evidence(spark, d), assessed, "cluster", F.lit("2024-01-31").cast("timestamp_ntz"))


_CARDS = """c AS (SELECT p_partkey AS card_id, p_size % 3 AS n_alternatives, p_size % 4 AS n_solutions, p_size % 2 + 1 AS n_channels, CASE WHEN p_size % 5 > 0 THEN 'PRODUCTIZABLE' ELSE 'SERVICE' END AS productizable, CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS n_blockers,
  CASE WHEN p_size % 11 > 0 THEN 'NONE_FOUND' ELSE 'UNCLEAR' END AS regulation, p_size % 4 AS n_gaps, p_size, p_retailprice, p_brand FROM part)"""


def _cards(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("card_id"), (s % 3).alias("n_alternatives"), (s % 4).alias("n_solutions"), (s % 2 + 1).alias("n_channels"), F.when(s % 5 > 0, "PRODUCTIZABLE").otherwise("SERVICE").alias("productizable"), F.when(s % 7 == 0, 1).otherwise(0).alias("n_blockers"),
        F.when(s % 11 > 0, "NONE_FOUND").otherwise("UNCLEAR").alias("regulation"), (s % 4).alias("n_gaps"), "p_size", "p_retailprice", "p_brand",
    )


@query(f"WITH {_CARDS} SELECT card_id, n_alternatives >= 1 AND n_solutions >= 1 AND n_channels >= 1 AND productizable = 'PRODUCTIZABLE' AND n_blockers = 0 AND regulation = 'NONE_FOUND' AND n_gaps >= 2 AS actionable FROM c")
def q_actionability_gate(spark, d):
    return opportunity.actionability_gate(_cards(spark, d)).select("card_id", "actionable")


_VALUE = "round(least(100.0, greatest(0.0, (p_size % 101) * 0.30 + (p_size * 2 % 101) * 0.25 + (p_size * 3 % 101) * 0.20 + (p_size * 5 % 101) * 0.15 + (p_size * 7 % 101) * 0.10 - p_size % 4)), 6)"


def _valued(spark: SparkSession, d: str) -> DataFrame:
    part = [(F.col("p_size") * k % 101).cast("double") for k in (1, 2, 3, 5, 7)]
    return _cards(spark, d).withColumn("review_value", F.round(opportunity.review_value(*part, (F.col("p_size") % 4).cast("double")), 6))


@query(f"WITH {_CARDS} SELECT card_id, {_VALUE}::DOUBLE AS review_value FROM c")
def q_review_value(spark, d):
    return _valued(spark, d).select("card_id", "review_value")


@query(f"""
WITH {_CARDS}, v AS (SELECT card_id, {_VALUE}::DOUBLE AS review_value, p_brand AS stratum FROM c), b AS (SELECT *, row_number() OVER (ORDER BY review_value DESC, card_id)::INT AS place FROM v),
r AS (SELECT *, sha256('23' || chr(0) || 'audit' || chr(0) || stratum || chr(0) || card_id::VARCHAR) AS draw FROM b WHERE place > 25), n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY draw, card_id) AS k FROM r)
SELECT card_id, review_value, stratum, place, CASE WHEN place <= 20 THEN 'top' ELSE 'boundary' END AS reason FROM b WHERE place <= 25
UNION ALL SELECT card_id, review_value, stratum, NULL, 'random' FROM (SELECT * FROM n WHERE k <= 5 ORDER BY k, draw, card_id LIMIT 5)""")
def q_top20_audit(spark, d):
    return opportunity.audit_sample(_valued(spark, d).withColumnRenamed("p_brand", "stratum"), 23)


@query("""
WITH g AS (SELECT user_id, count_if(ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-03')::BIGINT AS n_before, count_if(ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05')::BIGINT AS n_after FROM events GROUP BY 1)
SELECT user_id, n_before, n_after, CASE WHEN n_before + n_after = 0 THEN 'EXCLUDED' WHEN n_before = 0 THEN 'UNKNOWN' ELSE 'KNOWN' END AS growth_status, round(CASE WHEN n_before > 0 THEN (n_after - n_before) / n_before END, 9) AS growth FROM g""")
def q_growth(spark, d):
    return opportunity.growth(table(spark, d, "events"), "user_id", "ts", "2024-01-01", "2024-01-03", "2024-01-05").withColumn("growth", F.round("growth", 9))


@query("""
WITH a AS (SELECT quality = 1 AS predicted, doc_id % 10 > 0 AS correct, doc_id % 4 = 0 AS boundary, doc_id % 6 = 0 AS merged, (doc_id % 9)::DOUBLE AS minutes FROM labels),
n AS (SELECT round(avg(correct::INT) FILTER (WHERE predicted), 9) AS positive_precision, round(avg((NOT correct)::INT) FILTER (WHERE boundary), 9) AS boundary_error, round(avg((NOT correct)::INT) FILTER (WHERE merged), 9) AS merge_error, median(minutes) AS median_minutes FROM a)
SELECT *, positive_precision >= 0.8 AND boundary_error <= 0.3 AND merge_error <= 0.1 AND median_minutes <= 5 AS passed FROM n""")
def q_audit_metrics(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "labels").select((F.col("quality") == 1).alias("predicted"), (i % 10 > 0).alias("correct"), (i % 4 == 0).alias("boundary"), (i % 6 == 0).alias("merged"), (i % 9).cast("double").alias("minutes"))
    found = opportunity.audit_metrics(rows)
    return found.select(*[F.round(c, 9).alias(c) for c in ("positive_precision", "boundary_error", "merge_error")], "median_minutes", "passed")


@query(f"""WITH RECURSIVE k AS (SELECT doc_id, 't' || sha256({_FOLD}) AS key FROM documents UNION ALL SELECT doc_id, 'a' || (doc_id % 211) FROM documents WHERE doc_id % 7 = 0),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, b.doc_id FROM reach r JOIN k a ON a.doc_id = r.other JOIN k b ON a.key = b.key)
SELECT id AS doc_id, min(other) AS group_id FROM reach GROUP BY 1""")
def q_independence_groups(spark, d):
    rows = _items(spark, d).select("doc_id", text.text_fingerprint(F.col("text")).alias("fp"), F.when(F.col("doc_id") % 7 == 0, F.col("author_hash")).alias("author"))
    return opportunity.independence_groups(rows, "doc_id", {"text": F.col("fp"), "author": F.col("author")}).select("doc_id", "group_id")


@query("""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.4),
reach(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN l ON l.a = r.other)
SELECT id AS vec_id, min(other) AS cluster_id FROM reach GROUP BY 1""")
def q_cluster_similarity(spark, d):
    """At a cosine that some of the tables' vectors reach."""
    links = opportunity.similarity_links(table(spark, d, "embeddings"), "vec_id", "embedding", 0.4, spanning=True)
    roots = opportunity.components(links.select("a", "b"))
    return table(spark, d, "embeddings").join(roots, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.coalesce("root", "vec_id").alias("cluster_id"))


@query("SELECT event_id, strftime(make_timestamp((event_id * 86413)::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS published_at FROM events")
def q_epoch_iso(spark, d):
    return table(spark, d, "events").select("event_id", values.epoch_to_iso(F.col("event_id") * 86413).alias("published_at"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE END AS day FROM orders")
def q_notice_date(spark, d):
    at = F.col("o_orderdate")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(at, "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("+02:00"))).otherwise(F.date_format(at, "dd.MM.yyyy"))
    return table(spark, d, "orders").select("o_orderkey", values.notice_date(shown).alias("day"))


@query("SELECT o_custkey, list_aggregate(list_sort(list(DISTINCT trim(o_orderpriority))), 'string_agg', chr(0)) AS buyer_key, ceil(count(*) * 1.5)::BIGINT AS required FROM orders GROUP BY 1")
def q_buyer_key(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_list("o_orderpriority")).alias("buyers"), F.count(F.lit(1)).alias("n"))
    return n.select("o_custkey", parse.buyer_key(F.col("buyers")).alias("buyer_key"), values.required_capacity(F.col("n"), 1.5).alias("required"))


@query("SELECT CASE WHEN n >= 30 THEN 'target_reached' ELSE 'source_exhausted' END AS termination, CASE WHEN n >= 30 THEN 'success' WHEN n > 0 THEN 'partial' ELSE 'failed' END AS status, count(*)::BIGINT AS runs FROM (SELECT user_id, count_if(value > 50) AS n FROM events GROUP BY 1) GROUP BY 1, 2")
def q_run_status(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("n")).withColumn("termination", F.when(F.col("n") >= 30, "target_reached").otherwise("source_exhausted"))
    return n.groupBy("termination", qualify.run_status(F.col("termination"), F.col("n")).alias("status")).agg(F.count(F.lit(1)).alias("runs"))


@query("""
WITH s AS (SELECT o_orderpriority AS segment, count(*)::BIGINT AS fetched, count_if(o_orderstatus = 'F')::BIGINT AS accepted FROM orders GROUP BY 1), r AS (SELECT o_orderpriority AS segment, o_orderstatus AS reason, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL)
SELECT s.*, string_agg(r.reason || '=' || r.n, ',' ORDER BY r.reason) AS reasons FROM s LEFT JOIN r USING (segment) GROUP BY ALL""")
def q_reason_maps(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("segment"), F.col("o_orderstatus").alias("reason"))
    segments = o.groupBy("segment").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("reason") == "F").alias("accepted"))
    found = qualify.with_reason_counts(segments, o.where("reason <> 'F'"), "segment")
    return found.select("segment", "fetched", "accepted", F.array_join(F.transform(F.map_entries("rejection_reason_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("reasons"))


_RESULT = """o AS (SELECT o_orderkey AS k, o_orderkey % 5 + 1 AS requests, o_orderkey % 6 AS successful, o_orderkey % 5 + 1 + o_orderkey % 3 AS attempts, o_orderkey % 4 AS retries, o_orderkey % 3 AS n, o_orderkey % 7 = 0 AS failed FROM orders),
s AS (SELECT *, CASE WHEN n = 2 AND NOT failed THEN 'success' WHEN n > 0 AND NOT failed THEN 'partial' ELSE 'failed' END AS wanted FROM o)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Collection results out of orders: counters that often contradict each other."""
    k, n, failed = F.col("o_orderkey"), F.col("o_orderkey") % 3, F.col("o_orderkey") % 7 == 0
    none = F.lit(None).cast("string")
    segment = F.struct(F.lit("stratum").alias("segment_type"), F.lit("a").alias("segment_id"), F.lit(2).cast("bigint").alias("quota"), n.alias("accepted"), (n + 1).alias("fetched"), (n + 1).alias("processed"), F.lit(1).cast("bigint").alias("rejected"))
    status = F.when(k % 2 == 0, results.expected_status(n, F.lit(2), n == 2, F.when(failed, "prerequisite_failed").otherwise("target_reached"))).otherwise("success")
    event = F.struct(
        F.lit(1).cast("bigint").alias("sequence"), F.when(k % 11 == 0, "odd").otherwise("timeout").alias("category"), F.lit(1).cast("bigint").alias("attempt"), (F.lit(200) + k % 401).alias("status_code"), F.lit(True).alias("retryable"),
        F.struct(*[F.lit(1).cast("bigint").alias(c) for c in results.LIMIT_NUMBERS], F.when(k % 2 == 0, "core").otherwise("x").alias("resource")).alias("rate_limit"),
    )
    return table(spark, d, "orders").select(
        k, *[F.lit("x").alias(c) for c in ("source", "run_id", "manifest_version", "adapter_version")], F.lit("2024-01-01").cast("timestamp").alias("started_at"), F.lit("2024-01-02").cast("timestamp").alias("finished_at"), F.lit(2).cast("bigint").alias("target_valid_count"),
        (k % 5 + 1).alias("request_count"), F.lit(1).cast("bigint").alias("response_bytes"), (k % 4).alias("retry_count"), F.lit(0).cast("bigint").alias("rate_limit_events"), (k % 6).alias("successful_request_count"), (k % 5 + 1 + k % 3).alias("http_attempt_count"),
        (n + 1).alias("fetched_item_count"), (n + 1).alias("processed_item_count"), n.alias("accepted_item_count"), F.lit(1).cast("bigint").alias("rejected_item_count"), F.array(event).alias("transport_events"), n.alias("n_items"), F.lit(1).cast("bigint").alias("n_invalid_items"),
        F.array(segment).alias("segments"), F.lit("a" * 64).alias("manifest_hash"), none.alias("compliance_hash"), F.when(failed, "prerequisite_failed").otherwise("target_reached").alias("termination_reason"), status.alias("status"),
        F.when(status != "success", "some_code").alias("error_code"), none.alias("error_message"),
    )


@query(f"""WITH {_RESULT}, t AS (SELECT *, CASE WHEN k % 2 = 0 THEN wanted ELSE 'success' END AS status FROM s)
SELECT k AS o_orderkey, concat_ws('; ', CASE WHEN successful > requests THEN 'more successes than requests' END, CASE WHEN retries <> attempts - requests THEN 'retries must be attempts beyond requests' END,
  CASE WHEN k % 11 = 0 OR k % 401 > 399 OR k % 2 = 1 THEN 'a transport event is out of its lists' END, CASE WHEN failed AND n > 0 THEN 'a failed prerequisite keeps no items' END, CASE WHEN status <> wanted THEN 'status must be ' || wanted END) AS errors FROM t""")
def q_result_errors(spark, d):
    return _results(spark, d).select("o_orderkey", F.array_join(results.result_errors(), "; ").alias("errors"))


@query(f"WITH {_RESULT} SELECT wanted AS status, CASE WHEN wanted <> 'success' THEN CASE WHEN failed THEN 'prerequisite_failed' ELSE 'target_reached' END END AS error_code, count(*)::BIGINT AS runs FROM s GROUP BY 1, 2")
def q_result_status(spark, d):
    rows = _results(spark, d).withColumn("status", results.expected_status(F.col("n_items"), F.col("target_valid_count"), F.forall("segments", lambda s: s["accepted"] == s["quota"]), F.col("termination_reason")))
    return rows.groupBy("status", results.error_code(F.col("termination_reason"), F.col("status")).alias("error_code")).agg(F.count(F.lit(1)).alias("runs"))


@query("""SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE 'timeout' END AS category, CASE WHEN o_orderkey % 2 = 0 THEN 'core' ELSE 'unknown' END AS resource, count(*)::BIGINT AS n, count_if(o_orderkey % 11 > 0)::BIGINT AS timeouts FROM orders GROUP BY 1, 2""")
def q_safe_events(spark, d):
    rows = _results(spark, d).select(F.transform("transport_events", results.safe_event).alias("events"))
    rows = rows.select(F.get("events", F.lit(0)).alias("e"), results.events_of(F.col("events"), "timeout").alias("t"))
    return rows.groupBy(F.col("e.category").alias("category"), F.col("e.rate_limit.resource").alias("resource")).agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("timeouts"))


@query("SELECT o_orderkey, o_custkey % 50 < 10 + (12 - o_orderkey % 12) AS stops, o_orderkey % 3 > 0 AS observed FROM orders")
def q_quota_reserve(spark, d):
    k = F.col("o_orderkey")
    code = F.when(k % 3 == 0, "runner_run_id_mismatch").when(k % 3 == 1, "transport_error")
    return table(spark, d, "orders").select(k, results.quota_reserve_reached(F.col("o_custkey") % 50, F.lit(10), F.lit(12), k % 12).alias("stops"), results.metrics_observed(code).alias("observed"))


@query("""WITH r AS (SELECT split_part(o_orderpriority, '-', 1) AS stratum, o_orderstatus AS reason FROM orders), c AS (SELECT stratum, reason, count(*)::BIGINT AS n FROM r GROUP BY 1, 2), t AS (SELECT DISTINCT split_part(o_orderpriority, '-', 1) AS stratum FROM orders UNION ALL SELECT '9')
SELECT t.stratum, c.reason, coalesce(c.n, 0)::BIGINT AS n FROM t LEFT JOIN c USING (stratum)""")
def q_stratum_rejections(spark, d):
    o = table(spark, d, "orders")
    strata = o.select(F.substring_index("o_orderpriority", "-", 1).alias("stratum")).distinct().unionByName(spark.range(1).select(F.lit("9").alias("stratum")))
    return results.rejections_by_stratum(o.select(F.concat(F.substring_index("o_orderpriority", "-", 1), F.lit(":"), "o_orderkey").alias("source_item_id"), F.col("o_orderstatus").alias("reason")), strata)


from . import contract_queries, evidence_queries, run_queries  # noqa: E402, F401  their queries register themselves
