import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import metrics, opportunity, parse, qualify, quality, review, sampling
from quernstone.schemas import ISSUE, LABEL, NOTICE, NOTICE_FIELDS, QUESTION, REVIEW, SUBMISSION

RUN = parse.Run(b"k" * 32, "run-1", "1.0.0", "2024-05-01T00:00:00Z")
BODY = "This issue has a body that is long enough to be kept as a record."


def read(spark, rows, schema):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


def reasons(parsed):
    return {r.source_item_id: r.reason for r in parsed.collect()}


def test_issues(spark):
    base = {"number": 5, "html_url": "https://h/x", "title": " A  title ", "body": BODY, "created_at": "2024-01-01T00:00:00Z", "comments": 2, "state": "open", "labels": [{"name": " bug "}, {"name": ""}], "user": {"id": 7}}
    rows = [base | {"id": "1"}, base | {"id": "2", "pull_request": {"url": "u"}}, base | {"id": "3", "body": None}, base | {"id": "4", "body": "short", "title": ""}, base | {"id": "5", "created_at": "yesterday"}, base | {"id": "6", "user": None}]
    parsed = parse.parse_issues(read(spark, rows, ISSUE), "o/r", RUN)
    assert reasons(parsed) == {"1": None, "2": "pr_not_issue", "3": "missing_body", "4": "short_text", "5": "invalid_timestamp", "6": None}
    good = quality.with_errors(parse.accepted(parsed)).collect()
    assert [r.errors for r in good] == [[], []] and good[0].text == "A title " + BODY and json.loads(good[0].source_metadata)["labels"] == ["bug"]
    assert good[0].author_hash != good[1].author_hash and good[0].engagement.comments == 2


def test_questions_and_reviews(spark):
    q = {"title": "T &amp; U", "body": f"<p>{BODY}</p>", "creation_date": 1700000000, "link": "https://s.com/questions/1/x", "tags": ["a"], "content_license": "CC BY-SA 4.0", "owner": {"user_id": 3}}
    rows = [q | {"question_id": 1}, q | {"question_id": 2, "content_license": None}, q | {"question_id": 3, "body": ""}, q | {"question_id": 4, "link": "http://s.com/questions/1"}]
    assert reasons(parse.parse_questions(read(spark, rows, QUESTION), "site", RUN)) == {"site:1": None, "site:2": "missing_license", "site:3": "missing_body", "site:4": "invalid_url"}
    v = {"author": {"steamid": "9"}, "review": BODY, "timestamp_created": 1700000000, "voted_up": True, "votes_up": -1, "comment_count": 4}
    rows = [v | {"recommendationid": "1"}, v, v | {"recommendationid": "3", "review": " "}, v | {"recommendationid": "4", "review": "x"}, v | {"recommendationid": "5", "timestamp_created": 5}]
    parsed = parse.parse_reviews(read(spark, rows, REVIEW), 10, "Game", "2023-01-01", "2024-01-01", RUN)
    assert reasons(parsed) == {"10:1": None, None: "missing_item_id", "10:3": "missing_body", "10:4": "short_text", "10:5": "outside_time_window"}
    good = parse.accepted(parsed).first()
    assert "9" not in json.dumps(good.source_metadata) and good.engagement.helpful is None and good.engagement.comments == 4


def notice(**over):
    base = {"publication-number": "1-2024", "notice-identifier": "n1", "procedure-identifier": ["p1"], "publication-date": "20240110", "notice-type": "cn", "form-type": "competition", "classification-cpv": ["48000000", "72000000"], "buyer-identifier": ["b2", "b1", "b1"], "notice-title": {"eng": "Software"}, "description-proc": {"eng": [BODY]}}
    base |= {k.replace("_", "-"): v for k, v in over.items()}
    return tuple(json.dumps(base[f]) if base.get(f) is not None else None for f in NOTICE_FIELDS)


def test_notices(spark):
    data = [notice(), notice(notice_identifier="n2", buyer_identifier=[]), notice(notice_identifier=None), notice(notice_identifier="n4", publication_date="soon"), notice(notice_identifier="n5", description_proc=BODY + " call 010-1234-5678")]
    parsed = parse.parse_notices(spark.createDataFrame(data, NOTICE), "cpv48", RUN)
    assert reasons(parsed) == {"n1": None, "n2": "missing_buyer_id", None: "missing_item_id", "n4": "invalid_timestamp", "n5": None}
    assert {r.source_item_id: json.loads(r.source_metadata)["redacted_contact_count"] for r in parse.accepted(parsed).collect()} == {"n1": 0, "n5": 1}
    cases = [({}, None), ({"notice_identifier": {"a": "b"}}, "invalid_field_shape"), ({"procedure_identifier": None}, "missing_procedure_id"), ({"buyer_identifier": [" "]}, "missing_buyer_id"), ({"notice_title": None, "description_proc": ""}, "missing_text"),
             ({"publication_date": "20250110"}, "outside_window"), ({"form_type": "result"}, "wrong_notice_scope"), ({"classification_cpv": "72000000"}, "wrong_cpv_stratum"), ({"change_notice_version_identifier": "c"}, "change_notice")]
    measured = parse.measure_notices(spark.createDataFrame([notice(**c) for c, _ in cases], NOTICE).coalesce(1))
    found = measured.select(parse.notice_reason("2024-01-01", "2024-04-01", "competition", ("cn",), "48").alias("r")).collect()
    assert [r.r for r in found] == [want for _, want in cases]


def test_every_error_is_reported(spark):
    item = parse.accepted(parse.parse_issues(read(spark, [{"id": "1", "number": 5, "html_url": "https://h/x", "title": "t", "body": BODY, "created_at": "2024-01-01T00:00:00Z"}], ISSUE), "o/r", RUN))
    bad = item.withColumns({"document_id": F.lit("other"), "text_length": F.lit(4000).cast("long"), "source_metadata": F.lit('{"userName":"x","odd":1}'), "text": F.concat("text", F.lit("  end"))})
    errors = quality.with_errors(bad).first().errors
    assert len(errors) == 6 and "identity key: userName" in errors
    assert quality.with_errors(item.withColumn("source_metadata", F.lit('{"odd":1}'))).first().errors == ["key not allowed: odd"]
    shapeless = item.withColumns({"title": F.lit(""), "text_length": F.lit(3).cast("long"), "author_hash": F.lit("x"), "source_metadata": F.lit('{"state":{"a":NaN,"a":1}}')})
    assert quality.with_errors(shapeless).first().errors == ["author_hash: pattern", "source_metadata.state.a: non-finite number", "source_metadata.state.a: repeated key", "source_metadata: type object", "text_length: minimum 40", "title: oneOf"]
    assert quality.privacy_violations(bad, ("other",)).first().found == ["identity key: userName", "secret in data"]
    assert quality.privacy_violations(item, ("nowhere",)).count() == 0


def test_densities(spark):
    labels = spark.createDataFrame([(i < 3,) for i in range(10)], "s boolean")
    row = metrics.signal_density(labels, ("s",)).first()
    assert (row.positive, row.total) == (3, 10) and abs(row.wilson_low - 0.1078) < 1e-3 and abs(row.wilson_high - 0.6032) < 1e-3
    money = spark.createDataFrame([(True, False), (True, True), (False, False), (False, False)], "money_signal boolean, structural_money_signal boolean")
    assert tuple(metrics.money_density(money).first()) == (0.5, 0.25)


@pytest.mark.parametrize(("a", "b", "status", "raw", "passed"), [("FFFFF", "FFFFT", "prevalence_limited", 0.8, True), ("TTFFT", "TTFFF", "calculated", 0.8, True), ("TFTF", "FTFT", "calculated", 0.0, False)])
def test_agreement(spark, a, b, status, raw, passed):
    row = metrics.agreement(spark.createDataFrame([(x == "T", y == "T") for x, y in zip(a, b)], "a boolean, b boolean")).first()
    assert (row.kappa_status, round(row.raw_agreement, 9), row.passed) == (status, raw, passed)


def test_sources_ranked(spark):
    rows = spark.createDataFrame([("a", "pass", 90.0), ("b", "provisional", 99.0), ("c", "fail", 100.0), ("d", "pass", 80.0)], "source string, eligibility string, score double")
    found = metrics.primary_sources(rows, "source").collect()
    assert {(r.source, r.role) for r in found} == {("a", "primary"), ("d", "primary"), ("b", "fallback")}


def test_sampling_counts_and_order_independence(spark):
    docs = spark.createDataFrame([(s, f"{s}-{i}", f"c{i % 4}") for s in ("x", "y") for i in range(100)], "source string, document_id string, community string")
    one = sampling.assignments(docs, 3)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, sampling.assignments(docs.orderBy(F.rand(1)).repartition(7), 3).collect()))
    n = one.groupBy("source", "assignment_split").agg(F.count("*").alias("n"), F.count_if("requires_second_review").alias("d")).collect()
    assert all(r.n == 10 for r in n) and sum(r.d for r in n) == 10
    two = sampling.stratified_assignments(docs, 3).groupBy("source", "stratum").count().collect()
    assert len(two) == 8 and all(r["count"] == 5 for r in two)


def _submission(i, who="r1", **over):
    base = dict(assignment_id=i, reviewer_id=who, reviewer_independence_asserted=True, problem_signal=True, money_signal=False, money_signal_type=None, structural_money_signal=False, usable_evidence=True, noise=False, label_reason="a reason that is long enough", labeled_at=datetime.datetime(2024, 1, 1), external_context_used=False)
    return tuple((base | over)[c.split()[0]] for c in SUBMISSION.split(", "))


def test_review_round_trip(spark):
    docs = spark.createDataFrame([("x", f"d{i}") for i in range(30)], "source string, document_id string")
    items = docs.select("document_id", F.lit("x").alias("source"), F.lit("t").alias("title"), F.lit(BODY).alias("text"), F.lit("2024").alias("published_at"), F.lit("u").alias("source_url"))
    blind, mapping = review.packet(sampling.assignments(docs, 1), items, "salt")
    assert blind.count() == 20 and "document_id" not in blind.columns
    keys = [(r.assignment_id, r.requires_second_review) for r in mapping.collect()]
    first = spark.createDataFrame([_submission(k) for k, _ in keys], SUBMISSION)
    second = spark.createDataFrame([_submission(k, "r2") for k, s in keys if s], SUBMISSION)
    labels = review.ingest(first, second, mapping, "1.0.0")
    assert labels.count() == 25 and {r.review_round: r.n_labels for r in review.ingestion_counts(labels).collect()} == {"primary": 20, "secondary": 5}
    with pytest.raises(ValueError, match="another reviewer"):
        review.ingest(first, second.withColumn("reviewer_id", F.lit("r1")), mapping, "1")
    with pytest.raises(ValueError, match="missing submission"):
        review.ingest(first.limit(19), second, mapping, "1")
    with pytest.raises(ValueError, match="invalid submission"):
        review.ingest(first.withColumn("label_reason", F.lit("mail me at a@example.org please now")), second, mapping, "1")
    with pytest.raises(ValueError, match="missing"):
        review.packet(sampling.assignments(docs, 1), items.limit(3), "salt")


def test_development_report(spark):
    row = lambda i, rnd, who: (f"l{i}{rnd}", f"d{i}", "x", who, "development", rnd, i % 2 == 0, i % 3 == 0, None, i % 6 == 0, True, False, "r" * 20, datetime.datetime(2024, 1, 1), "1.0.0")
    labels = spark.createDataFrame([row(i, "primary", "a") for i in range(10)] + [row(i, "secondary", "b") for i in range(5)], LABEL)
    density, agreed = metrics.development_report(labels)
    assert {r.field: r.positive for r in density.collect()} == {"problem_signal": 5, "money_signal": 4, "usable_evidence": 10, "noise": 0, "money_signal_adjusted": 2}
    assert agreed.count() == 4
    with pytest.raises(ValueError):
        metrics.development_report(labels.limit(9))


def test_stratum_summary_and_receipts(spark):
    rows = spark.createDataFrame([("s", i < 40 if i < 90 else None, True, i % 5 > 0, True) for i in range(100)], "stratum string, accepted boolean, procedure_present boolean, buyer_present boolean, text_present boolean")
    r = qualify.stratum_summary(rows, "stratum", 38).first()
    assert (r.fetched, r.processed, r.accepted, r.rejected) == (100, 90, 40, 50) and r.buyer_completeness == 0.8 and r.capacity_pass
    none = qualify.stratum_summary(rows.withColumn("accepted", F.lit(None).cast("boolean")), "stratum", 38).first()
    assert none.processed == 0 and none.acceptance_yield == 0 and not none.capacity_pass
    assert qualify.capacity_receipt(qualify.stratum_summary(rows, "stratum", 38), ["s"], 38).first().capacity_pass
    assert not qualify.capacity_receipt(qualify.stratum_summary(rows, "stratum", 38), ["s", "t"], 38).first().capacity_pass


def test_qualification(spark):
    payload = {"number": 5, "title": "t", "created_at": "2024-01-01T00:00:00Z"}
    rows = [payload | {"id": str(i), "html_url": f"https://h/{i}", "body": f"{BODY} {i}", "user": {"id": i}} for i in range(4)]
    items = parse.accepted(parse.parse_issues(read(spark, rows, ISSUE), "o/r", RUN))
    ok = F.startswith("source_url", F.lit("https://h/"))
    assert tuple(qualify.qualify(items, {"o/r": 4}, ok).first()) == (True, [], 4)
    bad = qualify.qualify(items.withColumns({"author_hash": F.lit("a" * 64), "document_id": F.lit("x")}), {"o/r": 5}, ~ok, success=False, provenance=False).first()
    assert bad.failures == sorted(["accepted_count_mismatch", "author_quota_exceeded", "canonical_url_mismatch", "collection_not_successful", "duplicate_document_id", "provenance_mismatch", "raw_item_invalid", "stratum_item_count_mismatch"])


def test_gates(spark):
    day = datetime.datetime(2024, 3, 1)
    ev = [("c", f"a{i % 5}", f"g{i % 3}", day - datetime.timedelta(days=i), k, f"u{i}") for i, k in enumerate(["loss"] * 2 + ["money", "willingness_to_pay"] + ["problem"] * 6)]
    schema = "cluster string, author_hash string, evidence_group_id string, published_at timestamp, kind string, source_url string"

    def gate(rows, status="NONE_CRITICAL"):
        assessed = spark.createDataFrame([("c", status)] if status else [], "cluster string, counter_status string")
        return opportunity.evidence_gate(spark.createDataFrame(rows, schema), assessed, "cluster", F.lit("2024-03-02").cast("timestamp")).first().evidence_backed

    assert gate(ev) and not gate(ev[1:]) and not gate(ev, "CRITICAL") and not gate(ev, None) and gate([*ev, ("c", "a1", "g1", day, "counter", "u")])
    assert not gate([(*r[:5], "one") for r in ev]) and not gate([(*r[:4], "alternative" if r[4] == "money" else r[4], r[5]) for r in ev])
    assert spark.range(1).select(opportunity.review_value(*[F.lit(100.0)] * 5, F.lit(7.0)).alias("v")).first().v == 93.0


def test_independence_groups(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "x"), (4, "b", None), (5, None, None)], "id long, author string, thread string")
    got = {r.id: r.group_id for r in opportunity.independence_groups(rows, "id", {"a": F.col("author"), "t": F.col("thread")}).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


@pytest.mark.parametrize(("chunk", "kind"), [(16_384, "float"), (40, "float"), (40, "double")])
def test_similarity_links_equal_brute_force(spark, chunk, kind):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(150):  # pairs at cosines 0.66 to 0.94, about 0.7 among them
        v, w = rng.normal(size=(2, 24))
        v /= np.linalg.norm(v)
        w -= (w @ v) * v
        c = 0.66 + 0.28 * i / 150
        rows += [(2 * i, (3 * v).tolist()), (2 * i + 1, (c * v + math.sqrt(1 - c * c) * w / np.linalg.norm(w)).tolist())]
    rows += [(300 + i, rows[0][1]) for i in range(60)]  # copies
    bad = [(400, None), (401, [1.0, None, *[0.0] * 22]), (402, [math.nan] * 24), (403, [math.inf] * 24), (404, [0.0] * 24), (405, rows[0][1][:23]), (None, rows[0][1])]
    data = spark.createDataFrame(rows + bad, f"id long, v array<{kind}>").repartition(3)
    x = np.array([v for _, v in rows], "f4" if kind == "float" else "f8").astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j): c for (i, j), c in np.ndenumerate(x @ x.T) if i > j and c >= 0.7}
    assert sum(0.7 <= c < 0.9 for c in want.values()) > 100
    got = {(r.a, r.b): r.cosine for r in opportunity.similarity_links(data, "id", "v", 0.7, chunk=chunk).collect()}
    ids = [i for i, _ in rows]
    assert set(got) == {(ids[i], ids[j]) for i, j in want} and all(abs(got[ids[i], ids[j]] - c) < 1e-12 for (i, j), c in want.items())
    some = opportunity.similarity_links(data, "id", "v", 0.7, spanning=True, chunk=chunk)
    assert some.count() < len(rows) * 10
    roots = {r.node: r.root for r in opportunity.components(some).collect()}
    least = {i: i for i in ids}
    for _ in ids:
        before = dict(least)
        for i, j in want:
            least[ids[i]] = least[ids[j]] = min(least[ids[i]], least[ids[j]])
        if least == before:
            break
    assert {i: roots.get(i, i) for i in ids} == least
    assert opportunity.similarity_links(data.where("false"), "id", "v", 0.7).count() == 0
