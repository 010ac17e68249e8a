import json
import os

import pytest
from pyspark.sql import functions as F

from quernstone.operators import receipts as rules_over_rows
from quernstone.operators import results
from quernstone.plans import receipts

def test_bindings():
    manifest = {k: 1 for k in receipts.CONTRACT_KEYS}
    assert receipts.query_contract_sha256(manifest | {"more": 1}) == receipts.query_contract_sha256(manifest) != receipts.query_contract_sha256(manifest | {"api": 2})
    run = {"run_id": "r", "dataset_sha256": "d"}
    assert receipts.bound_run(run, run, [{"source": "steam"}], "steam") == []
    assert len(receipts.bound_run(run, {"run_id": "x"}, [{"source": "ted"}], "steam")) == 3


def test_authorization(tmp_path):
    smoke = {"status": "PASS", "termination_reason": "target_reached", "accepted": 10, "run_id": "s", "provenance": {"manifest_hash": "m", "capacity_manifest_hash": "c", "authorization_hash": "a"}}
    raw = json.dumps(smoke).encode()
    place = tmp_path / "auth" / "a.json"
    value = receipts.authorize(raw, str(place), str(tmp_path), "2024-01-01T00:00:00Z")
    assert json.loads(place.read_text()) == value and place.stat().st_mode & 0o777 == 0o600 and place.parent.stat().st_mode & 0o777 == 0o700
    assert receipts.authorization_errors(value, raw) == [] and receipts.authorization_errors(value, raw + b" ") == ["smoke_receipt_sha256: mismatch"]
    assert receipts.authorization_errors(value, json.dumps(smoke | {"accepted": 9}).encode()) == ["the smoke run doesn't qualify"]
    with pytest.raises(FileExistsError):
        receipts.authorize(raw, str(place), str(tmp_path), "x")
    os.symlink(tmp_path / "auth", tmp_path / "link")
    for bad in (tmp_path / "link" / "b.json", tmp_path.parent / "out.json", tmp_path / "a" / ".." / ".." / "b.json"):
        with pytest.raises(ValueError):
            receipts.authorize(raw, str(bad), str(tmp_path), "x")
    with pytest.raises(ValueError):
        receipts.output_root(str(tmp_path / "link"))
    assert receipts.output_root(str(tmp_path / "new")).is_dir()


def result(**changes):
    segment = {"segment_type": "repository", "segment_id": "a", "quota": 2, "accepted": 2, "fetched": 4, "processed": 3, "rejected": 1}
    return {
        "source": "github", "run_id": "r", "manifest_version": "1", "adapter_version": "1", "started_at": "2024-01-01 00:00:00", "finished_at": "2024-01-01 00:01:00", "target_valid_count": 2, "request_count": 2, "response_bytes": 5, "retry_count": 1, "rate_limit_events": 0,
        "successful_request_count": 2, "http_attempt_count": 3, "fetched_item_count": 4, "processed_item_count": 3, "accepted_item_count": 2, "rejected_item_count": 1, "n_items": 2, "n_invalid_items": 1, "segments": [segment],
        "transport_events": [{"sequence": 1, "category": "timeout", "attempt": 1, "status_code": None, "retryable": True, "rate_limit": None}], "manifest_hash": "a" * 64, "compliance_hash": None, "termination_reason": "target_reached", "status": "success", "error_code": None, "error_message": None,
    } | changes


def test_result_invariants(spark):
    partial = {"status": "partial", "termination_reason": "source_exhausted", "error_code": "source_exhausted", "target_valid_count": 3}
    cases = [
        (result(), []), (result(**partial), []), (result(**partial | {"error_code": None}), ["error_code: required in lower snake case"]), (result(**partial | {"error_code": "Bad Code"}), ["error_code: required in lower snake case"]),
        (result(status="partial", error_code="x"), ["status must be success"]), (result(error_message="x"), ["a success has no error"]), (result(retry_count=0), ["retries must be attempts beyond requests"]),
        (result(n_items=1), ["accepted must be the items", "status must be partial"]), (result(segments=[]), ["segments: required", "segments' accepted must total the result's", "segments' fetched must total the result's", "segments' processed must total the result's", "segments' rejected must total the result's"]),
        (result(finished_at="2023-01-01 00:00:00"), ["finished before it started"]), (result(manifest_hash="A" * 64), ["manifest_hash: not a digest"]), (result(termination_reason="odd"), ["termination_reason: unknown", "status must be partial"]),
        (result(transport_events=[{"sequence": 0, "category": "timeout", "attempt": 1, "status_code": 700, "retryable": True}]), ["a transport event is out of its lists"]), (result(source=None), ["source: required"]),
        (result(termination_reason="prerequisite_failed", status="failed", error_code="x"), ["a failed prerequisite keeps no items"]),
    ]
    rows = spark.createDataFrame([(json.dumps(r),) for r, _ in cases], "j string").select(F.from_json("j", results.RESULT).alias("r")).select("r.*")
    got = rows.select(results.result_errors().alias("e")).collect()
    for (row, want), e in zip(cases, got):
        assert e.e == want, row
    report = results.smoke_report(spark.createDataFrame([("r", "1", "u", "2024", "f", "private")], "fetch_run_id string, source_item_id string, source_url string, published_at string, text_fingerprint string, text string"), rows.limit(1))
    one = report.first()
    assert "error_message" not in report.columns and [tuple(x) for x in one.accepted_references] == [("1", "u", "2024", "f")] and one.transport_events[0].category == "timeout"
    counts = results.rejections_by_stratum(spark.createDataFrame([("a:1", "short"), ("a:2", "short"), ("b:1", "odd")], "source_item_id string, reason string"), spark.createDataFrame([("a",), ("c",)], "stratum string"))
    assert sorted(map(tuple, counts.collect()), key=str) == [("a", "short", 2), ("c", None, 0)]


COUNTS = {"fetched": 50, "processed": 45, "accepted": 40, "rejected": 5, "reasons": {"short_text": 5}, "procedure_completeness": 1.0, "buyer_completeness": 0.9, "text_completeness": 0.8, "acceptance_yield": 0.88, "capacity_pass": True}
SPENT = {"run_id": "r", "logical_requests": 4, "max_logical_requests": 12, "http_attempts": 5, "max_http_attempts": 24, "retries": 1, "response_bytes": 9, "max_response_bytes": 99, "deadline_seconds": 60.0, "deadline_exhausted": False, "pages_observed": 4, "unique_page_signatures": 4, "repeated_page_signatures": 0, "retained_items": 0, "status": "PASS", "termination_reason": "capacity_reached"}


def broken(spark, spent=(), strata=("a", "b"), **counts):
    rows = [{"run_id": "r", "stratum": s} | COUNTS | (counts if s == "a" else {}) for s in strata]
    schema = "run_id string, stratum string, " + ", ".join(f"{k} {'map<string,bigint>' if k == 'reasons' else 'boolean' if k == 'capacity_pass' else 'double' if '_' in k else 'bigint'}" for k in COUNTS)
    totals = SPENT | dict(spent)
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'bigint'}" for k, v in SPENT.items())
    found = rules_over_rows.contradictions(spark.createDataFrame([tuple(totals[k] for k in SPENT)], kinds), spark.createDataFrame([tuple(r.values()) for r in rows], schema), ["a", "b"], 38)
    return sorted((r.subject, r.rule) for r in found.collect())


def test_stored_verdicts_are_held_against_their_counts(spark):
    assert broken(spark) == []
    for key, value in (("accepted", 37), ("processed", 301), ("procedure_completeness", 0.94), ("acceptance_yield", float("nan")), ("text_completeness", None)):
        assert ("a", "verdict") in broken(spark, **{key: value})
    assert broken(spark, capacity_pass=False, accepted=10, rejected=35, reasons={"x": 35}) == [("run", "a PASS has its strata")]
    assert broken(spark, reasons={"x": 4}) == [("a", "counts")] == broken(spark, rejected=None)
    assert broken(spark, strata=("a",)) == [("run", "strata")] == broken(spark, strata=("a", "a", "b"))[-1:]
    for key, value, rule in (("retries", 9, "transport"), ("response_bytes", 100, "a PASS keeps its budgets"), ("deadline_exhausted", True, "a PASS keeps its budgets"), ("pages_observed", 5, "pages"), ("retained_items", 1, "nothing is kept"), ("termination_reason", "quota_unmet", "verdict"), ("status", "FAIL", "verdict"), ("http_attempts", None, "transport")):
        assert ("run", rule) in broken(spark, {key: value})
