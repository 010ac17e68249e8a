import copy
import json

from pyspark.sql import functions as F

from quernstone.functions.ids import content_sha256
from quernstone.operators import parse
from quernstone.plans import collect, contracts
from quernstone.schemas import ISSUE

RECORD = {"source": "github", "decision": "approved"}


def test_manifests():
    manifest = {"target_valid_records": 4, "sources": [{"source": "github", "compliance_ref": "c", "compliance_hash": content_sha256(RECORD), "compliance_decision": "approved", "strata": [{"name": "a", "target": "x", "quota": 1}, {"name": "b", "target": "y", "quota": 3}]}]}
    assert contracts.manifest_errors(manifest, {"c": RECORD}) == []
    bad = copy.deepcopy(manifest)
    bad["sources"].append(bad["sources"][0])
    bad["target_valid_records"] = 5
    assert len(contracts.manifest_errors(bad, {"c": RECORD | {"decision": "no"}})) == 4
    assert contracts.manifest_errors(manifest, {}) == ["github: compliance record is missing"]
    one = {"source": "github", "target_valid_records": 4, "compliance_hash": content_sha256(RECORD), "compliance_decision": "approved", "repositories": [{"name": "o/A", "quota": 2}, {"name": "o/b", "quota": 2}], "request": {"max_http_attempts": 4, "max_requests": 2}, "retry": {"base_backoff_seconds": 1, "max_backoff_seconds": 8}, "published_after": "2024-01-01T00:00:00Z", "published_before": "2024-03-31T00:00:00Z"}
    assert contracts.collection_errors(one, RECORD, "repositories", "name", (89, 91)) == []
    assert contracts.collection_errors(one | {"repositories": [{"name": "o/A", "quota": 2}, {"name": "O/a", "quota": 1}]}, RECORD, "repositories", "name", (10, 20)) == ["publication window has another length", "quotas don't total the target", "repositories must be unique"]
    assert contracts.frozen_errors({"a": 1}, {"a": 1, "b": 2}) == ["b: frozen value differs"]


def test_events_and_references():
    event = {"sequence": 1, "category": "odd", "attempt": 1, "status_code": 503, "retryable": True, "rate_limit": {"limit": 5, "resource": "x", "token": "t"}, "token": "x"}
    assert contracts.safe_event(event) == {"sequence": 1, "category": "unknown", "attempt": 1, "status_code": 503, "retryable": True, "rate_limit": {"limit": 5, "remaining": None, "reset_at": None, "retry_after_seconds": None, "resource": "unknown"}}
    assert contracts.safe_event({"category": "timeout"})["category"] == "timeout"
    assert contracts.reference_errors({"a": 1}, {"a"}) == [] and contracts.reference_errors({}, {"a"})


def test_preflight_order():
    good = {"result": {"data": [{"id": 1}], "cursor": {"after": None}}}
    run = lambda code=200, size=9, payload=good, canonical=(200,): contracts.preflight(code, size, payload, list(canonical), 10, 5, {"id": lambda x: x.get("id")})["termination_reason"]
    assert [run(), run(None), run(403), run(500), run(size=11), run(payload=None), run(payload={"result": {"data": []}}), run(canonical=(404,)), run(payload={"result": {"data": [{}], "cursor": {"after": 1}}})] == [
        "shape_qualified", "not_attempted", "authentication_required", "http_error", "response_byte_budget_exhausted", "malformed_response", "empty_result", "canonical_anonymous_read_failed", "required_field_incomplete",
    ]


def feasible():
    import hashlib

    return {
        "policy_evidence": [{"id": "e", "captured_excerpt": "x", "captured_excerpt_sha256": hashlib.sha256(b"x").hexdigest(), "manual_revalidation_due_at": "2025-01-01T00:00:00Z"}], "evaluated_at": "2024-01-01T00:00:00Z",
        "required_gates": [{"id": "g", "status": "pass", "evidence_ids": ["e"]}], "data_classes": [{"name": "n", "role": "r", "evidence_ids": ["e"], "persisted": False, "max_retention_days": None, "refresh_method": None, "stable_across_runs": True}],
        "evaluation_profile": {"required_gate_ids": ["g"], "required_data_roles": ["r"], "horizon_gate_ids": {"current_collection": ["g"]}}, "eligibility": {"current_collection": "PASS"}, "authorization_status": "verified", "status": "PASS",
        "blockers": [], "next_action": "probe_capacity", "operational_next_action": "probe_capacity", "recheck_conditions": [], "product_requirements": {"evidence_window_days": 90, "stable_author_identity_required": True},
    }


def test_feasibility():
    assert contracts.feasibility_errors(feasible()) == []
    bad = feasible()
    bad["required_gates"][0]["status"] = "fail"
    assert contracts.feasibility_errors(bad) == ["PASS needs all gates, both horizons, no blocker and a way forward", "current_collection: passes with open gates"]
    assert contracts.feasibility_errors(feasible() | {"authorization_status": "unverified"}) == ["unverified authorization can't go forward"]


def test_run_end_to_end(spark, tmp_path):
    body = "This issue has a body that is long enough to be kept as a record."
    rows = [{"id": str(i), "number": i, "html_url": f"https://h/{i}", "title": "t", "body": f"{body} {i % 12}", "created_at": "2024-01-01T00:00:00Z", "user": {"id": i % 9}} for i in range(20)]
    data = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", ISSUE).alias("r")).select("r.*")
    parsed = parse.parse_issues(data, "o/r", parse.Run(b"k" * 32, "run", "1", "2024-05-01T00:00:00Z"))
    result = collect.collect(parsed, {"o/r": 10}, F.col("source_item_id").cast("long"))
    assert result.termination == "target_reached" and result.items.count() == 10
    assert collect.publish(result, f"file://{tmp_path}", "r1", {"o/r": 10}, F.startswith("source_url", F.lit("https://h/")), 3)["qualified"]
    assert json.loads((tmp_path / "latest-qualified.json").read_text()) == {"run_id": "r1"}
    assert len(list((tmp_path / "runs/r1/assignments").glob("part*"))) > 0
    private = collect.Result(result.items.withColumn("source_metadata", F.lit('{"email":"x"}')), result.rejections, result.segments, "target_reached")
    assert collect.publish(private, f"file://{tmp_path}", "r2", {"o/r": 10}, F.lit(True), 3) == {"qualified": False, "failures": ["privacy_violation"]}
    assert not (tmp_path / "runs/r2").exists() and (tmp_path / "privacy-failures/r2.json").exists()

    def fails():
        raise RuntimeError

    assert collect.isolated(fails, lambda: result).error == "runner_adapter_exception"
    empty = lambda: collect.Result(result.items, result.rejections, result.segments, "x")
    stated = {"source": "github", "adapter_version": "1", "run_id": "run", "manifest_version": "m", "target": 10, "manifest_hash": "h", "compliance_hash": None}
    good = empty()
    good.stated = stated
    assert collect.isolated(lambda: good, empty, stated) is good
    for name, code in collect.MISMATCHES.items():
        assert collect.isolated(lambda: good, empty, stated | {name: "other"}).error == code  # noqa: B023
    borrowed = empty()
    borrowed.error = "runner_source_mismatch"
    assert {collect.isolated(lambda: x, empty).error for x in (None, borrowed)} == {"runner_invalid_adapter_result"}  # noqa: B023
