"""Frozen configuration checks on the driver: each returns its broken rules, sorted and distinct.

These documents are a few kilobytes each, so they are plain dictionaries, not tables.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable
from datetime import datetime

from ..functions.ids import content_sha256
from ..schemas import EVENT_CATEGORIES, EVENT_KEYS, LIMIT_NUMBERS, LIMIT_RESOURCES


def _broken(rules: Iterable[tuple[bool, str]]) -> list[str]:
    return sorted({message for holds, message in rules if holds})


def _repeats(values: Iterable) -> list[str]:
    return sorted(str(v) for v, n in Counter(values).items() if n > 1)


def manifest_errors(manifest: dict, compliance: dict[str, dict]) -> list[str]:
    """Unique sources and strata, quotas that total the target, and compliance records that are the ones bound."""
    target = manifest.get("target_valid_records")
    sources = manifest.get("sources") or []
    rules = [(not isinstance(target, int) or isinstance(target, bool) or target < 1, "target_valid_records: must be a positive integer"), (not sources, "sources: required")]
    rules += [(True, f"{name}: source repeats") for name in _repeats(s.get("source") for s in sources)]
    for s in sources:
        name, strata, record = s.get("source"), s.get("strata") or [], compliance.get(s.get("compliance_ref"))
        rules += [(bool(_repeats(x.get(k) for x in strata)), f"{name}: strata repeat a {k}") for k in ("name", "target")]
        rules.append((sum(x.get("quota", 0) for x in strata) != target, f"{name}: quotas don't total the target"))
        if record is None:
            rules.append((True, f"{name}: compliance record is missing"))
            continue
        rules += [
            (content_sha256(record) != s.get("compliance_hash"), f"{name}: compliance record differs from its hash"), (record.get("source") != name, f"{name}: compliance record is of another source"),
            (record.get("decision") != s.get("compliance_decision"), f"{name}: compliance decision differs"),
        ]
    return _broken(rules)


def collection_errors(manifest: dict, record: dict, strata: str, key: str, window_days: tuple[int, int] | None = None) -> list[str]:
    """A source's collection manifest: strata unique in any case, quotas, budgets, backoff, window and binding."""
    rows, request, retry = manifest.get(strata) or [], manifest.get("request") or {}, manifest.get("retry") or {}
    low, high = retry.get("base_backoff_seconds", 0), retry.get("max_backoff_seconds", 0)
    rules = [
        (bool(_repeats(str(r.get(key)).casefold() for r in rows)), f"{strata} must be unique"), (bool(_repeats(r["archetype"] for r in rows if "archetype" in r)), "archetypes must be unique"),
        (sum(r.get("quota", 0) for r in rows) != manifest.get("target_valid_records"), "quotas don't total the target"), (content_sha256(record) != manifest.get("compliance_hash"), "compliance hash mismatch"),
        (record.get("source") != manifest.get("source"), "compliance source mismatch"), (record.get("decision") != manifest.get("compliance_decision"), "compliance decision mismatch"),
        (request.get("max_http_attempts", 0) < request.get("max_requests", 0), "fewer attempts than requests"), (low > high, "base backoff exceeds the longest"),
    ]
    if window_days:
        span = (_time(manifest["published_before"]) - _time(manifest["published_after"])).days
        rules.append((not window_days[0] <= span <= window_days[1], "publication window has another length"))
    return _broken(rules)


def frozen_errors(value: dict, frozen: dict) -> list[str]:
    """Fields that differ from constants a contract has frozen."""
    return _broken((value.get(k) != v, f"{k}: frozen value differs") for k, v in frozen.items())


def _time(x: str) -> datetime:
    return datetime.fromisoformat(x.replace("Z", "+00:00"))


def feasibility_errors(d: dict) -> list[str]:
    """Evidence intact and current, gates complete and consistent with horizons, status and the next action."""
    evidence, gates, classes, profile = d["policy_evidence"], d["required_gates"], d["data_classes"], d["evaluation_profile"]
    ids = [e["id"] for e in evidence]
    status = {g["id"]: g["status"] for g in gates}
    needed, horizons = set(profile["required_gate_ids"]), profile["horizon_gate_ids"]
    passing = {h: set(g) <= set(status) and all(status[x] == "pass" for x in g) for h, g in horizons.items()}
    all_pass, eligible = all(s == "pass" for s in status.values()), d["eligibility"]
    both, verified, unverified = all(x == "PASS" for x in eligible.values()), d["authorization_status"] == "verified", d["authorization_status"] == "unverified"
    forward, actions, now = {"probe_capacity", "implement_adapter"}, (d["next_action"], d["operational_next_action"]), eligible.get("current_collection") == "PASS"
    rules = [(bool(_repeats(ids)), "policy evidence ids repeat"), (set(status) != needed or len(gates) != len(status), "required gates differ"), (bool(_repeats(c["name"] for c in classes)), "data classes repeat")]
    rules += [(hashlib.sha256(e["captured_excerpt"].encode()).hexdigest() != e["captured_excerpt_sha256"], f"{e['id']}: excerpt differs from its hash") for e in evidence]
    rules += [(_time(e["manual_revalidation_due_at"]) < _time(d["evaluated_at"]), f"{e['id']}: revalidation is overdue") for e in evidence]
    rules += [(not set(x["evidence_ids"]) <= set(ids), f"{x.get('name', x.get('id'))}: unknown evidence") for x in (*classes, *gates)]
    rules += [(sorted(c["role"] for c in classes) != sorted(profile["required_data_roles"]), "data roles differ"), (not needed <= {g for gs in horizons.values() for g in gs}, "a gate has no horizon")]
    for h, gs in horizons.items():
        rules += [(not set(gs) <= set(status), f"{h}: unknown gates"), (eligible.get(h) == "PASS" and not passing[h], f"{h}: passes with open gates"), (verified and eligible.get(h) == "NOT_ELIGIBLE" and passing[h], f"{h}: must pass")]
    window = d["product_requirements"]["evidence_window_days"]
    short = any(c["persisted"] and isinstance(c["max_retention_days"], int) and c["max_retention_days"] < window and c["refresh_method"] is None for c in classes)
    unstable = any(c["role"] == "author_identity" and c["stable_across_runs"] is False for c in classes)
    rules += [
        (status.get("retention") == "pass" and short, "retention passes without a refresh path"), (status.get("author_independence") == "pass" and unstable and d["product_requirements"]["stable_author_identity_required"] is True, "author independence passes without stable identity"),
        (d["status"] == "PASS" and not (all_pass and both and not d["blockers"] and actions[0] in forward), "PASS needs all gates, both horizons, no blocker and a way forward"),
        (d["status"] != "PASS" and (not d["blockers"] or all_pass or both or actions[0] in forward), "NOT_ELIGIBLE needs a blocker, an open gate and horizon, and no way forward"), (now != (actions[1] in forward), "operational action contradicts current eligibility"),
        (("probe_capacity" == actions[0]) != ("probe_capacity" == actions[1]), "capacity routing differs"), (unverified and (now or bool(forward & set(actions))), "unverified authorization can't go forward"),
        (actions[0] == "seek_compliance_clearance" and not d["recheck_conditions"], "clearance needs a recheck condition"),
    ]
    return _broken(rules)


def reference_errors(row: dict, keys: set[str]) -> list[str]:
    """A report row holds exactly the safe reference keys."""
    return _broken([(not row, "empty"), (set(row) != keys, "keys differ")])


def safe_event(event: dict) -> dict:
    """An event's allow-listed part; categories and resources out of the lists become ``unknown``."""
    limit = event.get("rate_limit")
    known = lambda x, values: x if x in values else "unknown"
    safe = {k: limit.get(k) for k in LIMIT_NUMBERS} | {"resource": known(limit.get("resource"), LIMIT_RESOURCES)} if isinstance(limit, dict) else None
    return {k: event.get(k) for k in EVENT_KEYS} | {"category": known(event.get("category"), EVENT_CATEGORIES), "rate_limit": safe}


def preflight(status_code: int | None, body_bytes: int, payload: dict | None, canonical_codes: list[int], max_bytes: int, sample: int, required: dict) -> dict:
    """Ordered, fail-closed decision on a static sample: the first thing that is wrong, or ``shape_qualified``.

    ``required`` maps a field to a predicate over a record.
    """
    data = ((payload or {}).get("result") or {}).get("data")
    cursor = ((payload or {}).get("result") or {}).get("cursor")
    n = len(data) if isinstance(data, list) else 0
    shares = {name: sum(bool(test(x)) for x in data) / n for name, test in required.items()} if n else {}
    checks = (
        (status_code is None, "not_attempted"), (status_code in (401, 403), "authentication_required"), (status_code != 200, "http_error"), (body_bytes > max_bytes, "response_byte_budget_exhausted"), (payload is None, "malformed_response"),
        (not isinstance((payload or {}).get("result"), dict), "unexpected_wrapper"), (not n, "empty_result"), (n > sample, "sample_limit_exceeded"), (not isinstance(cursor, dict) or "after" not in cursor, "cursor_shape_missing"),
        (any(s != 1.0 for s in shares.values()), "required_field_incomplete"), (len(canonical_codes) != n or any(c != 200 for c in canonical_codes), "canonical_anonymous_read_failed"),
    )
    reason = next((name for wrong, name in checks if wrong), "shape_qualified")
    return {"status": "PASS" if reason == "shape_qualified" else "FAIL", "termination_reason": reason, "observed": n, "completeness": shares, "retained_items": 0}
