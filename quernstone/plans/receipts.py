"""Bindings of runs to what they rest on, and authorizations: local files and digests."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from pathlib import Path

from ..functions.ids import content_sha256

#: The parts of a manifest that its query contract binds.
CONTRACT_KEYS = ("api", "window", "selection", "notice_scope", "fields", "forbidden_contact_fields", "sort", "strata", "thresholds", "pagination", "retry", "privacy")


def _broken(rules: Iterable[tuple[bool, str]]) -> list[str]:
    return [message for holds, message in rules if holds]


def query_contract_sha256(manifest: dict) -> str:
    """Digest of the parts of a manifest that decide what is asked for."""
    return content_sha256({k: manifest[k] for k in CONTRACT_KEYS})


def bound_run(pointer: dict, qualification: dict, assignments: list[dict], source: str) -> list[str]:
    """Whether pointer, qualification and packet are of one run and source."""
    rules = [(pointer.get(k) is None or pointer.get(k) != qualification.get(k), f"{k}: pointer mismatch") for k in ("run_id", "dataset_sha256")]
    return _broken([*rules, (not assignments or any(a.get("source") != source for a in assignments), f"the packet isn't {source}'s alone")])


def output_root(path: str) -> Path:
    """A local folder to write to, made if need be; a link or a file in its place is refused."""
    root = Path(path)
    if root.is_symlink() or root.exists() and not root.is_dir():
        raise ValueError(f"{path} is no folder of its own")
    root.mkdir(parents=True, exist_ok=True)
    return root


def _smoke(raw: bytes) -> dict:
    smoke = json.loads(raw)
    if (smoke.get("status"), smoke.get("termination_reason"), smoke.get("accepted")) != ("PASS", "target_reached", 10) or not isinstance(smoke.get("provenance"), dict):
        raise ValueError("the smoke run doesn't qualify")
    return smoke


def _bindings(raw: bytes) -> dict:
    smoke = _smoke(raw)
    p = smoke["provenance"]
    return {"smoke_run_id": smoke.get("run_id"), "smoke_receipt_sha256": hashlib.sha256(raw).hexdigest(), "smoke_manifest_hash": p.get("manifest_hash"), "capacity_manifest_hash": p.get("capacity_manifest_hash"), "smoke_authorization_hash": p.get("authorization_hash")}


def authorization_errors(value: dict, smoke_receipt: bytes) -> list[str]:
    """Whether an authorization is of exactly this smoke run."""
    try:
        expected = _bindings(smoke_receipt) | {"status": "AUTHORIZED", "operational_next_action": "run_analysis"}
    except ValueError as error:
        return [str(error)]
    return _broken((value.get(k) != v, f"{k}: mismatch") for k, v in expected.items())


def authorize(smoke_receipt: bytes, destination: str, trusted_root: str, authorized_at: str) -> dict:
    """Write an authorization bound to a smoke run, readable by its owner alone, once, within ``trusted_root``."""
    root, place = Path(trusted_root), Path(destination)
    on_the_way = [root, *(root.joinpath(*place.relative_to(root).parts[:n]) for n in range(1, len(place.relative_to(root).parts) + 1))]
    if any(p.is_symlink() for p in on_the_way) or root.resolve() not in place.resolve().parents:
        raise ValueError("an authorization lies in its own folders, without links")
    if any(p.exists() and not p.is_dir() for p in on_the_way[:-1]):
        raise ValueError("a file stands in the way")
    value = {"schema_version": "1.0.0", "status": "AUTHORIZED", "operational_next_action": "run_analysis", **_bindings(smoke_receipt), "authorized_at": authorized_at}
    place.parent.mkdir(parents=True, mode=0o700, exist_ok=True)
    # created for this process alone, never over another
    with os.fdopen(os.open(place, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w", encoding="utf-8") as f:
        f.write(json.dumps(value, sort_keys=True, indent=2) + "\n")
    return value
