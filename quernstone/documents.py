"""Contracts of the engine's documents, for ``functions.rules``: cards, records, labels, segments, page wrappers.

Names of fields, vocabularies, patterns and bounds are fixed values: documents written by others
must pass or fail here as they do there.
"""

from __future__ import annotations

from .schemas import EVIDENCE_KINDS, ITEM_TYPES, MAX_TEXT, MIN_TEXT, MONEY_SIGNALS, SPENDING_KINDS

#: Digests, versions, codes, languages, times with a zone, addresses.
DIGEST, VERSION, CODE, LANGUAGE = "^[a-f0-9]{64}$", r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$", "^[a-z][a-z0-9_]{0,63}$", "^[a-z]{2,3}(?:-[A-Z]{2})?$"
TIME, ADDRESS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$", r"^https?://[^\s]+$"
#: States of cards and their parts.
EVIDENCE_STATES = ("INSUFFICIENT_EVIDENCE", "CONFLICTING_EVIDENCE", "EVIDENCE_BACKED", "NEEDS_REVIEW")
ACTION_STATES = ("ACTIONABLE", "NOT_ACTIONABLE", "UNKNOWN")
AUDIT_CODES = ("CONFIRMED", "MISINTERPRETED_QUOTE", "DUPLICATE_EVIDENCE", "MISSING_COUNTER_EVIDENCE", "WRONG_CLUSTER", "INACCESSIBLE_SOURCE", "POLICY_MISMATCH")


def text(least: int = 1, **more: object) -> dict:
    return {"type": "string", "minLength": least, **more}


def whole(least: int | None = 0, **more: object) -> dict:
    return {"type": "integer", **({} if least is None else {"minimum": least}), **more}


def word(*values: object) -> dict:
    return {"enum": list(values)}


def or_null(part: dict) -> dict:
    return {"oneOf": [part, {"type": "null"}]}


def listed(items: dict, least: int = 0, unique: bool = True) -> dict:
    return {"type": "array", "items": items} | ({"minItems": least} if least else {}) | ({"uniqueItems": True} if unique else {})


def record(optional: dict | None = None, /, **fields: dict) -> dict:
    """An object with exactly these fields, and perhaps the optional ones."""
    return {"type": "object", "additionalProperties": False, "required": list(fields), "properties": fields | (optional or {})}


def when(field: str, value: object, required: bool = True, **then: dict) -> dict:
    """Rules for fields that hold where ``field`` has ``value``."""
    return {"if": {"properties": {field: {"const": value}}} | ({"required": [field]} if required else {}), "then": {"properties": then}}


FLAG, TEXT, TEXTS, MOMENT = {"type": "boolean"}, text(), listed(text()), {"type": "string", "format": "date-time", "pattern": TIME}

#: What a card quotes.
EVIDENCE = record(
    evidence_id=TEXT, document_id=TEXT, source_url={"type": "string", "format": "uri", "pattern": ADDRESS}, published_at=MOMENT, author_hash=TEXT, community=TEXT, evidence_group_id=TEXT,
    kind=word(*EVIDENCE_KINDS), quote=TEXT, interpretation=TEXT, confidence={"type": "number", "minimum": 0, "maximum": 1},
)


def evidence_of(kind: dict) -> dict:
    return listed({"allOf": [{"$ref": "#/$defs/evidence"}, {"properties": {"kind": kind}}]})


def state(*states: str) -> dict:
    return record(status=word(*states), reasons=listed(text(), 1))


def with_status(value: str) -> dict:
    return {"properties": {"status": {"const": value}}}


#: Which kinds each of a card's lists may hold.
BUCKETS = {
    "loss_evidence": word("loss"), "money_evidence": word(*SPENDING_KINDS), "current_solution_evidence": word("alternative"), "customer_channel_evidence": word("customer_channel"),
    "known_blockers": word("blocker"), "solution_gap_evidence": word("solution_gap"), "supporting_evidence": {"not": word("counter")}, "counter_evidence": word("counter"),
}
CARD = record(
    **{name: TEXT for name in ("card_id", "cluster_id", "observed_actor", "problem_statement", "model_version", "prompt_version", "policy_version")},
    **{name: whole() for name in ("independent_author_count", "independent_evidence_group_count", "recent_case_count")},
    **{name: evidence_of(kind) for name, kind in BUCKETS.items()},
    inferred_customer_segment={"type": ["string", "null"]}, evidence_status=word(*EVIDENCE_STATES), actionability_status=word(*ACTION_STATES), review_value_score={"type": "number", "minimum": 0, "maximum": 100},
    growth_status=word("KNOWN", "UNKNOWN", "EXCLUDED"), current_alternatives=TEXTS, uncertainties=TEXTS, automatic_decision=word("REVIEW", "HOLD", "REJECT"), decision_reasons=listed(text(), 1, unique=False), generated_at=MOMENT,
    productizable_scope=record(status=word("PRODUCTIZABLE", "NOT_PRODUCTIZABLE", "UNKNOWN"), delivery_mode=word("SOFTWARE", "SERVICE", "HYBRID", "UNKNOWN"), summary=TEXT),
    blocker_assessment=state("NONE_FOUND", "BLOCKED", "UNKNOWN"), counter_assessment=state("NONE_CRITICAL", "CRITICAL", "UNKNOWN"), source_versions={"type": "object", "minProperties": 1, "additionalProperties": TEXT},
    human_audit=or_null(record(evidence_status=word(*EVIDENCE_STATES), actionability_status=word(*ACTION_STATES), reason_codes=listed(word(*AUDIT_CODES), 1), duration_seconds=whole(maximum=1800), audited_at=MOMENT)),
) | {
    "$defs": {"evidence": EVIDENCE},
    "allOf": [
        when(
            "evidence_status", "EVIDENCE_BACKED", independent_author_count={"minimum": 5}, independent_evidence_group_count={"minimum": 3}, recent_case_count={"minimum": 10},
            loss_evidence={"minItems": 2}, money_evidence={"minItems": 2}, supporting_evidence={"minItems": 3}, counter_assessment=with_status("NONE_CRITICAL"),
        ),
        when(
            "actionability_status", "ACTIONABLE", current_alternatives={"minItems": 1}, current_solution_evidence={"minItems": 1}, customer_channel_evidence={"minItems": 1}, known_blockers={"maxItems": 0},
            solution_gap_evidence={"minItems": 2}, productizable_scope=with_status("PRODUCTIZABLE"), blocker_assessment=with_status("NONE_FOUND"),
        ),
    ],
}

WHEN = {"type": "string", "format": "date-time"}
#: A normalised record.
ITEM = record(
    **{name: TEXT for name in ("source", "source_item_id", "community", "thread_id", "collector_version", "fetch_run_id")},
    document_id=text(3), source_url={"type": "string", "format": "uri"}, item_type=word(*ITEM_TYPES), author_hash={"type": "string", "pattern": DIGEST}, parent_id={"type": "null"}, title=or_null(TEXT),
    text=text(MIN_TEXT, maxLength=MAX_TEXT), text_fingerprint={"type": "string", "pattern": DIGEST}, text_length=whole(MIN_TEXT), original_text_length=whole(MIN_TEXT), text_truncated=FLAG, published_at=WHEN, updated_at=or_null(WHEN),
    language=or_null({"type": "string", "pattern": LANGUAGE}), source_metadata={"type": "object"}, collected_at=WHEN,
    engagement={"type": "object", "additionalProperties": False, "properties": {"score": whole(None)} | {name: whole() for name in ("comments", "likes", "views", "answers", "helpful", "votes")}},
)

#: A reviewer's label: a type of money signal stands exactly where there is one.
LABEL = record(
    **{name: FLAG for name in ("problem_signal", "money_signal", "structural_money_signal", "usable_evidence", "noise")},
    label_id=text(3), document_id=text(3), source=TEXT, reviewer_id=TEXT, assignment_split=word("development", "holdout"), review_round=word("primary", "secondary"), money_signal_type=or_null(word(*MONEY_SIGNALS)),
    label_reason=text(20), labeled_at=WHEN, guide_version={"type": "string", "pattern": VERSION},
) | {
    "allOf": [
        when("money_signal", True, False, money_signal_type=word(*MONEY_SIGNALS)),
        when("money_signal", False, False, money_signal_type={"const": None}, structural_money_signal={"const": False}),
    ]
}

#: Counters of one segment of a run, and a record that the run turned away.
SEGMENT = record(segment_type=TEXT, segment_id=TEXT, **{name: whole() for name in ("quota", "accepted_item_count", "fetched_item_count", "processed_item_count", "rejected_item_count")})
INVALID_ITEM = record(source_item_id=or_null(TEXT), error_code={"type": "string", "pattern": CODE}, errors=listed(text(maxLength=500), 1, unique=False) | {"maxItems": 20})

#: A page of notices: a count and no time-out; other keys fail it.
WRAPPER = record({"iterationNextToken": {"type": ["string", "null"]}}, notices=listed({"type": "object"}, unique=False), totalNoticeCount=whole(), timedOut={"const": False, "type": "boolean"})
