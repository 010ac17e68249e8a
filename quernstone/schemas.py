"""Declared schemas and fixed vocabularies; nothing is inferred from data."""

from __future__ import annotations

#: Sources, item types and their bounds.
ITEM_TYPES = ("submission", "issue", "review", "question", "top_level_comment", "story", "notice")
MIN_TEXT, MAX_TEXT = 40, 20_000
UNKNOWN_AUTHOR = "__unknown__"
#: Metadata keys that may be kept, by source.
ALLOWED_METADATA = {
    "github": ("labels", "locked", "state"),
    "stackexchange": ("accepted_answer_id", "closed_reason", "content_license", "is_answered", "tags"),
    "steam": ("received_for_free", "steam_purchase", "voted_up", "written_during_early_access"),
    "youtube": ("can_reply", "is_public", "video_id"),
    "reddit": ("link_flair_text", "locked", "over_18", "stickied", "subreddit"),
    "hackernews": ("dead", "deleted", "type"),
    "ted": ("redacted_contact_count", "redaction_policy_version", "language_selection_version"),
}
#: Keys that name a person, in canonical form.
IDENTITY_KEYS = (
    "account_id", "author", "author_display_name", "author_id", "author_username", "by", "display_name", "email", "profile_url", "steamid", "user", "user_id", "user_name", "username",
)
#: How a collection can end, and the codes of a runner that got no result it can use.
TERMINATIONS = (
    "target_reached", "request_budget_exhausted", "page_budget_exhausted", "repository_quota_unreachable", "source_exhausted", "prerequisite_failed", "transport_error", "rate_limit_exhausted", "smoke_deadline_exhausted", "backoff_budget_exhausted", "quota_budget_exhausted", "privacy_failure",
)
RUNNER_CODES = (
    "runner_adapter_exception", "runner_invalid_adapter_result", "runner_source_mismatch", "runner_adapter_version_mismatch", "runner_run_id_mismatch", "runner_manifest_version_mismatch", "runner_target_mismatch", "runner_manifest_hash_mismatch", "runner_compliance_hash_mismatch",
)
#: What a transport event may say, and the resources a rate limit may name.
EVENT_CATEGORIES = ("http_error", "timeout", "connection_reset", "rate_limit")
EVENT_KEYS = ("sequence", "category", "attempt", "status_code", "retryable", "rate_limit")
LIMIT_NUMBERS = ("limit", "remaining", "reset_at", "retry_after_seconds")
LIMIT_RESOURCES = ("core", "search", "graphql", "integration_manifest", "source_import", "code_scanning", "actions_runner_registration", "scim")
#: Kinds of money signals in labels, kinds of evidence, and those that show spending.
MONEY_SIGNALS = ("purchase", "subscription", "outsourcing", "labor_cost", "loss", "willingness_to_pay", "price_complaint", "replacement_search")
EVIDENCE_KINDS = ("problem", "loss", "money", "willingness_to_pay", "alternative", "customer_channel", "solution_gap", "counter", "blocker")
SPENDING_KINDS = ("money", "willingness_to_pay")
#: The columns of a report that may name an accepted record.
SAFE_REFERENCE = ("source_item_id", "source_url", "published_at", "text_fingerprint")

ENGAGEMENT = "struct<score:bigint,comments:bigint,likes:bigint,views:bigint,answers:bigint,helpful:bigint,votes:bigint>"
#: A normalised record; source_metadata stays JSON until its keys have been checked.
RAW_ITEM = f"""
document_id string, source string, source_item_id string, source_url string, item_type string,
author_hash string, community string, thread_id string, parent_id string, title string, text string,
text_fingerprint string, text_length bigint, original_text_length bigint, text_truncated boolean,
published_at string, updated_at string, language string, engagement {ENGAGEMENT},
source_metadata string, collected_at string, collector_version string, fetch_run_id string
"""
REJECTION = "source_item_id string, reason string"
ISSUE = "id string, number bigint, html_url string, title string, body string, created_at string, updated_at string, comments bigint, state string, locked boolean, labels array<struct<name:string>>, user struct<id:string>, pull_request string"
QUESTION = "question_id bigint, title string, body string, creation_date bigint, link string, tags array<string>, content_license string, owner struct<user_id:bigint>"
REVIEW = "recommendationid string, author struct<steamid:string>, review string, timestamp_created bigint, timestamp_updated bigint, voted_up boolean, steam_purchase boolean, received_for_free boolean, written_during_early_access boolean, votes_up bigint, comment_count bigint"
#: Notices are polymorphic: each field keeps its JSON and is read by shape.
NOTICE_FIELDS = ("publication-number", "notice-identifier", "procedure-identifier", "publication-date", "notice-type", "form-type", "classification-cpv", "buyer-identifier", "notice-title", "description-proc", "change-notice-version-identifier")
NOTICE = ", ".join(f"`{f}` string" for f in NOTICE_FIELDS)
LABEL = "label_id string, document_id string, source string, reviewer_id string, assignment_split string, review_round string, problem_signal boolean, money_signal boolean, money_signal_type string, structural_money_signal boolean, usable_evidence boolean, noise boolean, label_reason string, labeled_at timestamp, guide_version string"
SUBMISSION = "assignment_id string, reviewer_id string, reviewer_independence_asserted boolean, problem_signal boolean, money_signal boolean, money_signal_type string, structural_money_signal boolean, usable_evidence boolean, noise boolean, label_reason string, labeled_at timestamp, external_context_used boolean"
