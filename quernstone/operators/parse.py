"""Raw payloads to normalised records or a rejection reason.

Each parser is a chain of projections: typed values, then the first failing check as ``reason``,
then the record's columns.  ``accepted`` and ``rejected`` split the result.  Python runs once a
row, for NFKC and case folding (and HTML where the payload has it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text, values
from ..schemas import ENGAGEMENT, MAX_TEXT, MIN_TEXT, UNKNOWN_AUTHOR


class Run:
    """What is equal for all records of a collection run."""

    def __init__(self, secret: bytes, run_id: str, version: str, collected_at: str) -> None:
        if len(secret) < 32 or not run_id or not version:
            raise ValueError("a run needs a secret of 32 bytes, an id and a version")
        self.secret, self.run_id, self.version, self.collected_at = secret, run_id, version, collected_at


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that holds; null if none does."""
    return F.coalesce(*[F.when(c, F.lit(name)) for c, name in checks])


def engagement(**counts: Column) -> Column:
    """Counts that are there and not negative; a score may be negative."""
    fields = [x.split(":")[0] for x in ENGAGEMENT[7:-1].split(",")]
    return F.struct(*[(F.when((counts[f] >= 0) | F.lit(f == "score"), counts[f]) if f in counts else F.lit(None)).cast("bigint").alias(f) for f in fields])


def _record(rows: DataFrame, source: str, run: Run, *, item_id: Column, item_type: str, url: Column, community: Column, thread: Column, author: Column, title: Column, published: Column, updated: Column, language: Column, counts: Column, metadata: Column) -> DataFrame:
    """``rows`` has ``full`` (normalised text) and ``reason``; the stored text is cut before it is fingerprinted."""
    rows = rows.withColumn("_stored", F.substring("full", 1, MAX_TEXT)).withColumn("_print", text.fingerprint(text.collapse(F.col("_stored"))))
    columns = {
        "document_id": F.concat(F.lit(f"{source}:"), item_id), "source": F.lit(source), "source_item_id": item_id, "source_url": url, "item_type": F.lit(item_type),
        "author_hash": ids.author_hash(source, F.coalesce(author, F.lit(UNKNOWN_AUTHOR)), run.secret), "community": community, "thread_id": thread, "parent_id": F.lit(None).cast("string"),
        "title": F.nullif(title, F.lit("")), "text": F.col("_stored"), "text_fingerprint": F.col("_print"), "text_length": F.length("_stored").cast("bigint"),
        "original_text_length": F.length("full").cast("bigint"), "text_truncated": F.length("full") > MAX_TEXT, "published_at": published, "updated_at": updated, "language": language.cast("string"),
        "engagement": counts, "source_metadata": metadata, "collected_at": F.lit(run.collected_at), "collector_version": F.lit(run.version), "fetch_run_id": F.lit(run.run_id),
    }
    return rows.select("reason", *[c.alias(k) for k, c in columns.items()])


def parse_issues(payloads: DataFrame, repository: str, run: Run) -> DataFrame:
    body, title = text.normalize_text(F.col("body")), text.normalize_text(F.coalesce("title", F.lit("")))
    rows = payloads.withColumns({"_body": body, "_title": title, "_published": values.iso_to_utc(F.col("created_at")), "_updated": values.iso_to_utc(F.col("updated_at"))})
    rows = rows.withColumn("full", F.trim(F.concat_ws(" ", "_title", "_body")))
    rows = rows.withColumn("reason", first_reason(
        (F.col("pull_request").isNotNull(), "pr_not_issue"), (F.coalesce("_body", F.lit("")) == "", "missing_body"), (F.length("full") < MIN_TEXT, "short_text"),
        (F.col("_published").isNull() | F.col("updated_at").isNotNull() & F.col("_updated").isNull(), "invalid_timestamp"),
        (F.coalesce(F.trim("id"), F.lit("")) == "", "invalid_item"), (F.col("number").isNull() | (F.coalesce("html_url", F.lit("")) == ""), "invalid_item"),
    ))
    names = F.filter(F.transform("labels", lambda x: text.collapse(x["name"])), lambda n: n.isNotNull() & (n != ""))
    return _record(
        rows, "github", run, item_id=F.trim("id"), item_type="issue", url=F.col("html_url"), community=F.lit(repository), thread=F.concat(F.lit(f"{repository}:"), F.col("number").cast("string")),
        author=F.col("user.id"), title=F.col("_title"), published=F.col("_published"), updated=F.col("_updated"), language=F.lit(None), counts=engagement(comments=F.col("comments")),
        metadata=F.to_json(F.struct("state", "locked", F.coalesce(names, F.array().cast("array<string>")).alias("labels"))),
    )


def parse_questions(payloads: DataFrame, site: str, run: Run) -> DataFrame:
    rows = payloads.withColumns({"_body": text.html_body_to_text(F.col("body")), "_title": text.html_title_to_text(F.coalesce("title", F.lit("")))})
    rows = rows.withColumn("full", text.collapse(F.concat_ws(" ", "_title", "_body"))).withColumn("_item", F.concat(F.lit(f"{site}:"), F.col("question_id").cast("string")))
    rows = rows.withColumn("reason", first_reason(
        (F.coalesce("_body", F.lit("")) == "", "missing_body"), (F.coalesce(F.trim("content_license"), F.lit("")) == "", "missing_license"), (F.length("full") < MIN_TEXT, "short_text"),
        (F.col("creation_date").isNull(), "invalid_timestamp"),
        (~F.coalesce(F.col("link").rlike(r"^https://[^/?#]+[^?#]*/questions/"), F.lit(False)), "invalid_url"), (F.col("question_id").isNull(), "invalid_item"),
    ))
    return _record(
        rows, "stackexchange", run, item_id=F.col("_item"), item_type="question", url=F.col("link"), community=F.lit(site), thread=F.col("_item"),
        author=F.concat(F.lit(f"{site}:"), F.col("owner.user_id").cast("string")), title=F.col("_title"), published=values.epoch_to_iso(F.col("creation_date")), updated=F.lit(None).cast("string"),
        language=F.lit(None), counts=engagement(), metadata=F.to_json(F.struct(F.trim("content_license").alias("content_license"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))),
    )


def parse_reviews(payloads: DataFrame, app_id: int, app_name: str, after: str, before: str, run: Run) -> DataFrame:
    rows = payloads.withColumn("full", text.normalize_text(F.coalesce("review", F.lit("")))).withColumn("_item", F.concat(F.lit(f"{app_id}:"), F.nullif("recommendationid", F.lit(""))))
    created = F.timestamp_seconds("timestamp_created")
    rows = rows.withColumn("reason", first_reason(
        (F.col("_item").isNull(), "missing_item_id"), (F.col("full") == "", "missing_body"), (F.length("full") < MIN_TEXT, "short_text"), (created.isNull(), "invalid_timestamp"),
        ((created < F.lit(after).cast("timestamp")) | (created >= F.lit(before).cast("timestamp")), "outside_time_window"),
    ))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("received_for_free", "steam_purchase", "voted_up", "written_during_early_access")]
    return _record(
        rows, "steam", run, item_id=F.col("_item"), item_type="review", url=F.concat(F.lit(f"https://steamcommunity.com/app/{app_id}/reviews/?recommendationid="), F.col("recommendationid")),
        community=F.lit(str(app_id)), thread=F.col("_item"), author=F.nullif("author.steamid", F.lit("")), title=F.lit(app_name), published=values.epoch_to_iso(F.col("timestamp_created")),
        updated=values.epoch_to_iso(F.col("timestamp_updated")), language=F.lit("en"), counts=engagement(helpful=F.col("votes_up"), comments=F.col("comment_count")), metadata=F.to_json(F.struct(*flags)),
    )


def json_strings(x: Column) -> Column:
    """All strings of a JSON string, array or language map, trimmed, without blanks."""
    one = F.from_json(F.concat(F.lit("["), F.when(F.startswith(x, F.lit('"')), x), F.lit("]")), "array<string>")
    by_key = F.flatten(F.transform(F.map_values(F.from_json(F.when(F.startswith(x, F.lit("{")), x), "map<string,string>")), lambda v: F.coalesce(F.from_json(F.when(F.startswith(v, F.lit("[")), v), "array<string>"), F.array(v))))
    many = F.from_json(F.when(F.startswith(x, F.lit("[")), x), "array<string>")
    found = F.coalesce(one, many, by_key, F.array().cast("array<string>"))
    return F.filter(F.transform(found, text.collapse_ends), lambda v: v.isNotNull() & (v != ""))


def one_string(x: Column) -> Column:
    """The only string of a field; null where there are none or several."""
    found = json_strings(x)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def buyer_key(field: Column) -> Column:
    """One key for a field's distinct buyers in order."""
    return F.array_join(F.array_sort(F.array_distinct(json_strings(field))), "\0")


def parse_notices(payloads: DataFrame, stratum: str, run: Run) -> DataFrame:
    field = lambda name: F.col(f"`{name}`")
    rows = payloads.withColumns({
        "_publication": one_string(field("publication-number")), "_notice": one_string(field("notice-identifier")), "_procedure": one_string(field("procedure-identifier")),
        "_buyers": F.array_sort(F.array_distinct(json_strings(field("buyer-identifier")))), "_date": one_string(field("publication-date")),
        "_t": text.redact_contacts(text.select_language(field("notice-title"))), "_d": text.redact_contacts(text.select_language(field("description-proc"))),
    })
    rows = rows.withColumns({"_title": text.normalize_text(F.col("_t.text")), "full": text.normalize_text(F.trim(F.concat_ws(" ", "_t.text", "_d.text"))), "_published": values.notice_published(F.col("_date"))})
    rows = rows.withColumn("reason", first_reason(
        (F.col("_publication").isNull() | F.col("_notice").isNull() | F.col("_procedure").isNull(), "missing_item_id"), (F.size("_buyers") == 0, "missing_buyer_id"),
        (text.residual_contacts(F.col("full")) > 0, "residual_contact"), (F.length("full") < MIN_TEXT, "short_text"), (F.col("_published").isNull(), "invalid_timestamp"),
    ))
    metadata = F.struct((F.col("_t.count") + F.col("_d.count")).alias("redacted_contact_count"), F.lit("ted-contact-v1").alias("redaction_policy_version"), F.lit("ted-language-v1").alias("language_selection_version"))
    return _record(
        rows, "ted", run, item_id=F.col("_notice"), item_type="notice", url=F.concat(F.lit("https://ted.europa.eu/en/notice/-/detail/"), F.col("_publication")), community=F.lit(stratum), thread=F.col("_procedure"),
        author=F.concat(F.lit("ted-buyers-v1\0"), buyer_key(field("buyer-identifier"))), title=F.col("_title"), published=F.col("_published"), updated=F.lit(None).cast("string"), language=F.lit(None), counts=engagement(), metadata=F.to_json(metadata),
    )


def measure_notices(payloads: DataFrame) -> DataFrame:
    """Typed values and presence flags of notices; a malformed field doesn't erase the others."""
    field = lambda name: F.col(f"`{name}`")
    single = {"notice_id": "notice-identifier", "procedure_id": "procedure-identifier", "publication_date": "publication-date", "notice_type": "notice-type", "form_type": "form-type"}
    several = {"cpv_codes": "classification-cpv", "buyer_ids": "buyer-identifier", "change_notice_ids": "change-notice-version-identifier"}
    fit = lambda c: field(c).isNull() | field(c).rlike(r'^\s*("|\[)')
    shape = F.lit(True)
    for c in single.values():
        shape = shape & fit(c) & (F.size(json_strings(field(c))) <= 1)
    for c in several.values():
        shape = shape & fit(c)
    texts = F.concat(json_strings(field("notice-title")), json_strings(field("description-proc")))
    return payloads.select(
        *[one_string(field(c)).alias(k) for k, c in single.items()], *[F.array_distinct(json_strings(field(c))).alias(k) for k, c in several.items()], texts.alias("text_values"), F.coalesce(shape, F.lit(False)).alias("shape_valid"),
    ).withColumns({"procedure_present": F.col("procedure_id").isNotNull(), "buyer_present": F.size("buyer_ids") > 0, "text_present": F.size("text_values") > 0})


def notice_reason(from_day: str, before_day: str, form_type: str, notice_types: tuple[str, ...], cpv_prefix: str) -> Column:
    """First failing eligibility check of a measured notice."""
    day = values.notice_date(F.col("publication_date"))
    return first_reason(
        (~F.col("shape_valid"), "invalid_field_shape"), (F.col("notice_id").isNull(), "missing_notice_id"), (F.col("procedure_id").isNull(), "missing_procedure_id"), (F.size("buyer_ids") == 0, "missing_buyer_id"),
        (F.size("text_values") == 0, "missing_text"), (day.isNull() | (day < F.lit(from_day).cast("date")) | (day >= F.lit(before_day).cast("date")), "outside_window"),
        (~F.coalesce((F.col("form_type") == form_type) & F.col("notice_type").isin(*notice_types), F.lit(False)), "wrong_notice_scope"),
        (~F.exists("cpv_codes", lambda c: c.rlike("^[0-9]{8}$") & F.startswith(c, F.lit(cpv_prefix))), "wrong_cpv_stratum"), (F.size("change_notice_ids") > 0, "change_notice"),
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NULL").drop("reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NOT NULL").select("source_item_id", "reason")


def reason_counts(rejections: DataFrame, *by: str) -> DataFrame:
    return rejections.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))
