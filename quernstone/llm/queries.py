"""The queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, extract, langid, licenses, mixing, packing, quality, simhash, tokencount, topk, urlfilter, whitening
from .common import new_path, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the isolation forest's verdict for every document."""
    scored = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly_score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose held_out is false."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit_on_training_rows(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 3) AS bin
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
caps AS (
  SELECT source, source_size, 2 * source_size AS cap,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sources),
filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights,
         (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total
  FROM caps),
levels AS (SELECT *, CASE WHEN (total - before) / weights * weight < cap THEN (total - before) / weights END AS level FROM filled),
plan AS (
  SELECT source, source_size, coalesce(least(max(level) OVER () * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM levels),
parts AS (SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS whole FROM plan),
bins AS (
  SELECT source, bin, sum(size)::BIGINT AS words,
         coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM rows GROUP BY source, bin),
edges AS (
  SELECT p.source, min(b.bin) AS edge, min((p.target - p.whole * p.source_size - b.before) / b.words) AS part
  FROM bins b JOIN parts p ON b.source IS NOT DISTINCT FROM p.source
  WHERE b.before <= p.target - p.whole * p.source_size AND b.before + b.words > p.target - p.whole * p.source_size
  GROUP BY p.source)
SELECT r.doc_id, r.size, p.source_size, p.target,
       (p.whole * r.size + coalesce(CASE WHEN r.bin < e.edge THEN r.size WHEN r.bin = e.edge THEN floor(r.size * e.part + 0.5) ELSE 0 END, 0))::BIGINT AS taken
FROM rows r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source
LEFT JOIN edges e ON r.source IS NOT DISTINCT FROM e.source
"""


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


OP5_SQL = r"""
WITH rows AS (
  SELECT vec_id, embedding, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, embedding, v FROM rows WHERE vec_id % 20 = 0) q JOIN rows c ON q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, through a cache that starts empty with each run."""
    counted = tokencount.count_tokens(table(spark, sf_dir, "documents"), new_path(spark, "token-counts"))
    return counted.withColumn("over_limit", counted["n_tokens"] > tokencount.LIMIT)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with their sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(found["fp"]).alias("fingerprint"), "component_id")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what is read back from its formatted text and mask."""
    planted = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, r in enumerate(("user", "assistant"))]))
    )
    columns = ("conv_id", "turn", "role", "text")
    turns = table(spark, sf_dir, "conversations").select(*columns).unionByName(planted)
    formatted = chat.format_conversations(turns)
    read = formatted.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(role) + length(regexp_replace(role, '[^\<\[]', '', 'g')) AS role_chars,
         CASE WHEN text[1] = '' OR contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]')
              THEN 1 + length(text) + length(regexp_replace(text, '[^\<\[]', '', 'g')) ELSE length(text) END AS text_chars
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(3 + role_chars + 6 + text_chars + 7 + 4)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families found in every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    sure = F.filter("findings", lambda x: x["confirmed"])
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.size(sure).cast("long").alias("n_found"),
        (F.size("findings") - F.size(sure)).cast("long").alias("n_unconfirmed"),
        F.round(F.array_max(F.transform(sure, lambda x: x["probability"])), 6).alias("probability"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sound vector on the 32 first components; a deviation beyond a long is null, as its type can't hold it."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


#: The rules that the query judges by: host, start of the path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL by five rules; what none fits is allowed."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_rows(spark, URL_RULES))


OP12_SQL = f"""
WITH rules AS (SELECT * FROM (VALUES {", ".join(map(str, URL_RULES))}) r(rule_host, rule_path, rule_verdict)),
rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
best AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN best USING (n)
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of every sound vector after four rounds, and how far it is off."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


def _op13_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS) -> str:
    """The rounds unrolled: distances by inner products of integers, exact as doubles."""
    found = [
        f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x FROM kept, range({parts}) r(p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM pieces QUALIFY e < {entries})"""
    ]
    for n in range(rounds + 1):
        found.append(f"""near{n} AS MATERIALIZED (
  SELECT a.vec_id, any_value(a.label) AS label, a.p, any_value(a.x) AS x,
         min((list_inner_product(a.x, a.x) - 2 * list_inner_product(a.x, b.x) + list_inner_product(b.x, b.x))::BIGINT * {entries} + b.e) AS best
  FROM pieces a JOIN book{n} b USING (p) GROUP BY a.vec_id, a.p)""")
        if n < rounds:
            found.append(f"""mean{n} AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT p, best % {entries} AS e, i, floor(sum(x[i]) / count(*)) AS m FROM near{n}, range(1, 1 + (SELECT max(len(x)) FROM pieces)) r(i) GROUP BY 1, 2, 3) GROUP BY p, e),
book{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN mean{n} m USING (p, e))""")
    return ",\n".join(found) + f"""
SELECT vec_id, string_agg(lower(lpad(to_hex(best % {entries}), 2, '0')), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error,
       (sum(sum(best // {entries})) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM near{rounds} GROUP BY vec_id, label"""


OP13_SQL = _op13_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op4_html_extraction": op4_html_extraction,
    "op5_exact_topk": op5_exact_topk,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_license_scan": op10_license_scan,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_url_filter": op12_url_filter,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": OP3_SQL,
    "op5_exact_topk": OP5_SQL,
    "op9_chat_format": OP9_SQL,
    "op12_url_filter": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
