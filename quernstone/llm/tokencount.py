"""Token counts through a digest cache.

A text's digest (SHA-256 of its normalised content) and the tokenizer's version digest (of its
vocabulary file) are joined to a table of stored counts.  One row of every distinct missing
digest is encoded, and its count is appended to the table, which all rows are then joined to.
A first pass writes digests by id.  While at most ``FEW`` digests are missing, they are sent to the
texts, and only texts to be encoded move; beyond that, texts meet the missing digests by a shuffle.  The copies
of a common text, whose digest more than a ``COMMON``-th of all rows share, are dropped before
it, and their counts are sent to the rows; so no digest's rows meet in one task.

Cases: a null text counts as empty, with 0 bytes and 0 tokens.  Rows of equal content are encoded
once and get equal counts.  A cache that another run has appended to meanwhile may hold a digest
twice; its counts are equal.  An empty table gives an empty result.  Columns other than the id
and the text are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialise
from .tokens import word_counts

LIMIT = 2048
#: Digests that are sent to every task (48 bytes each), and the share of rows from which on one is common: at most so many are.
FEW, COMMON = 100_000, 1_000
CACHE = "version string, digest binary, n_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def version_digest(vocabulary: str) -> str:
    with open(vocabulary, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def collapse_blanks(text: Column) -> Column:
    """Runs of ASCII blanks as one: the word tokenizer's own normaliser does so, and drops them."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest and n_tokens of one tokenizer version, each digest once; other versions' folders are not read."""
    rows = spark.read.schema(CACHE).parquet(cache) if _exists(spark, cache) else spark.createDataFrame([], CACHE)
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def compact(spark: SparkSession, cache: str, target: str) -> None:
    """A copy of ``cache`` in the new folder ``target``, with each digest of a version once, in few files."""
    rows = spark.read.schema(CACHE).parquet(cache).groupBy("version", "digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows.write.partitionBy("version").parquet(target)


def count_tokens(docs: DataFrame, cache: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", normalise=collapse_blanks, few: int = FEW) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of ``docs``; missing counts are appended to ``cache``."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    version = version_digest(vocabulary)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2(normalise(F.col("text")).cast("binary"), 256)))
    narrow = materialise(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    by_digest = materialise(narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-digests")
    total = by_digest.agg(F.sum("n")).first()[0] or 0
    common = by_digest.where(F.col("n") > total / COMMON).select("digest", F.struct("first").alias("only"))  # fewer than COMMON
    chosen = materialise(by_digest.join(stored_counts(spark, cache, version), "digest", "left_anti").select(F.col("digest").alias("missed"), "first"), "missing-digests")
    wanted = (F.col("digest") == F.col("missed")) & F.col("doc_id").eqNullSafe(F.col("first"))
    if chosen.count() <= few:
        misses = rows.join(F.broadcast(chosen), wanted).select("digest", "text").dropDuplicates(["digest"])  # of repeated rows
    else:
        one = rows.join(F.broadcast(common), "digest", "left").where(F.col("only").isNull() | F.col("doc_id").eqNullSafe(F.col("only.first")))
        misses = one.join(chosen.hint("shuffle_hash"), wanted)

    def encode(batch: pa.RecordBatch) -> list:
        texts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))  # repeated rows once
        return [list(texts), word_counts(vocabulary).counts(list(texts.values()))]

    new = map_batches(misses.select("digest", "text"), "digest binary, n_tokens long", encode)
    new.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").partitionBy("version").parquet(cache)
    counts = stored_counts(spark, cache, version)
    sent = materialise(common.select("digest").join(counts, "digest").withColumnRenamed("n_tokens", "sent"), "common-counts")
    flagged = narrow.join(F.broadcast(sent), "digest", "left")
    columns = ["doc_id", "n_bytes", "n_tokens"]
    near = flagged.where(F.col("sent").isNotNull()).withColumnRenamed("sent", "n_tokens").select(*columns)
    return near.unionByName(flagged.where(F.col("sent").isNull()).join(counts, "digest").select(*columns))
