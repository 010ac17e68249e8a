"""Reproducible review samples: rows ordered by a seeded digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import score


def assignments(documents: DataFrame, seed: int, size: int = 20, development: int = 10, double: int = 5, source: str = "source", document: str = "document_id") -> DataFrame:
    """``size`` documents a source with rank, split and whether a second reviewer sees them.

    The first window has a group limit, so each task sends at most ``size`` rows a source on.
    """
    src, doc = F.col(source).cast("string"), F.col(document).cast("string")
    rows = documents.select(src.alias("source"), doc.alias("document_id")).withColumn("_sample", score(seed, "sample", F.col("source"), F.col("document_id")))
    order = lambda c: Window.partitionBy("source").orderBy(c, "document_id")
    chosen = rows.withColumn("rank", F.row_number().over(order("_sample"))).where(F.col("rank") <= size)
    for purpose in ("split", "double-review"):
        chosen = chosen.withColumn(f"_{purpose}", score(seed, purpose, F.col("source"), F.col("document_id")))
    chosen = chosen.withColumn("_s", F.row_number().over(order("_split"))).withColumn("_d", F.row_number().over(order("`_double-review`")))
    return chosen.select("source", "document_id", F.when(F.col("_s") <= development, "development").otherwise("holdout").alias("assignment_split"), (F.col("_d") <= double).alias("requires_second_review"), "rank")


def stratified_assignments(documents: DataFrame, seed: int, per_stratum: int = 5, development: int = 10, double: int = 5, source: str = "source", document: str = "document_id", stratum: str = "community") -> DataFrame:
    """``per_stratum`` documents of each stratum of a source; split, second review and rank are drawn over the source."""
    rows = documents.select(F.col(source).cast("string").alias("source"), F.col(document).cast("string").alias("document_id"), F.col(stratum).cast("string").alias("stratum"))
    own = score(seed, F.concat(F.lit("stratum:"), F.col("stratum")), F.col("source"), F.col("document_id"))
    within = Window.partitionBy("source", "stratum").orderBy("_own", "document_id")
    chosen = rows.withColumn("_own", own).withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= per_stratum)
    for c, purpose in (("_s", "stratified-split"), ("_d", "stratified-double-review"), ("rank", "stratified-rank")):
        chosen = chosen.withColumn(f"{c}_key", score(seed, purpose, F.col("source"), F.col("document_id")))
        chosen = chosen.withColumn(c, F.row_number().over(Window.partitionBy("source").orderBy(f"{c}_key", "document_id")))
    return chosen.select("source", "document_id", "stratum", F.when(F.col("_s") <= development, "development").otherwise("holdout").alias("assignment_split"), (F.col("_d") <= double).alias("requires_second_review"), "rank")


def short_strata(documents: DataFrame, needed: int, *by: str) -> DataFrame:
    """Strata with fewer documents than a sample needs."""
    return documents.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < needed)
