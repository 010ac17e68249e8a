"""Mixing sources to target weights by capped water-filling.

The mix holds ``share`` times the words of all sources.  A source gets its weight's part, but no
more than ``max_epochs`` times its own words; what it can't hold is shared again among the others
by weight until none is above its cap.  The level at which that ends is found in closed form:
sources are ordered by cap over weight, and the first ones are filled.

Within a source every document is taken floor(target / size) times whole.  The remaining
fraction is drawn by a seeded digest that puts documents into 4,096 bins: bins before the
boundary are taken whole once more, and those in the boundary bin for the part of their words
that is still missing.  Counts of words by source and bin decide that; no rows are gathered.

Cases: a null text has size 0 and so takes nothing.  A null source is a source, ordered last.  A
source without words has target 0.  Rows of one id share a bin, so repeated rows are taken alike;
a null id has a bin too.  An empty table gives an empty result.  Columns other than the id, text
and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialise

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, source, size in words and the seeded bin of every row."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_of(F.col(text_col)).alias("size"), F.substring(drawn, 1, 3).alias("bin")
    )


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: one row per source of ``by_source`` (source, source_size).

    The windows run over the sources alone, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    caps = by_source.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    filled = caps.select(
        "*",
        F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("weights"),
        (F.sum("source_size").over(whole) * F.lit(share).cast("double")).alias("total"),
    )
    level = (F.col("total") - F.col("before")) / F.col("weights")
    open_ = filled.select("*", F.when(level * F.col("weight") < F.col("cap"), level).alias("level"))
    # The first source in the order that stays below its cap sets the level of all after it.  It is
    # the largest: each later one's figure takes a source for filled that isn't.
    return open_.select(
        "source", "source_size", F.coalesce(F.least(F.max("level").over(whole) * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **plan) -> DataFrame:
    """doc_id, source, size, bin, source_size, target and taken for every row of ``docs``."""
    rows = materialise(sizes(docs, id_col, text_col, source_col, seed), "mix-sizes")
    plan_of = materialise(boundaries(rows, **plan), "mix-plan")  # a row a source; its written size decides how it is joined
    return rows.join(plan_of, F.col("source").eqNullSafe(F.col("key"))).drop("key").withColumn("taken", taken())


def boundaries(rows: DataFrame, **plan) -> DataFrame:
    """For each source: target, how often all is taken whole, the boundary bin and its part."""
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))  # at most 4,096 rows a source
    by_source = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), **plan)
    by_source = by_source.select(F.col("source").alias("key"), "source_size", "target", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).alias("whole"))
    left = F.col("target") - F.col("whole") * F.col("source_size")
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    summed = bins.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    met = summed.join(by_source, F.col("source").eqNullSafe(F.col("key"))).where((F.col("before") <= left) & (F.col("before") + F.col("words") > left))
    edge = met.groupBy("key").agg(F.min("bin").alias("edge"), F.min((left - F.col("before")) / F.col("words")).alias("part"))
    return by_source.join(edge.withColumnRenamed("key", "edge_key"), F.col("key").eqNullSafe(F.col("edge_key")), "left").drop("edge_key")


def taken() -> Column:
    """Words of a row that the mix takes: whole repetitions, one more before the boundary, a part at it."""
    once = F.when(F.col("bin") < F.col("edge"), F.col("size")).when(F.col("bin") == F.col("edge"), F.floor(F.col("size") * F.col("part") + 0.5)).otherwise(0)
    return (F.col("whole") * F.col("size") + F.coalesce(once, F.lit(0))).cast("long")


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **plan) -> DataFrame:
    """The mix itself: rows of ``docs`` once for every whole repetition, and once cut to the part that remains.

    A cut row keeps its text up to the last word it takes, blanks and lines as they stand.  The written plan has a row a source, so
    it is joined to the texts where they are as long as its size allows.
    """
    rows = materialise(sizes(docs, id_col, text_col, source_col, seed), "mix-sizes")
    plan_of = materialise(boundaries(rows, **plan), "mix-plan")
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).cast("string").alias("source"), F.substring(drawn, 1, 3).alias("bin"), words_of(F.col(text_col)).alias("size"))
    mixed = own.join(plan_of, F.col("source").eqNullSafe(F.col("key"))).withColumn("taken", taken())
    parts = F.when(F.col("size") > 0, F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).otherwise(F.array().cast("array<int>"))
    parts = F.when(F.col("taken") > 0, parts).otherwise(F.array().cast("array<int>"))
    each = mixed.select("row", "size", F.explode(parts).alias("copy"), "taken")
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    text = F.col(f"row.{text_col}")
    # pieces of blanks with the word after them: the first ones make up the text as far as it is taken
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), left.cast("int")), "")
    cut = F.when(left >= F.col("size"), text).otherwise(first)
    return each.select(*[(cut if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
