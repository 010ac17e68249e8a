"""Densities, agreement, completeness and ranking: closed forms over partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.959963984540054


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def with_wilson(counts: DataFrame, positive: str = "positive", total: str = "total") -> DataFrame:
    """``counts`` with estimate and the bounds of its 95 % Wilson interval."""
    n, p = F.col(total).cast("double"), F.col(positive) / F.col(total)
    spread = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    scale = 1 + Z * Z / n
    middle = p + Z * Z / (2 * n)
    return counts.withColumns({"estimate": p, "wilson_low": F.greatest(F.lit(0.0), (middle - spread) / scale), "wilson_high": F.least(F.lit(1.0), (middle + spread) / scale)})


def signal_density(labels: DataFrame, fields: tuple[str, ...], *by: str) -> DataFrame:
    """Positives, total and Wilson interval of each boolean field."""
    long = labels.unpivot(list(by), list(fields), "field", "value") if by else labels.select(*fields).unpivot([], list(fields), "field", "value")
    return with_wilson(long.groupBy(*by, "field").agg(F.count_if("value").alias("positive"), F.count("value").alias("total")).where("total > 0"))


def money_density(labels: DataFrame, *by: str) -> DataFrame:
    """Share of money signals, and of those that aren't structural."""
    return labels.groupBy(*by).agg(F.avg(F.col("money_signal").cast("int")).alias("raw_density"), F.avg((F.col("money_signal") & ~F.col("structural_money_signal")).cast("int")).alias("adjusted_density"))


def agreement(pairs: DataFrame, *by: str) -> DataFrame:
    """Raw agreement and Cohen's kappa of boolean columns ``a`` and ``b``; none where one answer is too rare."""
    n = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("sample_size"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if("a").alias("pa"), F.count_if("b").alias("pb"))
    size, a, b = F.col("sample_size"), F.col("pa") / F.col("sample_size"), F.col("pb") / F.col("sample_size")
    raw = F.col("same") / size
    positive = F.col("pa") + F.col("pb")
    rare = F.least(positive, 2 * size - positive) < 2
    chance = a * b + (1 - a) * (1 - b)
    kappa = F.when(~rare, F.try_divide(raw - chance, 1 - chance))
    return n.select(
        *by, "sample_size", raw.alias("raw_agreement"), kappa.alias("kappa"), F.when(rare, "prevalence_limited").otherwise("calculated").alias("kappa_status"), (positive / (2 * size)).alias("positive_prevalence"),
        ((raw >= 0.8) & (rare | F.coalesce(kappa >= 0.6, F.lit(False)))).alias("passed"),
    )


def paired(primary: DataFrame, secondary: DataFrame, fields: tuple[str, ...], key: str = "document_id") -> DataFrame:
    """Two reviewers' answers to each field about the same documents."""
    a = primary.unpivot([key, "reviewer_id"], list(fields), "field", "a")
    b = secondary.unpivot([key, "reviewer_id"], list(fields), "field", "b").withColumnRenamed("reviewer_id", "second_id")
    return a.join(b, [key, "field"]).where(F.col("reviewer_id") != F.col("second_id"))


def development_report(labels: DataFrame, fields: tuple[str, ...] = ("problem_signal", "money_signal", "usable_evidence", "noise"), primary_size: int = 10, secondary_size: int = 5) -> tuple[DataFrame, DataFrame]:
    """Densities and agreements of the development split; raises where its gates aren't met."""
    rounds = {r["review_round"]: r for r in labels.groupBy("review_round").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("docs"), F.count_if(F.col("assignment_split") != "development").alias("other")).collect()}
    for name, size in (("primary", primary_size), ("secondary", secondary_size)):
        r = rounds.get(name)
        if r is None or r["n"] != size or r["docs"] != size or r["other"]:
            raise ValueError(f"the {name} round must have {size} development labels of {size} documents")
    first, second = (labels.where(F.col("review_round") == x) for x in ("primary", "secondary"))
    if second.join(first, "document_id", "left_anti").take(1):
        raise ValueError("a secondary label has no primary one")
    pairs = paired(first, second, fields)
    if pairs.count() != secondary_size * len(fields):
        raise ValueError("secondary labels must be another reviewer's")
    first = first.withColumn("money_signal_adjusted", F.col("money_signal") & ~F.col("structural_money_signal"))
    return signal_density(first, (*fields, "money_signal_adjusted")), agreement(pairs, "field")


def primary_sources(candidates: DataFrame, order: str, limit: int = 3) -> DataFrame:
    """Candidates with their role: the best ``limit`` that pass, and the provisional ones as fallback; ties by ``order``."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("eligibility").orderBy(F.col("score").desc(), order))
    ranked = candidates.where(F.col("eligibility").isin("pass", "provisional")).withColumn("place", place)
    return ranked.where((F.col("eligibility") == "provisional") | (F.col("place") <= limit)).select("source", F.when(F.col("eligibility") == "pass", "primary").otherwise("fallback").alias("role"), "place", "score")


def completeness(rows: DataFrame, conditions: dict[str, Column], *by: str) -> DataFrame:
    """Share of rows that meet each condition."""
    return rows.groupBy(*by).agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in conditions.items()], F.count(F.lit(1)).alias("n_rows"))


def selection_succeeded(selected: DataFrame, limit: int = 3) -> DataFrame:
    """One row over the rows of ``primary_sources``: how many stand first, how many may step in, and whether enough were found."""
    n = lambda role: F.count_if(F.col("role") == role)
    return selected.agg(n("primary").alias("n_primary"), n("fallback").alias("n_fallback"), (n("primary") == limit).alias("success"))
