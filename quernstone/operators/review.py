"""Blind review: packets out, submissions in, canonical labels and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import submission_errors

PACKET = ("assignment_id", "source", "title", "normalized_text", "published_at", "canonical_url")


def packet(assignments: DataFrame, items: DataFrame, salt: str) -> tuple[DataFrame, DataFrame]:
    """The blind packet and the internal map of opaque ids; raises where an assignment has no record."""
    joined = assignments.join(items.drop("source"), "document_id", "left")
    if joined.where(F.col("text").isNull()).take(1):
        raise ValueError("an assigned document is missing")
    joined = joined.withColumn("assignment_id", F.substring(F.sha2(F.concat_ws("\0", F.lit(salt), "source", "document_id"), 256), 1, 24))
    blind = joined.select("assignment_id", "source", "title", F.col("text").alias("normalized_text"), "published_at", F.col("source_url").alias("canonical_url"))
    return blind, joined.select("assignment_id", "document_id", "source", "assignment_split", "requires_second_review")


def coverage(submissions: DataFrame, expected: DataFrame, key: str = "assignment_id") -> DataFrame:
    """Keys that are missing from, or too many in, the submissions."""
    missing = expected.select(key).join(submissions, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    strange = submissions.select(key).join(expected, key, "left_anti").select(key, F.lit("unexpected").alias("problem"))
    twice = submissions.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("repeated").alias("problem"))
    return missing.unionByName(strange).unionByName(twice)


def rater_pairs(first: DataFrame, second: DataFrame, key: str = "assignment_id", reviewer: str = "reviewer_id") -> DataFrame:
    """The two reviewers of each key that two different ones have judged."""
    a = first.select(key, F.col(reviewer).alias("first_reviewer"))
    return a.join(second.select(key, F.col(reviewer).alias("second_reviewer")), key).where("first_reviewer <> second_reviewer")


def ingest(primary: DataFrame, secondary: DataFrame, mapping: DataFrame, guide_version: str) -> DataFrame:
    """Canonical labels of both rounds; raises on an invalid, missing or dependent submission."""
    both = primary.withColumn("review_round", F.lit("primary")).unionByName(secondary.withColumn("review_round", F.lit("secondary")))
    bad = both.withColumn("errors", submission_errors()).where(F.size("errors") > 0).select("assignment_id", "errors").take(1)
    if bad:
        raise ValueError(f"invalid submission {bad[0]['assignment_id']}: {bad[0]['errors']}")
    for rows, expected in ((primary, mapping), (secondary, mapping.where("requires_second_review"))):
        if problem := coverage(rows, expected).take(1):
            raise ValueError(f"{problem[0]['problem']} submission {problem[0]['assignment_id']}")
    if secondary.join(rater_pairs(primary, secondary), "assignment_id", "left_anti").take(1):
        raise ValueError("a second review must be another reviewer's")
    return both.join(mapping, "assignment_id").select(
        F.sha2(F.concat_ws("\0", "assignment_id", "reviewer_id", "review_round"), 256).alias("label_id"), "document_id", "source", "reviewer_id", "assignment_split", "review_round", "problem_signal", "money_signal",
        "money_signal_type", "structural_money_signal", "usable_evidence", "noise", "label_reason", "labeled_at", F.lit(guide_version).alias("guide_version"), "external_context_used", "reviewer_independence_asserted",
    )


def audit(labels: DataFrame) -> DataFrame:
    return labels.select("label_id", "external_context_used", "reviewer_independence_asserted")


def ingestion_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("review_round").agg(
        F.count(F.lit(1)).alias("n_labels"), F.count_if("external_context_used").alias("n_external_context"), F.count_if("reviewer_independence_asserted").alias("n_independent"), F.count_if(F.col("assignment_split") == "development").alias("n_development")
    )
