"""Streams of records: a page is a micro-batch, and state outlives batches as written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..operators.select import Key, accepted_keys, select
from ..sources.sinks import exists, path_of


class StreamingSelection:
    """Greedy selection over micro-batches: pass ``process`` to ``foreachBatch``.

    Keys that accepted rows hold come before all rows of later batches.  Results and held keys lie
    in ``root`` by the number of their batch.  A batch is done once its keys are written, so one
    that is replayed after a failure, in this process or a later one with the same ``root``, is
    selected again only if it wasn't done.
    """

    def __init__(self, spark: SparkSession, keys: list[Key], order: str, quota: int | None = None, root: str | None = None) -> None:
        self.spark, self.keys, self.order, self.quota = spark, keys, order, quota
        self.root = root or f"{tables.shared_dir(spark)}/selection-{uuid.uuid4().hex}"

    def _path(self, kind: str, number: int) -> str:
        return f"{self.root}/{kind}/{number:012d}"

    def numbers(self) -> list[int]:
        """Batches that are done."""
        folder, fs = path_of(self.spark, f"{self.root}/held")
        if not fs.exists(folder):
            return []
        found = [int(x.getPath().getName()) for x in fs.listStatus(folder)]
        return sorted(n for n in found if exists(self.spark, f"{self._path('held', n)}/_SUCCESS"))

    def _read(self, kind: str, numbers: list[int]) -> DataFrame | None:
        return self.spark.read.parquet(*[self._path(kind, n) for n in numbers]) if numbers else None

    def process(self, batch: DataFrame, number: int) -> None:
        done = self.numbers()
        if number in done:
            return
        before = [n for n in done if n < number]
        earlier = self._read("results", before)
        left = None if self.quota is None else self.quota - (earlier.where("accepted").count() if earlier is not None else 0)
        if left == 0:  # the rest of the stream is fetched but not processed
            part = batch.withColumn("accepted", F.lit(None).cast("boolean")).withColumn("reason", F.lit(None).cast("string"))
        else:
            part = select(batch, F.col(self.order), self.keys, left, self._read("held", before))
        part.write.mode("overwrite").parquet(self._path("results", number))
        accepted_keys(self._read("results", [number]), self.keys).write.mode("overwrite").parquet(self._path("held", number))

    def selected(self) -> DataFrame | None:
        return self._read("results", self.numbers())


def windowed_counts(events: DataFrame, ts: str, late: str, width: str, *by: str) -> DataFrame:
    """Counts by time window, with rows later than the watermark dropped: batch and stream alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def is_open(ts: str, cutoff: str) -> Column:
    return F.col(ts) < F.lit(cutoff)


def before_cutoff(rows: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """Rows published before a frozen cutoff, which never opens again."""
    return rows.where(is_open(ts, cutoff))


def cutoff_counts(rows: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """How many rows a frozen cutoff leaves out, and how many it lets be processed."""
    open_ = is_open(ts, cutoff)
    return rows.agg(F.count_if(~open_).alias("after_cutoff"), F.count_if(open_).alias("processed"))
