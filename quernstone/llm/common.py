"""Shared pieces of the corpus operators: written tables, bounded Arrow batches, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of characters other than the ASCII blanks (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that a Python function works on at once: whole texts travel in batches.
ROWS, BYTES = 1024, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, or one of our own in a local session.

    A cluster must name its folder in that setting; a machine-local one would not be seen by its
    executors, so without it this raises.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark.sparkContext, "_quernstone_dir", None)
    if own is None:
        own = spark.sparkContext._quernstone_dir = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    return own


#: Paths made while a ``scratch`` is open.
_scratch: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables made within are deleted at the end: what is to last must be written to a path made before."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop_path(spark, path)


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there.

    Unlike a cached or locally checkpointed DataFrame it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of at most ``ROWS`` rows and about ``BYTES`` bytes, none empty.

    Spark bounds a batch by its own settings, which belong to the caller's session.
    """
    for batch in batches:
        n = max(1, min(ROWS, batch.num_rows * BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def map_batches(df: DataFrame, schema: str, function: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """``function`` returns the columns of one output batch for each input batch."""
    out = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            columns = function(batch)
            arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, out)]
            arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, out)]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, keep: Callable[[pa.RecordBatch], object]) -> DataFrame:
    """The rows for which ``keep`` gives true, all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
