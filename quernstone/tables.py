"""Tables written between the steps of an iterative operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; in a local session a folder of our own where it is unset; a cluster must set it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark.sparkContext, "_quernstone_tables", None)
    if own is None:
        own = spark.sparkContext._quernstone_tables = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    return own


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table read back: its lineage ends there, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quernstone_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a written table that no later plan reads."""
    path = getattr(df, "_quernstone_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
