"""Fail-closed sinks: data is staged, checked and then named; a pointer moves last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_of(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = path_of(spark, path)
    return fs.exists(target)


def write_text(spark: SparkSession, path: str, content: str, private: bool = False) -> None:
    """A small file, whole or not at all: written beside its place, then renamed over it."""
    staged, fs = path_of(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(staged)
    out.write(bytearray(content.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    target, _ = path_of(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(staged), fs.makeQualified(target), over)  # one step: a reader sees the old file or the new one
    if private:
        fs.setPermission(target, jvm.org.apache.hadoop.fs.permission.FsPermission("600"))


def write_json(spark: SparkSession, path: str, value: object, private: bool = False) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n", private)


def write_bundle(root: str, run_id: str, tables: dict[str, DataFrame], documents: dict[str, object], qualified: bool, order: str = "document_id") -> str:
    """A run's tables and JSON documents under ``root/runs/run_id``, written once; the pointer names the latest qualified run.

    Tables are range-partitioned and sorted by ``order``, so their files stand in order.
    """
    spark = next(iter(tables.values())).sparkSession
    final, staged = f"{root}/runs/{run_id}", f"{root}/.staged-{run_id}"
    if exists(spark, final) or exists(spark, staged):
        raise FileExistsError(final)
    target, fs = path_of(spark, staged)
    try:
        for name, df in tables.items():
            (df.repartitionByRange(order).sortWithinPartitions(order) if order in df.columns else df).write.mode("errorifexists").json(f"{staged}/{name}")
        for name, value in documents.items():
            write_json(spark, f"{staged}/{name}.json", value)
        place, _ = path_of(spark, final)
        fs.mkdirs(place.getParent())
        if not fs.rename(target, place):
            raise OSError(f"could not name {final}")
    except BaseException:
        fs.delete(target, True)
        raise
    if qualified:
        write_json(spark, f"{root}/latest-qualified.json", {"run_id": run_id})
    return final


def write_receipt(spark: SparkSession, root: str, run_id: str, receipt: DataFrame) -> str:
    """An aggregate-only receipt of one row, and the pointer to the latest."""
    rows = receipt.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a receipt is one row")
    path = f"{root}/runs/{run_id}/receipt.json"
    if exists(spark, path):
        raise FileExistsError(path)
    write_json(spark, path, json.loads(rows[0]))
    write_json(spark, f"{root}/latest.json", {"run_id": run_id})
    return path


def write_labels(labels: DataFrame, root: str) -> None:
    """Labels in a folder for each split, so that the holdout stays sealed."""
    labels.write.mode("errorifexists").partitionBy("assignment_split").json(root)


def privacy_receipt(spark: SparkSession, root: str, run_id: str, found: DataFrame) -> str:
    """Counts of violations instead of any data."""
    counts = {r["kind"]: r["n"] for r in found.select(F.explode("found").alias("f")).groupBy(F.substring_index("f", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    path = f"{root}/privacy-failures/{run_id}.json"
    write_json(spark, path, {"run_id": run_id, "violations": counts, "retained_items": 0}, private=True)
    return path


def review_form(packet: DataFrame, title: str, most: int = 25) -> str:
    """A self-contained review page of a packet of at most ``most`` records."""
    from html import escape

    from ..operators.review import PACKET

    rows = packet.select(*PACKET).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a packet holds at most {most} records")
    fields = ("problem_signal", "money_signal", "structural_money_signal", "usable_evidence", "noise")
    cards = "".join(
        f"<section><h2>{escape(r['title'] or r['assignment_id'])}</h2><p>{escape(r['normalized_text'])}</p>" + "".join(f"<label><input type=checkbox name={f} data-id={escape(r['assignment_id'])}>{f}</label>" for f in fields) + "</section>" for r in rows
    )
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title>{cards}"
