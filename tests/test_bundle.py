"""The committing sink and predicates pushed to a paged source."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quernstone.schemas import TERMINATIONS
from quernstone.sources import bundle, paged


def save(df, root, run):
    df.write.format("bundle").option("path", f"file://{root}").option("run", run).mode("append").save()


def test_a_run_is_its_manifest(spark, tmp_path):
    bundle.register(spark)
    rows = spark.range(100).select("id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"), F.lit(None).cast("string").alias("none"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("at")).repartition(4)
    save(rows, tmp_path, "r1")
    manifest = bundle.read_manifest(f"file://{tmp_path}", "r1")
    assert manifest["rows"] == 100 and sum(f["rows"] for f in manifest["files"]) == 100 and len(manifest["files"]) == 4
    for f in manifest["files"]:
        raw = (tmp_path / "r1" / f["file"]).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == f["sha256"] and raw.count(b"\n") == f["rows"]
    lines = [x for f in manifest["files"] for x in (tmp_path / "r1" / f["file"]).read_text().splitlines()]
    assert sorted(json.loads(x)["id"] for x in lines) == list(range(100)) and '"none":null,"text":"é' in lines[0] and lines[0].startswith('{"at":"2024-01-02T03:04:05"')
    before = {p: os.stat(tmp_path / "r1" / p).st_mtime_ns for p in os.listdir(tmp_path / "r1")}
    save(rows, tmp_path, "r1")  # the same rows again
    assert {p: os.stat(tmp_path / "r1" / p).st_mtime_ns for p in os.listdir(tmp_path / "r1")} == before and os.listdir(tmp_path) == ["r1"]
    with pytest.raises(Exception, match="written before, with other rows"):
        save(rows.where("id > 0"), tmp_path, "r1")
    assert bundle.damaged(f"file://{tmp_path}", "r1") == []
    first = manifest["files"][0]["file"]
    (tmp_path / "r1" / first).write_text("{}\n")
    (tmp_path / "r1" / "more").write_text("")
    assert bundle.damaged(f"file://{tmp_path}", "r1") == ["more", first] and bundle.damaged(f"file://{tmp_path}", "r2") == ["manifest.json"]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    bundle.register(spark)
    rows = spark.range(0, 40, 1, 4).select("id", F.when(F.col("id") == 35, float("nan")).otherwise(1.0).alias("x"))
    with pytest.raises(Exception):
        save(rows, tmp_path, "r1")
    assert os.listdir(tmp_path) == [] and bundle.read_manifest(f"file://{tmp_path}", "r1") is None
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "part-00000.jsonl").write_text("of a commit that didn't end")
    save(rows.where("id < 30"), tmp_path, "r1")
    assert bundle.damaged(f"file://{tmp_path}", "r1") == [] and bundle.read_manifest(f"file://{tmp_path}", "r1")["rows"] == 30
    save(rows.where("id < 0"), tmp_path, "none")
    assert bundle.read_manifest(f"file://{tmp_path}", "none") == {"files": [], "rows": 0, "run": "none"}
    with pytest.raises(Exception, match="one step of a path"):
        save(rows, tmp_path, "../r")


NOTICES = [{"publication-date": f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", "notice-type": ["cn-standard", "can", "pin"][i % 3], "classification-cpv": f"{[48, 72][i % 2]}{i:06d}", "publication-number": str(i)} for i in range(112)]


def recorded(stratum, page, options):
    """A recorded service: it answers the pushed query, ten notices a page."""
    found = [n for n in NOTICES if paged.answers(n, json.loads(options.get("predicates", "[]")))]
    return {"items": found[page * 10 - 10 : page * 10], "more": page * 10 < len(found)}


def test_predicates_are_pushed_to_the_service(spark):
    paged.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        fields = {"published": "publication-date", "kind": "notice-type", "cpv": "classification-cpv"}
        read = lambda kind: spark.read.format(kind).option("transport", "tests.test_bundle:recorded").option("strata", '["a","b"]').option("fields", json.dumps(fields)).load()
        everything = read("paged").where("termination IS NULL").collect()
        assert len(everything) == 224 and max(r.page for r in everything) == 12
        asked = read("paged_query").where("published >= '2024-02-01' AND published < '2024-03-01' AND kind IN ('can', 'pin') AND cpv LIKE '48%' AND stratum = 'a' AND length(payload) > 5")
        assert "stratum = a" not in asked._jdf.queryExecution().optimizedPlan().toString()  # taken over whole by the source
        got = asked.collect()
        plain = [r for r in everything if "2024-02-01" <= r.published < "2024-03-01" and r.kind in ("can", "pin") and r.cpv.startswith("48") and r.stratum == "a"]
        assert sorted(r.payload for r in got) == sorted(r.payload for r in plain) and len(got) > 5 and max(r.page for r in got) == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def failing(stratum, page, options):
    return {"error": stratum}


def slow(stratum, page, options):
    return {"error": "retryable", "retry_after": 1000} if stratum == "waits" else {"items": ["x" * 100], "more": True}


def test_pages_end_by_the_fixed_reasons(spark):
    paged.register(spark)
    read = lambda function, strata, **options: {r.stratum: r.termination for r in spark.read.format("paged").options(transport=f"tests.test_bundle:{function}", strata=json.dumps(strata), **options).load().where("termination IS NOT NULL").collect()}
    ends = read("failing", ["rate_limited", "backoff_budget_exhausted", "odd"]) | read("slow", ["waits", "bytes"], bytes=250, seconds=5) | {"requests": read("slow", ["r"], requests=1)["r"], "attempts": read("slow", ["t"], attempts=1)["t"]}
    assert ends == {"rate_limited": "rate_limit_exhausted", "backoff_budget_exhausted": "backoff_budget_exhausted", "odd": "transport_error", "waits": "smoke_deadline_exhausted", "bytes": "source_exhausted", "requests": "request_budget_exhausted", "attempts": "transport_error"}
    assert set(ends.values()) <= set(TERMINATIONS)
