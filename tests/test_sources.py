import json

import pytest
from pyspark.sql import functions as F

from quernstone.sources import files, paged, sinks

CALLS = {}


def transport(stratum, page, options):
    """Two pages; the second answers only when asked again."""
    if stratum == "down":
        return {"error": "fatal"}
    if page == 2:
        CALLS[stratum] = CALLS.get(stratum, 0) + 1
        if CALLS[stratum] == 1:
            return {"error": "retryable", "retry_after": 0.0}
    return {"items": [{"id": f"{stratum}-{page}-{i}"} for i in range(3)], "more": page < 2}


def test_paged_source(spark):
    paged.register(spark)
    read = lambda **o: spark.read.format("paged").options(transport="tests.test_sources:transport", strata=json.dumps(["a", "b", "down"]), **o).load()
    rows = read().collect()
    assert sum(r.payload is not None for r in rows) == 12
    assert {r.stratum: r.termination for r in rows if r.termination} == {"a": "source_exhausted", "b": "source_exhausted", "down": "transport_error"}
    few = read(requests="1").collect()
    assert {r.stratum: r.termination for r in few if r.termination}["a"] == "request_budget_exhausted"
    assert [paged.pause(n, paged.Budget(), None) for n in (1, 2, 3, 4, 5)] == [1, 2, 4, 8, 8] and paged.pause(1, paged.Budget(), 3) == 3


def test_pages(spark, tmp_path):
    issue = {"id": "1", "number": 1, "title": "t"}
    (tmp_path / "p.json").write_text("\n".join(json.dumps({"page": p, "items": [issue] * 2, "has_next": p < 2}) for p in (1, 2)))
    rows = files.pages(spark, str(tmp_path / "p.json"), "github")
    assert rows.select("signature").distinct().count() == 1 and files.payloads(rows, "github").count() == 4
    assert [r.m for r in rows.select(files.more_pages("github", F.col("page"), 2).alias("m")).orderBy("page").collect()] == [True, False]
    (tmp_path / "n.json").write_text(json.dumps({"notices": [{"notice-identifier": "n", "buyer-identifier": ["b"]}], "totalNoticeCount": 1, "timedOut": False}))
    got = files.notices(files.notice_pages(spark, str(tmp_path / "n.json"))).first()
    assert json.loads(got["buyer-identifier"]) == ["b"]


def test_query_set():
    found = files.query_set({"a": "48", "b": "72"}, "20240101", "20240401", "competition", ("cn",))
    assert "classification-cpv = 48*" in found[0]["query"] and len({x["set_sha256"] for x in found}) == 1


def test_bundle_is_written_once_and_fails_closed(spark, tmp_path):
    root = f"file://{tmp_path}"
    items = spark.createDataFrame([("b", 1), ("a", 2)], "document_id string, n int")
    sinks.write_bundle(root, "r1", {"items": items}, {"report": {"x": 1}}, qualified=True)
    assert json.loads((tmp_path / "latest-qualified.json").read_text()) == {"run_id": "r1"}
    with pytest.raises(FileExistsError):
        sinks.write_bundle(root, "r1", {"items": items}, {}, qualified=True)
    broken = items.select(F.raise_error(F.lit("no")).alias("document_id"))
    with pytest.raises(Exception):
        sinks.write_bundle(root, "r2", {"items": broken}, {}, qualified=True)
    assert json.loads((tmp_path / "latest-qualified.json").read_text()) == {"run_id": "r1"} and not (tmp_path / "runs/r2").exists()
    sinks.write_receipt(spark, root, "c1", items.agg(F.count("*").alias("n")))
    assert json.loads((tmp_path / "runs/c1/receipt.json").read_text()) == {"n": 2}
    with pytest.raises(ValueError):
        sinks.write_receipt(spark, root, "c2", items)
