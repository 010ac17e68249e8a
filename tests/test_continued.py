"""Streams over recorded envelopes: restarts, waiting and ends."""

import json

import pytest

from quernstone.sources import continued


def record(root, stratum, token, **envelope):
    place = root / "pages" / continued.quote(stratum, safe="")
    place.mkdir(parents=True, exist_ok=True)
    (place / f"{continued.quote(token, safe='')}.json").write_text(json.dumps(envelope))


def run(spark, root, kind, strata):
    """A run until all that is recorded has been read, from where the one before ended."""
    stream = spark.readStream.format("continued").option("path", f"file://{root}/pages").option("kind", kind).option("strata", json.dumps(strata)).load()
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(root / "state")).option("path", str(root / "out")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted((r.stratum, r.number, r.place, json.loads(r.payload)) for r in spark.read.parquet(str(root / "out")).collect())


def test_restarts_give_each_row_once(spark, tmp_path):
    continued.register(spark)
    record(tmp_path, "a/b", "*", items=[1, 2], cursor="x/é?")
    record(tmp_path, "a/b", "x/é?", items=[3], cursor="y")
    record(tmp_path, "c", "*", items=[9], cursor="*")  # a cursor that stays
    first = [("a/b", 1, 0, 1), ("a/b", 1, 1, 2), ("a/b", 2, 0, 3), ("c", 1, 0, 9)]
    assert run(spark, tmp_path, "cursor", ["a/b", "c"]) == first == run(spark, tmp_path, "cursor", ["a/b", "c"])
    record(tmp_path, "a/b", "y", items=[4], cursor="z")
    record(tmp_path, "a/b", "z", items=[], cursor="more")
    record(tmp_path, "a/b", "more", items=[5], cursor="")
    record(tmp_path, "c", "1", items=[8], cursor="")
    assert run(spark, tmp_path, "cursor", ["a/b", "c"]) == sorted([*first, ("a/b", 3, 0, 4)])


def test_pages_and_links(spark, tmp_path):
    continued.register(spark)
    for n in (1, 2, 3):
        record(tmp_path, "p", str(n), items=[n], has_more=n < 2)
    assert run(spark, tmp_path, "page", ["p"]) == [("p", 1, 0, 1), ("p", 2, 0, 2)]
    link = '<https://h/x?page=1>; rel="prev", <https://h/x?per_page=5&page=7>; rel="next"'
    assert continued.next_token("link", "2", {"items": [1], "link": link}) == "7" and continued.next_token("link", "7", {"items": [1], "link": link}) is None
    assert continued.next_token("link", "2", {"items": [1], "link": None}) is None and continued.next_token("page", "2", {"items": [], "has_more": True}) is None
    with pytest.raises(ValueError):
        continued.ContinuedReader({"path": "x", "kind": "odd", "strata": "[]"})


def test_a_batch_reads_the_same_again(tmp_path):
    for n in (1, 2, 3):
        record(tmp_path, "p", str(n), items=[n, -n], has_more=True)
    reader = continued.ContinuedReader({"path": f"file://{tmp_path}/pages", "kind": "page", "strata": '["p", "q"]'})
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end["p"] == {"taken": 3, "token": "4", "ended": False} and end["q"] == start["q"]
    rows = [list(reader.read(x)) for x in reader.partitions(start, end)]
    assert rows == [list(reader.read(x)) for x in reader.partitions(start, end)] and len(rows[0]) == 6
    assert [list(reader.read(x)) for x in reader.partitions(end, reader.latestOffset())] == [[]]
