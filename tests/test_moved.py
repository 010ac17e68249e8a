"""What an iterative operator writes shrinks with what is left to decide."""

import random

from pyspark.sql import functions as F

from quernstone import tables
from quernstone.operators.opportunity import components
from quernstone.operators.select import Key, select


def recorded(monkeypatch) -> list[tuple[str, int]]:
    seen, write = [], tables.written

    def written(df, label):
        back = write(df, label)
        seen.append((label, back.count()))
        return back

    monkeypatch.setattr(tables, "written", written)
    return seen


def test_leaves_go_no_round(spark, monkeypatch):
    seen = recorded(monkeypatch)
    star = spark.range(1, 200).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    tail = spark.createDataFrame([(500, 7), (0, 7)], "a long, b long")
    got = {r.node: r.root for r in components(star.unionByName(tail)).collect()}
    assert got == {**{n: 0 for n in range(1, 200)}, 500: 0}
    assert all(n <= 2 for label, n in seen[1:] if label == "links") and seen[0] == ("links", 200)


def test_decided_rows_move_once(spark, monkeypatch):
    rng = random.Random(9)
    rows = spark.createDataFrame([(i, f"a{rng.randrange(20)}", f"b{rng.randrange(20)}") for i in range(300)], "ord long, a string, b string")
    seen = recorded(monkeypatch)
    got = select(rows, F.col("ord"), [Key("r0", F.col("a"), 2), Key("r1", F.col("b"))], fold_rows=0)
    assert got.where("accepted").count() <= 20
    assert sum(n for label, n in seen[1:] if label != "selection-broken") < 600  # each round's tables together: less than two passes over the rows
