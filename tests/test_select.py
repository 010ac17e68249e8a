"""Selection against a sequential fold, under random keys, orders and partitionings."""

import random

from pyspark.sql import functions as F

from quernstone.operators.select import Key, segment_counters, select, select_strata
from quernstone.streaming.observations import StreamingSelection


def fold(rows, limits, quota=None, held=None):
    held = held if held is not None else [{} for _ in limits]
    out, n = {}, 0
    for ord_, keys in rows:
        if quota is not None and n >= quota:
            out[ord_] = (None, None)
            continue
        reason = next((i for i, ks in enumerate(keys) if any(held[i].get(k, 0) >= limits[i] for k in ks)), None)
        out[ord_] = (reason is None, None if reason is None else f"r{reason}")
        if reason is None:
            n += 1
            for i, ks in enumerate(keys):
                for k in set(ks):
                    held[i][k] = held[i].get(k, 0) + 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(o, k[0][0], k[1][0], k[2]) for o, k in rows], "ord long, a string, b string, c array<string>")


def keys():
    return [Key("r0", F.col("a")), Key("r1", F.col("b")), Key("r2", F.col("c"), 2)]


def sample(rng, n):
    return [(i, ([f"a{rng.randrange(n)}"], [f"b{rng.randrange(n)}"], [f"c{rng.randrange(n // 4 + 1)}" for _ in range(rng.randint(0, 3))])) for i in range(n)]


def test_agrees_with_fold(spark):
    rng = random.Random(4)
    for n, partitions, fold_rows in ((25, 3, 0), (60, 7, 10**6), (60, 1, 80)):
        rows = sample(rng, n)
        shuffled = rows[:]
        rng.shuffle(shuffled)
        got = {r.ord: (r.accepted, r.reason) for r in select(table(spark, shuffled).repartition(partitions), F.col("ord"), keys(), fold_rows=fold_rows).collect()}
        assert got == fold(rows, (1, 1, 2))


def test_quota_cuts(spark):
    rows = sample(random.Random(5), 50)
    got = {r.ord: (r.accepted, r.reason) for r in select(table(spark, rows), F.col("ord"), keys(), quota=7).collect()}
    assert got == fold(rows, (1, 1, 2), 7)


def test_strata_share_keys_and_cut_rows_block_nothing(spark):
    rows = sample(random.Random(6), 40)
    data = table(spark, rows).withColumn("s", F.when(F.col("ord") % 2 == 0, "x").otherwise("y"))
    got = {r.ord: r.accepted for r in select_strata(data, "s", {"x": 6, "y": 6}, F.col("ord"), keys()).collect()}
    held = [{}, {}, {}]
    want = fold([r for r in rows if r[0] % 2 == 0], (1, 1, 2), 6, held) | fold([r for r in rows if r[0] % 2], (1, 1, 2), 6, held)
    assert got == {k: v[0] for k, v in want.items()}


def test_null_keys_and_empty(spark):
    data = spark.createDataFrame([(1, None, "x", None), (2, None, "x", [None, "q"]), (3, None, "y", [])], "ord long, a string, b string, c array<string>")
    assert {r.ord: r.reason for r in select(data, F.col("ord"), keys()).collect()} == {1: None, 2: "r1", 3: None}
    assert select(data.where("false"), F.col("ord"), keys()).count() == 0


def test_stream_equals_batch(spark):
    rows = sample(random.Random(7), 30)
    state = StreamingSelection(spark, keys(), "ord", quota=10)
    for number, at in enumerate(range(0, 30, 10)):
        state.process(table(spark, rows[at : at + 10]), number)
    state.process(table(spark, rows[:10]), 0)  # a replayed batch
    got = {r.ord: r.accepted for r in state.selected().collect()}
    assert got == {k: v[0] for k, v in fold(rows, (1, 1, 2), 10).items()}
    n = segment_counters(state.selected().withColumn("s", F.lit(1)), "s").first()
    assert n.fetched == 30 and n.accepted == 10 and n.processed == n.accepted + n.rejected
