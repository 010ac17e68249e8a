"""Near-identical texts and bursts against brute force."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import opportunity, similar


def least_of(ids, links):
    """The least id that each is connected to."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def sets_of(text, words=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows if i is not None]
    return [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if a and b and 9 * len(a & b) >= 4 * (len(a) + len(b))]


def made(rng):
    """Unlike texts, copies, near copies at all distances about the bound, chains, and a common passage."""
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("abcdefghijklmnopqrstuvwxyz")
    passage = [word() for _ in range(30)]
    texts = [[word() for _ in range(rng.randint(1, 60))] for _ in range(60)]
    for _ in range(40):
        texts.append(rng.choice(texts[:60])[:])
    for _ in range(150):
        t = rng.choice(texts)[:]
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    for _ in range(80):
        texts.append([word() for _ in range(rng.randint(0, 12))] + passage + [word() for _ in range(rng.randint(0, 12))])
    chain = [word() for _ in range(80)]
    for n in range(60):
        chain = chain[1:] + [word()] if n % 3 else chain[2:] + [word(), word()]
        texts.append(chain)
    rows = [(i, rng.choice([" ", "  ", "\n"]).join(t).replace("a", "A" if i % 2 else "a")) for i, t in enumerate(texts)]
    return rows + [(None, rows[0][1]), (1000, None), (1001, ""), (1002, " \n"), (3, rows[70][1]), (1003, "one two"), (1004, "One  two"), (1005, "x " * 20_000)]


@pytest.mark.parametrize(("chunk", "common", "orders"), [(512, 64, 2), (4, 2, 1)])
def test_links_equal_brute_force(spark, monkeypatch, chunk, common, orders):
    monkeypatch.setattr(similar, "CHUNK", chunk)
    monkeypatch.setattr(similar, "COMMON", common)
    monkeypatch.setattr(similar, "ORDERS", orders)
    rows = made(random.Random(chunk))
    data = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "id long, t string, s int, key int").repartition(5)
    want = least_of({i for i, _ in rows if i is not None}, brute(rows))
    links = similar.near_text_links(data, "id", "t")
    got = least_of(want, [(r.a, r.b) for r in links.collect()])
    assert got == want and len(set(want.values())) < len(want) * 0.7
    assert similar.near_text_links(data.where("false"), "id", "t").count() == 0


def test_large_groups_give_few_pairs(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(700) for k in [rng.randrange(100)]]
    pairs = []
    plain = similar._verified
    monkeypatch.setattr(similar, "_verified", lambda p, *rest: pairs.append(p.count()) or plain(p, *rest))
    got = least_of(range(700), [(r.a, r.b) for r in similar.near_text_links(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()])
    assert set(got.values()) == {0} and sum(pairs) < 700 * 10  # of 244,650


def compared(spark, monkeypatch, rows):
    """The pairs that bitmaps, and then sets, are compared of; and the groups."""
    met, alike = [], []
    for seen, name in ((met, "_alike"), (alike, "_verified")):
        plain = getattr(similar, name)
        monkeypatch.setattr(similar, name, lambda p, *rest, seen=seen, plain=plain: seen.append(p.count()) or plain(p, *rest))
    links = similar.near_text_links(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    return sum(met), sum(alike), least_of([i for i, _ in rows], [(r.a, r.b) for r in links])


def test_sets_of_unlike_pairs_do_not_move(spark, monkeypatch):
    passages = [[f"p{k}.{i}" for i in range(8)] for k in range(3)]
    rows = [(i, " ".join(f"x{i}.{j}" for j in range(20)) + " " + " ".join(passages[i % 3])) for i in range(150)]  # passages of 50 rows each
    met, alike, got = compared(spark, monkeypatch, rows)
    assert len(set(got.values())) == 150 and met > 100 and alike == 0


def test_a_group_about_the_bound_gives_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(400):
        words = base[:]
        for k in rng.sample(range(400), rng.randint(1, 20)):
            words[k] = f"x{i}.{k}"
        rows.append((i, " ".join(words)))
    met, alike, got = compared(spark, monkeypatch, rows)
    assert got == least_of(range(400), brute(rows)) and 20 < len(set(got.values())) < 380
    assert met < 400 * 60 and alike < 400 * 30  # of 79,800


def test_bitmaps_reject_no_link():
    rng = np.random.default_rng(4)
    for n in (1, 2, 15, 16, 17, 300, 5000):
        a = rng.integers(0, 1 << 63, n)
        for share in (0.0, 0.5, 0.8, 1.0):
            b = np.concatenate([a[: int(n * share)], rng.integers(0, 1 << 63, int(n * (1.25 - share)))])
            x, y = np.unique(a), np.unique(b)
            if len(y):
                most, shared = similar.most_shared(len(x), similar.bitmap(x), len(y), similar.bitmap(y)), len(np.intersect1d(x, y))
                assert shared <= most and (n < 300 or most - shared < 0.25 * n)


def windowed(rows, gap):
    out = []
    by = {}
    for i, c, t in rows:
        if None not in (i, c, t):
            by.setdefault(c, []).append((t, i))
    for seen in by.values():
        seen.sort()
        out += [(a[1], b[1]) for a, b in zip(seen, seen[1:]) if b[0] - a[0] <= gap]
    return out


def test_bursts_equal_the_plain_window_and_spread_a_hot_community(spark):
    rng, start = random.Random(5), datetime.datetime(1969, 12, 31, 23, 0)
    rows = [(i, "hot" if rng.random() < 0.9 else rng.choice("ab"), start + datetime.timedelta(seconds=rng.randrange(40_000) * 5)) for i in range(2000)]
    rows += [(3000 + i, "edge", start + datetime.timedelta(minutes=10 * i)) for i in range(20)] + [(4000, "over", start), (4001, "over", start + datetime.timedelta(minutes=10, microseconds=1))]
    rows += [(None, "hot", start), (5000, None, start), (5001, None, start), (5002, "hot", None)]
    data = spark.createDataFrame(rows, "id long, community string, at timestamp")
    ids = {i for i, _, _ in rows if i is not None}
    for gap, width in (("10 MINUTES", 600), ("45 SECONDS", 45)):
        want = least_of(ids, windowed(rows, datetime.timedelta(seconds=width)))
        links = opportunity.burst_links(data, "id", "community", "at", gap)
        assert least_of(ids, [(r.a, r.b) for r in links.collect()]) == want and 3 < len(set(want.values())) < 2000
        assert "Window" not in links._jdf.queryExecution().executedPlan().toString()


def test_groups_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "x", ["e1", "e2"], 9), (2, None, ["e2", None], 9), (None, "x", None, 9), (3, "y", [], 9), (3, "x", None, 8), (4, "y", None, 8)], "id long, root string, node array<string>, group_id int")
    found = opportunity.independence_groups(rows, "id", {"r": F.col("root"), "events": F.col("node")}).collect()
    assert sorted((r.id or 0, r.group_id or 0) for r in found) == [(0, 0), (1, 1), (2, 1), (3, 1), (3, 1), (4, 1)] and set(found[0].asDict()) == {"id", "root", "node", "group_id"}
