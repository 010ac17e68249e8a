"""Near-identical texts: an exact join of shingle sets.

Two texts are near-identical where the Jaccard similarity of their sets of word shingles is at least
``part / whole``.  A set holds 64-bit hashes of runs of ``words`` words of the folded text, mixed from
hashes of the words; a shorter text is one run, and a text without words has no set and no link.

The join loses no link between different sets and is no comparison of all pairs:

* Equal sets are one: each further row is linked to the least id of its set.
* Rows with a common least hash, for a few hash functions, are put in a range-partitioned order, by
  their signatures among these, and rows that stand near each other and whose sizes and signatures
  are alike are compared.  That connects large groups of near copies by few comparisons.  It only
  saves work: what it misses is found below.
* Prefix filter: sets that are similar enough share one of their first ``n - ceil(n part / whole) + 1``
  shingles, in any order that holds for all sets; common shingles come last in ours.  Rows of one
  shingle that the neighbours have not connected yet are paired, if their sizes, the places of
  the shingle and how many before it others have too allow the similarity, and compared.  So rows
  of a large group with many shingles of their own give no pairs.  The rows of a common shingle are cut into
  chunks, each pair of chunks met on its own, so no task holds them all.
* A pair meets by bitmaps first, of four to eight bits a shingle.  A bit that one has alone is a
  shingle that it has alone, so bitmaps bound from above what two sets share; they never reject a link.

What moves is a few numbers for each prefix shingle, a bitmap for each pair, and the sets of the pairs
whose bitmaps allow a link.  Only the links are left when it returns; its other tables are deleted.

Cases: a row without an id takes no part.  Rows that share an id are one node with several sets.  An
empty table has no links.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables
from ..functions import text as texts
from .opportunity import components

#: Hash functions whose least values order rows for the comparison of neighbours, values of a signature, and how many of these must agree.
ORDERS, SIGNED, AGREEING = 2, 12, 7
#: Places in an order within which rows are compared.
BESIDE = 6
#: Rows beyond which a prefix shingle is common, common shingles that are known, and rounds to find them.
COMMON, MOST_COMMON, ROUNDS = 64, 200_000, 6
#: Rows of one shingle that are paired at once, and ids that are sent to every task.
CHUNK, SENT = 512, 1_000_000
_SEED = 11


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(folded: str, words: int, known: dict[str, int]) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words of a text whose blanks are single; ``known`` keeps words' hashes."""
    parts = folded.split()
    for word in set(parts).difference(known):
        known[word] = xxhash.xxh64_intdigest(word.encode(), _SEED)
    hashes = np.fromiter((known[w] for w in parts), np.uint64, len(parts))
    runs = max(1, len(hashes) - words + 1) if len(hashes) else 0
    out = np.zeros(runs, np.uint64)
    for at in range(min(words, len(hashes))):
        out = _mixed(out + hashes[at : at + runs])
    return np.unique(out).view(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each place that a shingle takes, of the least power of two of places that is four times the shingles or more."""
    places = 1 << max(6, (4 * len(s) - 1).bit_length())
    bits = np.zeros(places, bool)
    bits[(s.view(np.uint64) >> np.uint64(32)) & np.uint64(places - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(n_a: int, a: bytes, n_b: int, b: bytes) -> int:
    """What two sets of these sizes and bitmaps share at most."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):  # the places of half as many are those of the two halves
        x, y = (np.bitwise_or(*np.split(z, 2)) if len(z) > min(len(x), len(y)) else z for z in (x, y))
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """(id, s, bits, key) of the rows (id, t) that have a word; equal sets share a key."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [shingles(t or "", words, known) for t in part.column(1).to_pylist()]
                if len(known) > 1_000_000:
                    known.clear()
                some = pa.array([len(s) > 0 for s in sets])
                sets = [s for s in sets if len(s)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                keys = [f"{len(s)}:{xxhash.xxh3_128_hexdigest(s.tobytes())}" for s in sets]
                whole = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(some), whole, pa.array(map(bitmap, sets), pa.binary()), pa.array(keys, pa.string())], names=["id", "s", "bits", "key"])

    return rows.mapInArrow(run, f"id {kind}, s array<long>, bits binary, key string")


def near_text_links(rows: DataFrame, id_col: str, text_col: str, part: int = 4, whole: int = 5, words: int = 5) -> DataFrame:
    """Links (a, b) that connect exactly the ids whose texts are near-identical, directly or by others."""
    folded = texts.folded_nfkc(F.col(text_col).cast("string"))
    sets = _sets(rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), folded.alias("t")), words)
    keys = tables.written(sets.select("id", "key"), "set-keys")
    first = keys.groupBy("key").agg(F.min("id").alias("b"))
    copies = tables.written(keys.join(first, "key").where("id <> b").select("id", "key", "b").distinct(), "set-copies")
    kept = tables.written(_joined(sets, copies.select("id", "key").distinct(), ["id", "key"], "left_anti").select("id", F.size("s").alias("n"), "s", "bits"), "sets")
    tables.drop(keys)
    beside = tables.written(_neighbours(kept, part, whole), "neighbours")
    alike = tables.written(_alike(beside, kept, part, whole), "alike-neighbours")
    near = tables.written(_verified(alike, kept, part, whole), "near-links")
    groups = tables.written(components(near), "near-groups")
    prefix, several = _shared_prefixes(kept, groups, part, whole)
    prefix = tables.written(_ranked(prefix), "prefixes")
    pairs = tables.written(_pairs(prefix, part, whole), "prefix-pairs")
    alike_pairs = tables.written(_alike(pairs, kept, part, whole), "alike-pairs")
    far = tables.written(_verified(alike_pairs, kept, part, whole), "far-links")
    for done in (kept, beside, alike, groups, several, prefix, pairs, alike_pairs):
        tables.drop(done)
    return copies.select(F.col("id").alias("a"), "b").unionByName(near).unionByName(far)


def _joined(rows: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi, anti or left join; what is joined is sent to every task if it has few rows."""
    return rows.join(F.broadcast(ids) if ids.count() <= SENT else ids, on, how)


def _neighbours(kept: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs of rows that share a least hash, stand near each other, and look alike."""
    rng = np.random.default_rng(_SEED)
    odd = rng.integers(0, 1 << 63, SIGNED, np.uint64) * np.uint64(2) + np.uint64(1)
    kind = kept.schema["id"].dataType.simpleString()

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            column = batch.column(2)
            values, starts = column.flatten().to_numpy().view(np.uint64), np.asarray(column.offsets)[:-1] - column.offsets[0].as_py()
            lows = np.stack([np.minimum.reduceat(_mixed(values * a), starts) for a in odd], 1)
            signed = pa.array([row.tobytes() for row in lows.astype(np.uint16)], pa.binary())
            for at in range(ORDERS):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lows[:, at].view(np.int64)), signed], names=["id", "n", "low", "signed"])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            new = len(table) - len(batch)  # rows before it have met each other
            last = table.slice(max(0, len(table) - BESIDE)).combine_chunks().to_batches()[0]
            n, low = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "low"))
            signed = np.frombuffer(b"".join(table.column("signed").to_pylist()), np.uint16).reshape(-1, SIGNED)
            ids = table.column("id").combine_chunks()
            for by in range(1, min(BESIDE, len(table) - 1) + 1):
                x, y = slice(by, None), slice(None, -by)
                near = (low[x] == low[y]) & (np.minimum(n[x], n[y]) * whole >= np.maximum(n[x], n[y]) * part) & ((signed[x] == signed[y]).sum(1) >= AGREEING) & (np.arange(by, len(n)) >= new)
                yield pa.RecordBatch.from_arrays([ids[by:].filter(pa.array(near)), ids[:-by].filter(pa.array(near))], names=["a", "b"])

    lows = kept.select("id", "n", "s").mapInArrow(least, f"id {kind}, n int, low long, signed binary")
    order = ["low", "signed", "id"]  # like rows stand together, and a common value is dealt to many ranges
    found = lows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(beside, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _met(pairs: DataFrame, kept: DataFrame, column: str) -> DataFrame:
    """The pairs with the sizes and a column of both rows."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = _joined(kept.select("id", "n", column), ids, ["id"], "left_semi")
    one = lambda name: held.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col(column).alias(f"{column}_{name}"))
    return pairs.join(one("a"), "a").join(one("b"), "b")


def _alike(pairs: DataFrame, kept: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs whose bitmaps allow that their sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b")), strict=True)
            may = pa.array([most_shared(n_a, a, n_b, b) * (part + whole) >= (n_a + n_b) * part for n_a, a, n_b, b in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(may) for c in ("a", "b")], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return _met(pairs, kept, "bits").select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _verified(pairs: DataFrame, kept: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs whose sets are similar enough."""
    common = F.size(F.array_intersect("s_a", "s_b")).cast("bigint")
    return _met(pairs, kept, "s").where(common * (part + whole) >= (F.col("n_a") + F.col("n_b")) * part).select("a", "b").distinct()


def _shared_prefixes(kept: DataFrame, groups: DataFrame, part: int, whole: int) -> tuple[DataFrame, DataFrame]:
    """Prefix rows, with their id's group, of the shingles that several groups share; and a table of these shingles with their rows.

    A shingle that many rows have among their first is common: it stands last from the next round on.
    What comes first then may be common too, so there are a few rounds; each after the first takes only
    the rows that had a shingle just found among their first, as the first shingles of others stay.
    """
    roots = groups.select(F.col("node").alias("id"), "root")

    def counted(prefix: DataFrame) -> tuple[DataFrame, DataFrame]:
        prefix = _joined(prefix, roots, ["id"], "left").withColumn("group", F.coalesce("root", "id")).drop("root")
        several = prefix.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("rows"))
        return prefix, several.where("low < high").select("token", "rows")

    common: dict[int, int] = {}
    found: dict[int, int] = {}
    for _ in range(ROUNDS):
        many = counted(_prefixes(kept, common, part, whole, found))[1].where(F.col("rows") > COMMON).orderBy(F.col("rows").desc(), "token").limit(MOST_COMMON - len(common)).collect()
        found = {r["token"]: r["rows"] for r in many if r["token"] not in common}
        if not found:
            break
        common |= found
    prefix, several = counted(_prefixes(kept, common, part, whole))
    several = tables.written(several, "shared-shingles")
    return _joined(prefix, several, ["token"], "inner"), several


def _prefixes(kept: DataFrame, common: dict[int, int], part: int, whole: int, found: dict[int, int] | None = None) -> DataFrame:
    """(token, id, n, place) for the first shingles of each row, common ones standing last; places from 1.

    With ``found``, the common ones that were found last, only of rows that had one of them among their first before.
    """
    known = np.array(sorted(common), np.int64)
    counts_of, fresh_of = np.array([common[int(t)] for t in known], np.int64), np.array([int(t) in (found or {}) for t in known], bool)
    kind, shared = kept.schema["id"].dataType.simpleString(), kept.sparkSession.sparkContext.broadcast((known, counts_of, fresh_of))
    changed = bool(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts, fresh = shared.value
        for batch in batches:
            columns: list[list] = [[], [], []]
            taken = []
            for row, s in enumerate(batch.column(1)):
                values = s.values.to_numpy()
                n = len(values)
                first = n + n * -part // whole + 1  # n - ceil(n part / whole) + 1
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, values), len(tokens) - 1)
                    held = tokens[at] == values
                    rank = np.where(held, counts[at], 0)
                    if changed:
                        new = held & fresh[at]
                        if not new.any() or not new[np.argsort(np.where(new, 0, rank), kind="stable")[:first]].any():
                            continue
                    values = values[np.argsort(rank, kind="stable")]  # sets are sorted: the hash decides between equal ones
                taken.append(row)
                columns[0].append(values[:first])
                columns[1].append(np.full(first, n, np.int32))
                columns[2].append(np.arange(1, first + 1, dtype=np.int32))
            if taken:
                repeated = batch.column(0).take(pa.array(np.repeat(taken, [len(c) for c in columns[0]])))
                token, n, place = (pa.array(np.concatenate(c)) for c in columns)
                yield pa.RecordBatch.from_arrays([token, repeated, n, place], names=["token", "id", "n", "place"])

    return kept.select("id", "s").mapInArrow(run, f"token long, id {kind}, n int, place int")


def _ranked(prefix: DataFrame) -> DataFrame:
    """Prefix rows with their rank among their id's: only so many shingles up to theirs can be in a set of another group."""
    return prefix.withColumn("rank", F.count(F.lit(1)).over(Window.partitionBy("id").orderBy("place")))


def _pairs(prefix: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs of ids of different groups that share a prefix shingle and can be similar enough."""
    chunks = F.ceil(F.col("rows") / CHUNK).cast("int")
    rows = prefix.withColumn("own", F.pmod(F.xxhash64("id", "token"), chunks).cast("int"))
    left = rows.select("token", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"), F.col("rank").alias("rank_a"), F.col("group").alias("group_a"), F.col("own").alias("low"), F.explode(F.sequence(F.col("own"), chunks - 1)).alias("high"))
    right = rows.select("token", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("rank").alias("rank_b"), F.col("group").alias("group_b"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("low"), F.col("own").alias("high"))
    met = left.join(right, ["token", "low", "high"]).where("group_a <> group_b AND (low < high OR a < b)")
    sizes = F.least("n_a", "n_b").cast("bigint") * whole >= F.greatest("n_a", "n_b") * part
    most = F.least("rank_a", "rank_b") + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    places = most * (part + whole) >= (F.col("n_a") + F.col("n_b")).cast("bigint") * part
    return met.where(sizes & places).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
