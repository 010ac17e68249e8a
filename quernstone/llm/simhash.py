"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, components.

A fingerprint sums the bits of the XXH64 (seed 42) of all 3-word shingles.  Two fingerprints
link at ``MAX_DIFFERENCE`` or fewer differing bits.  Of four 16-bit blocks two such fingerprints
share one, so every distinct fingerprint goes to its four block groups.  A group of more than
``GROUP_CAP`` is dealt again by blocks of the bits that are left (12, then 9 bits); what is still
larger is cut into salted parts, and every two parts meet in one task.  That is exact: no
candidate is dropped.

Within a group the hierarchical index (Tang et al., 2015) sorts the fingerprints by Gray rank,
so that neighbours share bits, and packs them into a tree.  A node holds the bits all below it
share; a child holds only those its parent lacks.  A search adds up the differences on the way
down and prunes a whole subtree once they exceed the limit, or once all below it is known to be
in the searcher's component.  A group yields a forest of links, never all pairs.

Cases: a null or empty text, or one without words, has fingerprint 0 and links like any other; a
text of one or two words has their sequence as its only shingle.  Equal fingerprints are one
vertex, whatever their number.  A null id takes part but names no component unless the whole
component has no id, whose component is then null.  An empty table gives an empty result.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, map_batches, materialise, new_path

MAX_DIFFERENCE = 3
#: Fingerprints that one task compares within a group.
GROUP_CAP = 20_000
FAN = 8
#: Search steps (queries times the size of their group) at a time: bounds the search's memory.
STEPS = 1_000_000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text, as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 3:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:-2].tolist(), ends[2:].tolist())), np.uint64, len(words) - 2)
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    ones = (np.bincount(columns.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed) and text_hash, by which a row's text is found again."""

    def run(batch: pa.RecordBatch) -> list:
        return [batch.column(0), [_signed(fingerprint(t.as_py())) for t in batch.column(1)], batch.column(2)]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return map_batches(rows, "doc_id long, fp long, text_hash long", run)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Trees over the groups of a block of rows, searched for all rows at once."""

    def __init__(self, groups: np.ndarray, fps: np.ndarray) -> None:
        order = np.lexsort((gray_rank(fps), groups))
        self.fps, groups = fps[order], groups[order]
        n = len(fps)
        new = np.concatenate([[True], groups[1:] != groups[:-1]])
        first = np.flatnonzero(new)
        self.group_of = np.cumsum(new) - 1
        self.bounds = np.append(first, n)
        # level 0 holds the rows; each level above holds FAN nodes of a group in one
        share, value, begin = np.full(n, ~np.uint64(0)), self.fps, np.arange(n)
        owner, end = self.group_of, np.arange(n)
        self.levels = [{"share": share, "value": value, "begin": begin, "end": begin + 1, "last": end}]
        while len(owner) > len(first):
            starts_group = np.concatenate([[True], owner[1:] != owner[:-1]])
            at = np.flatnonzero(starts_group)
            within = np.arange(len(owner)) - np.repeat(at, np.diff(np.append(at, len(owner))))
            cut = np.flatnonzero(within % FAN == 0)
            low = self.levels[-1]
            shared = np.bitwise_and.reduceat(low["share"], cut)
            shared &= np.bitwise_and.reduceat(low["value"], cut) | ~np.bitwise_or.reduceat(low["value"], cut)
            stop = np.append(cut[1:], len(owner))
            self.levels.append({"share": shared, "value": low["value"][cut] & shared, "begin": cut, "end": stop, "last": low["last"][stop - 1]})
            owner = owner[cut]
        # a child keeps the shared bits that its parent lacks
        for low, up in zip(self.levels, self.levels[1:]):
            low["rest"] = low["share"] & ~np.repeat(up["share"], up["end"] - up["begin"])
        self.levels[-1]["rest"] = self.levels[-1]["share"]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A forest that connects exactly the fingerprints that links within their group connect."""
        n = len(self.fps)
        label = np.arange(n)
        sizes = np.diff(self.bounds)[self.group_of]
        at = 0
        steps = np.cumsum(sizes)
        while at < n:
            stop = max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + STEPS, "right")))
            low, high = int(self.bounds[self.group_of[at]]), int(self.bounds[self.group_of[stop - 1] + 1])
            a, b = self._search(at, stop, label, low, high)
            self._unite(label, a, b, low, high)
            at = stop
        moved = np.flatnonzero(label != np.arange(n))
        return self.fps[moved], self.fps[label[moved]]

    def _search(self, at: int, stop: int, label: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of [at, stop) with later rows of their group within the limit and not yet known to be connected."""
        uniform, lowest, offset = [], label[low:high], low
        highest = lowest
        for k, level in enumerate(self.levels):
            if k:
                first, last = np.searchsorted(level["begin"], offset), np.searchsorted(level["begin"], offset + len(lowest))
                cut = level["begin"][first:last] - offset
                lowest, highest, offset = np.minimum.reduceat(lowest, cut), np.maximum.reduceat(highest, cut), int(first)
            uniform.append((np.where(lowest == highest, lowest, -1), offset))
        q = np.arange(at, stop)
        node = self.group_of[at:stop].astype(np.int64)
        top = self.levels[-1]
        gone = np.bitwise_count((self.fps[q] ^ top["value"][node]) & top["rest"][node]).astype(np.int64)
        for k in range(len(self.levels) - 1, 0, -1):
            level, below = self.levels[k], self.levels[k - 1]
            width = level["end"][node] - level["begin"][node]
            start = np.repeat(level["begin"][node] - np.cumsum(width) + width, width)
            q, gone = np.repeat(q, width), np.repeat(gone, width)
            node = start + np.arange(len(start))
            same, offset = uniform[k - 1]
            open_ = (below["last"][node] > q) & (same[node - offset] != label[q])
            q, node, gone = q[open_], node[open_], gone[open_]
            gone = gone + np.bitwise_count((self.fps[q] ^ below["value"][node]) & below["rest"][node])
            near = gone <= MAX_DIFFERENCE
            q, node, gone = q[near], node[near], gone[near]
        return q, node

    @staticmethod
    def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray, low: int, high: int) -> None:
        """Labels are the smallest row of a component; ``a`` and ``b`` are rows that link."""
        part = label[low:high]
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            least = np.minimum(x, y)
            np.minimum.at(label, x, least)
            np.minimum.at(label, y, least)
            while (part != label[part]).any():
                part[:] = label[part]


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, fp) come sorted by group; whole groups are indexed in blocks."""
    held: list[tuple[np.ndarray, ...]] = []
    waiting = 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, waiting
        key, part, fp = (np.concatenate(x) for x in zip(*held))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        end = len(key) if last else int(np.flatnonzero(new)[-1])
        held = [(key[end:], part[end:], fp[end:])]
        waiting = len(key) - end
        if end > 1:
            groups = np.cumsum(new[:end])
            shared = np.bincount(groups)[groups] > 1
            if shared.any():
                a, b = GrayIndex(groups[shared], fp[:end][shared].view(np.uint64)).links()
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            waiting += batch.num_rows
            if waiting >= 4 * GROUP_CAP:
                yield from flush(False)
    if waiting:
        yield from flush(True)


def _blocks(x: Column, key: Column, total: int, width: int) -> Column:
    """Array of (key, rest): each block of ``width`` bits of the ``total`` lowest of ``x`` with the bits left."""
    out = []
    for k in range(total // width):
        value = F.shiftrightunsigned(x, k * width).bitwiseAND(F.lit((1 << width) - 1))
        above = F.shiftleft(F.shiftrightunsigned(x, (k + 1) * width), k * width) if (k + 1) * width < 64 else F.lit(0).cast("long")
        rest = above.bitwiseOR(x.bitwiseAND(F.lit((1 << k * width) - 1)))
        out.append(F.struct((key * 4 + k).alias("block"), value.alias("value"), rest.alias("rest")))
    return F.array(*[F.struct(F.shiftleft(s["block"], width).bitwiseOR(s["value"]).alias("key"), s["rest"].alias("rest")) for s in out])


def links(distinct: DataFrame, cap: int = GROUP_CAP) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column fp that give all their components."""
    level = distinct.select("fp", F.inline(_blocks(F.col("fp"), F.lit(0).cast("long"), 64, 16)))
    ready = []
    for total, width in ((48, 12), (36, 9), (None, None)):
        hot = level.groupBy("key").count().where(F.col("count") > cap)
        if not hot.take(1):
            break
        ready.append(level.join(hot, "key", "left_anti").select("key", F.lit(0).alias("part"), "fp"))
        level = level.join(hot, "key")
        if total:
            level = level.select("fp", F.inline(_blocks(F.col("rest"), F.col("key"), total, width)))
        else:  # every two of n parts of a group meet once
            n = F.ceil(F.col("count") * 2 / cap).cast("int")
            own = F.pmod(F.xxhash64("fp"), n).cast("int")
            level = level.withColumn("n", n).withColumn("own", own)
            level = level.select("key", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.least(i, F.col("own")) * F.col("n") + F.greatest(i, F.col("own")))).alias("part"))
    else:
        ready.append(level.select("key", "part", "fp"))
        level = None
    if level is not None:
        ready.append(level.select("key", F.lit(0).alias("part"), "fp"))
    groups = ready[0]
    for more in ready[1:]:
        groups = groups.unionByName(more)
    dealt = groups.repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(_link_groups, "a long, b long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) other than a root: the least node it is connected to.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each round a written
    table, until a round changes nothing.  Minima are taken by partial aggregation, and the join
    back may be split by adaptive execution, so that a large star is no single task's work.
    """
    spark = edges.sparkSession

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    path = new_path(spark, label)
    edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().write.parquet(path)
    current = spark.read.schema("a long, b long").parquet(path)
    before = sign(current)
    while before[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        old, path = path, new_path(spark, label)
        small.select("e.a", "e.b").where("a <> b").distinct().write.parquet(path)
        current = spark.read.schema("a long, b long").parquet(path)
        drop_path(spark, old)
        after = sign(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _placed(prints: DataFrame, cap: int) -> DataFrame:
    """(fp, first, root) of every distinct fingerprint of ``prints``: its least id, and its component."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct, cap))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = GROUP_CAP) -> DataFrame:
    """doc_id, fp, text_hash and component_id, the least id reachable over links, for every row of ``docs``."""
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    placed = _placed(prints, cap)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "text_hash", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = GROUP_CAP) -> DataFrame:
    """One row of each component of ``docs``, unchanged: that of the least id, null last; of equal ids, of the least text hash.

    Of rows with that id and text any one stays.  Rows that share an id, or have none, are told
    apart by their texts, so no component goes without a row.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    roots = _placed(prints, cap).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash"))
    kept = materialise(prints.join(roots, "fp").groupBy("root").agg(first.alias("k")).select("k.*"), "kept-rows")
    # the input's columns travel in one struct, so that none of their names can clash with ours
    number = F.col(id_col).cast("long")
    own = docs.select(
        number.isNull().alias("no_id"), F.coalesce(number, F.lit(0)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )
    keys = ["no_id", "id", "text_hash"]
    return own.join(kept, keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"row.`{c}`") for c in docs.columns])
