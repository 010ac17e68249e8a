"""Exact top-k by inner product with block-at-a-time pruning.

Vectors become integers, floor(scale * component).  Candidates are ordered so that like vectors
meet (by the nearest of some centres, then by a Gray-ordered code of the sides of random planes
they lie on) and cut into chunks; a chunk is halved down to ``BLOCK``-row document-range blocks.
Blocks and chunks keep the greatest and least value of each component (term maxima, for either
sign of a query's weight) beside a forward index of their rows, and the ball around their rows.
A query's summed maxima, or the ball's bound where that is less, bound all scores within.

Every query first gets a floor, a score that k other rows reach: the k-th best of a sample, then
of the chunk with the greatest bound.  It is sent only to chunks whose bound reaches its floor, and
there blocks are scored whole in descending order of bound until bounds lie below the k-th score so far
(Mallia et al., 2024).  A chunk yields at most k rows a query, and none below the floor; a
window with a group limit takes the best k.  Floors and bounds only save work: no candidate that
could be among the k best is passed over.

Cases: a vector that is null or holds a null or non-finite component takes no part, as query or
candidate, nor does one with a null id.  Components and sums of any size are computed exactly; a
score beyond a long counts as the long nearest to it.  Vectors of another length than a query's
are no candidates of it: lengths are searched apart.  Equal scores go to the smaller id, then
stand in any order for repeated rows; a query's own id is no candidate.  A query row that is
repeated asks once.  An id that stands with several vectors is one query, answered by the best
scores of all of them, so a candidate may stand once for each.  Fewer candidates than k give fewer
rows.  An empty table gives an empty result.  Columns other than the id and the vector
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

K, SCALE, BLOCK = 20, 64, 32
#: Least and greatest rows of a chunk of candidates; a chunk holds a ``CHUNKS``-th of all rows between these.
CHUNK, LARGEST_CHUNK, CHUNKS = 8_192, 65_536, 4_096
#: Rows of a batch of queries, and chunks whose bounds one row of summaries holds.
QUERIES, SUMMARISED = 2_048, 1_024
#: Rows sampled for centres and first floors, centres, planes of the code: what is broadcast is bounded by them.
SAMPLE, CENTRES, PLANES, SEED = 4_096, 128, 12, 17
_LEAST, _GREATEST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
_PACKED = "width int, kind string, ids binary, matrix binary"


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as doubles that are exact, or as Python's integers where doubles can't hold them."""
    with np.errstate(over="ignore"):
        out = np.floor(values * scale)
    if np.abs(out).max(initial=0) < 2.0**53:
        return out
    exact = [int(x) * scale if abs(x) >= 2.0**52 else int(np.floor(x * scale)) for x in values.ravel().tolist()]
    return np.array([*exact, None], object)[:-1].reshape(values.shape)


def to_bytes(values: np.ndarray) -> tuple[str, bytes]:
    """The type that holds a matrix of whole numbers in the fewest bytes, and these."""
    if values.dtype == object:
        return "text", ",".join(map(str, values.ravel().tolist())).encode()
    top = np.abs(values).max(initial=0)
    kind = "|i1" if top < 2**7 else "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return kind, values.astype(kind).tobytes()


def from_bytes(kind: str, raw: bytes, rows: int, width: int) -> np.ndarray:
    if kind == "text":
        return np.array([*map(int, raw.decode().split(",")), None], object)[:-1].reshape(rows, width)
    return np.frombuffer(raw, kind).reshape(rows, width).astype(np.float64)


def products(q: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles, 64-bit integers or Python's, as their size asks for."""
    if q.dtype != object and values.dtype != object:
        top = float(np.abs(q).max(initial=0)) * float(np.abs(values).max(initial=0)) * max(1, q.shape[1])
        if top < 2.0**53:
            return (q @ values.T).astype(np.int64)
        if top < 2.0**62:
            return q.astype(np.int64) @ values.astype(np.int64).T
    if not q.shape[1]:
        return np.zeros((len(q), len(values)), np.int64)
    as_int = lambda x: x if x.dtype == object else x.astype(np.int64).astype(object)
    return np.clip(as_int(q) @ as_int(values).T, _LEAST, _GREATEST).astype(np.int64)


def box_and_ball(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Greatest and least values of the runs of rows from ``cuts`` on, their centres and radii, as doubles."""
    v = values.astype(np.float64)
    sizes = np.diff(np.append(cuts, len(v)))
    centre = np.add.reduceat(v, cuts, axis=0) / sizes[:, None]
    away = np.sqrt(((v - np.repeat(centre, sizes, axis=0)) ** 2).sum(1))
    return np.maximum.reduceat(v, cuts, axis=0), np.minimum.reduceat(v, cuts, axis=0), centre, np.maximum.reduceat(away, cuts)


def bounds(q: np.ndarray, summary: tuple[np.ndarray, ...]) -> np.ndarray:
    """What no score of a query (rows) with a row of a run (columns) exceeds."""
    q = q.astype(np.float64)
    high, low, centre, radius = summary
    with np.errstate(over="ignore", invalid="ignore"):
        box = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        ball = q @ centre.T + np.sqrt((q * q).sum(1))[:, None] * radius
        size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt(np.maximum(high**2, low**2).sum(1))
        out = np.minimum(box, ball) + 1e-9 * size + 0.5  # over all roundings
    return np.where(np.isnan(out), np.inf, out)


class BlockIndex:
    """Term maxima and forward indexes of the blocks of one chunk."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, block: int = BLOCK) -> None:
        order = self._like_together(values.astype(np.float64), ids, block)
        self.ids, self.values = ids[order], values[order]
        self.cuts = np.arange(0, len(ids), block)
        self.summary = box_and_ball(self.values, self.cuts)
        self.ends = np.append(self.cuts[1:], len(ids))
        self.scored = self.offered = 0  # blocks, by queries

    @staticmethod
    def _like_together(values: np.ndarray, ids: np.ndarray, block: int) -> np.ndarray:
        """Order by repeated halving along the direction of greatest spread, down to a block."""
        out, stack = [], [np.lexsort((ids,))]
        values = values / max(1.0, float(np.abs(values).max(initial=0)))
        while stack:
            part = stack.pop()
            if len(part) <= block or values.shape[1] == 0:
                out.append(part)
                continue
            x = values[part]
            x -= x.mean(0)
            direction = x[int((x * x).sum(1).argmax())]
            for _ in range(3):
                direction = x.T @ (x @ direction)
                direction /= max(float(np.abs(direction).max()), 1e-12)
            half = -(-len(part) // (2 * block)) * block
            place = np.argsort(x @ direction, kind="stable")
            stack += [part[place[half:]], part[place[:half]]]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (query id, id, score): the k best of the chunk for each query, of those that reach its floor.

        Blocks are taken in waves, each of twice as many as the one before, in descending order of
        bound; between waves a query's k-th score rises.
        """
        limit = bounds(q, self.summary)
        order = np.argsort(-limit, axis=1, kind="stable")
        n, blocks = limit.shape
        kth = floor.copy()
        row, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.offered += n * blocks
        at, width = 0, 1
        while at < blocks:
            take = order[:, at : at + width]
            # a bound equal to the k-th score may still hold a smaller id
            need = np.take_along_axis(limit, take, 1) >= kth[:, None]
            if not need.any():
                break
            rows, columns = np.nonzero(need)
            which = take[rows, columns]
            self.scored += len(rows)
            by_block = np.argsort(which, kind="stable")
            rows, which = rows[by_block], which[by_block]
            starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            new = [(row, found, score)]
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(which)]):
                r, span = rows[a:b], slice(self.cuts[which[a]], self.ends[which[a]])
                s = products(q[r], self.values[span])
                ids = self.ids[span]
                x, y = np.nonzero((s >= kth[r, None]) & (ids[None, :] != qids[r, None]))
                new.append((r[x], ids[y], s[x, y]))
            row, found, score = (np.concatenate(x) for x in zip(*new))
            best = np.lexsort((found, -score, row))
            row, found, score = row[best], found[best], score[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kth[row[place == k - 1]] = np.maximum(kth[row[place == k - 1]], score[place == k - 1])
            kept = place < k
            row, found, score = row[kept], found[kept], score[kept]
            at, width = at + width, 2 * width
        return qids[row], found, score


@dataclass
class Landmarks:
    """Of vectors of one length: centres and planes for the order of candidates, a sample for first floors."""

    centres: np.ndarray
    planes: np.ndarray
    ids: np.ndarray
    sample: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, sample: np.ndarray) -> Landmarks:
        rng = np.random.default_rng(SEED)
        x = sample.astype(np.float64)
        big = max(1.0, float(np.abs(x).max(initial=0)))
        centres = x[rng.permutation(len(x))[: max(1, min(CENTRES, len(x) // 16))]]
        for _ in range(6):
            # not through the linear algebra library, whose threads the driver does without
            nearest = (np.einsum("ij,kj->ik", x / big, centres / big) - ((centres / big) ** 2).sum(1) / 2).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, x)
            sizes = np.bincount(nearest, minlength=len(centres))[:, None]
            centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
        return Landmarks(centres, rng.normal(size=(x.shape[1], PLANES)), ids, sample)

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):  # only an order hangs on it
            return (x @ centres.T - (centres * centres).sum(1) / 2).argmax(1)

    def keys(self, values: np.ndarray) -> np.ndarray:
        """Numbers whose order brings like vectors together."""
        x = values.astype(np.float64)
        nearest = self._nearest(x, self.centres)
        code = ((x - self.centres[nearest]) @ self.planes > 0) @ (1 << np.arange(PLANES))
        for shift in (1, 2, 4, 8):
            code ^= code >> shift
        return nearest << PLANES | code

    def floors(self, qids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query within the sample, or the least number."""
        if len(self.sample) < k:
            return np.full(len(q), _LEAST)
        s = np.where(qids[:, None] == self.ids, _LEAST, products(q, self.sample))
        return np.partition(s, -k, axis=1)[:, -k]


def sound(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x, an array of doubles, of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    right = F.col(vector_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.where(right & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def _by_width(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, whole numbers) of the vectors of each length in a batch (id, x)."""
    column = batch.column(1)
    widths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for width in np.unique(widths).tolist():
        places = np.flatnonzero(widths == width)
        yield width, places, whole(column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(len(places), width), scale)


def _order(shared, scale: int):
    """Rows (id, x) with the key that orders them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, widths = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            for width, places, values in _by_width(batch, scale):
                widths[places] = width
                if width in shared.value:
                    keys[places] = shared.value[width].keys(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(widths), pa.array(keys)], names=["id", "x", "width", "key"])

    return run


def _pack(rows: int, scale: int):
    """Rows of a partition as matrices of at most ``rows`` rows: width, type, ids and values as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def matrix(width: int, some: list) -> pa.RecordBatch:
            ids, values = np.concatenate([i for i, _ in some]), np.concatenate([v for _, v in some])
            kind, raw = to_bytes(values)
            return pa.RecordBatch.from_pydict({"width": pa.array([width], pa.int32()), "kind": [kind], "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "matrix": pa.array([raw], pa.binary())})

        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for width, places, values in _by_width(batch, scale):
                part = held.setdefault(width, [])
                part.append((all_ids[places], values))
                while (n := sum(len(i) for i, _ in part)) >= rows:
                    last_ids, last = part.pop()
                    cut = len(last_ids) - (n - rows)
                    yield matrix(width, [*part, (last_ids[:cut], last[:cut])])
                    part[:] = [(last_ids[cut:], last[cut:])]
        for width, part in held.items():
            if sum(len(i) for i, _ in part):
                yield matrix(width, part)

    return run


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Box and ball of each chunk."""
    for batch in batches:
        for width, chunk, kind, ids, raw in zip(*(c.to_pylist() for c in batch.columns)):
            box = box_and_ball(from_bytes(kind, raw, len(ids) // 8, width), np.zeros(1, np.int64))
            yield pa.RecordBatch.from_pydict({"width": pa.array([width], pa.int32()), "chunk": [chunk], "box": pa.array([np.concatenate([x.ravel() for x in box]).astype("<f8").tobytes()], pa.binary())})


def _with_floors(shared, k: int):
    """Batches of queries with their first floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for width, kind, ids, raw in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(ids, "<i8")
                known = shared.value.get(width)
                floor = known.floors(own, from_bytes(kind, raw, len(own), width), k) if known else np.full(len(own), _LEAST)
                floors.append(floor.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.binary())], names=["width", "qkind", "qids", "qmatrix", "floors"])

    return run


_SENT = "chunk long, qkind string, qids binary, qmatrix binary, floors binary"


def _route(first: bool):
    """A batch of queries beside summaries: for each chunk the queries it must see; at ``first`` only where their bound is greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, qkind, qids, qmatrix, floors, chunks, boxes in zip(*(c.to_pylist() for c in batch.columns)):
                ids, floor = np.frombuffer(qids, "<i8"), np.frombuffer(floors, "<i8")
                q = from_bytes(qkind, qmatrix, len(ids), width)
                flat = np.stack([np.frombuffer(b, "<f8") for b in boxes])
                limit = bounds(q, (flat[:, :width], flat[:, width : 2 * width], flat[:, 2 * width : 3 * width], flat[:, 3 * width]))
                need = limit >= floor[:, None]
                if first:
                    need &= np.arange(len(chunks)) == limit.argmax(1)[:, None]
                for c in np.flatnonzero(need.any(0)).tolist():
                    r = np.flatnonzero(need[:, c])
                    kind, raw = to_bytes(q[r])
                    yield pa.RecordBatch.from_pydict({"chunk": [chunks[c]], "qkind": [kind], "qids": pa.array([ids[r].tobytes()], pa.binary()), "qmatrix": pa.array([raw], pa.binary()), "floors": pa.array([floor[r].tobytes()], pa.binary())})

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                width, chunk, kind, ids, matrix, qkind, qids, qmatrix, floors = (c[at].as_py() for c in batch.columns)
                if last != chunk:
                    own = np.frombuffer(ids, "<i8")
                    last, index = chunk, BlockIndex(own, from_bytes(kind, matrix, len(own), width))
                asked = np.frombuffer(qids, "<i8")
                q, i, s = index.search(asked, from_bytes(qkind, qmatrix, len(asked), width), k, np.frombuffer(floors, "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


def _raise_floors(batches: DataFrame, kth: DataFrame) -> DataFrame:
    """Batches with the floors of ``kth`` (query_id, kth) where these are higher."""
    numbered = batches.withColumn("batch", F.monotonically_increasing_id())
    numbered = materialise(numbered, "numbered-batches")

    def spread(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for batch, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_pydict({"batch": pa.array([batch] * len(own), pa.int64()), "place": pa.array(np.arange(len(own), dtype=np.int32)), "query_id": pa.array(own)})

    named = numbered.select("batch", "qids").mapInArrow(spread, "batch long, place int, query_id long")
    better = named.join(kth, "query_id").groupBy("batch").agg(F.collect_list(F.struct("place", "kth")).alias("better"))  # a batch's queries at most

    def raised(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            out = []
            for floors, better in zip(part.column("floors").to_pylist(), part.column("better").to_pylist()):
                floor = np.frombuffer(floors, "<i8").copy()
                for x in better or ():
                    floor[x["place"]] = max(int(floor[x["place"]]), x["kth"])
                out.append(floor.tobytes())
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(out, pa.binary())], names=["width", "qkind", "qids", "qmatrix", "floors"])

    joined = numbered.join(better, "batch", "left").select("width", "qkind", "qids", "qmatrix", "floors", "better")
    return joined.mapInArrow(raised, batches.schema)


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int | None = None, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score: the k best other rows of each row where ``is_query`` of the id holds."""
    spark = vectors.sparkSession
    rows = sound(vectors, id_col, vector_col)
    count, n_queries = (int(x or 0) for x in rows.agg(F.count(F.lit(1)), F.count_if(is_query(F.col("id")))).first())
    chunk = chunk or max(CHUNK, min(LARGEST_CHUNK, count // CHUNKS))
    rate = min(1.0, 1.1 * SAMPLE / max(1, count))
    sampled = rows.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 20)) < rate * (1 << 20)).limit(SAMPLE).collect()
    by_width: dict[int, list] = {}
    for r in sampled:
        by_width.setdefault(len(r["x"]), []).append(r)
    shared = spark.sparkContext.broadcast({
        w: Landmarks.of(np.array([r["id"] for r in some]), whole(np.array([r["x"] for r in some], float).reshape(len(some), w), scale)) for w, some in by_width.items()
    })
    # equal vectors share a key, so the hash of the id deals them out
    place = (F.col("width"), F.col("key"), F.xxhash64("id"))
    ordered = rows.mapInArrow(_order(shared, scale), "id long, x array<double>, width int, key long")

    def packed(some: DataFrame, n: int, size: int) -> DataFrame:
        dealt = some.repartitionByRange(max(1, -(-n // size)), *place).sortWithinPartitions(*place)
        return dealt.select("id", "x").mapInArrow(_pack(size, scale), _PACKED)

    chunks = materialise(packed(ordered, count, chunk).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    asking = ordered.where(is_query(F.col("id"))).dropDuplicates(["id", "x"])  # a repeated row asks once
    asked = packed(asking, n_queries, queries).mapInArrow(_with_floors(shared, k), "width int, qkind string, qids binary, qmatrix binary, floors binary")
    asked = materialise(asked, "query-batches")
    boxes = chunks.select("width", "chunk", "kind", "ids", "matrix").mapInArrow(_summarise, "width int, chunk long, box binary")
    # summaries stand together by the thousand; every batch of queries meets every such row of its width
    groups = max(1, -(-count // (chunk * SUMMARISED)))
    lists = boxes.groupBy("width", F.pmod(F.xxhash64("chunk"), F.lit(groups)).alias("number")).agg(F.collect_list(F.struct("chunk", "box")).alias("all"))
    summaries = materialise(lists.select("width", F.col("all.chunk").alias("chunks"), F.col("all.box").alias("boxes")), "chunk-summaries")

    def searched(some: DataFrame, first: bool) -> DataFrame:
        sent = some.join(summaries, "width").select("width", "qkind", "qids", "qmatrix", "floors", "chunks", "boxes").mapInArrow(_route(first), _SENT)
        pairs = chunks.join(sent, "chunk").select("width", "chunk", "kind", "ids", "matrix", "qkind", "qids", "qmatrix", "floors")
        return pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    if count > chunk:
        tried = searched(asked, True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
        asked = materialise(_raise_floors(asked, tried.select("query_id", F.col("score").alias("kth"))), "raised-batches")
    best = searched(asked, False)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
