"""Vector code compression: a codebook for each part of the vectors, by delta-maintained Lloyd.

A component x becomes the integer floor(1024 x), and a vector is cut into equal consecutive parts.
The codebook of a part starts as that part of the vectors of the least ids.  Each round assigns
every part to its nearest entry, by exact integer distance, ties to the lower index, and moves each
entry to the floor of its parts' mean; an entry without parts stays.

State between rounds is a written table of the integers with the last two assignments, and running
sums of every entry, integers that the driver holds: parts x entries x width of a part.  A round
reads the table, assigns, and writes the next one; then only the parts whose assignment changed
give a minus to the sum of the old entry and a plus to that of the new.  A task adds these up before
the shuffle, so that moves at most one row for each entry and task, whatever entry is the common
one.  As rounds converge, fewer row groups are decoded for it.  Tables are written in the shared
folder, so the loss of an executor costs its tasks only; each is deleted once the next is there.

Cases: a vector that is null or holds a null or non-finite component is dropped; an empty one is
all zeros.  Vectors shorter than the longest, and a length that the number of parts doesn't divide,
are filled up by zeros.  Repeated rows, ids and null ids count row by row; the first entries are
taken by id, nulls last, then by components.  With fewer vectors than entries the codebook is as
short.  An empty table gives an empty result.  Integers of 2 to the 27th or beyond end the job with
an error, as their squares' sums don't fit a long.  Columns other than the id, the vector and the
label are not read, and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import drop_path, materialise, new_path, pa_schema, small

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Labels whose sums are sent to every task; more meet the rows by a salted shuffle.
BROADCAST_LABELS, SALTS = 100_000, 16
_LARGEST = 1 << 27


@dataclass
class Codebooks:
    """Entries, and the count and sum of the parts assigned to each: [part, entry(, position)]."""

    entries: np.ndarray
    counts: np.ndarray
    sums: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def moved(self, counts: np.ndarray, sums: np.ndarray) -> Codebooks:
        """The codebooks after changes to counts and sums."""
        counts, sums = self.counts + counts, self.sums + sums
        used = counts > 0
        entries = self.entries.copy()
        entries[used] = sums[used] // counts[used][:, None]
        return Codebooks(entries, counts, sums)


def integers(column: pa.Array, width: int) -> np.ndarray:
    scaled = np.floor(vectors.matrix(column, width) * SCALE)
    if scaled.size and np.abs(scaled).max() >= _LARGEST:
        raise ValueError("a component is too large for exact distances")
    return scaled.astype(np.int64)


def assigned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and the squared distance to it: [row, part]."""
    parts, _, width = entries.shape
    near, error = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
    # products in doubles are exact as long as their sums are below 2 to the 53rd
    kind = float if width * max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0))) ** 2 < 1 << 51 else np.int64
    for p in range(parts):
        own, book = x[:, p * width : (p + 1) * width].astype(kind), entries[p].astype(kind)
        distance = (book * book).sum(1) - 2 * (own @ book.T)
        near[:, p] = distance.argmin(1)  # the first of equal ones
        error[:, p] = (distance[np.arange(len(x)), near[:, p]] + (own * own).sum(1)).astype(np.int64)
    return near, error


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every sound row.

    A code has two hexadecimal digits a part, so ``entries`` may be 256 at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code holds at most 256 entries a part")
    spark = rows.sparkSession
    state, width = _integers(rows, parts, id_col, vector_col, label_col)
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([list(r["x"]) for r in first], np.int64).reshape(len(first), parts, width // parts).swapaxes(0, 1)
    books = Codebooks(start, np.zeros(start.shape[:2], np.int64), np.zeros(start.shape, np.int64))
    for _ in range(rounds if len(first) else 0):
        new = _assign(state, books, width)
        drop_path(spark, state._path)
        state = new
        books = books.moved(*_changes(state, books))
    final = _coded(state, books, width)
    drop_path(spark, state._path)
    labels = final.groupBy("label").agg(F.sum("error").alias("label_error"))
    known, joined = labels.select(F.col("label").alias("known"), "label_error"), final["label"].eqNullSafe(F.col("known"))
    if labels.count() <= BROADCAST_LABELS:
        out = final.join(F.broadcast(known), joined)
    else:
        known = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("copy"))
        out = final.join(known, joined & (F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)) == F.col("copy")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _integers(rows: DataFrame, parts: int, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """A table of the sound rows' integers, not assigned yet, and their number of components."""
    narrow = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max((int(vectors.lengths(b.column(0).filter(pa.array(vectors.sound(b.column(0))))).max(initial=0)) for b in batches), default=0)
        yield pa.RecordBatch.from_pydict({"n": pa.array([most], pa.int32())})

    width = narrow.select("v").mapInArrow(longest, "n int").agg(F.max("n")).first()[0] or 0
    width = max(1, -(-width // parts)) * parts
    label = rows.schema[label_col].dataType.simpleString()
    schema = f"vec_id long, label {label}, x array<int>, before binary, code binary"
    out = pa_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            batch = batch.filter(pa.array(vectors.sound(batch.column(2))))
            none = pa.nulls(len(batch), pa.binary())
            yield _batch(out, batch.column(0), batch.column(1), _lists(integers(batch.column(2), width)), none, none)

    return _written(narrow.mapInArrow(run, schema)), width


def _written(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession, "codes")
    table = materialise(df, "codes", path)
    table._path = path
    return table


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().astype(np.int32)))


def _batch(schema: pa.Schema, *arrays: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, width)


def _bytes(codes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary())


def _assign(state: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """The next state: its assignments by ``books`` beside the ones before."""
    shared, out = state.sparkSession.sparkContext.broadcast(books.entries), pa_schema(state.sparkSession, _ddl(state))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            near, _ = assigned(_matrix(batch.column(2), width), shared.value)
            yield _batch(out, batch.column(0), batch.column(1), batch.column(2), batch.column(4), _bytes(near))

    return _written(state.mapInArrow(run, state.schema))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def _changes(state: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Changes of counts and sums: plus for each part that came to an entry, minus for each that left."""
    parts, n, size = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(parts * n, np.int64), np.zeros((parts * n, size), np.int64)
        for batch in small(batches):
            x = _matrix(batch.column(0), parts * size).reshape(-1, parts, size)
            new = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            known = np.asarray(batch.column(1).is_valid())
            old = new.copy()
            old[known] = np.frombuffer(b"".join(b for b in batch.column(1).to_pylist() if b is not None), np.uint8).reshape(-1, parts)
            for at, sign, moved in ((new, 1, (new != old) | ~known[:, None]), (old, -1, (new != old) & known[:, None])):
                for p in range(parts):
                    rows = moved[:, p]
                    place = at[rows, p] + p * n
                    np.add.at(counts, place, sign)
                    np.add.at(sums, place, sign * x[rows, p])
        some = np.flatnonzero(counts.astype(bool) | sums.any(1))
        yield pa.RecordBatch.from_pydict({"at": pa.array(some, pa.int32()), "n": pa.array(counts[some]), "sums": pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * size), pa.array(sums[some].ravel()))})

    changed = state.where("before IS NULL OR before <> code").select("x", "before", "code").mapInArrow(run, "at int, n long, sums array<long>")
    total = changed.groupBy("at").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(size)]).alias("sums"))
    counts, sums = np.zeros((parts * n), np.int64), np.zeros((parts * n, size), np.int64)
    for r in total.collect():  # at most one row an entry
        counts[r["at"]], sums[r["at"]] = r["n"], r["sums"]
    return counts.reshape(parts, n), sums.reshape(parts, n, size)


def _coded(state: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """A table of vec_id, label, code and error by the final codebooks."""
    shared, label = state.sparkSession.sparkContext.broadcast(books.entries), state.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, code string, error long"
    out = pa_schema(state.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            near, error = assigned(_matrix(batch.column(2), width), shared.value)
            codes = pa.array([row.tobytes().hex() for row in near.astype(np.uint8)], pa.string())
            yield _batch(out, batch.column(0), batch.column(1), codes, pa.array(error.sum(1)))

    return _written(state.select("vec_id", "label", "x").mapInArrow(run, schema))
