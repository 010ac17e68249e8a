"""Embedding whitening: principal components by matrix-free block subspace iteration.

Every component c becomes the integer x = floor(64 c) + 1,000,000.  One pass sums the fit list
exactly.  Each further pass multiplies the centred rows X by a block Q of orthonormal columns and
sums X'(XQ), without a covariance matrix: a task adds up one product for its rows, tasks' products
meet row by row, and only the sum, of dimensions times block, reaches the driver.  There the
Rayleigh-Ritz step turns the block within its span, and QR makes the next one.  The rounds end when
the residual of each wanted component certifies it, ``TOLERANCE`` of the largest eigenvalue.  A
block whose residuals fall too slowly, as eigenvalues beyond its end are close to those within, is
widened by random directions; as wide as the dimensions, one pass is exact, so the rounds end.

Rows are centred as (n x - S) / n with an exact integer numerator, before anything is multiplied.

Cases: a vector that is null or holds a null or non-finite component is dropped; an empty one is
not.  Vectors shorter than the longest are filled up by zeros.  Repeated rows, ids and null ids
count and return row by row.  Components without variance, up to ``NO_VARIANCE`` of the trace, are
left out, so a table of equal vectors, of one, or of none gives no rows.  Of equal eigenvalues any
orthonormal vectors serve.  A component beyond 2 to the 53rd, or a sum beyond a long, ends the job
with an error; the deviation is exact as a decimal of 38 digits.  Columns other than the id and the
vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import pa_schema, small

SCALE, SHIFT = 64, 1_000_000
SEED = 29
#: Residual of a certified component, as a part of the largest eigenvalue.
TOLERANCE = 1e-13
#: Passes that a block may take by the rate of the last ones; one that needs more is widened.
PATIENCE = 12
#: Part of the trace up to which a component has no variance.
NO_VARIANCE = 1e-12


@dataclass
class Fit:
    """Rows, sums, unit components by falling eigenvalue (columns), eigenvalues, trace and passes."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int


def integers(column: pa.Array, width: int) -> np.ndarray:
    scaled = np.floor(vectors.matrix(column, width) * SCALE)
    if scaled.size and np.abs(scaled).max() >= 2.0**53:
        raise ValueError("a component is too large for exact sums")
    return scaled.astype(np.int64) + SHIFT


def fit(rows: DataFrame, k: int = 32, vector_col: str = "embedding", block: int | None = None) -> Fit:
    """The ``k`` first components of the vectors of ``rows``."""
    only = rows.select(F.col(vector_col).alias("v"))
    n, sums = _sums(only)
    width = len(sums)
    k = min(k, width)
    if not n or not k:
        return Fit(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0)
    size = min(width, block or 2 * k)
    rng = np.random.default_rng(SEED)
    q = np.eye(width) if size == width else np.linalg.qr(rng.standard_normal((width, size)))[0]
    passes, last = 0, None
    while True:
        z, trace = _product(only, n, sums, q)
        passes += 1
        small_one = q.T @ z
        values, turn = np.linalg.eigh((small_one + small_one.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        y, z = q @ turn, z @ turn
        residual = float(np.linalg.norm(z[:, :k] - y[:, :k] * values[:k], axis=0).max())
        bound = TOLERANCE * max(float(values[0]), 0.0)
        if residual <= bound or q.shape[1] == width:
            break
        slow = last is not None and (residual >= last or np.log(residual / max(bound, 1e-300)) / np.log(last / residual) > PATIENCE)
        more = min(width, 2 * q.shape[1]) - q.shape[1] if slow else 0
        last = None if more else residual
        q = np.linalg.qr(np.hstack([z, rng.standard_normal((width, more)) * (np.abs(z).max() or 1.0)]))[0]
    keep = values[:k] > NO_VARIANCE * trace
    return Fit(n, sums, y[:, :k][:, keep], values[:k][keep], trace, passes)


def _sums(only: DataFrame) -> tuple[int, np.ndarray]:
    """Number of sound vectors and the sum of each dimension's integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, np.int64)
        for batch in small(batches):
            column = batch.column(0).filter(pa.array(vectors.sound(batch.column(0))))
            if not len(column):
                continue
            width = max(len(total), int(vectors.lengths(column).max()))
            total = np.concatenate([total, np.full(width - len(total), n * SHIFT)])
            total += integers(column, width).sum(0)
            n += len(column)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, len(total)), pa.int32()), "s": pa.array([n, *total.tolist()], pa.int64()), "m": pa.array([n] * (1 + len(total)), pa.int64())})

    found = {r["i"]: (r["s"], r["m"]) for r in only.mapInArrow(run, "i int, s long, m long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("m").alias("m")).collect()}
    n = found.get(-1, (0, 0))[0]
    # a task without vectors of that length holds zeros there
    return n, np.array([s + (n - m) * SHIFT for s, m in (found[i] for i in range(max(found, default=-1) + 1))], np.int64)


def centred(column: pa.Array, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly."""
    x = integers(column, len(sums))
    if x.size and int(np.abs(x).max()) * n + int(np.abs(sums).max()) >= 2**63:
        raise ValueError("a deviation is too large for a long")
    return x * n - sums


def _product(only: DataFrame, n: int, sums: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """V Q and the trace of V, V being the covariance."""
    shared = only.sparkSession.sparkContext.broadcast((n, sums, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, q = shared.value
        total = np.zeros((len(sums), q.shape[1] + 1))
        for batch in small(batches):
            column = batch.column(0).filter(pa.array(vectors.sound(batch.column(0))))
            x = centred(column, n, sums) / n
            total[:, :-1] += x.T @ (x @ q)
            total[:, -1] += (x * x).sum(0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(sums)), pa.int32()), "v": pa.array([row.tobytes() for row in total], pa.binary())})

    got = _added(only.mapInArrow(run, "i int, v binary"))
    total = np.vstack([got[i] for i in range(len(sums))]) / n
    return total[:, :-1], float(total[:, -1].sum())


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the doubles of each i: tasks add the rows of some i's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = np.frombuffer(v.as_buffer())
                held[i] = held[i] + value if i in held else value.copy()
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(held), pa.int32()), "v": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    return {r["i"]: np.frombuffer(bytes(r["v"])) for r in parts.repartition("i").mapInArrow(run, "i int, v binary").collect()}


def identity_error(rows: DataFrame, fitted: Fit, vector_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(fitted.values)
    if not k:
        return 0.0
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in small(batches):
            w = _white(batch.column(0).filter(pa.array(vectors.sound(batch.column(0)))), shared.value)[1]
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(k + 1), pa.int32()), "v": pa.array([row.tobytes() for row in total], pa.binary())})

    got = _added(rows.select(F.col(vector_col).alias("v")).mapInArrow(run, "i int, v binary"))
    second, mean = np.vstack([got[i] for i in range(k)]) / fitted.n, got[k] / fitted.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def _white(column: pa.Array, fitted: Fit) -> tuple[np.ndarray, np.ndarray]:
    x = centred(column, fitted.n, fitted.sums)
    return x, (x / fitted.n) @ fitted.components / np.sqrt(fitted.values)


def _squares(x: np.ndarray) -> list[Decimal]:
    """Sum of squares of each row, exactly."""
    if not x.size or int(np.abs(x).max()) ** 2 * x.shape[1] < 2**63:
        return [Decimal(v) for v in (x * x).sum(1).tolist()]
    return [Decimal(sum(v * v for v in row)) for row in x.tolist()]


def whiten(rows: DataFrame, k: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", block: int | None = None, fitted: Fit | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every sound row and component."""
    fitted = fitted or fit(rows, k, vector_col, block)
    spark = rows.sparkSession
    schema = "vec_id long, deviation decimal(38,0), w array<double>"
    out, shared = pa_schema(spark, schema), spark.sparkContext.broadcast(fitted)
    error = identity_error(rows, fitted, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            batch = batch.filter(pa.array(vectors.sound(batch.column(1))))
            x, w = _white(batch.column(1), shared.value)
            width = w.shape[1]
            arrays = [batch.column(0), pa.array(_squares(x), out.field(1).type), pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * width), pa.array(w.ravel()))]
            yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, out)], schema=out)

    explained = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values]).cast("array<double>")
    found = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, schema)
    found = found.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return found.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
