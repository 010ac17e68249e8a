"""Packing token sequences: cutting stock by column generation.

A text's ids, with one end id, are cut into full sequences and a rest.  The histogram of piece
lengths (at most ``CAPACITY`` numbers, however many texts there are) is a cutting-stock problem:
patterns of lengths that fit one sequence, each to be used so many times.  A sequence costs its
padded length: the capacity, or its own length where that is a power of two.

Best-fit decreasing gives the first columns.  A linear program over patterns is solved by the
simplex method to within ``GAP`` of its bound, where a knapsack dynamic program over the duals
prices new patterns (Gilmore and Gomory, 1961).  Uses are rounded down, and the pieces left, fewer
than a constant however many texts there are, are packed best-fit.  Pieces are ranked within their
length, and ranks map to patterns.

Cases: a null or empty text is the end id alone.  Repeated rows are packed once each.  Texts of
any length are cut, never truncated.  An empty table gives an empty result.  Columns other than
the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, materialise, small
from .tokens import byte_ids

CAPACITY, END_ID = 1024, 0
#: The program is solved when its cost lies within this share of its bound.
GAP, SEED = 0.0001, 23
#: Fractions from which uses are rounded up.
CUTS = (1 - 1e-6, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25)
#: Pivots for each length after which a program ends as it is: none seen takes 20, and only cycles that rounding makes could.
GUARD = 500
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every row of ``docs``: full ones and a rest.

    ``part`` and ``number`` (from 0) tell a piece from others of its length: they hold once the
    result is written.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = byte_ids(vocabulary), TaskContext.get().partitionId(), {}
        for batch in small(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    own = ids[4 * at : 4 * (at + capacity)]
                    length = len(own) // 4
                    number = seen.get(length, 0)
                    seen[length] = number + 1
                    out.append((doc, at, length, zlib.crc32(own), n, part, number))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    schema = f"{PIECES}, part long, number long"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def padded(fill: int, capacity: int = CAPACITY) -> int:
    return fill if fill & (fill - 1) == 0 else capacity


class PatternProgram:
    """min cost x  subject to  patterns x >= demand, x >= 0, by column generation.

    Columns are the surpluses of the lengths, then patterns of at most the demand of each length.
    The simplex method prices by devex weights; it keeps the basis inverse with the pivots since
    its last renewal, of which there are at most ``RENEWED``.
    """

    #: Pivots before the inverse is renewed; columns kept for each length.
    RENEWED, KEPT = 48, 12

    def __init__(self, demand: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.lengths = np.array(sorted(x for x in demand if demand[x]), np.int64)
        self.row = {x: i for i, x in enumerate(self.lengths.tolist())}
        self.demand = np.array([demand[x] for x in self.lengths.tolist()], float)
        self.columns: list[dict[int, int]] = [{i: -1} for i in range(len(self.lengths))]
        self.cost = np.zeros(len(self.lengths))
        self.place: dict[tuple, int] = {}
        self.new_costs: list[int] = []
        #: (row, count, size): any number of each length, as far as demanded and fit, is a sum of some
        self.items = []
        for i, x in enumerate(self.lengths.tolist()):
            left, k = min(int(self.demand[i]), capacity // x), 1
            while left:
                k = min(k, left)
                self.items.append((i, k, k * x))
                left, k = left - k, 2 * k
        self.pivots, self.gap = 0, 0.0

    def _add(self, pattern: dict[int, int]) -> int:
        """The column of a pattern of rows, cut to the demand."""
        pattern = {i: min(k, int(self.demand[i])) for i, k in sorted(pattern.items())}
        key = tuple(pattern.items())
        if key not in self.place:
            self.place[key] = len(self.columns)
            self.columns.append(pattern)
            self.new_costs.append(padded(sum(int(self.lengths[i]) * k for i, k in key), self.capacity))
        return self.place[key]

    def _arrange(self) -> None:
        """Arrays of all columns; of many, those far from use are forgotten until they are priced again."""
        self.cost = np.append(self.cost, self.new_costs)
        self.new_costs = []
        m = len(self.lengths)
        if len(self.columns) > self.KEPT * m:
            reduced = np.append(self.reduced, np.full(len(self.columns) - len(self.reduced), -np.inf))
            reduced[:m] = reduced[self.basis] = -np.inf
            kept = np.sort(np.argsort(reduced, kind="stable")[: self.KEPT * m // 2])
            self.columns, self.cost = [self.columns[i] for i in kept.tolist()], self.cost[kept]
            self.basis = np.searchsorted(kept, self.basis)
            self.place = {tuple(p.items()): i for i, p in enumerate(self.columns) if i >= m}
        self.rows = np.array([i for p in self.columns for i in p])
        self.counts = np.array([k for p in self.columns for k in p.values()], float)
        self.starts = np.cumsum([0, *(len(p) for p in self.columns[:-1])])
        self.weight = np.ones(len(self.columns))

    def _times(self, row: np.ndarray) -> np.ndarray:
        """The product of a row vector with every column."""
        return np.add.reduceat(row[self.rows] * self.counts, self.starts)

    def _begin(self) -> None:
        """A feasible basis: for each length, greatest first, the commonest best-fit pattern that it leads, or its surplus."""
        m = len(self.lengths)
        lead: dict[int, tuple[int, int]] = {}
        for pattern, n in best_fit({x: int(d) for x, d in zip(self.lengths.tolist(), self.demand)}, self.capacity):
            column = self._add({self.row[x]: k for x, k in pattern.items()})
            top = self.row[max(pattern)]
            lead[top] = max(lead.get(top, (0, 0)), (n, column))
        # a demand off by a hair keeps the simplex method from standing still at ties; it is put right in the end
        self.near = self.demand * (1 + 1e-5 * np.random.default_rng(SEED).random(m))
        matrix, left, self.basis = np.zeros((m, m)), self.near.copy(), np.arange(m)
        for i in range(m - 1, -1, -1):
            if left[i] <= 0:
                matrix[i, i] = -1.0
                continue
            column = lead[i][1] if i in lead else self._add({i: self.capacity // int(self.lengths[i])})
            self.basis[i] = column
            uses = left[i] / self.columns[column][i]
            for j, k in self.columns[column].items():
                matrix[j, i] = k
                left[j] -= uses * k
        self._arrange()
        self.inverse = np.linalg.inv(matrix)
        self.since: list[tuple[int, np.ndarray]] = []
        self.x = np.maximum(self.inverse @ self.near, 0)
        self._renew()

    def _renew(self) -> None:
        """Take the pivots since the last time into the inverse; duals and reduced costs anew."""
        if self.since:
            touched = sorted({out for out, _ in self.since})
            change = np.zeros((len(self.x), len(touched)))
            change[touched, np.arange(len(touched))] = 1
            for out, step in self.since:
                lead = change[out] / step[out]
                change -= step[:, None] * lead
                change[out] = lead
            old = self.inverse[touched]
            self.inverse[touched] = 0
            self.inverse += change @ old
            self.since = []
        self.dual = self.cost[self.basis] @ self.inverse
        self.reduced = self.cost - self._times(self.dual)

    def _step(self, column: int) -> np.ndarray:
        """The column in terms of the basis."""
        entries = self.columns[column]
        v = self.inverse[:, list(entries)] @ np.array(list(entries.values()), float)
        for out, step in self.since:
            lead = v[out] / step[out]
            if lead:
                v -= step * lead
                v[out] = lead
        return v

    def _inverse_row(self, r: int) -> np.ndarray:
        if not self.since:
            return self.inverse[r]
        place = {r: 0}
        at = [place.setdefault(out, len(place)) for out, _ in self.since]
        places = list(place)
        steps = np.array([step[places] for _, step in self.since])
        u = np.zeros(len(places))
        u[0] = 1.0
        for k in range(len(at) - 1, -1, -1):
            own, lead = u[at[k]], steps[k, at[k]]
            u[at[k]] = own + (own - u @ steps[k]) / lead
        return u @ self.inverse[places]

    def _price(self) -> tuple[float, bool]:
        """Patterns that a knapsack over the duals finds: the best of each length and of each fill that has its own cost.

        Returns the greatest value per cost, which gives a bound, and whether a pattern is new.
        """
        cap = self.capacity
        value = np.maximum(self.dual, 0)
        best = np.full(cap + 1, -np.inf)
        best[0] = 0.0
        took = np.zeros((len(self.items), cap + 1), bool)
        for t, (i, k, size) in enumerate(self.items):
            with_it = best[: cap + 1 - size] + k * value[i]
            np.greater(with_it, best[size:], out=took[t, size:])
            np.maximum(best[size:], with_it, out=best[size:])
        price = np.array([1, *(padded(w, cap) for w in range(1, cap + 1))], float)
        top = np.maximum.accumulate(best)  # the best fill of at most so much
        at = np.maximum.accumulate(np.where(best >= top, np.arange(cap + 1), 0))
        fills = np.array(sorted({*(1 << b for b in range(cap.bit_length())), cap, int((price - best)[1:].argmin()) + 1}))
        fills = fills[best[fills] > price[fills] + 1e-7]
        more = np.flatnonzero(top[cap - self.lengths] + value > cap + 1e-7)
        patterns: list[dict[int, int]] = [{} for _ in fills] + [{i: 1} for i in more.tolist()]
        left = np.concatenate([fills, at[cap - self.lengths[more]]])
        for t in range(len(self.items) - 1, -1, -1):
            used = np.flatnonzero(took[t, left])
            if len(used):
                i, k, size = self.items[t]
                left[used] -= size
                for j in used.tolist():
                    patterns[j][i] = patterns[j].get(i, 0) + k
        known = len(self.columns)
        for pattern in patterns:
            self._add(pattern)
        return float((best / price)[1:].max()), len(self.columns) > known

    def solve(self, gap: float = GAP) -> PatternProgram:
        if not len(self.lengths):
            self.x, self.basis = np.zeros(0), np.zeros(0, np.int64)
            return self
        self._begin()
        least = float(self.lengths @ self.near)  # no sequence costs less than its fill
        while True:
            self.gap = float(self.cost[self.basis] @ self.x) / least - 1
            if self.gap <= gap or self.pivots > GUARD * len(self.lengths):
                break
            if not self._improve():
                ratio, new = self._price()
                least = max(least, float(np.maximum(self.dual, 0) @ self.near) / max(ratio, 1.0))
                self.gap = float(self.cost[self.basis] @ self.x) / least - 1
                if not new:
                    break
                self._arrange()
            self._renew()
        self.x = np.maximum(self.inverse @ self.demand, 0)
        return self

    def _improve(self) -> bool:
        """At most ``RENEWED`` pivots; whether there was any."""
        while len(self.since) < self.RENEWED:
            column = int(np.where(self.reduced < -1e-6, self.reduced**2 / self.weight, 0).argmax())
            reduced = self.reduced[column]
            if reduced >= -1e-6:
                break
            step = self._step(column)
            up = np.flatnonzero(step > 1e-7)
            if not len(up):
                break
            ratios = np.maximum(self.x[up], 0) / step[up]
            out = int(up[ratios.argmin()])
            length = float(ratios.min())
            across = self._times(self._inverse_row(out)) / step[out]
            self.x -= length * step
            self.x[out] = length
            self.weight = np.maximum(self.weight, across**2 * self.weight[column])
            self.weight[self.basis[out]] = max(self.weight[column] / step[out] ** 2, 1.0)
            self.reduced -= reduced * across
            self.reduced[column] = 0.0
            self.basis[out] = column
            self.since.append((out, step))
            self.pivots += 1
        return bool(self.since)

    def rounded(self) -> list[tuple[dict[int, int], int]]:
        """(lengths of a pattern with their counts, uses), which together meet the demand exactly.

        Uses are rounded, up from each of ``CUTS`` on, greatest first and as far as the demand
        allows; the pieces that no use takes are packed best-fit.  The rounding that costs least counts.
        """
        return min((self._rounded(cut) for cut in CUTS), key=lambda uses: cost_of(uses, self.capacity))

    def _rounded(self, cut: float) -> list[tuple[dict[int, int], int]]:
        left, out = self.demand.astype(np.int64), []
        for j in np.argsort(-self.x, kind="stable").tolist():
            rows = self.columns[self.basis[j]]
            uses = min([int(self.x[j] + 1 - cut), *(int(left[i]) // k for i, k in rows.items())]) if self.basis[j] >= len(self.lengths) else 0
            if uses > 0:
                out.append(({int(self.lengths[i]): k for i, k in rows.items()}, uses))
                for i, k in rows.items():
                    left[i] -= uses * k
        return out + best_fit(dict(zip(self.lengths.tolist(), left.tolist())), self.capacity)


def cost_of(uses: list[tuple[dict[int, int], int]], capacity: int = CAPACITY) -> int:
    return sum(padded(sum(x * k for x, k in p.items()), capacity) * n for p, n in uses)


def best_fit(demand: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing, equal bins at a time: bins with how many there are."""
    by_room: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, bool)

    def put(room: int, bin_: dict[int, int], n: int) -> None:
        by_room[room].append((bin_, n))
        filled[room] = True

    for x, n in sorted(demand.items(), reverse=True):
        while n:
            open_ = np.flatnonzero(filled[x:])
            if len(open_):
                room = x + int(open_[0])
                bin_, bins = by_room[room].pop()
                filled[room] = bool(by_room[room])
                each = min(room // x, n)  # a bin stays the best fit until it has no room for one more
                used = min(bins, n // each)
                if bins > used:
                    put(room, bin_, bins - used)
            else:
                room, bin_, each = capacity, {}, min(capacity // x, n)
                used = n // each
            put(room - each * x, bin_ | {x: bin_.get(x, 0) + each}, used)
            n -= each * used
    return [b for bins in by_room for b in bins]


def runs(uses: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, offset) that map ranks to places."""
    out, ranks, sequence = [], {}, 0
    for pattern, n in uses:
        offset = 0
        for length, k in sorted(pattern.items(), reverse=True):
            out.append((length, ranks.get(length, 0), sequence, k, offset))
            ranks[length] = ranks.get(length, 0) + n * k
            offset += length * k
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every row of ``docs`` with their sequence_id and offset."""
    cut = materialise(pieces(docs, vocabulary, id_col, text_col, capacity, end_id), "pieces")
    shared = docs.sparkSession.sparkContext.broadcast(np.array(sorted(map(tuple, plan(cut, capacity).collect())), np.int64).reshape(-1, 5))  # at most a row for each length of each pattern

    def place(batch: pa.RecordBatch) -> list:
        table = shared.value
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        at = np.searchsorted(table[:, 0] << 44 | table[:, 1], length << 44 | rank, "right") - 1
        _, first, sequence, k, offset = table[at].T
        return [*batch.columns[:-1], sequence + (rank - first) // k, offset + (rank - first) % k * length]

    return map_batches(ranked(cut), f"{PIECES}, sequence_id long, offset long", place)


def plan(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``runs`` for the histogram of ``cut``: at most ``capacity`` lengths, so one task solves the program.

    It runs in a worker, whose linear algebra has one thread.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        demand = {x: n for batch in batches for x, n in zip(*(c.to_pylist() for c in batch.columns))}
        full = demand.pop(capacity, 0)
        uses = PatternProgram(demand, capacity).solve().rounded()
        table = runs([({capacity: 1}, full)] * (full > 0) + uses)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in table.T], names=names)

    names = ["length", "first", "sequence", "each", "offset"]
    return cut.groupBy("length").count().coalesce(1).mapInArrow(solve, ", ".join(f"{x} long" for x in names))


def ranked(cut: DataFrame) -> DataFrame:
    """The written ``cut`` with each piece's rank, from 0, among those of its length.

    Pieces are numbered within the part that cut them; counts by part give each its first rank, so
    no length's pieces, however many, meet in one task.
    """
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut.groupBy("length", "part").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return cut.join(firsts, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("number")).cast("long").alias("rank"))
