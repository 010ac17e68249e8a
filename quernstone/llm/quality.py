"""Quality rules: rule statistics, base rules, and an isolation forest over the statistics.

The forest (Liu, Ting and Zhou, 2008) isolates a row by random splits; rows with a short mean
path are anomalous.  A tree holds a sample of good labelled rows, and its splits fall anywhere
within the bounds of all labelled rows of one half, so that rows unlike good ones soon stand alone,
be there one or many of them.  A split takes a rate the likelier the better it alone ranks that
half's bad rows against its good ones: a phone number's digits are odd, but not bad.  The score
above which a document goes is calibrated on the other half, which the trees never see.
The sample is bounded; statistics and scores cover every document.

Cases: a null or empty text has zero words and fails the base rules.  Rows of equal text get
equal results, whatever their number.  Where labelled rows that pass the base rules lack one of the
classes in the half for the trees, only the base rules decide; where the other half lacks one, the
threshold is calibrated on all of them.  An empty table gives an empty result.  Columns of the
input other than the id and the text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_batches, map_batches

#: Largest number of labelled rows that the forest and its threshold are fitted on.
MAX_LABELLED = 20_000
TREES, SUBSAMPLE, SEED = 200, 256, 7
#: Share of labelled good rows that the threshold may reject.
MAX_GOOD_REJECTED = 0.002

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS)
_BLANKS, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
#: ``\n`` never occurs within a line.
_LINE_BLANKS = " \t\r\x0b\x0c"


def repeated_positions(ids: np.ndarray, n_types: int, width: int = 5) -> int:
    """How many of the words ``ids`` lie in a window of ``width`` words that occurs twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key, span = ids[:n].astype(np.int64), n_types
    for k in range(1, width):
        if span * n_types >= 2**62:  # ranks instead of products: still one number for each distinct window
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            span = n
        key = key * n_types + ids[k : k + n]
        span *= n_types
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    cover = np.zeros(len(ids), bool)
    for k in range(width):
        cover[k : k + n] |= hit
    return int(cover.sum())


def rule_statistics(text: str | None) -> tuple[int, ...]:
    """The counts named in ``_COUNTS`` for one whole text."""
    if not text:
        return (0,) * len(_COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # on exactly the six ASCII blanks
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(text)
    lines = [x for x in text.split("\n") if x.strip(_LINE_BLANKS)]
    return (
        len(words),
        points - int(count[list(_BLANKS)].sum()),
        int(count[list(_SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeated_positions(ids, len(seen)),
        len(lines),
        int(count[65:91].sum()),
        int(count[48:58].sum()),
        int(count[33]) + int(count[63]),
        len(seen),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per row of ``docs``."""

    def count(batch: pa.RecordBatch) -> list:
        rows = [rule_statistics(t.as_py()) for t in batch.column(1)]
        return [batch.column(0), *map(list, zip(*rows))]

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), STATS_SCHEMA, count)


def features(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Rates of the counts: what the forest splits on, one row per document."""
    c = {k: np.asarray(v, float) for k, v in columns.items()}
    words, chars = c["n_words"] + 20, c["word_chars"] + 100  # so that a mark in a short text is no outlier
    return np.column_stack([
        c["n_symbols"] / words,
        c["n_dup_lines"] / (c["n_lines"] + 3),
        c["n_repeat_words"] / words,
        c["n_upper"] / chars,
        c["n_marks"] / words,
        c["n_digits"] / chars,
        np.minimum(c["word_chars"] / np.maximum(c["n_words"], 1), 40) / 10,
        (c["n_distinct"] + 20) / words,
    ])


def _mean_path(n: float) -> float:
    """Mean path of an unsuccessful search in a tree of ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def telling(rows: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How far each rate alone ranks bad rows apart from good ones, from 0 to 1."""
    out = []
    for x in rows.T:
        usual = np.sort(x[good])
        below = (np.searchsorted(usual, x[~good], "left") + np.searchsorted(usual, x[~good], "right")) / 2
        out.append(abs(2 * below.mean() / len(usual) - 1))
    return np.array(out)


class IsolationForest:
    """Trees as flat arrays, so that whole batches walk them at once."""

    def __init__(self, rows: np.ndarray, good: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> None:
        """Splits are drawn within the bounds of all ``rows``; what they isolate are the rows that ``good`` marks."""
        rng = np.random.default_rng(seed)
        low, self.middle, high = np.quantile(rows[good], (0.05, 0.5, 0.95), axis=0)
        self.width = np.maximum(high - low, 0.01)
        self.odds = telling(rows, good)
        rows = self.scaled(rows)
        usual = rows[good]
        self.size = min(subsample, len(usual))
        self.depth = max(1, math.ceil(math.log2(max(2, self.size))))
        self.trees = [self._grow(usual[rng.choice(len(usual), self.size, replace=False)], rows.min(0), rows.max(0), rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        """A tree over a sample: a node without a row of it is a leaf, however much room it has."""
        feature, cut, left, right, path = [], [], [], [], []

        def node(part: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
            at = len(feature)
            for x, v in ((feature, 0), (cut, math.inf), (left, at), (right, at), (path, depth + _mean_path(len(part)))):
                x.append(v)
            odds = np.where(high > low, self.odds, 0)
            if depth < self.depth and len(part) and odds.any():
                f = int(rng.choice(len(odds), p=odds / odds.sum()))
                feature[at], cut[at] = f, float(rng.uniform(low[f], high[f]))
                below = part[:, f] < cut[at]
                left[at] = node(part[below], low, np.where(np.arange(len(high)) == f, cut[at], high), depth + 1)
                right[at] = node(part[~below], np.where(np.arange(len(low)) == f, cut[at], low), high, depth + 1)
            return at

        node(rows, low, high, 0)
        return tuple(map(np.array, (feature, cut, left, right, path)))

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        """Distances from the median of the good rows in widths of their middle, far ones drawn in."""
        x = (rows - self.middle) / self.width
        return np.sign(x) * np.log1p(np.abs(x))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): near 1 for rows that few splits isolate."""
        rows = self.scaled(rows)
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = np.where(rows[every, feature[at]] < cut[at], left[at], right[at])
            total += path[at]
        return 2 ** (-total / max(len(self.trees), 1) / max(_mean_path(self.size), 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray, max_good_rejected: float = MAX_GOOD_REJECTED) -> float:
    """The score with the most bad rows above it, less the good ones, within the allowed share of good rows."""
    if good.all() or not good.any():
        return math.inf
    cuts = np.unique(scores)
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts + 1
    g, b = np.sort(scores[good]), np.sort(scores[~good])
    good_out = 1 - np.searchsorted(g, cuts) / len(g)
    bad_out = 1 - np.searchsorted(b, cuts) / len(b)
    allowed = good_out <= max_good_rejected
    if not allowed.any():
        return math.inf
    gain = np.where(allowed, bad_out - good_out, -1.0)
    return float(cuts[int(gain.argmax())])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> tuple[IsolationForest | None, float]:
    """Forest and threshold from at most ``max_labelled`` labelled rows that pass the base rules.

    ``labels`` has doc_id and quality (1 good, 0 bad); the rows are chosen by a hash of the id, at
    a rate that makes about that many, so that no task sends more than its share to the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1) AND doc_id IS NOT NULL")
    rate = min(1.0, 0.9 * max_labelled / max(1, known.count()))
    place = F.xxhash64("doc_id", F.lit(SEED))
    known = known.where(F.pmod(place, F.lit(1 << 20)) < rate * (1 << 20)).orderBy(place, "quality").limit(max_labelled)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")  # max_labelled ids at most
    rows = (
        statistics(chosen).where(~base_failed()).join(F.broadcast(known), "doc_id")
        .orderBy(place, "doc_id", "quality", *_COUNTS)
        .limit(max_labelled).select("quality", *_COUNTS).toPandas()
    )
    good = rows["quality"].to_numpy() == 1
    return trained(features({c: rows[c].to_numpy() for c in _COUNTS}), good)


def trained(x: np.ndarray, good: np.ndarray) -> tuple[IsolationForest | None, float]:
    """A forest of every other row of each class, and its threshold from the rest; rows come in the order of a hash."""
    both = lambda some: good[some].any() and not good[some].all()
    grown = np.zeros(len(good), bool)
    for kind in (good, ~good):
        grown[np.flatnonzero(kind)[::2]] = True
    if not both(grown):
        return None, math.inf
    forest = IsolationForest(x[grown], good[grown])
    rest = ~grown if both(~grown) else np.ones(len(good), bool)
    return forest, calibrate(forest.score(x[rest]), good[rest])


def base_failed():
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the rule counts, base_failed, anomaly_score and kept for every row of ``docs``, in one pass over the texts."""
    forest, threshold = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # trees of SUBSAMPLE rows each

    def run(batch: pa.RecordBatch) -> list:
        columns = list(zip(*(rule_statistics(t.as_py()) for t in batch.column(1))))
        return [batch.column(0), *map(list, columns), anomaly(shared.value, columns)]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = map_batches(rows, f"{STATS_SCHEMA}, anomaly_score double", run)
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly_score") < F.lit(threshold)))


def anomaly(forest: IsolationForest | None, columns: list[tuple]) -> np.ndarray:
    counts = {c: np.array(v) for c, v in zip(_COUNTS, columns)}
    return forest.score(features(counts)) if forest else np.zeros(len(columns[0]))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that the base rules and the forest keep."""
    forest, threshold = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    at = docs.columns.index(text_col)

    def good(batch: pa.RecordBatch) -> np.ndarray:
        columns = list(zip(*(rule_statistics(t.as_py()) for t in batch.column(at))))
        words, repeated = np.array(columns[0]), np.array(columns[4])
        return (words >= 10) & (100 * repeated <= 20 * words) & (anomaly(shared.value, columns) < threshold)

    return filter_batches(docs, good)
