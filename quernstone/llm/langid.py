"""Language identification: a linear-chain conditional random field over the words of a text.

A text is a run of chains of at most ``CHAIN`` words.  Every word has character n-gram features
of two to four bytes, which hold its affixes where they touch the blank on either side, and a
lexicon feature for known words; transitions between the languages of neighbouring words are
learned with them.  Training chains splice segments of differently labelled texts, so that the
transitions know code-switched text.  Forward-backward gives each word's language marginals;
their mean over a text's words gives its language and score.

Cases: a null text, or one without a letter, is ``und`` with score 0.  Rows of equal text get
equal results.  With no labelled text at all every text is ``und``.  An empty table gives an
empty result.  Words of any length and texts of any length are scored whole, in bounded blocks.
Columns other than the id, text and language are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_batches, map_batches, materialise

#: Bounds of the labelled sample: texts for each language, windows of words for each text, all windows, which the languages share evenly.
TEXTS_PER_LANG, WINDOWS_PER_TEXT, MAX_WINDOWS = 300, 4, 20_000
CHAIN, BLOCK_WORDS, SEED = 64, 65_536, 11
#: Training chains for each language, but four languages' at least.
LANG_CHAINS, EPOCHS, BATCH, RATE = 600, 6, 80, 0.15
#: The quantile of known texts' scores that the least score is calibrated on, its part that still counts, and bins that find it.
LOWEST, PART, BINS = 0.01, 0.7, 4_096
LEXICON, LEXICON_MIN = 4_000, 3
_BITS = {2: 16, 3: 16, 4: 17}
_MULTIPLIER = {3: 0x9E3779B1, 4: 0x85EBCA6B}
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 2**64))
_LETTER = re.compile(r"[^\W\d_]")
_POWERS: list[np.ndarray] = []


def has_letter(text: str | None) -> bool:
    return text is not None and any(m.group().isalpha() for m in _LETTER.finditer(text))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """Feature numbers of a block of words: n-gram numbers by byte, hashes by word."""

    starts: np.ndarray
    scale: np.ndarray
    grams: dict[int, np.ndarray]
    hashes: np.ndarray


def word_features(words: list[bytes]) -> Words:
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    n = len(raw) - 1  # no n-gram starts at the last blank
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    wide = np.concatenate([raw, np.full(3, 32, np.uint8)]).astype(np.uint32)
    blank = wide == 32
    two = wide[:n] << np.uint32(8) | wide[1 : n + 1]
    grams = {2: two.astype(np.int32)}
    three = two << np.uint32(8) | wide[2 : n + 2]
    for k, code in ((3, three), (4, three << np.uint32(8) | wide[3 : n + 3])):
        bits = _BITS[k]
        number = (code * np.uint32(_MULTIPLIER[k]) >> np.uint32(32 - bits)).astype(np.int32)
        over = blank[1 : n + 1] if k == 3 else blank[1 : n + 1] | blank[2 : n + 2]
        number[over] = 1 << bits  # would reach into the next word: the row of zeros
        grams[k] = number
    power, inverse = _powers(len(raw))
    total = np.concatenate([[np.uint64(0)], np.cumsum(raw.astype(np.uint64) * power[: len(raw)])])
    begin = starts + 1
    hashes = (total[begin + lengths] - total[begin]) * inverse[begin]
    return Words(starts, 1 / np.sqrt(3.0 * (lengths + 1)).astype(np.float32), grams, hashes)


class ChainField:
    """Weights by language of n-grams and lexicon words, and of transitions."""

    def __init__(self, langs: list[str]) -> None:
        self.langs = langs
        n = len(langs)
        self.weights = {k: np.zeros(((1 << b) + 1, n), np.float32) for k, b in _BITS.items()}
        self.lexicon = np.zeros(0, np.uint64)
        self.lexical = np.zeros((1, n), np.float32)  # row 0: words outside the lexicon
        self.transition = np.zeros((n, n), np.float64)
        self.start = np.zeros(n, np.float64)

    def lexical_rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at + 1, 0)

    def emissions(self, words: Words) -> np.ndarray:
        by_byte = self.weights[2][words.grams[2]]
        for k in (3, 4):
            by_byte += self.weights[k][words.grams[k]]
        out = np.add.reduceat(by_byte, words.starts, axis=0)
        return out * words.scale[:, None] + self.lexical[self.lexical_rows(words.hashes)]

    def marginals(self, score: np.ndarray, chains: np.ndarray, places: np.ndarray, n_chains: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, by forward-backward, and the expected transitions summed over all chains."""
        n = len(self.langs)
        used = np.zeros((n_chains, CHAIN), bool)
        used[chains, places] = True
        e = np.ones((CHAIN, n_chains, n), np.float64)
        e[places, chains] = np.exp(score - score.max(1, keepdims=True))
        step = np.exp(self.transition)
        forward, backward = np.empty_like(e), np.ones_like(e)
        forward[0] = np.exp(self.start) * e[0]
        forward[0] /= forward[0].sum(1, keepdims=True)
        for t in range(1, CHAIN):
            a = forward[t - 1] @ step * e[t]
            forward[t] = a / a.sum(1, keepdims=True)
        expected = np.zeros((n, n))
        for t in range(CHAIN - 2, -1, -1):
            ahead = e[t + 1] * backward[t + 1]
            b = ahead @ step.T
            b /= b.sum(1, keepdims=True)
            more = used[:, t + 1]
            backward[t] = np.where(more[:, None], b, 1.0)
            if self.training:
                pair = forward[t][:, :, None] * step * ahead[:, None, :]
                pair /= pair.sum((1, 2), keepdims=True)
                expected += pair[more].sum(0)
        m = (forward * backward)[places, chains]
        return m / m.sum(1, keepdims=True), expected

    training = False

    def fit(self, windows: list[tuple[str, list[bytes]]], seed: int = SEED) -> ChainField:
        """Adagrad on the log likelihood of spliced chains."""
        rng = np.random.default_rng(seed)
        by_lang = {x: [w for lang, w in windows if lang == x and w] for x in self.langs}
        count: dict[bytes, int] = {}
        for _, w in windows:
            for x in w:
                count[x] = count.get(x, 0) + 1
        known = sorted((x for x in count if count[x] >= LEXICON_MIN), key=lambda x: (-count[x], x))[:LEXICON]
        self.lexicon = np.unique(word_features(known).hashes) if known else self.lexicon
        self.lexical = np.zeros((len(self.lexicon) + 1, len(self.langs)), np.float32)
        chains = [self._spliced(by_lang, rng) for _ in range(LANG_CHAINS * max(4, len(self.langs)))]
        tables = [*self.weights.values(), self.lexical, self.transition, self.start]
        squares = [np.full_like(x, 1e-4) for x in tables]
        self.training = True
        for _ in range(EPOCHS):
            order = rng.permutation(len(chains))
            for at in range(0, len(order), BATCH):
                part = [chains[i] for i in order[at : at + BATCH]]
                for x, g, s in zip(tables, self._gradient(part), squares):
                    s += g * g
                    x += RATE * (g / np.sqrt(s)).astype(x.dtype)
        self.training = False
        return self

    def _spliced(self, by_lang: dict[str, list], rng: np.random.Generator) -> tuple[list[bytes], list[int]]:
        words: list[bytes] = []
        gold: list[int] = []
        switching = rng.random() < 0.5
        lang = int(rng.integers(len(self.langs)))
        while len(words) < CHAIN:
            pool = by_lang[self.langs[lang]]
            source = pool[int(rng.integers(len(pool)))]
            at = int(rng.integers(len(source)))
            piece = source[at : at + (int(rng.integers(4, 25)) if switching else CHAIN)]
            words += piece
            gold += [lang] * len(piece)
            if switching:
                lang = int(rng.integers(len(self.langs)))
        return words[:CHAIN], gold[:CHAIN]

    def _gradient(self, part: list[tuple[list[bytes], list[int]]]) -> list[np.ndarray]:
        words = word_features([w for ws, _ in part for w in ws])
        gold = np.array([g for _, gs in part for g in gs])
        n, total = len(self.langs), len(gold)
        m, expected = self.marginals(self.emissions(words), np.arange(total) // CHAIN, np.arange(total) % CHAIN, len(part))
        error = -m
        error[np.arange(total), gold] += 1
        spread = np.repeat(error * words.scale[:, None], np.diff(np.append(words.starts, len(words.grams[2]))), axis=0)
        out = []
        for k, numbers in words.grams.items():
            g = np.column_stack([np.bincount(numbers, spread[:, c], (1 << _BITS[k]) + 1) for c in range(n)])
            if k > 2:
                g[-1] = 0
            out.append(g / len(part))
        rows = self.lexical_rows(words.hashes)
        out.append(np.column_stack([np.bincount(rows, error[:, c], len(self.lexical)) for c in range(n)]) / len(part))
        seen, pairs = np.zeros((n, n)), gold.reshape(len(part), CHAIN)
        np.add.at(seen, (pairs[:, :-1].ravel(), pairs[:, 1:].ravel()), 1)
        out.append((seen - expected) / len(part))
        first = np.arange(total) % CHAIN == 0
        out.append(error[first].sum(0) / len(part))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each whole text."""
        sums = np.zeros((len(texts), max(1, len(self.langs))))
        slices: list[tuple[int, list[bytes]]] = []
        waiting = 0
        lettered = [bool(self.langs) and has_letter(t) for t in texts]
        limit = max(CHAIN, BLOCK_WORDS * 4 // max(4, len(self.langs)) // CHAIN * CHAIN)
        for i, t in enumerate(texts):
            if lettered[i]:
                words = t.lower().encode("utf-8", "surrogatepass").split()
                for at in range(0, len(words), limit):
                    piece = words[at : at + limit]
                    if waiting + len(piece) > limit:
                        self._add(slices, sums)
                        slices, waiting = [], 0
                    slices.append((i, piece))
                    waiting += len(piece)
        self._add(slices, sums)
        out = []
        for i, lettered_i in enumerate(lettered):
            total = sums[i].sum()
            out.append((self.langs[int(sums[i].argmax())], float(min(1.0, sums[i].max() / total))) if lettered_i and total else ("und", 0.0))
        return out

    def _add(self, slices: list[tuple[int, list[bytes]]], sums: np.ndarray) -> None:
        if not slices:
            return
        sizes = np.array([len(w) for _, w in slices])
        place = np.concatenate([np.arange(k) for k in sizes])
        per = (sizes + CHAIN - 1) // CHAIN
        chain = np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), sizes) + place // CHAIN
        words = word_features([x for _, w in slices for x in w])
        m, _ = self.marginals(self.emissions(words), chain, place % CHAIN, int(per.sum()))
        np.add.at(sums, [i for i, _ in slices], np.add.reduceat(m, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0))


def _windows(batch: pa.RecordBatch) -> list:
    """Up to ``WINDOWS_PER_TEXT`` seeded windows of words of each text, for training."""
    out: tuple[list, ...] = ([], [], [])
    for lang, text, number in zip(*(c.to_pylist() for c in batch.columns)):
        if has_letter(text):
            words = text.lower().encode("utf-8", "surrogatepass").split()
            rng = np.random.default_rng(abs(number))
            for k in range(min(WINDOWS_PER_TEXT, -(-len(words) // CHAIN))):
                at = int(rng.integers(max(1, len(words) - CHAIN + 1)))
                for column, x in zip(out, (lang, b" ".join(words[at : at + CHAIN]).decode("utf-8", "surrogatepass"), number + k)):
                    column.append(x)
    return list(out)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ChainField:
    """A field learned from a bounded, seeded sample of the rows with a text and a language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.lit(SEED)).alias("number"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    texts = min(1.2 * TEXTS_PER_LANG, MAX_WINDOWS / WINDOWS_PER_TEXT / max(1, len(counts)))  # no language crowds another out
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, min(1.0, texts / n)).otherwise(share)
    sample = rows.where(F.pmod("number", F.lit(1 << 20)) < share * (1 << 20))
    windows = map_batches(sample, "lang string, words string, number long", _windows)
    chosen = windows.orderBy("number", "lang", "words").limit(MAX_WINDOWS).collect()
    langs = sorted({r["lang"] for r in chosen})
    return ChainField(langs).fit([(r["lang"], r["words"].encode("utf-8", "surrogatepass").split()) for r in chosen]) if langs else ChainField([])


def identify(docs: DataFrame, field: ChainField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # its size is fixed by the languages and the tables above

    def run(batch: pa.RecordBatch) -> list:
        found = shared.value.predict(batch.column(1).to_pylist())
        return [batch.column(0), [x for x, _ in found], [s for _, s in found]]

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id long, lang_pred string, score double", run)


def keep_identified(docs: DataFrame, field: ChainField, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, unchanged, that have a language, with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index(text_col)
    return filter_batches(docs, lambda batch: [x != "und" and s >= least for x, s in shared.value.predict(batch.column(at).to_pylist())])


def keep_lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has a letter: all that can be said without a learned language."""
    at = docs.columns.index(text_col)
    return filter_batches(docs, lambda batch: [has_letter(x) for x in batch.column(at).to_pylist()])


def least_score(docs: DataFrame, field: ChainField, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """The score from which on a text is in a learned language: part of the score that all but the lowest hundredth of known texts reach, 0 without any.

    It comes from all rows that training never saw and that got their language.
    """
    known = docs.where(held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def right(batch: pa.RecordBatch) -> list:
        found = shared.value.predict(batch.column(1).to_pylist())
        return [[score for (lang, score), said in zip(found, batch.column(0).to_pylist()) if lang == said]]

    scores = materialise(map_batches(known.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")), "score double", right), "scores")
    n = scores.count()
    if not n:
        return 0.0
    place = (n - 1) * LOWEST
    low = at_rank(scores, int(place))
    return PART * (low + (at_rank(scores, min(int(place) + 1, n - 1)) - low) * (place - int(place)))


def at_rank(scores: DataFrame, rank: int) -> float:
    """The score of that rank, from 0, exactly: counts of bins, then of the bins of one bin, until it holds one value."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        bins = F.floor((F.col("score") - low) / (high - low) * BINS).alias("bin")  # no lesser score has a greater bin
        counted = scores.where(F.col("score").between(low, high)).groupBy(bins).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for row in sorted(counted.collect(), key=lambda r: r["bin"]):
            if rank < row["n"]:
                low, high = row["low"], row["high"]
                break
            rank -= row["n"]
    return float(low)


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ChainField:
    return fit(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)), id_col, text_col, lang_col)
