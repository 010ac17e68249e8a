"""Token ids and counts, equal to the library's; tests compare them.

The word tokenizer splits a text into pieces before it merges characters, and a piece's tokens
depend on the piece alone.  Texts of a plain alphabet (ASCII and the letters of Latin-1) are
split here and only pieces not yet met are encoded; any other text goes to the library whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np

#: Pieces that a worker remembers before it forgets them all: bounds its memory.
REMEMBERED = 250_000
#: Letters of the plain alphabet, as a character class.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\t\n\x0b\x0c\r -~{_L}]*+")
_WORD_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_L}]++|[0-9]|[^\s{_L}0-9]++")
_LONG = 2_000
_RUN = re.compile(rf"\s{{{_LONG}}}|\S{{{_LONG}}}")
_made: dict[tuple, object] = {}


def _once(key: tuple, make: Callable[[], object]) -> object:
    """One object for each worker process and key."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return _once(("tokenizer", path), lambda: Tokenizer.from_file(path))


class ByteIds:
    """Ids of byte-level BPE as unsigned 32-bit little-endian bytes.

    ``path`` is the library's vocabulary.  Its merges are also ranks of byte strings, which the
    faster encoder takes: the byte string of an id, in order of ids, is its rank.
    """

    def __init__(self, path: str) -> None:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            saved = json.load(f)
        special = {x["content"]: x["id"] for x in saved["added_tokens"]}
        shown = _byte_of_character()
        ranks = {bytes(shown[c] for c in token): i for token, i in saved["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("byte-ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.library = tokenizer(path)

    def __call__(self, text: str) -> bytes:
        # runs of thousands of like characters are slow there
        if len(text) > _LONG and _RUN.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


def byte_ids(path: str) -> ByteIds:
    return _once(("byte ids", path), lambda: ByteIds(path))


class WordCounts:
    """Token counts of the lower-case BPE whose words end in a mark, through its library.

    The split is that of the vocabulary's file (checked when it is opened); for any other
    tokenizer every text goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        import json

        with open(path, encoding="utf-8") as f:
            saved = json.load(f)
        self.library = tokenizer(path)
        self.special = re.compile("|".join(re.escape(x["content"]) for x in saved["added_tokens"]) or r"(?!)")
        shape = json.dumps([saved["normalizer"], saved["pre_tokenizer"]])
        self.splits = all(x in shape for x in ("NFC", r"\\s+", "Lowercase", r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", "Removed")) and all(not x["normalized"] and not x["lstrip"] and not x["rstrip"] for x in saved["added_tokens"])
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int | None] = [None] * len(texts)
        whole, split = [], []
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for i, t in enumerate(texts):
            if self.splits and len(t) == _PLAIN.match(t).end() and not self.special.search(t):
                pieces = _WORD_PIECES.findall(t.lower())
                split.append((i, pieces))
            else:
                whole.append(i)
        new = sorted(set().union(*(p for _, p in split)).difference(known))
        if new:
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                known.update(zip(part, map(len, self.library.encode_batch_fast(part, add_special_tokens=False))))
        for i, pieces in split:
            out[i] = sum(map(known.__getitem__, pieces))
        for i in whole:
            out[i] = len(self.library.encode(texts[i], add_special_tokens=False))
        return out


def word_counts(path: str) -> WordCounts:
    return _once(("word counts", path), lambda: WordCounts(path))


