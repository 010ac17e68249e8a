"""Vectors in Arrow batches: sound rows as one matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def sound(column: pa.Array) -> np.ndarray:
    """Which rows are neither null nor hold a null or non-finite component."""
    starts, stops, values = _parts(column)
    good = np.isfinite(values)
    before = np.concatenate([[0], np.cumsum(~good)])
    return (before[stops] == before[starts]) & np.asarray(column.is_valid())


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of sound vectors as doubles, shorter ones filled up by zeros to ``width``."""
    starts, stops, values = _parts(column)
    lengths = stops - starts
    if len(lengths) and (lengths == width).all() and width:
        return values[starts[0] : stops[-1]].reshape(-1, width)
    out = np.zeros((len(lengths), width))
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, place] = values[np.repeat(starts, lengths) + place]
    return out


def lengths(column: pa.Array) -> np.ndarray:
    starts, stops, _ = _parts(column)
    return stops - starts


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each row and all components as doubles, null ones not a number."""
    offsets = column.offsets.to_numpy()
    raw = column.values.cast(pa.float64(), safe=False)
    values = raw.to_numpy(zero_copy_only=False) if not raw.null_count else np.where(np.asarray(raw.is_valid()), np.asarray(raw.fill_null(0.0)), np.nan)
    starts, stops = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    stops = np.where(np.asarray(column.is_valid()), stops, starts)
    return starts, stops, values
