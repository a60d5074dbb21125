"""Vectorised cutting of UTF-8 text batches into spans, and exact span codes.

All functions see whole texts. A null text counts as the empty text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes that separate words, 0x09-0x0D and 0x20.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(batch: pa.RecordBatch, text: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Runs of rows of the batch with at most so many bytes of text, a longer text alone."""
    col = batch.column(text)
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(ends)
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and the len+1 places where rows begin."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or at[0] == at[-1]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def encoded(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Codes of the spans between consecutive cuts, and the bytes of each code. Exact: no hashing."""
    n = len(cuts) - 1
    if n <= 0:
        return np.zeros(0, np.int32), []
    spans = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    d = spans.dictionary_encode()
    known, at = text_bytes(d.dictionary)
    raw, at = known.tobytes(), at.tolist()
    return d.indices.to_numpy(), [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes without SPACES, and for each row its first word's number (len+1 values)."""
    full = ~IS_SPACE[data]
    first = full.copy()
    first[1:] &= ~full[:-1]
    heads = rows[:-1][rows[:-1] < len(data)]
    first[heads] = full[heads]
    last = full.copy()
    last[:-1] &= ~full[1:]
    tails = rows[1:][rows[1:] > 0] - 1
    last[tails] = full[tails]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, rows)


def word_codes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Codes of words, and the bytes of each code (some codes are of the gaps between words)."""
    if not len(begin):
        return np.zeros(0, np.int32), []
    cuts = np.empty(2 * len(begin), np.int64)
    cuts[0::2], cuts[1::2] = begin, end
    codes, known = encoded(data, cuts)
    return codes[0::2], known


def release() -> None:
    """Give memory that is free within this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library that has it
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, so that a worker which goes on to other tasks keeps no memory of this one, nor of the one before."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
