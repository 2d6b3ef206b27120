"""Hashed word and character n-grams of whole texts, computed over the UTF-8 buffers of Arrow batches.

All work is on flat numpy arrays for a slice of rows at a time, so memory follows CHUNK (or one text, if that is longer).
A span's hash is a polynomial in its bytes: prefix sums give every word's and every n-gram's hash without a loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time.
CHUNK = 1 << 20
#: Rows worked on at a time.
ROWS = 4096
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_up = np.ones(1, np.uint64)
_down = np.ones(1, np.uint64)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its len + 1 offsets; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offs, data = col.buffers()
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of at most `most` bytes of text and `rows` rows, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = size[begin - 1] if begin else 0
            end = min(begin + rows, max(begin + 1, int(np.searchsorted(size, before + most, "right"))))
            yield batch.slice(begin, end - begin)
            begin = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that any of their bits can number a bucket."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        n = max(n, CHUNK + 1)
        _up, _down = np.full(n, _P, np.uint64), np.full(n, _INV, np.uint64)
        _up[0] = _down[0] = 1
        np.cumprod(_up, out=_up)
        np.cumprod(_down, out=_down)
    return _up, _down


def prefix_sums(values: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Spans(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    #: Of each row, the first span; one more at the end.
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(inside: np.ndarray, offsets: np.ndarray) -> Spans:
    """The maximal runs of True within each row."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Spans(starts, ends, np.searchsorted(starts, offsets))


_bytes = np.arange(256)
#: \x20 and \x09-\x0D
SPACE = (_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13))
#: Letters, digits and all bytes of other scripts.
WORDY = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes | 32) >= 97) & ((_bytes | 32) <= 122) & (_bytes < 128) | (_bytes >= 128)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n bytes from each position on; one for each position that has n."""
    m = max(0, len(values) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= np.uint64(_P)
        out += values[k : k + m]
    return mix(out + np.uint64(n))
