"""Arrow-buffer text helpers shared by the operators.

A string column of an Arrow batch is one byte buffer with offsets, so words of
a whole batch are found and hashed with a few numpy passes; no Python string
is made. Batches are cut into slices of about ``SLICE`` bytes (one very long
document is a slice of its own), which bounds memory.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (in place on a copy)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@functools.cache
def _byte_codes(fold: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64))
    if fold:
        codes[65:91] = codes[97:123]
    return codes


@functools.cache
def separators(kind: str) -> np.ndarray:
    """Bytes that part words: ``space`` (space and \\t..\\r) or ``word`` (all ASCII but letters and digits)."""
    b = np.arange(256)
    if kind == "space":
        return (b == 32) | ((b >= 9) & (b <= 13))
    letters = ((b >= 48) & (b < 58)) | ((b >= 65) & (b < 91)) | ((b >= 97) & (b < 123)) | (b >= 128)
    return ~letters


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("p", ())) < n:
        size = max(n, SLICE + 4096)
        for key, base in (("p", _P), ("q", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def text_slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first_row, last_row, bytes, bounds)``; row r of a slice is ``bytes[bounds[r]:bounds[r + 1]]``. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # the bytes under a null are not text
        valid = np.asarray(column.is_valid())
        sizes = np.where(valid, np.diff(off), 0)
        if sizes.sum() != off[-1] - off[0]:
            raw = np.concatenate([raw[off[i] : off[i + 1]] for i in np.flatnonzero(valid)] or [raw[:0]])
            off = np.concatenate([[0], np.cumsum(sizes)])
    row = 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + SLICE, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


class Words:
    """Words of one slice: byte spans, 64-bit hashes and the row of each; ``first[r]:first[r + 1]`` are the words of row r."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kind: str = "space", fold: bool = True) -> None:
        rows = len(bounds) - 1
        keep = ~separators(kind)[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.empty(len(data) + 1, bool)
        before[0], before[1:] = True, ~keep
        self.start = np.flatnonzero(keep & (before[:-1] | edge[:-1]))
        after = np.empty(len(data) + 1, bool)
        after[-1], after[:-1] = True, ~keep
        self.end = np.flatnonzero(keep & (after[1:] | edge[1:])) + 1
        p, q = powers(len(data) + 1)
        self.total = total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_codes(fold)[data] * p[:-1], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * q[self.start])
        self.first = np.searchsorted(self.start, bounds)
        self.first[-1] = len(self.start)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.hash)


_MUL = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3], np.uint64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of hashes (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m] * _MUL[0]
    for i in range(1, n):
        out = mix(out) if i % len(_MUL) == 0 else out
        out = out * np.uint64(0x9FB21C651E98DF25) + h[i : i + m] * _MUL[i % len(_MUL)]
    return mix(out)


def within(row: np.ndarray, n: int) -> np.ndarray:
    """Which n-grams of consecutive words lie in one row."""
    return row[: len(row) - n + 1] == row[n - 1 :] if len(row) >= n else np.zeros(0, bool)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each row as sorted hashes: ``(hashes, offsets)``. Fewer than n words: the whole sequence as one; none: empty."""
    w = Words(data, bounds)
    g = grams(w.hash, n)
    parts, sizes = [], np.zeros(len(bounds), np.int64)
    for r in range(len(bounds) - 1):
        a, b = int(w.first[r]), int(w.first[r + 1])
        if b - a >= n:
            s = np.unique(g[a : b - n + 1])
        elif b > a:
            s = grams(w.hash[a:b], b - a) ^ np.uint64(b - a)
        else:
            continue
        parts.append(s)
        sizes[r + 1] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)
