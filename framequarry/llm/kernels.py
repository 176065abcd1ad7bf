"""Numpy kernels that the operators run inside Arrow tasks.

All of them work on a buffer of UTF-8 bytes that holds several texts one after
another, so that a task pays numpy's call overhead once per few megabytes and
not once per text or word. Memory is bounded by CHUNK bytes of text (or by one
text, where a single text is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
CHUNK = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, _U)
        have[0], k, p = 1, 1, base
        while k < size:
            m = min(k, size - k)
            have[k : k + m] = have[:m] * _U(p)
            k, p = k * 2, p * p & (1 << 64) - 1
        _tables[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a polynomial hash are usable."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


_CODES = _byte_codes()


class Poly:
    """Polynomial hashes of any slice of a sequence of 64-bit codes.

    One cumulative sum is made; the hash of a slice is then a difference of two
    sums times an inverse power, so equal slices have equal hashes wherever they
    stand. Different slices collide with a chance of about 2**-64."""

    def __init__(self, codes: np.ndarray, base: int):
        self.base = base
        self.sums = np.empty(len(codes) + 1, _U)
        self.sums[0] = 0
        np.cumsum(codes * powers(base, len(codes)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = powers(pow(self.base, -1, 1 << 64), len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(_U))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all slices of length k."""
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, _U)
        inverse = powers(pow(self.base, -1, 1 << 64), n)
        return mix((self.sums[k:] - self.sums[:n]) * inverse + _U(k))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offsets of its texts (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about size bytes of text, with their bytes and offsets."""
    data, off = texts(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts of a chunk: start and end byte,
    number of the text, and first word of each text."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        inside = ~_SPACE[data]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[off] = True
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | first[1:n]
            ends[:-1] &= ~inside[1:] | first[1:n]
        self.data, self.off = data, off
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(off) - 1), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return Poly(_CODES[self.data], _BASE | 1).of(self.start, self.end)


def byte_poly(data: np.ndarray) -> Poly:
    return Poly(_CODES[data], _BASE | 1)


WORD_BASE = 0xD1B54A32D192ED03


def sliding(a: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f (minimum or maximum) over each window of the given width."""
    if len(a) < width:
        return a[:0]
    k, m = 1, a
    while 2 * k <= width:
        m = f(m[:-k], m[k:])
        k *= 2
    if k < width:
        m = f(m[: len(m) - (width - k)], m[width - k :])
    return m


def winnowed(grams: np.ndarray, width: int, usable: np.ndarray) -> np.ndarray:
    """Places of the grams that are least in a usable window of width grams
    (usable: by the window's first gram). Which grams of a window are chosen
    depends on the window's content alone; every minimum of a window counts."""
    least = sliding(grams, width, np.minimum)
    if not len(least):
        return np.empty(0, np.int64)
    least = np.where(usable[: len(least)], least, _U(0))
    padded = np.concatenate([np.zeros(width - 1, _U), least, np.zeros(width - 1, _U)])
    return np.flatnonzero((sliding(padded, width, np.maximum) == grams) & (grams != 0))


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + length) for a start s."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, n), -1)
    return np.cumsum(steps[:-1]) > 0


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length l, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[s : s + l] for each s and l, concatenated."""
    return pool[np.repeat(starts, lengths) + ragged(lengths)] if len(starts) else pool[:0]
