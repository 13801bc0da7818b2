"""Word, shingle and MinHash arithmetic on the byte buffers of Arrow text columns.

Whole slices of documents are processed with numpy, without a Python object per word. Words are
hashed as polynomials over their bytes modulo 2**64 and mixed; a shingle hash mixes the hashes of
its words. Memory is bounded by the slice, which holds ``SLICE_BYTES`` of text or one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_CHUNK = 1 << 18
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the one of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with at most ``SLICE_BYTES`` of text, or a single longer row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and their offsets (rows + 1); NULL rows are empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts: byte starts and ends, offsets per row, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, seed: int = 1) -> None:
        inside = np.ones(256, bool)
        inside[list(_SPACES)] = False
        word = inside[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        rows = offsets[:-1][offsets[1:] > offsets[:-1]]
        first[rows] = word[rows]
        ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        last[ends] = word[ends]
        self.data = data
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash(lower, seed)

    def _hash(self, lower: bool, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        if lower:
            table[65:91] = table[97:123]
        base = U64(int(rng.integers(0, 1 << 62)) * 2 + 1)
        back = U64(pow(int(base), -1, 1 << 64))
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            at = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, at + _CHUNK, side="right")))
            size = int(self.ends[j - 1]) - at
            power, inverse = _powers(base, size), _powers(back, size)
            terms = table[self.data[at : at + size]] * power
            terms = np.append(terms, U64(0))
            bounds = np.stack([self.starts[i:j] - at, self.ends[i:j] - at], 1).ravel()
            sums = np.add.reduceat(terms, bounds)[::2]
            lengths = (self.ends[i:j] - self.starts[i:j]).astype(np.uint64)
            out[i:j] = mix(sums * inverse[self.starts[i:j] - at] + lengths * U64(0x9E3779B97F4A7C15))
            i = j
        return out

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word of each run of ``k`` words inside one row, and offsets per row."""
        counts = np.maximum(np.diff(self.offsets) - k + 1, 0)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        first = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - self.offsets[:-1], counts)
        return first, offsets

    def window_hashes(self, k: int, first: np.ndarray, seed: int = 7) -> np.ndarray:
        out = np.zeros(len(first), np.uint64)
        for j, c in enumerate(_coefficients(k, seed)):
            out += self.hashes[first + j] * c
        return mix(out)

    def shingles(self, k: int = 5) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each row; with fewer than ``k`` words one for all of them."""
        first, offsets = self.windows(k)
        hashes = self.window_hashes(k, first)
        counts = np.diff(self.offsets)
        out = []
        for row in range(len(counts)):
            if counts[row] >= k:
                out.append(np.unique(hashes[offsets[row] : offsets[row + 1]]))
            elif counts[row]:
                own = self.hashes[self.offsets[row] : self.offsets[row + 1]]
                total = (own * _coefficients(k, 7)[: len(own)]).sum(dtype=np.uint64) + U64(len(own))
                out.append(mix(np.array([total], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, size: int) -> np.ndarray:
    """base**0, base**1, ... ; kept for the usual chunk, made anew for a longer word."""
    if size > 2 * _CHUNK:
        return _power_row(base, size)
    if int(base) not in _POWERS:
        _POWERS[int(base)] = _power_row(base, 2 * _CHUNK)
    return _POWERS[int(base)][:size]


def _power_row(base: np.uint64, size: int) -> np.ndarray:
    row = np.full(size, base, np.uint64)
    row[:1] = 1
    return np.multiply.accumulate(row)


def _coefficients(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, k, dtype=np.uint64) | U64(1)


class MinHash:
    """``n`` universal permutations a*x + b modulo 2**32 of shingle hashes, a odd."""

    def __init__(self, n: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.n = n
        self.a = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, n) minima as uint32; an empty set has the largest value everywhere."""
        out = np.full((len(sets), self.n), 0xFFFFFFFF, np.uint32)
        rows = [i for i, s in enumerate(sets) if len(s)]
        step = 1 << 16
        at = 0
        while at < len(rows):
            group, size = [], 0
            while at < len(rows) and (not group or size + len(sets[rows[at]]) <= step):
                group.append(rows[at])
                size += len(sets[rows[at]])
                at += 1
            x = np.concatenate([sets[i] for i in group])
            x = (x >> U64(32)).astype(np.uint32)
            starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in group])[:-1]]).astype(np.intp)
            value = np.empty_like(x)
            for p in range(self.n):
                np.multiply(x, self.a[p], out=value)
                np.add(value, self.b[p], out=value)
                out[group, p] = np.minimum.reduceat(value, starts)
        return out
