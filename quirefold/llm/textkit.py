"""Vectorised text primitives over Arrow string batches: words, word hashes, n-gram hashes.

A *word* is a maximal run of bytes other than the six ASCII white-space characters, that is a match of
``[^\\x20\\x09-\\x0D]+``. Everything works on the UTF-8 bytes of many documents at once; a document's text is never
cut. Hashes are 64-bit, deterministic across processes and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MASK = (1 << 64) - 1
#: Seeds and odd multipliers of the hash functions.
_BASE_BYTES = 0x9E3779B97F4A7C15
_BASE_WORDS = 0xD1342543DE82EF95
_MIX_1 = U64(0xBF58476D1CE4E5B9)
_MIX_2 = U64(0x94D049BB133111EB)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, _MASK, 256, dtype=U64, endpoint=True)

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of text that are hashed at once (a longer document is one slice by itself).
SLICE_BYTES = 1 << 20


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    p = np.full(size, b, dtype=U64)
                    p[0] = 1
                    setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(_BASE_BYTES), _Powers(_BASE_WORDS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64's)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _MIX_1
        x = (x ^ (x >> U64(27))) * _MIX_2
        return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of consecutive documents: byte spans, hashes, and the range of words of each document."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True) -> None:
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = _IS_WORD[raw]
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edge = offsets[(offsets > 0) & (offsets < n)]  # words end where documents do
        first[edge] |= inside[edge + 1]
        last[edge - 1] |= inside[edge]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.start, offsets)  # document d has words doc[d] to doc[d + 1]
        if hashes:
            self.hash = self._hashes(_LOWER if lower else None)

    def _hashes(self, letters: np.ndarray | None) -> np.ndarray:
        """A word's hash depends on its bytes only, so words are taken in blocks: a long text needs no long sums."""
        out = np.empty(len(self.start), dtype=U64)
        a = 0
        while a < len(out):
            lo = self.start[a]
            b = max(a + 1, int(np.searchsorted(self.end, lo + SLICE_BYTES, "right")))
            raw = self.raw[lo : self.end[b - 1]]
            start, end = self.start[a:b] - lo, self.end[a:b] - lo
            up, down = _byte_powers.get(len(raw) + 1)
            with np.errstate(over="ignore"):
                sums = np.zeros(len(raw) + 1, dtype=U64)
                np.cumsum(_BYTE_VALUES[raw if letters is None else letters[raw]] * up[: len(raw)], out=sums[1:])
                out[a:b] = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
            a = b
        return out

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def doc_of(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.doc) - 1), self.counts())

    def ngrams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether these k words lie in one document."""
        return ngram_hashes(self.hash, k), self.room(k)

    def room(self, k: int) -> np.ndarray:
        """For each word: do k words from it on lie in its document?"""
        left = np.repeat(self.doc[1:], self.counts()) - np.arange(len(self))
        return left >= k


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; the last k - 1 entries are of shorter sequences and must be masked."""
    n = len(h)
    if k <= 8:
        out, factor = h.copy(), 1
        with np.errstate(over="ignore"):
            for j in range(1, min(k, n)):
                factor = factor * _BASE_WORDS & _MASK
                out[: n - j] += h[j:] * U64(factor)
        return mix(out)
    up, down = _word_powers.get(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(h * up[:n], out=sums[1:])
        ends = np.minimum(np.arange(n) + k, n)
        return mix((sums[ends] - sums[:n]) * down[:n])


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of about `most` bytes, or one longer document."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def per_slice(column: pa.Array, lower: bool = False, hashes: bool = True, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first document, end, their words) for slices of a string column."""
    raw, offsets = utf8(column)
    for a, b in slices(offsets, most):
        yield a, b, Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower, hashes)


def sums_by_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[d]:bounds[d + 1]]; empty ranges give 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
