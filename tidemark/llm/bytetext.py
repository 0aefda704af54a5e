"""Words, windows and hashes of whole Arrow text batches, as numpy arrays over the UTF-8 bytes.

Every operator of this package that reads words goes through ``split``: one pass over the bytes of a slice of texts
yields word boundaries and a 64-bit hash for each word; hashes of runs of words come from prefix sums.  A slice is at
least one whole text and otherwise about ``SLICE`` bytes, so memory does not depend on the batch size Spark sends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_SEQ = 0xD1342543DE82EF95


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit (splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))

#: A-Z to a-z on bytes; bytes of longer UTF-8 sequences are not touched.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Byte classes of the word patterns: True where a byte belongs to a word.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(base: int, n: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _kept or len(_kept[base][0]) < n:
        inverse = pow(base, -1, 1 << 64)
        tables = []
        for b in (base, inverse):
            t = np.full(max(n, 1 << 16), b, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _kept[base] = tuple(tables)
    return _kept[base]


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _SEQ) -> np.ndarray:
    """Hash of values[start:end] for each pair of bounds; equal runs hash alike wherever they stand."""
    p, inv = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a slice of texts. first[d]:first[d + 1] are the words of text d; start and end are byte positions."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return run_hashes(_BYTE_CODE[self.data], self.start, self.end, _BASE)

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def data_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, at least one row each."""
    _, offsets = data_of(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def split(texts: pa.Array, inside: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    """Maximal runs of bytes for which ``inside`` holds; a run never crosses from one text to the next."""
    data, offsets = data_of(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    word = np.zeros(n + 1, bool)
    word[:n] = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | cut))
    end = np.flatnonzero(before & (~word | cut))
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def windows(words: Words, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, text) of every run of ``size`` consecutive words of one text."""
    h = words.hashes() if hashes is None else hashes
    n = np.maximum(words.counts - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = words.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return run_hashes(h, at, at + size), at, doc


def covered(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """Which of n positions lie in a run of ``size`` positions that starts at one of ``at``."""
    d = np.zeros(n + size + 1, np.int64)
    np.add.at(d, at, 1)
    np.add.at(d, at + size, -1)
    return np.cumsum(d[:n]) > 0


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    s = np.sort(x)
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
