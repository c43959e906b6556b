"""Distinct word-shingle sets of whole texts as sorted 64-bit hashes, computed in numpy over runs of texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from terrace.llm.common import text_chunks

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    values = mix64(lower.astype(U64) + U64(1))
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    apart = np.ones(256, bool)
    apart[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
    return values, blank, apart


#: Hash values of bytes, the bytes between words, and those between words without punctuation.
_VALUES, BLANK, APART = _tables()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the hash base and of its inverse, grown as longer runs come."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return self.up, self.down


_POWERS = Powers()


def _word_places(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of several texts in order."""
    n = len(data)
    word = ~between[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    return np.flatnonzero(word & (~before | cut[:n])), np.flatnonzero(word & (~after | cut[1:])) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = BLANK, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of the words of several texts in order, A-Z lower-cased, and for each text the end of its words.

    For each length in `prefixes` follow the hashes of the words' first so many bytes, and which words are that long.
    """
    n = len(data)
    if n == 0:
        none = np.empty(0, U64)
        return none, np.zeros(len(offsets) - 1, np.int64), *[(none, np.empty(0, bool)) for _ in prefixes]
    up, down = _POWERS.upto(n)
    starts, ends = _word_places(data, offsets, between)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(_VALUES[data] * up[:n], out=sums[1:])
    hashed = lambda to: mix64((sums[to] - sums[starts]) * down[starts] + (to - starts).astype(U64))
    first = [(hashed(np.minimum(starts + k, ends)), ends - starts >= k) for k in prefixes]
    return hashed(ends), np.searchsorted(starts, offsets[1:], side="left"), *first


@dataclass
class Sets:
    """Sets of consecutive rows: sorted distinct hashes one after another, `bounds` between them."""

    first_row: int
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.sizes)


def shingle_sets(batch: pa.RecordBatch, column: str, width: int) -> Iterator[Sets]:
    """The distinct `width`-word shingles of each text; with fewer words the whole sequence is one; else empty."""
    for first, _, data, offsets in text_chunks(batch, column):
        words, word_ends = word_hashes(data, offsets)
        word_starts = np.concatenate([[0], word_ends[:-1]])
        counts = word_ends - word_starts
        n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        bounds = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(bounds[-1]) + np.repeat(word_starts - bounds[:-1], n)
        limit = np.repeat(word_ends, n)
        raw = np.zeros(len(at), U64)
        for i in range(width):
            inside = at + i < limit
            raw = raw * U64(_BASE) + np.where(inside, words[np.minimum(at + i, max(len(words) - 1, 0))], U64(0)) if len(words) else raw
        raw = mix64(raw)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            raw[a:b].sort()
        keep = np.ones(len(raw), bool)
        keep[1:] = raw[1:] != raw[:-1]
        keep[bounds[:-1][n > 0]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        yield Sets(first, raw[keep], kept[bounds])


def per_set(values: np.ndarray, sets: Sets, ufunc: np.ufunc, empty: int) -> np.ndarray:
    """Reduces one value per hash to one per set."""
    out = np.full(len(sets.bounds) - 1, empty, values.dtype)
    full = sets.sizes > 0
    if full.any():
        out[full] = ufunc.reduceat(values, sets.bounds[:-1][full])
    return out
