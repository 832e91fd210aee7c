"""Vectorised word and window hashing over batches of texts.

A word is a maximal run of bytes that are not ASCII white space.  Hashes are
64-bit polynomials with wrap-around arithmetic followed by an avalanche step;
they are the same in every process and at every batch size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64
MASK = (1 << 64) - 1
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 256, dtype=U64) | U64(1)
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    x = np.full(n + 1, base & MASK, U64)
    x[0] = 1
    return np.multiply.accumulate(x)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """hashes[k] is the k-th word; text i owns words first[i]:first[i + 1].

    begin and end are byte offsets of each word in ``buffer``; base[i] is the
    byte offset at which text i begins.
    """

    hashes: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    base: np.ndarray
    buffer: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: list[str | None], lower: bool = True) -> Words:
    """Hash every word of every text; None counts as an empty text."""
    raw = [(t.lower() if lower else t).encode("utf-8", "replace") if t else b"" for t in texts]
    sizes = np.fromiter((len(x) for x in raw), np.int64, len(raw))
    base = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(sizes + 1, out=base[1:])
    buffer = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    begins, ends, hashes = [], [], []
    for lo, hi in _chunks(buffer):
        begin, end, value = _chunk_words(buffer[lo:hi])
        begins.append(begin + lo)
        ends.append(end + lo)
        hashes.append(value)
    none = np.zeros(0, np.int64)
    begin = np.concatenate(begins) if begins else none
    end = np.concatenate(ends) if ends else none
    found = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    return Words(found, np.searchsorted(begin, base), begin, end, base, buffer)


def _chunks(buffer: np.ndarray, size: int = 1 << 19):
    """Ranges of about ``size`` bytes that end at white space, so that the working memory doesn't grow with the text."""
    lo, n = 0, len(buffer)
    while lo < n:
        hi = min(n, lo + size)
        while hi < n and not _SPACE[buffer[hi]]:
            step = np.flatnonzero(_SPACE[buffer[hi : hi + size]])
            hi = hi + int(step[0]) if len(step) else min(n, hi + size)
        yield lo, hi
        lo = hi


def _chunk_words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[buffer]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    if not space[-1]:
        edge = np.concatenate([edge, [len(buffer)]])
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return begin, end, np.zeros(0, U64)
    lengths = end - begin
    letters = buffer[~space]
    starts = np.zeros(len(begin), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    place = np.arange(len(letters)) - np.repeat(starts, lengths)
    value = _TABLE[letters] * powers(_BYTE_BASE, int(lengths.max()))[place]
    return begin, end, mix(np.add.reduceat(value, starts))


class Windows:
    """Hashes of any window of words, by prefix sums of a polynomial."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(hashes * powers(_WORD_BASE, n)[:n], out=self.prefix[1:])
        self.inverse = powers(pow(_WORD_BASE, -1, 1 << 64), n)

    def at(self, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        return mix((self.prefix[starts + width] - self.prefix[starts]) * self.inverse[starts])


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Word indexes at which a window of ``width`` words fits in its text."""
    count = np.maximum(np.diff(first) - width + 1, 0)
    skip = np.zeros(len(count), np.int64)
    np.cumsum(count[:-1], out=skip[1:])
    return np.repeat(first[:-1] - skip, count) + np.arange(count.sum())
