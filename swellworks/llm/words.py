"""Vectorised word work on UTF-8 buffers: boundaries, hashes and windows without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D; documents never share a word.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash

from swellworks.llm.runtime import ragged

_U = np.uint64
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
IN_TERM = np.array([chr(b).isalnum() or b >= 0x80 for b in range(256)])  # words without ASCII punctuation
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _U(_BASE))
        up[0] = 1
        down = np.full(n, _U(pow(_BASE, -1, 1 << 64)))
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of every uint64 over the whole word."""
    h = (h ^ (h >> _U(32))) * _U(_STEP)
    h = (h ^ (h >> _U(32))) * _U(_STEP)
    return h ^ (h >> _U(32))


def lanes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first eight bytes, last eight bytes) of the pieces buf[start:end] as numbers.

    Pieces of up to eight bytes have all of them in the first and 0 in the last.  With the length the two make up a
    piece of up to LANES bytes exactly.
    """
    wide = np.concatenate([buf, np.zeros(8, np.uint8)])
    at = np.ndarray((len(buf) + 1,), "<u8", wide, 0, (1,))
    size = end - start
    short = np.minimum(size, 8).astype(_U) * _U(8)
    first = at[start]
    return np.where(short == 64, first, first & ((_U(1) << (short & _U(63))) - _U(1))), np.where(size > 8, at[np.maximum(end - 8, 0)], _U(0))


LANES = 16


def piece_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each piece buf[start:end]; no two pieces of up to eight bytes without zeros share one.

    Pieces of up to LANES bytes mix their two numbers; longer ones, which are few, take XXH3: a polynomial modulo
    2^64 would be equal for some long pieces of regular build, whatever its base.
    """
    first, last = lanes(buf, start, end)
    size = end - start
    h = mix(first ^ mix(last + size.astype(_U) * _U(_BASE)))
    long = np.flatnonzero(size > LANES)
    if len(long):
        data, of = memoryview(np.ascontiguousarray(buf)), xxhash.xxh3_64_intdigest
        h[long] = np.fromiter((of(data[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist())), _U, len(long))
    return h


class Words:
    """Word boundaries of a piece: ``start``/``end`` byte positions, ``first[d]`` the first word of document d."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray = IN_WORD):
        self.buf, self.offs = buf, offs
        on = table[buf]
        head, tail = on.copy(), on.copy()
        if len(buf):
            head[1:] &= ~on[:-1]
            tail[:-1] &= ~on[1:]
            cut = offs[1:-1]
            cut = cut[(cut > 0) & (cut < len(buf))]
            head[cut] = on[cut]
            tail[cut - 1] = on[cut - 1]
        self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands."""
        return piece_hashes(LOWER[self.buf] if lower else self.buf, self.start, self.end)

    def windows(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of k words from each word on, documents' first rows): windows that cross documents are left out."""
        counts = np.maximum(self.counts - k + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        at = ragged(self.first[:-1], counts)
        acc = np.zeros(max(len(h) - k + 1, 0), _U)
        for j in range(k):
            acc = acc * _U(_STEP) + h[j : j + len(acc)]
        return mix(acc)[at] if len(at) else np.empty(0, _U), bounds

    def word_at(self, k: int) -> np.ndarray:
        """The word number at which each row of ``windows(_, k)`` starts."""
        return ragged(self.first[:-1], np.maximum(self.counts - k + 1, 0))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of v[i : i+w] for every full window, by doubling."""
    span = 1
    while span * 2 <= w:
        v = np.minimum(v[:-span], v[span:]) if len(v) > span else v[:0]
        span *= 2
    rest = w - span
    if rest:
        v = np.minimum(v[:-rest], v[rest:]) if len(v) > rest else v[:0]
    return v


def joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words joined by one space."""
    if not len(start):
        return b""
    size = end - start + 1
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]), 0x20, np.uint8)
    body = np.ones(len(out), bool)
    body[ends - 1] = False
    out[body] = buf[ragged(start, end - start)]
    return out[:-1].tobytes()
