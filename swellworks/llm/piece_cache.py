"""A numpy hash table from text pieces to token ids, so that known pieces cost no Python object.

A piece of up to LANES bytes is known by its length and two numbers that hold all its bytes, a longer one by its bytes in a
dict: equality is exact.  Both are bounded: when one is full all begins anew, which costs time but changes no result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from swellworks.llm.runtime import ragged
from swellworks.llm.words import LANES, lanes, mix

LONG_BYTES, MOST_IDS = 8 << 20, 1 << 23  # of long pieces held, and ids of all pieces


class PieceCache:
    """``encode(pieces: list[bytes]) -> (ids, count of each piece)`` fills in what is missing."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], bits: int = 20):
        self.encode, self.bits = encode, bits
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.first, self.last, self.slot = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.full(n, -1, np.int32)
        self.size = np.zeros(n, np.uint8)
        self.at, self.n, self.pieces = np.zeros(n, np.int64), np.zeros(n, np.int32), 0
        self.flat, self.used = np.empty(n, np.int32), 0
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    def _find(self, h: np.ndarray, first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Slots of pieces, -1 for unknown ones."""
        mask = np.uint64((1 << self.bits) - 1)
        out = np.full(len(h), -1, np.int32)
        todo, at = np.arange(len(h)), (h & mask).astype(np.int64)
        while len(todo):
            slot = self.slot[at]
            same = (self.first[at] == first[todo]) & (self.last[at] == last[todo]) & (self.size[at] == size[todo]) & (slot >= 0)
            out[todo[same]] = slot[same]
            go = (slot >= 0) & ~same
            todo, at = todo[go], (at[go] + 1) & int(mask)
        return out

    def _place(self, h: np.ndarray, first: np.ndarray, last: np.ndarray, size: np.ndarray, slots: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        todo, at = np.arange(len(h)), (h & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = self.slot[at] < 0
            _, one = np.unique(at[free], return_index=True)  # one piece a place
            won = np.flatnonzero(free)[one]
            w, p = todo[won], at[won]
            self.slot[p], self.first[p], self.last[p], self.size[p] = slots[w], first[w], last[w], size[w]
            keep = np.ones(len(todo), bool)
            keep[won] = False
            todo, at = todo[keep], (at[keep] + 1) & mask

    def _encoded(self, pieces: list[bytes]) -> np.ndarray:
        """Encode new pieces and give them slots."""
        ids, n = self.encode(pieces)
        k, self.pieces = self.pieces, self.pieces + len(n)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[k : self.pieces], self.n[k : self.pieces] = self.used + np.cumsum(n) - n, n
        self.used += len(ids)
        return np.arange(k, self.pieces, dtype=np.int32)

    def ids(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, ids of each piece) for the pieces buf[start:end]."""
        if not len(start):
            return np.empty(0, np.int32), np.zeros(0, np.int64)
        if self.used > MOST_IDS or self.long_bytes > LONG_BYTES or self.pieces + len(start) > 6 << self.bits - 3:
            self.clear()
            while len(start) > 4 << self.bits - 3:  # a batch of its own needs a larger table
                self.bits += 1
                self.clear()
        slots = np.empty(len(start), np.int32)
        size = end - start
        short, long = np.flatnonzero(size <= LANES), np.flatnonzero(size > LANES)
        data = None
        if len(long):
            data = buf.tobytes()
            pieces = [data[a:b] for a, b in zip(start[long].tolist(), end[long].tolist())]
            new = [p for p in dict.fromkeys(pieces) if p not in self.long]
            if new:
                self.long.update(zip(new, self._encoded(new).tolist()))
                self.long_bytes += sum(map(len, new))
            slots[long] = [self.long[p] for p in pieces]
        if len(short):
            a, b, size = start[short], end[short], size[short].astype(np.uint8)
            first, last = lanes(buf, a, b)
            h = mix(first ^ mix(last + size))
            found = self._find(h, first, last, size)
            while len(gaps := np.flatnonzero(found < 0)):
                _, one = np.unique(h[gaps], return_index=True)  # of equal hashes one a round
                new = gaps[one]
                data = data or buf.tobytes()
                self._place(h[new], first[new], last[new], size[new], self._encoded([data[x:y] for x, y in zip(a[new].tolist(), b[new].tolist())]))
                found[gaps] = self._find(h[gaps], first[gaps], last[gaps], size[gaps])
            slots[short] = found
        n = self.n[slots].astype(np.int64)
        return self.flat[ragged(self.at[slots], n)], n
