"""Byte-level BPE by ranks: pre-tokenisation as a transition-function scan, cached pair merging, decoding by offsets.

The split rule is that of the rank files' pattern::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

No regex runs.  Every codepoint has a symbol (its class and what follows it), every symbol is a function on the
eight states of a left-to-right automaton, and functions compose associatively, so the state before every
codepoint comes from a doubling scan over a whole batch.  All but letters and contraction apostrophes map every
state that can stand before them to a constant, so the scan ends after a few doublings.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from swellworks.llm.piece_cache import PieceCache
from swellworks.llm.runtime import map_slices, ragged, utf8

OTHER, LETTER, NUMBER, SPACE = range(4)
#: White_Space of Unicode, fixed values.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions of the pattern, fixed values: one letter, and two letters.
ONE, TWO = "stmd", ("re", "ve", "ll")

# Automaton: what the token before a codepoint is.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, LONE_SPACE, TAKE_ONE, TAKE_TWO, EDGE = range(8)
# Symbols: what a codepoint is.
(S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_JOIN, S_LAST, S_SPACE, S_FIRST) = range(9)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a token starts at this codepoint)."""
    if symbol == S_LETTER:
        if state in (TAKE_ONE, TAKE_TWO):
            return (EDGE if state == TAKE_ONE else TAKE_ONE), False
        return IN_LETTERS, state not in (IN_LETTERS, LONE_SPACE)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, LONE_SPACE)
    if symbol in (S_OTHER, S_SHORT, S_LONG):
        if state in (IN_OTHERS, LONE_SPACE):
            return IN_OTHERS, False
        return {S_OTHER: IN_OTHERS, S_SHORT: TAKE_ONE, S_LONG: TAKE_TWO}[symbol], True
    if symbol == S_JOIN:  # 0x20 right before something else than white space: joins it
        return LONE_SPACE, True
    if symbol == S_LAST:  # any other white space there: a token of its own
        return EDGE, True
    if symbol == S_SPACE:
        return IN_SPACES, state != IN_SPACES
    raise AssertionError(symbol)


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, composition table, whether a function is constant and its value or 255, token starts)."""
    identity = tuple(range(8))
    base = [tuple(_step(s, y)[0] for s in range(8)) for y in range(8)]
    base.append((EDGE,) * 8)  # S_FIRST: the edge before a document
    known = {f: i for i, f in enumerate(dict.fromkeys([identity, *base]))}
    grew = True
    while grew:
        grew = False
        for f in list(known):
            for g in list(known):
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h], grew = len(known), True
    fs = list(known)
    compose = np.array([[known[tuple(g[x] for x in f)] for g in fs] for f in fs], np.uint8)
    constant = np.array([f[0] if len(set(f)) == 1 else 255 for f in fs], np.uint8)
    starts = np.array([[_step(s, y)[1] for y in range(8)] for s in range(8)])
    return np.array([known[f] for f in base], np.uint8), compose, constant, starts


@functools.cache
def classes() -> np.ndarray:
    """The class of every codepoint, from general categories and White_Space."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE] = SPACE
    return table


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where tokens start: codepoints of a batch of texts, ``first`` the index at which each text starts (ascending)."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = classes()[points]
    begin = np.zeros(n + 1, bool)
    begin[first] = True
    begin[n] = True
    letter = np.where(begin[1:], 0, np.append(points[1:], 0))  # the next codepoint of the same text, else 0
    letter2 = np.where(begin[1:], 0, np.append(letter[1:], 0))
    symbol = np.array([S_OTHER, S_LETTER, S_NUMBER, S_SPACE], np.uint8)[kind]
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        a, b = letter[quote], letter2[quote]
        symbol[quote[np.isin(a, [ord(c) for c in ONE])]] = S_SHORT
        for x, y in TWO:
            symbol[quote[(a == ord(x)) & (b == ord(y))]] = S_LONG
    follow = np.append(kind[1:], SPACE)
    last = (kind == SPACE) & (follow != SPACE) & ~begin[1:]
    symbol[last] = np.where(points[last] == 0x20, S_JOIN, S_LAST)
    of, compose, constant, starts = _monoid()
    # State before codepoint i: the composition of the functions of i-1, i-2, .. back to a constant one.
    f = np.empty(n, np.uint8)
    f[0] = of[S_FIRST]
    f[1:] = of[symbol[:-1]]
    f[begin[:n]] = of[S_FIRST]
    open_, span = np.flatnonzero(constant[f] == 255), 1
    while len(open_):
        f[open_] = compose[f[open_ - span], f[open_]]  # earlier first: the left side is read before any write
        open_, span = open_[constant[f[open_]] == 255], span * 2
    return np.flatnonzero(starts[constant[f], symbol] | begin[:n])


class Ranks:
    """A rank file's vocabulary with cached pair merging."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.pairs: dict[tuple[int, int], int] = {}
        ranks = self.ranks
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank
        self.single = [ranks[bytes([b])] for b in range(256)]
        top = max(ranks.values()) + 1
        tokens = [b""] * top
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache = PieceCache(self._merged)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the lowest-ranked neighbouring pair merges first, the leftmost of equals."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.single[b] for b in piece]
        if len(ids) > 48:
            return self._merge_long(ids)
        get, never = self.pairs.get, 1 << 60
        scores = [get(p, never) for p in zip(ids, ids[1:])]
        while scores:
            best = min(scores)
            if best == never:
                break
            i = scores.index(best)
            ids[i : i + 2] = [best]
            del scores[i]
            if i:
                scores[i - 1] = get((ids[i - 1], best), never)
            if i + 1 < len(ids):
                scores[i] = get((best, ids[i + 1]), never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list: n log n for pieces of any length."""
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (x := get((r, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[j]]))
            if before[i] >= 0 and (x := get((ids[before[i]], r))) is not None:
                heapq.heappush(heap, (x, before[i], ids[before[i]], r))
        return [x for x in ids if x >= 0]

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.merge(p) for p in pieces]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for i in ids for x in i), np.int32, int(n.sum())), n

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each text and the end, byte offset of each id in buf) of a batch of UTF-8 texts."""
        data = buf.tobytes()
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
        text_at = np.searchsorted(lead, offs)
        nonempty = np.flatnonzero(np.diff(offs))
        starts = lead[boundaries(points, text_at[nonempty])] if len(points) else np.empty(0, np.int64)
        ids, n = self.cache.ids(buf, starts, np.append(starts[1:], len(buf)) if len(starts) else starts)
        bounds = np.concatenate([[0], np.cumsum(n)])
        first = bounds[np.searchsorted(starts, offs)]
        size = self.sizes[ids]
        at = np.cumsum(size) - size
        return ids, first, at

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other."""
        return self.bytes[ragged(self.first[ids], self.sizes[ids])]


_LOADED: dict[str, Ranks] = {}


def load(data: bytes) -> Ranks:
    """The vocabulary of a rank file, kept between the tasks of a Python worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Ranks(data)
    return _LOADED[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, offsets array<int>): every text's token ids and the byte at which each token starts.

    Null and empty texts give empty arrays; repeated rows stay rows; an empty table gives an empty result.  The vocabulary file (bounded, read on the
    driver) travels as a broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = utf8(piece.column(1))
        ids, first, at = load(shared.value).encode(buf, offs)
        rel = at - np.repeat(offs[:-1], np.diff(first))
        lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, rel)]
        return pa.record_batch([piece.column(0), *lists], [id_col, "ids", "offsets"])

    rows = docs.select(id_col, text_col)
    return map_slices(rows, text_col, work, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, ids array<int>, offsets array<int>")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every whole text, decode its ids, digest both.

    Null and empty texts have no tokens; repeated rows stay rows, a null doc_id too; an empty table gives an empty
    result; other columns are ignored.
    """
    return _encoded(docs, vocabulary, False)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids array<int>): the ids as well; odd rows as in digests."""
    return _encoded(docs, vocabulary, True)


def _encoded(docs: DataFrame, vocabulary: str, with_ids: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = utf8(piece.column(1))
        ranks = load(shared.value)
        ids, first, _ = ranks.encode(buf, offs)
        raw, text = ids.astype("<u4"), ranks.decode(ids)
        byte = np.concatenate([[0], np.cumsum(ranks.sizes[ids])])[first]
        sha = lambda x, at: [hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
        lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))] if with_ids else []
        return pa.record_batch([piece.column(0), pa.array(np.diff(first)), pa.array(sha(raw, first), pa.string()), pa.array(sha(text, byte), pa.string()), *lists], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return map_slices(docs.select("doc_id", "text"), "text", work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
