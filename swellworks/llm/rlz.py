"""Substring dedup by relative Lempel-Ziv parsing against the whole corpus.

The index answers, for every window of ``window`` words, the smallest doc_id (and first place) that has it; hash
partitions of it are met through joins.  The texts that it points to are cut into reference blocks of BLOCK words.  Documents
are dealt out to units of work, and each unit gets the blocks that its documents' lookups point to, each block once.  There a
document is factored greedily: the next window with a source is looked up, its words are compared with the reference and
the factor goes on, word by word and block by block, as long as both agree.  Where it ends, the first window that straddles the
boundary has the next lookup.  Factors of at least ``window`` words are duplicate spans; a lookup whose words differ
from the reference (equal hashes of unequal words) gives none.

To index little, a window is first filed under its anchor, the least hash among its runs of ``gram`` words: equal windows
have equal anchors.  Anchors of one document only go; consecutive windows with one anchor travel as one segment, and only
segments that no smaller document has whole are looked up window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from swellworks.llm.runtime import Workspace, map_slices, ragged, settle, ship, slices, utf8
from swellworks.llm.words import Words, _powers, joined, mix, sliding_min

WINDOW, GRAM = 13, 7
BLOCK = 64  # words of a reference block
UNIT_BYTES = 1 << 20  # of text in a unit of work
_U = np.uint64
_PLACE = 26  # bits of a word's number within a piece of work


class Anchors:
    """Runs of consecutive windows with one anchor: ``hash``, document ``doc``, first window ``start`` (word in its document), ``count``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        self.words = w = Words(buf, offs)
        self.word_hash = w.hashes()
        g, bounds = w.windows(self.word_hash, gram)
        span = window - gram + 1
        windows = np.maximum(w.counts - window + 1, 0)
        at = ragged(bounds[:-1], windows)
        packed = (g >> _U(_PLACE) << _U(_PLACE)) | (np.arange(len(g)).astype(_U) & _U((1 << _PLACE) - 1))
        place = (sliding_min(packed, span)[at] & _U((1 << _PLACE) - 1)).astype(np.int64) if len(at) else np.empty(0, np.int64)
        new = np.ones(len(at), bool)
        new[1:] = place[1:] != place[:-1]
        rows = np.concatenate([[0], np.cumsum(windows)])
        new[rows[:-1][windows > 0]] = True
        head = np.flatnonzero(new)
        self.doc = np.searchsorted(rows, head, "right") - 1
        self.start = head - rows[self.doc]
        self.count = np.diff(np.append(head, len(at)))
        self.hash = g[place[head]]
        self.lead = place[head] - bounds[self.doc] - self.start
        self.window = window

    def take(self, keep: np.ndarray) -> None:
        self.doc, self.start, self.count, self.hash, self.lead = (x[keep] for x in (self.doc, self.start, self.count, self.hash, self.lead))

    def segments(self) -> np.ndarray:
        """A hash of each run's words, and of where its anchor stands."""
        n = len(self.word_hash)
        up, down = _powers(1 << max(20, n.bit_length()))
        sums = np.zeros(n + 1, _U)
        np.cumsum(self.word_hash * up[:n], out=sums[1:])
        a = self.words.first[self.doc] + self.start
        b = a + self.count + self.window - 1
        return mix(mix((sums[b] - sums[a]) * down[a]) + self.count.astype(_U) * _U(0x9E3779B97F4A7C15) + self.lead.astype(_U))

    def window_hashes(self) -> np.ndarray:
        """Hashes of the runs' windows, one run after the other."""
        h, bounds = self.words.windows(self.word_hash, self.window)
        return h[ragged(bounds[self.doc] + self.start, self.count)]


@dataclass(frozen=True)
class Places:
    """A place (doc_id, word) as one number in that order: Spark hash-aggregates minima of numbers but sorts for structs.

    The number is a long where ids and words of the table fit into 62 bits, else a decimal; both order alike.
    """

    least: int  # doc_id
    bits: int  # of a word's number
    wide: bool

    @classmethod
    def of(cls, docs: DataFrame) -> tuple[Places, int]:
        """The places of a table, and its bytes of text."""
        low, high, most, total = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text")), F.sum(F.octet_length("text"))).first()
        bits = max(1, (most or 0).bit_length())
        return cls(low or 0, bits, (high or 0) - (low or 0) >= 1 << 62 - bits), total or 0

    def pack(self) -> Column:
        if self.wide:
            return (F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(12,0)") + F.col("pos")).cast("decimal(38,0)")
        return F.shiftleft(F.col("doc_id") - F.lit(self.least), self.bits) + F.col("pos")

    def unpack(self, name: str) -> list[Column]:
        """src_doc and src_pos of a place."""
        if self.wide:
            pos = f"CAST(pmod({name}, CAST(4294967296 AS DECIMAL(12,0))) AS BIGINT)"
            return [F.expr(f"({name} - {pos}) div 4294967296").alias("src_doc"), F.expr(f"CAST({pos} AS INT)").alias("src_pos")]
        pos = F.col(name).bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int").alias("src_pos")
        return [(F.shiftright(name, self.bits) + F.lit(self.least)).alias("src_doc"), pos]


def _ids(column: pa.Array, doc: np.ndarray) -> pa.Array:
    return column.take(pa.array(doc))


def sources(docs: DataFrame, ws: Workspace, places: Places, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, t, pos, n, src_doc, src_pos): every run of windows that a smaller document has, and its first place there.

    ``t`` tells texts of one doc_id apart.  Rows without a doc_id are no source and have none.
    """
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")

    def anchor_rows(piece: pa.RecordBatch) -> pa.RecordBatch:
        a = Anchors(*utf8(piece.column(1)), window, gram)
        return pa.record_batch([_ids(piece.column(0), a.doc), pa.array(a.hash.view(np.int64))], ["doc_id", "h"])

    anchors = ws.table(map_slices(texts, "text", anchor_rows, "doc_id long, h long"), "anchors")
    shared = ws.table(anchors.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h"), "shared")
    wanted = ws.table(anchors.join(shared.hint("shuffle_hash"), "h").groupBy("doc_id").agg(F.collect_set("h").alias("shared")), "wanted")
    ws.drop("anchors", "shared")
    ws.reclaim()

    def segment_rows(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        a = Anchors(*utf8(piece.column(1)), window, gram)
        known = piece.column(2)
        values = known.flatten().to_numpy(zero_copy_only=False).view(_U)
        a.take(np.isin(a.hash, values))
        if not len(a.hash):
            return None
        windows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(a.count)]).astype(np.int32)), pa.array(a.window_hashes().view(np.int64)))
        return pa.record_batch(
            [_ids(piece.column(0), a.doc), _ids(piece.column(3), a.doc), pa.array(a.hash.view(np.int64)), pa.array(a.segments().view(np.int64)), pa.array(a.start.astype(np.int32)), windows],
            ["doc_id", "t", "h", "seg", "pos", "windows"],
        )

    found = texts.join(wanted, "doc_id").select("doc_id", "text", "shared", F.xxhash64("text").alias("t"))
    segments = ws.table(map_slices(found, "text", segment_rows, "doc_id long, t long, h long, seg long, pos int, windows array<long>"), "segments")
    ws.drop("wanted")
    ws.reclaim()
    first = F.min(places.pack()).alias("src")
    classes = ws.table(segments.groupBy("h", "seg").agg(first), "classes")
    several = classes.groupBy("h").agg((F.count(F.lit(1)) > 1).alias("several"))
    known = ws.table(classes.join(several, "h"), "known")
    met = ws.table(segments.join(known.hint("shuffle_hash"), ["h", "seg"]).select("doc_id", "t", "h", "pos", F.col("windows"), "several", *places.unpack("src")).where("doc_id > src_doc OR several"), "met")
    ws.drop("segments", "classes", "known")
    ws.reclaim()
    whole = met.where("doc_id > src_doc").select("doc_id", "t", "pos", F.size("windows").alias("n"), "src_doc", "src_pos")
    # a segment that no smaller document has whole may still share windows with other segments of its anchor
    single = met.where("doc_id = src_doc").select("doc_id", "t", "h", "pos", F.posexplode("windows").alias("i", "w")).select("doc_id", "t", "h", "w", (F.col("pos") + F.col("i")).alias("pos"))
    by_window = ws.table(single.groupBy("h", "w").agg(first, F.max("doc_id").alias("hi")).select("h", "w", "hi", *places.unpack("src")).where("src_doc < hi").drop("hi"), "by_window")
    parts = single.join(by_window.hint("shuffle_hash"), ["h", "w"]).where("doc_id > src_doc").select("doc_id", "t", "pos", F.lit(1).alias("n"), "src_doc", "src_pos")
    return whole.unionByName(parts)


def chains(pos: np.ndarray, n: np.ndarray, src_doc: np.ndarray, src_pos: np.ndarray) -> np.ndarray:
    """Where a new chain of runs starts: runs in order of pos whose source doesn't go on from the run before."""
    go_on = (pos[1:] == pos[:-1] + n[:-1]) & (src_doc[1:] == src_doc[:-1]) & (src_pos[1:] == src_pos[:-1] + n[:-1])
    return np.flatnonzero(np.concatenate([[True], ~go_on]))


Blocks = dict[tuple[int, int], dict[int, list[bytes]]]  # (doc_id, number) to the block's words in each text of that doc_id


def extension(words: list[bytes], at: int, blocks: Blocks, doc: int, pos: int) -> int:
    """How many words from ``at`` on equal those of document ``doc`` from its word ``pos`` on, as far as its blocks are here."""
    best = 0
    for t in blocks.get((doc, pos // BLOCK), ()):
        n = 0
        while ref := blocks.get((doc, (pos + n) // BLOCK), {}).get(t, [])[(pos + n) % BLOCK :]:
            own = words[at + n : at + n + len(ref)]
            if own != ref:
                n += next((i for i, (x, y) in enumerate(zip(own, ref)) if x != y), len(own))
                break
            n += len(ref)
        best = max(best, n)
    return best


def factors(words: list[bytes], runs: np.ndarray, blocks: Blocks, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start word, words, source document, source word) of a document.

    ``runs`` has rows of pos, n, src_doc, src_pos in order of pos: the index's answers for the n windows from word pos on.
    """
    out, q = [], 0
    for pos, n, doc, src in runs.tolist():
        q = max(q, pos)
        while q < pos + n:
            size = extension(words, q, blocks, doc, src + q - pos)
            if size >= window:
                out.append((q, size, doc, src + q - pos))
                q += size - window  # windows inside the factor are done
            q += 1
    return out


LISTS = "pos array<int>, n array<int>, src_doc array<long>, src_pos array<int>"


def _asked(runs: DataFrame, window: int) -> DataFrame:
    """(b, src_doc, k): the reference blocks that the runs of unit b point to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.columns[3:]
            bounds = lists[0].offsets.to_numpy()
            pos, n, doc, src = (c.values.to_numpy().astype(np.int64) for c in lists)
            head = np.union1d(chains(pos, n, doc, src), bounds[:-1])
            first, last = src[head] // BLOCK, (src[head] + np.add.reduceat(n, head) + window - 2) // BLOCK
            owner = np.searchsorted(bounds, head, "right") - 1
            many = last - first + 1
            yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(owner, many))), pa.array(np.repeat(doc[head], many)), pa.array(ragged(first, many))], ["b", "src_doc", "k"])

    return runs.mapInArrow(work, "b long, src_doc long, k long").distinct()


def _blocks(texts: DataFrame, want: DataFrame) -> DataFrame:
    """(src_doc, t, k, block): the words of the wanted blocks, joined by a space.  ``want`` has doc_id and the list k."""

    def cut(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        buf, offs = utf8(piece.column(2))
        w, out = Words(buf, offs), []
        for d, (doc, t, ks) in enumerate(zip(*(piece.column(i).to_pylist() for i in (0, 1, 3)))):
            a, b = int(w.first[d]), int(w.first[d + 1])
            for k in ks:
                x, y = a + k * BLOCK, min(a + (k + 1) * BLOCK, b)
                if x < y:
                    out.append((doc, t, k, joined(buf, w.start[x:y], w.end[x:y]).decode("utf-8")))
        return pa.record_batch([pa.array(c) for c in zip(*out)], ["src_doc", "t", "k", "block"]) if out else None

    held = texts.join(want, "doc_id").select("doc_id", "t", "text", "k").dropDuplicates(["doc_id", "t"])
    return map_slices(held, "text", cut, "src_doc long, t long, k long, block string")


def _factored(docs: DataFrame, window: int, work: Callable, schema: str) -> DataFrame:
    """``work(piece, runs, blocks)`` over all documents: piece has doc_id, t, text; runs are by (doc_id, t).

    Rows travel in units of about UNIT_BYTES of text: reference blocks first, the index's answers next, texts last.
    """
    ws = Workspace(docs.sparkSession, "rlz")
    places, size = Places.of(docs)
    found = ws.table(sources(docs, ws, places, window), "sources")
    ws.drop("met", "by_window")
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    units = max(-(-size // UNIT_BYTES), 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    unit = F.pmod(F.xxhash64("doc_id", "t"), F.lit(units)).cast("long").alias("b")
    grouped = found.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("pos", "n", "src_doc", "src_pos"))).alias("r"))
    runs = ws.table(grouped.select(unit, "doc_id", "t", "r.pos", "r.n", "r.src_doc", "r.src_pos"), "runs")
    ws.drop("sources")
    ws.reclaim()
    asks = ws.table(_asked(runs, window), "asks")
    want = asks.select("src_doc", "k").distinct().groupBy(F.col("src_doc").alias("doc_id")).agg(F.sort_array(F.collect_list("k")).alias("k"))
    blocks = asks.join(_blocks(texts, want), ["src_doc", "k"])
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in LISTS.split(", ")]
    rows = (
        blocks.select("b", F.lit(0).alias("kind"), F.col("src_doc").alias("doc_id"), "t", "k", F.col("block").alias("text"), *none)
        .unionByName(runs.select("b", F.lit(1).alias("kind"), "doc_id", "t", F.lit(0).cast("long").alias("k"), F.lit("").alias("text"), "pos", "n", "src_doc", "src_pos"))
        .unionByName(texts.select(unit, F.lit(2).alias("kind"), "doc_id", "t", F.lit(0).cast("long").alias("k"), "text", *none))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, runs = None, {}, {}
        for batch in batches:
            b, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                part = batch.slice(x, y - x)
                if now != b[x]:
                    now, blocks, runs = b[x], {}, {}
                ids = zip(part.column(2).to_pylist(), part.column(3).to_pylist())
                if kind[x] == 0:
                    for (doc, t), k, text in zip(ids, part.column(4).to_pylist(), part.column(5).cast(pa.binary()).to_pylist()):
                        blocks.setdefault((doc, k), {})[t] = text.split(b" ")
                elif kind[x] == 1:
                    runs.update((i, np.array(r, np.int64).T) for i, *r in zip(ids, *(c.to_pylist() for c in part.columns[6:])))
                else:
                    for piece in slices(part.select(["doc_id", "t", "text"]), "text"):
                        out = work(piece, runs, blocks)
                        if out is not None:
                            yield out
            settle()

    dealt = rows.repartition("b").sortWithinPartitions("b", "kind")
    return dealt.mapInArrow(run, schema)


def _parsed(piece: pa.RecordBatch, runs: dict, blocks: Blocks, window: int) -> tuple[np.ndarray, Words, list[list[tuple[int, int, int, int]]]]:
    """(bytes, words, factors of each document) of a piece."""
    buf, offs = utf8(piece.column(2))
    w, out = Words(buf, offs), []
    for d, i in enumerate(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist())):
        a, b, mine = int(w.first[d]), int(w.first[d + 1]), runs.get(i)
        out.append(factors(joined(buf, w.start[a:b], w.end[a:b]).split(b" "), mine, blocks, window) if mine is not None else [])
    return buf, w, out


def parse(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start_word, n_words, src_doc, src_word): the duplicate factors of all documents.

    Null and empty texts, rows without a doc_id and empty tables have none; repeated rows have theirs each.
    """

    def work(piece: pa.RecordBatch, runs: dict, blocks: Blocks) -> pa.RecordBatch | None:
        found = [(d, *f) for d, fs in enumerate(_parsed(piece, runs, blocks, window)[2]) for f in fs]
        if not found:
            return None
        owner, *columns = zip(*found)
        return pa.record_batch([piece.column(0).take(pa.array(owner)), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "start_word", "n_words", "src_doc", "src_word"])

    return _factored(docs, window, work, "doc_id long, start_word long, n_words long, src_doc long, src_word long")


def removed(docs: DataFrame, window: int = WINDOW, text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]): each document without the words of its factors.

    Kept words are joined by one space.  Null text counts as empty; rows that share a doc_id are no source for each
    other; a row without a doc_id is kept whole; repeated rows stay rows; an empty table gives an empty result; a text
    of any length is one document; other columns are ignored.
    """

    def work(piece: pa.RecordBatch, runs: dict, blocks: Blocks) -> pa.RecordBatch:
        buf, w, found = _parsed(piece, runs, blocks, window)
        total, gone, digest, kept = [], [], [], []
        for d, own in enumerate(found):
            a, b = int(w.first[d]), int(w.first[d + 1])
            stays = np.ones(b - a, bool)
            for start, size, _, _ in own:
                stays[start : start + size] = False
            keep = a + np.flatnonzero(stays)
            rest = joined(buf, w.start[keep], w.end[keep])
            total.append(b - a)
            gone.append(b - a - len(keep))
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8") if text else None)
        return pa.record_batch([piece.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())] + [pa.array(kept, pa.string())] * text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * text)

    return _factored(docs, window, work, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text)
