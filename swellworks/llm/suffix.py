"""Exact repeats of long byte strings by common-prefix intervals of an enhanced suffix array.

A window of ``length`` bytes is filed under its anchor: the least hash among its runs of ``gram`` bytes, the leftmost of
equals.  Equal windows have equal anchors at equal distance, so repeats meet where suffixes that start at one anchor meet: the
suffix array is sparse (anchors only) and falls into one part for each anchor value.

* Anchors that stand once in the corpus go.  Consecutive windows with one anchor form a segment.  A segment that stands twice
  repeats as a whole; counts settle that, copies need no suffix.
* What is left is sorted by the text behind its anchor.  The stack scan of the common-prefix array gives every interval
  (occurrences that share r bytes and no more).  Within an interval the occurrences are ordered by the text before the anchor, read
  backwards: where neighbours share l bytes with l + gram + r >= length they form a repeat, left-diverse at l, and each
  occurrence takes the longest left extension it has with any other.
* What stands twice within one piece of work (about 1 MB of text) is known to repeat there: all its rows are settled on the
  spot and one of them, the first, stands for the piece in counts and joins.  So no key has more rows in an exchange than there
  are pieces, however common a passage is.
* An anchor with more different segments than ``group`` never becomes one task's work.  Its segments are cut into blocks of window
  positions; a block whose common core stands once is settled (no repeat), one that stands twice as a whole as well, and the
  windows of the others are counted one by one.  All of this is partial counts and joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from swellworks.llm.runtime import Workspace, column, extended, map_slices, ragged, spare, utf8
from swellworks.llm.words import _powers, mix, sliding_min

LENGTH, GRAM = 400, 200
GROUP, STEP = 256, 25
PIECE = 4 << 20  # bytes of a long text hashed at once
_U = np.uint64
_PLACE = _U(24)
_MARK = 16  # bytes of the anchor's digest in front of the text behind it: equal anchor hashes need not be equal anchors
# What a piece knows of a row: it is the first of its kind there, or one of several.
FIRST, TWICE, LEAD, SEVERAL = 1, 2, 4, 8
NO_ID = -(1 << 63)  # stands for a null doc_id


def anchor_runs(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, anchor place, first window, windows, segment hash) of every run of windows with one anchor.

    Places count bytes of the document.  Long texts go in pieces that overlap by length - 1 bytes.  A segment's hash
    is XXH3 of its text and of where its anchor stands.
    """
    if len(buf) > PIECE + length and len(offs) == 2:
        parts = [_runs(buf[a : a + PIECE + length - 1], np.array([0, min(PIECE + length - 1, len(buf) - a)]), length, gram, a) for a in range(0, len(buf) - length + 1, PIECE)]
        return tuple(np.concatenate(c) for c in zip(*parts))
    return _runs(buf, offs, length, gram, 0)


def _runs(buf: np.ndarray, offs: np.ndarray, length: int, gram: int, base: int) -> tuple[np.ndarray, ...]:
    windows = np.maximum(np.diff(offs) - length + 1, 0)
    at = ragged(offs[:-1], windows)
    if not len(at):
        return (np.empty(0, np.int64), np.empty(0, _U), *[np.empty(0, np.int64)] * 3, np.empty(0, _U))
    n = len(buf)
    up, down = _powers(1 << max(20, n.bit_length()))
    sums = np.zeros(n + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * up[:n], out=sums[1:])
    g = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    packed = (g >> _PLACE << _PLACE) | np.arange(len(g)).astype(_U)
    place = (sliding_min(packed, length - gram + 1)[at] & ((_U(1) << _PLACE) - _U(1))).astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(windows)])
    new = np.ones(len(at), bool)
    new[1:] = place[1:] != place[:-1]
    new[rows[:-1][windows > 0]] = True
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    doc = np.searchsorted(rows, head, "right") - 1
    first, where = at[head], place[head]
    text, of = memoryview(np.ascontiguousarray(buf)), xxhash.xxh3_64_intdigest
    ends = first + count + length - 1
    seg = np.fromiter((of(text[a:b], s) for a, b, s in zip(first.tolist(), ends.tolist(), (where - first).tolist())), _U, len(first))
    return doc, g[where], where - offs[doc] + base, first - offs[doc] + base, count, seg


def marks(keys: list[np.ndarray], place: list[np.ndarray], later: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(whether a row is the first by place with its keys, whether it is one of several or, if ``later``, has a later place)."""
    order = np.lexsort([*place[::-1], *keys[::-1]])
    same = lambda columns: np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    new = np.ones(len(order), bool)
    new[1:] = ~same(keys)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(order)))
    first, twice = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order[head]] = True
    if later:
        moved = np.ones(len(order), bool)
        moved[1:] = ~same([*keys, *place])
        step = np.cumsum(moved)
        twice[order] = step > np.repeat(step[head], size)
    else:
        twice[order] = np.repeat(size > 1, size)
    return first, twice


def _common(rows: list[bytes], order: list[int]) -> list[int]:
    """Common prefix lengths of neighbours in order; a text's end differs from anything."""
    out = []
    for a, b in zip(order, order[1:]):
        x, y = rows[a], rows[b]
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            out.append(n)
            continue
        d = np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)
        out.append(int(d.argmax()))
    return out


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of every common-prefix interval of a sorted list whose neighbours share ``lcp`` bytes."""
    stack = [(-1, 0)]
    for i, v in enumerate([*lcp, -1]):
        left = i
        while stack[-1][0] > v:
            value, left = stack.pop()
            yield value, left, i
        if stack[-1][0] < v:
            stack.append((v, left))


def repeats(before: list[bytes], behind: list[bytes], need: int, later: bool = False) -> Iterator[tuple[int, int, int]]:
    """(occurrence, l, r) for occurrences of one anchor: l bytes before and r behind it, l + r >= need, stand elsewhere too.

    ``before`` is read backwards from the anchor.  For each interval every occurrence has its longest l, with any other
    or, if ``later``, with any earlier one: along the order by left text the nearest on either side shares most.
    """
    order = sorted(range(len(behind)), key=behind.__getitem__)
    by_left = sorted(range(len(before)), key=before.__getitem__)
    rank = [0] * len(before)
    for i, x in enumerate(by_left):
        rank[x] = i
    for r, a, b in intervals(_common(behind, order)):
        members = sorted(order[a : b + 1], key=rank.__getitem__)
        shared = _common(before, members)
        for k, x in enumerate(members):
            best = -1
            for step in (-1, 1):
                i, common = k + step, 1 << 30
                while 0 <= i < len(members) and (common := min(common, shared[min(i, i - step)])) + r >= need:
                    if not later or members[i] < x:
                        best = max(best, common)
                        break
                    i += step
            if best >= 0:
                yield x, best, r


def _group_spans(rows: DataFrame, length: int, gram: int, later: bool) -> DataFrame:
    """(d, t, start, size) from segments of anchors with few different segments: sorted by anchor and place, one anchor at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, out = [], None, []

        def settle() -> None:
            if len(held) > 1:
                for x, left, right in repeats([r[4] for r in held], [r[5] for r in held], length - gram + _MARK, later):
                    out.append((held[x][1], held[x][2], held[x][3] - left, left + gram + right - _MARK))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now:
                    settle()
                    held, now = [], row[0]
                held.append(row)
            if len(out) > 4096:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["d", "t", "start", "size"])
                out = []
        settle()
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["d", "t", "start", "size"])

    dealt = rows.select("h", "d", "t", "p", "before", "behind").repartition("h").sortWithinPartitions("h", "d", "t", "p")
    return dealt.mapInArrow(run, "d long, t long, start long, size long")


def _hash(*parts: bytes) -> int:
    v = xxhash.xxh3_64_intdigest(b"".join(parts), len(parts[0]))
    return v - (1 << 64) if v >> 63 else v


def _block_spans(rows: DataFrame, ws: Workspace, length: int, gram: int, later: bool) -> DataFrame:
    """(d, t, start, size) from segments of anchors with many different segments, by counts and first places alone."""
    span, place = length - gram, F.struct("d", "t", "p")
    elsewhere = place > F.col("r") if later else F.lit(True)  # of a row whose key stands twice, r is the key's first place

    def blocks(row: tuple) -> Iterator[tuple[int, int, int]]:
        low, high = span + _MARK - len(row[5]), len(row[4])
        for b in range(low // STEP, high // STEP + 1):
            yield b, max(low, b * STEP), min(high, b * STEP + STEP - 1)

    names = ["h", "d", "t", "p", "b", "low", "high", "core", "whole", "kind"]

    def cut(piece: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in zip(*(c.to_pylist() for c in piece.columns)):
            before, behind = row[4], row[5]
            for b, low, high in blocks(row):
                core = _hash(before[: b * STEP], behind[: _MARK + max(0, span - b * STEP - STEP + 1)])
                out.append((*row[:4], b, low, high, core, _hash(before[:high], behind[: _MARK + span - low]) ^ (low << 10 | high)))
        cols = [np.array(c, np.int64) for c in zip(*out)]
        (first, twice), (lead, several) = marks([cols[i] for i in (0, 4, 7, 8)], cols[1:4], later), marks([cols[i] for i in (0, 4, 7)], cols[1:4])
        kind = FIRST * first + TWICE * twice + LEAD * lead + SEVERAL * several
        return pa.record_batch([*map(pa.array, cols), pa.array(kind)], names)

    columns = rows.select("h", "d", "t", "p", "before", "behind")
    parts = ws.table(map_slices(columns, "behind", cut, ", ".join(f"{n} long" for n in names), 1 << 18), "blocks")
    core, whole_of = ["h", "b", "core"], ["h", "b", "core", "whole"]
    cores = ws.table(parts.where(f"kind & {LEAD} > 0").groupBy(*core).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "cores")
    met = ws.table(parts.where(f"kind & {SEVERAL} > 0").unionByName(parts.where(f"kind & {SEVERAL} = 0").join(cores, core)), "met_blocks")
    wholes = ws.table(met.where(f"kind & {FIRST} > 0").groupBy(*whole_of).agg((F.count(F.lit(1)) > 1).alias("twice"), F.min(place).alias("r")), "wholes")
    asked = met.where(f"kind & {TWICE} = 0").join(wholes, whole_of).withColumn("twice", F.col("twice") & elsewhere).select(*met.columns, "twice")
    settled = ws.table(met.where(f"kind & {TWICE} > 0").withColumn("twice", F.lit(True)).unionByName(asked), "settled")
    whole = settled.where("twice").select("d", "t", (F.col("p") - F.col("high")).alias("start"), (F.col("high") - F.col("low") + length).alias("size"))
    open_ = settled.where("NOT twice").groupBy("h", "d", "t", "p").agg(F.collect_set("b").alias("open"))
    # windows of settled blocks count as partners too: one segment of each settled block is opened with the rest (the
    # first place's, which isn't settled itself if only later ones go)
    again = settled.where(f"twice AND kind & {FIRST} > 0").groupBy(*whole_of).agg(F.min(F.struct("d", "t", "p")).alias("r")).select("h", "r.*", F.array("b").alias("open"))
    todo = open_.union(again.select(open_.columns)).groupBy("h", "d", "t", "p").agg(F.array_distinct(F.flatten(F.collect_list("open"))).alias("open"))

    def single(piece: pa.RecordBatch) -> pa.RecordBatch:
        """A row a window."""
        places: dict[tuple[int, int, int], list[tuple]] = {}
        gone = (lambda x, at: x > at[0]) if later else (lambda x, at: len(at) > 1)
        for row in zip(*(c.to_pylist() for c in piece.columns)):
            wanted = set(row[6])
            for b, low, high in blocks(row):
                if b in wanted:
                    for o in range(low, high + 1):
                        places.setdefault((row[0], o, _hash(row[4][:o], row[5][: _MARK + span - o])), []).append(row[1:4])
        out = [(h, *x, o, w, TWICE * gone(x, at) + FIRST * (i == 0)) for (h, o, w), at in places.items() for at in [sorted(at)] for i, x in enumerate(at)]
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["h", "d", "t", "p", "o", "w", "kind"])

    ask = columns.join(ws.table(todo, "open"), ["h", "d", "t", "p"]).select("h", "d", "t", "p", "before", "behind", "open")
    windows = ws.table(map_slices(ask, "behind", single, "h long, d long, t long, p long, o long, w long, kind long", 1 << 18), "single")
    twice = ws.table(windows.where(f"kind & {FIRST} > 0").groupBy("h", "o", "w").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("r")).where("c > 1").drop("c"), "twice")
    known = windows.where(f"kind & {TWICE} > 0").unionByName(windows.where(f"kind & {TWICE} = 0").join(twice, ["h", "o", "w"]).where(elsewhere).select(windows.columns))
    return whole.unionByName(known.select("d", "t", (F.col("p") - F.col("o")).alias("start"), F.lit(length).cast("long").alias("size")))


def repeated_spans(docs: DataFrame, ws: Workspace, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, later: bool = False) -> DataFrame:
    """(d, t, start, size): byte spans whose windows of ``length`` bytes all start somewhere else as well, or if ``later``
    somewhere before, in order of d, t and place.

    ``d`` is the doc_id (the least long for null) and ``t`` tells texts of one doc_id apart; rows that share both are one
    place, so none of them is later than another.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("t"), "text")

    def anchor_rows(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        doc, h, p, first, count, seg = anchor_runs(*utf8(piece.column(2)), length, gram)
        if not len(doc):
            return None
        take = pa.array(doc)
        place = [piece.column(i).take(take).to_numpy() for i in (0, 1)] + [p]
        (first_of, twice), (lead, several) = marks([h, seg], place, later), marks([h], place)
        kind = (FIRST * first_of + TWICE * twice + LEAD * lead + SEVERAL * several).astype(np.int8)
        columns = [piece.column(0).take(take), piece.column(1).take(take), pa.array(h.view(np.int64)), pa.array(p), pa.array(first), pa.array(count), pa.array(seg.view(np.int64)), pa.array(kind)]
        return pa.record_batch(columns, ["d", "t", "h", "p", "first", "n", "seg", "kind"])

    runs = ws.table(map_slices(texts, "text", anchor_rows, "d long, t long, h long, p long, first long, n long, seg long, kind byte"), "runs")
    shared = ws.table(runs.where(f"kind & {LEAD} > 0").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "shared")
    alone = runs.where(f"kind & {SEVERAL} = 0").join(shared, "h").select(runs.columns)
    met = ws.table(runs.where(f"kind & {SEVERAL} > 0").unionByName(alone), "met")
    ws.drop("runs", "shared")
    ws.reclaim()
    segments = ws.table(met.where(f"kind & {FIRST} > 0").groupBy("h", "seg").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "t", "p", "first", "n")).alias("r")), "segments")
    copies = ws.table(segments.where("c > 1").select("h", "seg", F.struct("r.d", "r.t", "r.p").alias("r")), "copies")
    elsewhere = F.struct("d", "t", "p") > F.col("r") if later else F.lit(True)
    whole = met.where(f"kind & {TWICE} > 0").unionByName(met.where(f"kind & {TWICE} = 0").join(copies, ["h", "seg"]).where(elsewhere).select(met.columns))
    whole = whole.select("d", "t", F.col("first").alias("start"), (F.col("n") + length - 1).alias("size"))
    groups = ws.table(segments.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "groups")
    wanted = segments.join(groups, "h").select("r.d", "r.t", F.struct("h", "m", "r.p", "r.first", "r.n").alias("s")).groupBy("d", "t").agg(F.collect_list("s").alias("s"))
    wanted = wanted.select("d", "t", "s.h", "s.m", "s.p", "s.first", "s.n")

    def fetch(piece: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = utf8(piece.column(2))
        data, out = buf.tobytes(), []
        for k, (d, t, h, m, p, first, n) in enumerate(zip(*(piece.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6, 7)))):
            o = int(offs[k])
            for hh, mm, pp, ff, nn in zip(h, m, p, first, n):
                out.append((hh, mm, d, t, pp, data[o + ff : o + pp][::-1], xxhash.xxh3_128_digest(data[o + pp : o + pp + gram]) + data[o + pp + gram : o + ff + nn - 1 + length]))
        h, m, d, t, p, before, behind = zip(*out)
        return pa.record_batch([*[pa.array(c, pa.int64()) for c in (h, m, d, t, p)], pa.array(before, pa.binary()), pa.array(behind, pa.binary())], ["h", "m", "d", "t", "p", "before", "behind"])

    holders = texts.join(wanted, ["d", "t"]).select("d", "t", "text", "h", "m", "p", "first", "n").dropDuplicates(["d", "t"])
    rows = ws.table(map_slices(holders, "text", fetch, "h long, m long, d long, t long, p long, before binary, behind binary"), "rows")
    ws.reclaim()
    few = _group_spans(rows.where(F.col("m") <= group), length, gram, later)
    many = rows.where(F.col("m") > group)
    out = whole.unionByName(few)
    if not many.isEmpty():
        out = out.unionByName(_block_spans(many, ws, length, gram, later))
    found = ws.table(out.distinct(), "spans")
    ws.drop("met", "segments", "copies", "groups", "rows", "blocks", "cores", "met_blocks", "wholes", "settled", "open", "single", "twice")
    ws.reclaim()
    return found


def merged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) of the union of spans."""
    order = np.argsort(start, kind="stable")
    a, b = start[order], np.maximum.accumulate((start + size)[order])
    head = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if len(a) else np.empty(0, np.int64)
    return a[head], b[np.append(head[1:], len(a)) - 1] if len(a) else b


def _with_spans(docs: DataFrame, names: list[str], length: int, gram: int, group: int, later: bool) -> tuple[DataFrame, str]:
    """The columns ``names``, the text, and the arrays of starts and sizes of each document's repeated spans (null without
    any), and the name that the text has there."""
    ws = Workspace(docs.sparkSession, "suffix")
    text, d, t, start, size = spare(names, "text", "d", "t", "start", "size")
    spans = repeated_spans(docs.select("doc_id", "text"), ws, length, gram, group, later).groupBy("d", "t").agg(F.collect_list(F.struct("start", "size")).alias("s"))
    spans = spans.select(F.col("d").alias(d), F.col("t").alias(t), F.col("s.start").alias(start), F.col("s.size").alias(size))
    texts = docs.select(*map(column, names), F.col("text").alias(text), F.coalesce("doc_id", F.lit(NO_ID)).alias(d), F.xxhash64("text").alias(t))
    return texts.join(spans, [d, t], "left").select(*map(column, [*names, text, start, size])), text


def _each(piece: pa.RecordBatch, k: int) -> Iterator[tuple[bytes, int, list[bytes]]]:
    """(text, number of spans, parts that stay) of every row; the text is column k, its spans follow."""
    buf, offs = utf8(piece.column(k))
    starts, sizes = piece.column(k + 1), piece.column(k + 2)
    s, z = starts.values.to_numpy(zero_copy_only=False), sizes.values.to_numpy(zero_copy_only=False)
    so, zo = starts.offsets.to_numpy(), sizes.offsets.to_numpy()
    for i in range(piece.num_rows):
        data = buf[offs[i] : offs[i + 1]].tobytes()
        a, b = merged(s[so[i] : so[i + 1]], z[zo[i] : zo[i + 1]])
        cuts = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(data)]
        yield data, len(a), [data[x:y] for x, y in zip(cuts[::2], cuts[1::2])]


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, keep_first: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each document without its repeated spans.

    Every occurrence of a repeat goes, the first too unless ``keep_first``.  Null text counts as empty; repeated rows are documents of their
    own, and a null doc_id is a document like any other; an empty table gives an empty result; other columns are ignored.
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(len(data), len(data) - sum(map(len, kept)), n, hashlib.sha256(b"".join(kept)).hexdigest()) for data, n, kept in _each(piece, 1)]
        total, gone, spans, digest = zip(*rows)
        return pa.record_batch([piece.column(0), *[pa.array(c, pa.int64()) for c in (total, gone, spans)], pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows, own = _with_spans(docs, ["doc_id"], length, gram, group, keep_first)
    return map_slices(rows, own, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, keep_first: bool = False) -> DataFrame:
    """docs, all columns, with repeated spans cut out of text (null text becomes empty).

    Characters that the end of a span cuts in two are left out as well.  Repeated rows are documents of their own, so
    all they have in common goes; with ``keep_first`` the first occurrence of a repeat (by doc_id, hash of the text and place)
    stays, and rows equal in doc_id and text stay alike.  An empty table stays empty; column names may be any.
    """
    names = docs.columns
    k = len(names)

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        text = pa.array(["".join(p.decode("utf-8", "ignore") for p in kept) for _, _, kept in _each(piece, k)], pa.string())
        return pa.record_batch([text if n == "text" else piece.column(i) for i, n in enumerate(names)], names)

    rows, own = _with_spans(docs, names, length, gram, group, keep_first)
    return map_slices(rows, own, work, extended(docs, names))
