"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by their number of word shingles: 1, 2 and 3, 4 to 7 and so on.  For the partition of sizes
below u a document counts as its windows of 2u shingles, one every u: an item that a document holds within u
shingles lies inside one of them, whose size is of the item's order, so containment turns into a Jaccard bound that does not
depend on the document's length.  Items and windows get one-permutation MinHash signatures of PERMUTATIONS x BINS places (a
bin is some bits of the hash, its value the least hash); a window and an item with an equal place are candidates.  An item of one
shingle is lost if in every permutation and window a lesser hash shares its bin, about once in 30,000 times; the more shingles
are shared the less likely (the tests measure it).  Every candidate is verified: the exact share of the item's distinct
shingles that occur in the whole document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from swellworks.llm.runtime import column, extended, map_slices, spare, utf8
from swellworks.llm.words import LOWER, Words, joined, mix

WORDS, CONTAINMENT = 5, 0.8
BINS, PERMUTATIONS = 256, 2


@dataclass
class Signatures:
    """One permutation's signature values of a partition's items, and which items have them."""

    values: np.ndarray  # sorted, all different
    first: np.ndarray  # ranges of ``owner`` for each
    owner: np.ndarray
    sieve: np.ndarray  # bitmap over the values' low bits


@dataclass
class SizePartition:
    """Items of one size range."""

    width: int  # words a shingle: WORDS, or all words of a shorter item
    upper: int  # shingles of its items are fewer
    signatures: list[Signatures]


def item_shingles(text: str | None, k: int = WORDS) -> tuple[int, frozenset[bytes]]:
    """(words a shingle, distinct shingles): fewer than k words give one shingle of all; none give none."""
    raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    w = Words(raw, np.array([0, len(raw)]))
    n = len(w.start)
    width = min(k, n)
    return width, frozenset(joined(raw, w.start[i : i + width], w.end[i : i + width]) for i in range(n - width + 1)) if n else frozenset()


def _shingle_hashes(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[Words, np.ndarray, np.ndarray]:
    w = Words(buf, offs)
    h, first = w.windows(w.hashes(), k)
    return w, h, first


def permuted(h: np.ndarray, p: int) -> np.ndarray:
    return mix(h + np.uint64(p)) if p else h


def _bin(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - BINS.bit_length() + 1)


def signature(h: np.ndarray) -> np.ndarray:
    """The least hash of each bin that has one."""
    h = np.sort(h)  # a bin is the top bits, so its hashes are neighbours
    return h[np.concatenate([[True], _bin(h[1:]) != _bin(h[:-1])])] if len(h) else h


def build(items: dict[int, tuple[int, frozenset[bytes]]]) -> list[SizePartition]:
    """Size partitions of items {id: (width, shingles)}; items without shingles match nothing."""
    groups: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, (width, shingles) in items.items():
        if shingles:
            groups[width, 1 << len(shingles).bit_length()].append(i)
    out = []
    for (width, upper), ids in sorted(groups.items()):
        hashes = []
        for i in ids:
            text = sorted(items[i][1])
            buf = np.frombuffer(b"".join(text), np.uint8)
            hashes.append(_shingle_hashes(buf, np.concatenate([[0], np.cumsum([len(s) for s in text])]), width)[1])
        signatures = []
        for p in range(PERMUTATIONS):
            rows = [signature(permuted(h, p)) for h in hashes]
            flat, owner = np.concatenate(rows), np.repeat(np.array(ids, np.int64), [len(r) for r in rows])
            order = np.lexsort((owner, flat))
            values, first = np.unique(flat[order], return_index=True)
            sieve = np.zeros(1 << max(10, (16 * len(values)).bit_length()), bool)
            sieve[values & np.uint64(len(sieve) - 1)] = True
            signatures.append(Signatures(values, np.append(first, len(flat)), owner[order], sieve))
        out.append(SizePartition(width, upper, signatures))
    return out


def candidates(part: SizePartition, h: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
    """(document, item) with an equal signature place in some window.

    The items' values are probed before windows' signatures are made: a place can only agree if some shingle has that
    value, so only such shingles are tested for being the least of their bin in their two windows.
    """
    found: set[tuple[int, int]] = set()
    for p, own in enumerate(part.signatures):
        hp = permuted(h, p)
        probe = np.flatnonzero(own.sieve[hp & np.uint64(len(own.sieve) - 1)])
        slot = np.minimum(np.searchsorted(own.values, hp[probe]), len(own.values) - 1)
        good = own.values[slot] == hp[probe]
        probe, slot = probe[good], slot[good]
        doc = np.searchsorted(first, probe, "right") - 1
        for x, s, d in zip(probe.tolist(), slot.tolist(), doc.tolist()):
            a, end, v = int(first[d]), int(first[d + 1]), hp[x]
            step = (x - a) // part.upper
            for k in range(max(step - 1, 0), step + 1):
                window = hp[a + k * part.upper : min(a + (k + 2) * part.upper, end)]
                if not ((_bin(window) == _bin(v)) & (window < v)).any():
                    found.update((d, int(i)) for i in own.owner[own.first[s] : own.first[s + 1]])
                    break
    return found


def find(parts: list[SizePartition], items: dict[int, tuple[int, frozenset[bytes]]], buf: np.ndarray, offs: np.ndarray, least: float = CONTAINMENT) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, shared shingles, item's shingles) of every verified pair."""
    low = LOWER[buf]
    by_width, pairs = {}, set()
    for part in parts:
        if part.width not in by_width:
            by_width[part.width] = _shingle_hashes(low, offs, part.width)
        _, h, first = by_width[part.width]
        pairs |= candidates(part, h, first)
    exact: dict[tuple[int, int], set[bytes]] = {}
    for d, i in sorted(pairs):
        width, wanted = items[i]
        if (d, width) not in exact:
            if len(exact) > 8:
                exact.clear()
            w = by_width[width][0]
            a, b = int(w.first[d]), int(w.first[d + 1])
            text = joined(low, w.start[a:b], w.end[a:b]).split(b" ")
            exact[d, width] = {b" ".join(text[x : x + width]) for x in range(len(text) - width + 1)}
        shared = len(wanted & exact[d, width])
        if shared >= least * len(wanted) - 1e-9:
            yield d, i, shared, len(wanted)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, block_bytes: int = 8 << 20, keep: list[str] | None = None) -> DataFrame:
    """One row for each document and test item it holds: the columns ``keep`` (default doc_id), item_id, shared, item_shingles, containment.

    Items are the query set; all documents pass by each block of at most ``block_bytes`` of item text, which is all that is ever
    broadcast.  ASCII letters count as lower case.  Null and empty texts match nothing; items of fewer than five
    words match as one shingle of all their words; repeated documents have rows each, repeated items (id and text)
    count once; an empty table gives an empty result.
    """
    names, spark = keep or ["doc_id"], docs.sparkSession
    (own,) = spare(names, "text")
    rows = docs.select(*map(column, names), F.col("text").alias(own))
    schema = extended(docs, names, "item_id long, shared int, item_shingles int, containment double")
    out = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark, block_bytes):
        texts = dict(enumerate(block))
        items = {n: item_shingles(text) for n, (_, text) in texts.items()}
        shared = spark.sparkContext.broadcast((build(items), items, {n: i for n, (i, _) in texts.items()}))

        def work(piece: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            parts, items, ids = shared.value
            found = list(find(parts, items, *utf8(piece.column(len(names))), least))
            if not found:
                return None
            at = pa.array([f[0] for f in found])
            cols = [piece.column(k).take(at) for k in range(len(names))]
            return pa.record_batch([*cols, pa.array([ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32()), pa.array([f[2] / f[3] for f in found])], [*names, "item_id", "shared", "item_shingles", "containment"])

        out = out.unionByName(map_slices(rows, own, work, schema))
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Distinct (item_id, text) in blocks of bounded text, streamed in order of id partition by partition."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        held += len(r.text) + 64
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def clean(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, all columns, that hold no test item: one pass over the documents for each block of items.

    Null and empty texts hold none; repeated rows stay or go alike; without items, or documents, docs come back as they are.
    """
    names, out, spark = docs.columns, docs, docs.sparkSession
    schema = extended(docs, names)
    for block in item_blocks(benchmark, block_bytes):
        items = {n: item_shingles(text) for n, (_, text) in enumerate(block)}
        shared = spark.sparkContext.broadcast((build(items), items))

        def work(piece: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            keep = np.ones(piece.num_rows, bool)
            keep[[f[0] for f in find(*shared.value, *utf8(piece.column(names.index("text"))), least)]] = False
            return pa.record_batch(piece.filter(pa.array(keep)).columns, names)

        out = map_slices(out, "text", work, schema)
    return out
