"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit of a fingerprint belongs to one of the 2^(r+1) - 1 nonzero vectors of GF(2)^(r+1); the mask of vector v
keeps the bits whose vector has an odd inner product with v.  For any r bits some v is orthogonal to all of their
vectors, so two fingerprints that differ in r bits or fewer agree under that mask: every pair within the radius
collides in some table, without exception.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from swellworks.llm.components import components
from swellworks.llm.runtime import Workspace, map_slices, ragged, ship, slices, utf8
from swellworks.llm.words import LOWER, Words, joined, mix

SEED = 42


def shingle_hashes(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every k-word shingle, documents' first rows): ASCII lower case, words joined by one space.

    A document of fewer than k words gives one shingle of all its words, one without words none.
    """
    low = LOWER[buf]
    w = Words(low, offs)
    size = w.end - w.start + 1
    ends = np.cumsum(size)
    text = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    starts = ends - size
    text[ragged(starts, size - 1)] = low[ragged(w.start, size - 1)]
    counts = w.counts
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = ragged(w.first[:-1], n)
    length = np.repeat(np.minimum(counts, k), n)
    a, b, data, h = starts[at].tolist(), (ends[at + length - 1] - 1).tolist() if len(at) else [], text.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((h(data[x:y], SEED) for x, y in zip(a, b)), np.uint64, len(at)), np.concatenate([[0], np.cumsum(n)])


def majority_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A fingerprint a document: bit j is set if it is set in over half of its hashes; none give zero."""
    out = np.zeros(len(first) - 1, np.uint64)
    n = np.diff(first)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, first[:-1][full], axis=0, dtype=np.int32)
    over = counts * 2 > n[full, None]
    out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the 64 bits as a signed long.  Null text counts as empty."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = utf8(piece.column(1))
        return pa.record_batch([piece.column(0), pa.array(majority_bits(*shingle_hashes(buf, offs, k)).view(np.int64))], [id_col, "fp"])

    rows = docs.select(id_col, text_col)
    return map_slices(rows, text_col, work, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks, as signed longs."""
    n = (1 << radius + 1) - 1
    vectors = [1 + i % n for i in range(bits)]
    masks = [sum(1 << i for i, x in enumerate(vectors) if bin(x & v).count("1") & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(classes: DataFrame, radius: int, ws: Workspace, small: int = 64, name: str = "links") -> DataFrame:
    """(a, b): representatives of fingerprints at 1..radius bits, enough of them to connect all such pairs.

    ``classes`` has one row a fingerprint: fp, rep.  Buckets of all tables are counted with partial sums first; buckets
    of one fingerprint go.  Up to ``small`` fingerprints are compared directly.  A larger bucket is never one group:
    its fingerprints are linked through shared neighbours instead.  Two fingerprints at two bits or fewer have a
    common neighbour at one bit or fewer, so each fingerprint sends itself and its one-bit flips as keys, and those
    that share a key are within two bits of each other; a key has 65 senders at most.
    (At radius 1 a flip counts only if it is itself a fingerprint.)
    """
    if radius > 2:
        raise ValueError("radius 0 to 2")
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(covering_masks(radius))])).alias("x")
    placed = classes.select("fp", "rep", tables).select("fp", "rep", "x.t", "x.key")
    sizes = ws.table(placed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{name}_sizes")
    shared = ws.table(placed.join(sizes, ["t", "key"]), f"{name}_placed")
    group = F.collect_list(F.struct("fp", "rep"))
    near = "filter(g, y -> y.rep > x.rep AND bit_count(x.fp ^ y.fp) <= {0})"
    direct = (
        shared.where(F.col("n") <= small).groupBy("t", "key").agg(group.alias("g"))
        .select(F.explode(F.expr(f"flatten(transform(g, x -> transform({near.format(radius)}, y -> struct(x.rep AS a, y.rep AS b))))")).alias("p")).select("p.a", "p.b")
    )
    flips: list[Column] = [F.col("fp")] + ([F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)] if radius else [])
    sent = shared.where(F.col("n") > small).select("fp", "rep").distinct().select("fp", "rep", F.explode(F.array(*flips)).alias("z"))
    if radius == 1:
        sent = sent.where("z = fp").select("fp", "rep", "z").union(sent.where("z <> fp").join(classes.select(F.col("fp").alias("z")), "z", "left_semi").select("fp", "rep", "z"))
    meets = sent.groupBy("z").agg(F.collect_set("rep").alias("g")).where(F.size("g") > 1)
    through = meets.select(F.array_min("g").alias("a"), F.explode("g").alias("b")).where("a <> b")
    return direct.union(through).distinct()


def near_duplicates(docs: DataFrame, k: int, radius: int, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of up to ``radius`` bits.

    Equal fingerprints form a class first (its smallest doc_id stands for it), so copies cost no link.  Documents
    without words have fingerprint zero and link like any other.  Repeated rows keep a row each; a null doc_id
    keeps its row and links nothing (component_id null); an empty table gives an empty result.
    """
    ws = ws or Workspace(docs.sparkSession, "simhash")
    prints = ws.table(fingerprints(docs, k), "prints")
    classes = ws.table(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    labels = components(ws.table(links(classes, radius, ws), "edges"), ws)
    known = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("label", "rep").alias("component_id"))
    out = prints.join(ws.table(known, "known"), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


PARITY = 8  # longs of parity bits
BUCKETS, CHUNK = 1 << 20, 1 << 12  # of the table of frequencies, and of a row of it on its way
UNCOMMON = 64  # documents under a shingle that are all paired


def shingle_numbers(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What shingle_hashes gives, but for the hash: mixed word hashes, without a Python object a shingle."""
    w = Words(LOWER[buf], offs)
    x, counts = w.hashes(), w.counts
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(first[-1]), np.uint64)
    full = np.flatnonzero(counts >= k)
    out[ragged(first[full], n[full])] = w.windows(x, k)[0]
    few = np.flatnonzero((counts > 0) & (counts < k))
    acc = counts[few].astype(np.uint64)
    for j in range(k - 1):
        on = counts[few] > j
        acc[on] = mix(acc[on] + x[w.first[few[on]] + j])
    out[first[few]] = acc
    return out, first


def distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner): each document's different shingles in rising order."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def frequency_levels(docs: DataFrame, k: int) -> np.ndarray:
    """How common the shingles of each bucket are in the documents, all of them: 0 up to the mean, one more with every half doubling.

    Tasks count first and send their tables in rows of CHUNK buckets; one table of BUCKETS counts reaches the driver,
    whatever the input.  It only orders shingles: any order finds the same pairs, this one keeps common passages last.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for piece in slices(batch, 0):
                total += np.bincount(_bucket(distinct(*shingle_numbers(*utf8(piece.column(0)), k))[0]), minlength=BUCKETS)
        rows = [(i, r.tobytes()) for i, r in enumerate(total.reshape(-1, CHUNK)) if r.any()]
        if rows:
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, r in zip(*(c.to_pylist() for c in batch.columns)):
                sums[i] = sums.get(i, 0) + np.frombuffer(r, np.int64)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([r.tobytes() for r in sums.values()], pa.binary())], ["chunk", "counts"])

    ship(docs.sparkSession)
    counted = docs.select("text").mapInArrow(count, "chunk int, counts binary")
    total = np.zeros((BUCKETS // CHUNK, CHUNK), np.int64)
    for r in counted.repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():
        total[r.chunk] = np.frombuffer(r.counts, np.int64)
    total = total.ravel()
    return np.clip(2 * np.log2(np.maximum(total, 1) / max(total.mean(), 1.0)), 0, 100).astype(np.int8)


def sketches(docs: DataFrame, k: int, least: float) -> DataFrame:
    """(doc_id, t, words0, words1, n, fp, g0.., tokens array<long>): text's hash, identity of the word sequence, number of
    different shingles, SimHash fingerprint of these, parity bits, prefix.

    Shingles have one order for the whole table (frequent ones last).  Two documents of similarity ``least`` share
    least * n shingles of either, so the first of those stands among the first n - ceil(least * n) + 1 of both: the prefix.
    A shingle toggles one of 64 * PARITY bits, so two documents differ in at least as many shingles as in bits.
    """
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, k))

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = utf8(piece.column(2))
        h, owner = distinct(*shingle_numbers(buf, offs, k))
        n = np.bincount(owner, minlength=piece.num_rows)
        bounds = np.concatenate([[0], np.cumsum(n)])
        fp = majority_bits(h, bounds)
        parity = np.zeros(piece.num_rows * PARITY, np.uint64)
        bit = mix(h) % np.uint64(64 * PARITY)
        np.bitwise_xor.at(parity, owner * PARITY + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        h = h[np.lexsort((h, levels.value[_bucket(h)], owner))]
        size = np.where(n > 0, n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, 0)
        low = LOWER[buf]
        w = Words(low, offs)
        text = [joined(low, w.start[a:b], w.end[a:b]) for a, b in zip(w.first[:-1], w.first[1:])]
        wide = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, text)), np.int64).reshape(-1, 2)
        tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(h[ragged(bounds[:-1], size)].view(np.int64)))
        g = parity.view(np.int64).reshape(-1, PARITY)
        columns = [*piece.columns[:2], pa.array(wide[:, 0]), pa.array(wide[:, 1]), pa.array(n), pa.array(fp.view(np.int64)), *(pa.array(g[:, i].copy()) for i in range(PARITY)), tokens]
        return pa.record_batch(columns, ["doc_id", "t", "words0", "words1", "n", "fp", *BITS, "tokens"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return map_slices(rows, "text", work, f"doc_id long, t long, words0 long, words1 long, n long, fp long, {', '.join(f'{b} long' for b in BITS)}, tokens array<long>")


BITS = [f"g{i}" for i in range(PARITY)]


def possible(least: float) -> str:
    """Condition on x and y: sizes and parity bits don't rule the similarity out."""
    apart = " + ".join(f"bit_count(x.{b} ^ y.{b})" for b in BITS)
    return f"least(x.n, y.n) >= {least} * greatest(x.n, y.n) - 1e-9 AND {apart} <= {(1 - least) / (1 + least)!r} * (x.n + y.n) + 1e-6"


def met(reps: DataFrame, least: float, small: int) -> DataFrame:
    """(a, b, token, n, pos): pairs a, b of up to ``small`` classes under a token; of more, each class a with its token.

    A pair counts where sizes and what is left of both from the token on allow the similarity; at the first shingle that
    two classes share all they share is left, so no pair is lost.
    """
    filed = reps.select("c", "n", F.posexplode("tokens").alias("pos", "token"))
    rows = filed.select("token", "c", (F.col("n") * (1 << 32) + F.col("pos")).alias("at")).repartition("token").sortWithinPartitions("token")

    def settle_groups(token: np.ndarray, c: np.ndarray, at: np.ndarray, large: int | None) -> Iterator[pa.RecordBatch]:
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(head, len(token)))
        group = np.repeat(np.arange(len(head)), size)
        big = size > small
        if large is not None:
            big |= token[head] == large
        n, pos = at >> 32, at & (1 << 32) - 1
        rest = np.flatnonzero(big[group])
        if len(rest):
            none = pa.nulls(len(rest), pa.int64())
            yield pa.record_batch([pa.array(c[rest]), none, pa.array(token[rest]), pa.array(n[rest]), pa.array(pos[rest])], ["a", "b", "token", "n", "pos"])
        i, d = np.flatnonzero((~big & (size > 1))[group]), 1
        while len(i):
            i = i[i + d < len(token)]
            i = i[group[i] == group[i + d]]
            j = i + d
            need = least / (1 + least) * (n[i] + n[j]) - 1e-6
            good = (c[i] != c[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9)
            x, y = c[i[good]], c[j[good]]
            if len(x):
                none = pa.nulls(len(x), pa.int64())
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), none, none, none], ["a", "b", "token", "n", "pos"])
            d += 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        large: int | None = None  # the token of a large group that began in an earlier batch
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate([o, c.to_numpy()]) for o, c in zip(held, batch.columns)]
            last = held[0][-1]
            cut = int(np.searchsorted(held[0], last))  # the last group may go on in the next batch
            if len(held[0]) - cut > small or last == large:
                yield from settle_groups(*held, large)
                held, large = [h[:0] for h in held], int(last)
            elif cut:
                yield from settle_groups(*(h[:cut] for h in held), large)
                held, large = [h[cut:].copy() for h in held], None
        if len(held[0]):
            yield from settle_groups(*held, large)

    return rows.mapInArrow(work, "a long, b long, token long, n long, pos long")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, least: float, ws: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose k-word shingle sets have a Jaccard similarity of at least ``least``.

    Only texts of classes that stand in a pair travel.
    """
    pairs = ws.table(pairs, f"{name}_pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    wanted = ws.table(reps.select("c", "doc_id", "t").join(wanted, "c"), f"{name}_wanted")
    held = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").join(wanted, ["doc_id", "t"])
    texts = ws.table(held.dropDuplicates(["doc_id", "t"]).select("c", "text"), f"{name}_texts")
    ws.reclaim()
    side = lambda c, text: texts.select(F.col("c").alias(c), F.col("text").alias(text))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")

    def work(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        (hx, ox), (hy, oy) = (distinct(*shingle_numbers(*utf8(piece.column(c)), k)) for c in (2, 3))
        rows = np.arange(piece.num_rows + 1)
        fx, fy, good = np.searchsorted(ox, rows), np.searchsorted(oy, rows), []
        for i in rows[:-1]:
            both = np.sort(np.concatenate([hx[fx[i] : fx[i + 1]], hy[fy[i] : fy[i + 1]]]))
            shared = int((both[1:] == both[:-1]).sum())
            good.append(shared >= least * (len(both) - shared) - 1e-9)
        return pa.record_batch([c.filter(pa.array(good)) for c in piece.columns[:2]], ["a", "b"])

    return ws.table(map_slices(both, "x", work, "a long, b long"), name)


def fingerprint_pairs(reps: DataFrame, ws: Workspace, radius: int = 2) -> DataFrame:
    """(a, b): classes whose fingerprints covering hashing links, enough to connect all within ``radius`` bits."""
    prints = ws.table(reps.groupBy("fp").agg(F.min("c").alias("rep")), "fingerprints")
    equal = reps.join(prints, "fp").where("c <> rep").select(F.col("rep").alias("a"), F.col("c").alias("b"))
    near = links(prints, radius, ws, name="prints").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.union(near)


def similar_edges(reps: DataFrame, docs: DataFrame, k: int, least: float, small: int, ws: Workspace) -> DataFrame:
    """(a, b): similar classes, enough of them to connect all similar pairs.  ``reps`` has c, doc_id, t, n, fp, g0.., tokens.

    Three sources of candidates: fingerprints that covering hashing links; up to ``small`` classes under a token of
    their prefixes, all paired; and in a larger group a hub, the class with most such tokens, that each of the group meets.
    Then every class that isn't connected with its group's hub meets all of the group that it isn't connected with.
    """
    under = ws.table(met(reps, least, small), "met")
    bits = reps.select("c", "n", *BITS)
    side = lambda x: F.struct("c", "n", *BITS).alias(x)
    ends = [F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")]

    def sieved(pairs: DataFrame) -> DataFrame:
        known = pairs.join(bits.select(F.col("c").alias("a"), side("x")), "a").join(bits.select(F.col("c").alias("b"), side("y")), "b")
        return known.where(possible(least)).select("a", "b")

    few = sieved(under.where("b IS NOT NULL").select("a", "b").union(fingerprint_pairs(reps, ws)).distinct())
    rows = under.where("token IS NOT NULL").select("token", "pos", F.col("a").alias("c"))
    many = rows.groupBy("c").agg(F.count(F.lit(1)).alias("tokens"))
    large = ws.table(rows.join(bits.join(many, "c"), "c"), "large")
    hubs = ws.table(large.groupBy("token").agg(F.min_by(side("x"), F.struct(-F.col("tokens"), "c")).alias("x")), "hubs")
    star = large.select("token", side("y")).join(hubs, "token").where("x.c <> y.c AND " + possible(least)).select(*ends)
    near = verified(few.union(star).distinct(), reps, docs, k, least, ws, "near")
    ws.drop("met", "near_pairs", "near_texts")
    ws.reclaim()
    labels = components(near, ws, "first")
    label = F.coalesce("label", "c").alias("label")
    member = large.join(labels.withColumnRenamed("node", "c"), "c", "left")
    member = ws.table(member.select("token", F.struct("c", "n", "pos", label, *BITS).alias("y")), "members")
    mains = hubs.select("token", F.col("x.c").alias("c")).join(labels.withColumnRenamed("node", "c"), "c", "left").select("token", label.alias("main"))
    apart = ws.table(member.join(ws.table(mains, "mains"), "token").where("y.label <> main").select("token", F.col("y").alias("x")), "apart")
    left = f"least(x.n - x.pos, y.n - y.pos) >= {least / (1 + least)!r} * (x.n + y.n) - 1e-6"
    rest = apart.join(member, "token").where(f"x.label <> y.label AND {left} AND {possible(least)}").select(*ends)
    return near.union(verified(rest.distinct(), reps, docs, k, least, ws, "far"))


def similar_components(docs: DataFrame, k: int = 5, least: float = 0.8, ws: Workspace | None = None, small: int = UNCOMMON) -> DataFrame:
    """(doc_id, t, component): ``component`` joins texts over pairs with a shingle similarity of at least ``least``; ``t``
    (xxhash64 of the text) tells texts of one doc_id apart.

    Texts with the same words form a class first; one of them is compared.  Fingerprints find close pairs, prefixes of the
    shingle sets all others without exception; exact shingle sets decide.  ``small`` changes the work, not the groups.
    Rows without a doc_id are left out; null and empty texts are one class; repeated rows count once; an empty table
    gives an empty result.
    """
    ws = ws or Workspace(docs.sparkSession, "similar")
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    every = ws.table(sketches(texts, k, least), "sketches")
    classes = every.groupBy("words0", "words1").agg(F.min(F.struct("doc_id", "t", "n", "fp", *BITS, "tokens")).alias("r"))
    classes = ws.table(classes.select(F.xxhash64("words0", "words1").alias("c"), "words0", "words1", "r.*"), "classes")
    edges = ws.table(similar_edges(classes, texts, k, least, small, ws), "edges")
    ws.reclaim()
    labels = components(edges, ws).withColumnRenamed("node", "c")
    known = ws.table(classes.join(labels, "c", "left").select("words0", "words1", F.coalesce("label", "c").alias("component")), "known")
    return every.select("doc_id", "t", "words0", "words1").distinct().join(known, ["words0", "words1"]).select("doc_id", "t", "component")


def similar_groups(docs: DataFrame, k: int = 5, least: float = 0.8, ws: Workspace | None = None, small: int = UNCOMMON) -> DataFrame:
    """similar_components with ``group_id``, the smallest doc_id of the component."""
    ws = ws or Workspace(docs.sparkSession, "similar")
    found = ws.table(similar_components(docs, k, least, ws, small), "components")
    return found.join(ws.table(found.groupBy("component").agg(F.min("doc_id").alias("group_id")), "group_ids"), "component").select("doc_id", "t", "component", "group_id")
