"""Token-id files: ids ranked by corpus frequency, in byte-aligned variable-length coding.

A shard file is ``header | documents | blocks``.  Every block has its control bytes (two bits an id: one to four
bytes) apart from its data bytes, so a table of 256 rows gives the four lengths of each control byte and numpy
decodes without a loop over ids.  Ids are replaced by their rank in corpus frequency, so frequent ids take one byte.

    header     8 s  magic, u4 documents, u8 ids
    documents  i8 doc ids, u8 first ids (one more than documents), u8 block offsets (likewise)
    blocks     one a document: control bytes, then data bytes
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from swellworks.llm.piece_cache import PieceCache
from swellworks.llm.runtime import RangeReader, Workspace, map_slices, put_file, ragged, slices, utf8
from swellworks.llm.words import LOWER, Words

MAGIC = b"RANKVL1\n"
HEAD = "<8sIQ"
#: Lengths of the four ids of each control byte.
LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The blocks of documents: values[first[i]:first[i+1]], unsigned 32-bit."""
    counts = np.diff(first)
    v = values.astype("<u4")
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    groups = -(-counts // 4)
    control_at = np.concatenate([[0], np.cumsum(groups)])
    codes = np.zeros(4 * int(control_at[-1]), np.uint8)
    codes[ragged(4 * control_at[:-1], counts)] = n - 1
    codes = codes.reshape(-1, 4)
    control = (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).tobytes()
    data_at = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[first].tolist()
    data, c = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < n[:, None]].tobytes(), control_at.tolist()
    return [control[c[i] : c[i + 1]] + data[data_at[i] : data_at[i + 1]] for i in range(len(counts))]


def unpack(data: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of all blocks that start at ``at`` in data, one after the other."""
    groups = -(-counts // 4)
    n = LENGTHS[data[ragged(at, groups)]].ravel()
    if (counts & 3).any():
        n = n[ragged(4 * (np.cumsum(groups) - groups), counts)]
    n = n.astype(np.int64)
    ends = np.cumsum(n)
    first = np.cumsum(counts) - counts
    before = np.concatenate([[0], ends])[first]
    where = ends - n + np.repeat(at + groups - before, counts)
    out = data[where].astype("<u4")
    for j in range(1, 4):
        has = np.flatnonzero(n > j)
        if not len(has):
            break
        out[has] |= data[where[has] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def shard_bytes(doc_ids: list[int], counts: list[int], blocks: list[bytes]) -> Iterator[bytes]:
    """The parts of a shard file."""
    ids, sizes = np.array([0, *counts], "<u8"), np.array([0, *map(len, blocks)], "<u8")
    yield struct.pack(HEAD, MAGIC, len(blocks), int(ids.sum()))
    yield np.array(doc_ids, "<i8").tobytes()
    yield np.cumsum(ids, dtype=np.uint64).astype("<u8").tobytes()
    yield np.cumsum(sizes, dtype=np.uint64).astype("<u8").tobytes()
    yield from blocks


class Shard:
    """Reads a shard file by ranges: the directory first, then any run of documents."""

    def __init__(self, uri: str, reader: RangeReader | None = None):
        self.uri, self.read = uri, reader or RangeReader()
        head = struct.calcsize(HEAD)
        magic, self.documents, self.ids = struct.unpack(HEAD, self.read(uri, 0, head))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        n = self.documents
        raw = self.read(uri, head, 8 * n + 16 * (n + 1))
        self.doc_ids = np.frombuffer(raw[: 8 * n], "<i8")
        self.first = np.frombuffer(raw[8 * n : 16 * n + 8], "<u8").astype(np.int64)
        self.at = np.frombuffer(raw[16 * n + 8 :], "<u8").astype(np.int64)
        self.base = head + len(raw)

    def ranks(self, a: int, b: int) -> np.ndarray:
        """The ranks of documents a..b-1 of this shard, one after the other."""
        data = np.frombuffer(self.read(self.uri, self.base + int(self.at[a]), int(self.at[b] - self.at[a])), np.uint8)
        return unpack(data, self.at[a:b] - self.at[a], np.diff(self.first[a : b + 1]))


#: 1 for ASCII letters and digits, 2 for ASCII signs but the apostrophe, 0 for any other byte.
KIND = np.array([1 if chr(b).isalnum() else 2 if 0x20 < b < 0x7F and b != 0x27 else 0 for b in range(0x80)] + [0] * 0x80, np.uint8)


class WordTokenizer:
    """Whole texts through the tokenizers library, by way of a cache of white-space separated chunks.

    The file's normaliser folds white space and lower-cases, and its splitter never crosses white space or the border
    of a letter or digit and a sign, so a text's ids are those of its chunks in order.  Only ASCII borders cut
    (white space; a letter or digit beside a sign other than the apostrophe); the rest is the library's.

    The file's added tokens (``<|endoftext|>``) are taken out of the raw text first and have ids of their own, as in
    the library's plain call; what stands around them is ordinary text.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        added = json.loads(data)["added_tokens"]
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must be plain strings")
        self.added = {t["content"].encode(): t["id"] for t in added}
        self.any_added = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or b"(?!)")
        self.library = Tokenizer.from_str(data.decode("utf-8"))
        self.library.encode_special_tokens = True  # in chunks their strings, in other cases say, are ordinary text
        self.cache = PieceCache(self._library_ids, bits=21)

    def _library_ids(self, chunks: list[bytes], together: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks and how many each has: line by line in one call for many, told apart by the offsets."""
        ids, counts = [], []
        for a in range(0, len(chunks), together):
            texts = [c.decode("utf-8") for c in chunks[a : a + together]]
            got = self.library.encode("\n".join(texts), add_special_tokens=False)
            first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
            owner = np.searchsorted(first, np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids)), "right") - 1
            ids.append(np.array(got.ids, np.int32))
            counts.append(np.bincount(owner, minlength=len(texts)))
        return np.concatenate(ids), np.concatenate(counts)

    def _found(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of the added tokens in the raw texts."""
        data, found = buf.tobytes(), []
        if self.any_added.search(data):
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                found += [(*m.span(), self.added[m.group()]) for m in self.any_added.finditer(data, a, b)]
        return tuple(np.array(found, np.int64).reshape(-1, 3).T)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text and the end)."""
        if not len(buf):
            return np.empty(0, np.int32), np.zeros(len(offs), np.int64)
        from_, to, added = self._found(buf, offs)
        ascii_next = np.append(buf[1:] < 0x80, True)
        buf = np.where(ascii_next, LOWER[buf], buf)  # a letter before a combining mark is the library's to lower
        w, kind = Words(buf, offs), KIND[buf]
        inner = np.flatnonzero(kind[1:] * kind[:-1] == 2) + 1  # a word byte beside a sign
        inner = inner[~np.isin(inner, offs)]
        if len(added):
            inner = inner[np.searchsorted(from_, inner, "left") <= np.searchsorted(to, inner, "right")]  # none within an added token
            inner = np.unique(np.concatenate([inner, from_, to]))
            inner = inner[~(np.isin(inner, w.start) | np.isin(inner, w.end))]  # where a word starts or ends there is nothing to cut
        start = np.sort(np.concatenate([w.start, inner]))
        end = np.sort(np.concatenate([w.end, inner]))
        if not len(added):
            ids, n = self.cache.ids(buf, start, end)
        else:
            own = np.isin(start, from_)
            some, count = self.cache.ids(buf, start[~own], end[~own])
            n = np.ones(len(start), np.int64)
            n[~own] = count
            at = np.cumsum(n) - n
            ids = np.empty(int(n.sum()), np.int32)
            ids[ragged(at[~own], count)], ids[at[own]] = some, added
        return ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, offs)]


_LOADED: dict[str, WordTokenizer] = {}


def load(data: bytes) -> WordTokenizer:
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordTokenizer(data)
    return _LOADED[key]


def id_type(size: int) -> str:
    """The narrowest little-endian type for ids below ``size``: what staged tables and shuffles carry."""
    return "<u2" if size <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, vocabulary: bytes, end_id: int, kind: str = "<u4") -> DataFrame:
    """(doc_id, ids binary of ``kind``): every whole text's ids and ``end_id`` after them.  Null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = utf8(piece.column(1))
        ids, first = load(shared.value).encode(buf, offs)
        ended = np.insert(ids, first[1:], end_id).astype(kind)
        at = first + np.arange(len(first))
        return pa.record_batch([piece.column(0), pa.array([ended[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["doc_id", "ids"])

    return map_slices(docs.select("doc_id", "text"), "text", work, "doc_id long, ids binary")


def frequency_ranks(tokens: DataFrame, vocabulary_size: int, kind: str = "<u4") -> np.ndarray:
    """rank[id] by falling count over all documents, ties by id.  Counts are summed in every task first; what
    reaches the driver is one row an id at most, bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary_size, np.int64)
        for b in batches:
            buf, _ = utf8(b.column(0))
            total += np.bincount(buf.view(kind), minlength=vocabulary_size)
        ids = np.flatnonzero(total)
        yield pa.record_batch([pa.array(ids.astype(np.int32)), pa.array(total[ids])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(vocabulary_size, np.int64)
    for r in rows:
        total[r.id] = r.n
    rank = np.empty(vocabulary_size, np.uint32)
    rank[np.lexsort((np.arange(vocabulary_size), -total))] = np.arange(vocabulary_size)
    return rank


SHARDS = "part int, seq int, uri string, documents long, ids long"
GROUP = 256  # parts whose running total one task makes


def write_shards(tokens: DataFrame, rank: np.ndarray, ws: Workspace, parts: int, kind: str = "<u4", target: int = 16 << 20) -> DataFrame:
    """Deal documents out by ascending doc_id, write shard files of about ``target`` bytes from each part, list the files.

    The order is total (doc_id, hash of the ids, row of the staged table), also among rows that share a doc_id, which may
    lie in several parts.  Part and file are numbered, so a task that runs again writes the same files again.
    """
    shared, folder = tokens.sparkSession.sparkContext.broadcast(rank.astype(kind)), ws.path("shards")
    order = ["doc_id", "tie", "row"]
    keyed = tokens.withColumns({"tie": F.xxhash64("ids"), "row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids", F.spark_partition_id().alias("part"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, counts, blocks, held, seq, part = [], [], [], 0, 0, None

        def close() -> pa.RecordBatch:
            nonlocal docs, counts, blocks, held, seq
            uri = put_file(folder, f"tokens-{part:06d}-{seq:04d}.rvl", shard_bytes(docs, counts, blocks))
            row = [part, seq, uri, len(docs), sum(counts)]
            docs, counts, blocks, held, seq = [], [], [], 0, seq + 1
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "seq", "uri", "documents", "ids"])

        for b in batches:
            for piece in slices(b, "ids"):
                buf, offs = utf8(piece.column(1))
                first = offs // np.dtype(kind).itemsize
                part = piece.column(2)[0].as_py()
                docs += piece.column(0).to_pylist()
                counts += np.diff(first).tolist()
                blocks += pack(shared.value[buf.view(kind)], first)
                held += len(buf)
                if held >= target:
                    yield close()
        if docs:
            yield close()

    return ws.table(dealt.mapInArrow(write, SHARDS), "shard_list")


def with_bases(listed: DataFrame) -> DataFrame:
    """The list of files with ``base``, the ids in all files before: a running total within GROUP parts, and one number a
    group of parts on the driver."""
    grouped = listed.withColumn("part_group", F.floor(F.col("part") / GROUP))
    sums = sorted(tuple(r) for r in grouped.groupBy("part_group").agg(F.sum("ids")).collect())
    starts = np.cumsum([0, *(n for _, n in sums)]).tolist()
    before = listed.sparkSession.createDataFrame([(g, s) for (g, _), s in zip(sums, starts)], "part_group long, start long")
    earlier = F.coalesce(F.sum("ids").over(Window.partitionBy("part_group").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return grouped.withColumn("earlier", earlier).join(F.broadcast(before), "part_group").select("part", "seq", "uri", (F.col("start") + F.col("earlier")).alias("base"))


def read_shards(listed: DataFrame, rank: np.ndarray, ws: Workspace) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) from the files; start counts ids over all of them."""
    back = np.empty(len(rank), "<u4")
    back[rank] = np.arange(len(rank))
    shared = listed.sparkSession.sparkContext.broadcast(back)
    known = ws.table(with_bases(listed), "bases")
    work_list = known.repartitionByRange(max(1, known.count()), "part", "seq").select("uri", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard, a = Shard(uri), 0
                while a < shard.documents:
                    e = max(a + 1, int(np.searchsorted(shard.first, shard.first[a] + (1 << 18), "right")) - 1)
                    data, at = shared.value[shard.ranks(a, e)].tobytes(), (4 * (shard.first[a : e + 1] - shard.first[a])).tolist()
                    ids = [data[x:y] for x, y in zip(at, at[1:])]
                    yield pa.record_batch([pa.array(shard.doc_ids[a:e]), pa.array(base + shard.first[a:e]), pa.array(np.diff(shard.first[a : e + 1])), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                    a = e
                shard.read.close()

    return work_list.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def vocabulary_size(data: bytes) -> int:
    spec = json.loads(data)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])


def encode_corpus(docs: DataFrame, vocabulary: str, end_id: int = 2, shard_bytes_target: int = 16 << 20) -> DataFrame:
    """Encode all documents, write the ranked token files in ascending doc_id order and read them back.

    Null text counts as empty (the end id alone); repeated rows stay rows, those of one doc_id in an order of their own that
    doesn't change from run to run; an empty table gives an empty result; other columns are ignored.  The number of parts
    follows the ids counted.
    """
    ws = Workspace(docs.sparkSession, "tokens")
    with open(vocabulary, "rb") as f:
        data = f.read()
    size = max(vocabulary_size(data), end_id + 1)
    kind = id_type(size)
    tokens = ws.table(tokenize(docs, data, end_id, kind), "ids")
    rank = frequency_ranks(tokens, size, kind)
    total = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    listed = write_shards(tokens, rank, ws, max(1, -(-total // shard_bytes_target)), kind, shard_bytes_target)
    out = read_shards(listed, rank, ws)
    ws.drop("ids")
    ws.reclaim()
    return out


def with_digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_shards gives."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        crc = [zlib.crc32(x) for x in piece.column(3).to_pylist()]
        return pa.record_batch([*piece.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_slices(tokens, "ids", work, "doc_id long, start long, n_tokens long, ids_crc32 long", 4 << 20)
