"""WARC archives and their two-level capture index.

Archives are ``.warc.gz`` files, one gzip member a record.  The index keeps captures sorted by reversed-host key
(``com,example)/path``) in compressed blocks; every index file ends with a sparse directory of its blocks' first
entries.  A lookup searches the list of index files, then one directory, by bisection, and reads single blocks and
records by byte range.  The order is (key, page_id), so lookups of a very common key can be shared out by page.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from swellworks.llm.runtime import RangeReader, Workspace, map_slices, put_file, slices

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRIES = "key string, page_id long, uri string, offset long, length long, record_type string"
PARTS = "part int, uri string, first_key string, first_page long, last_key string, last_page long, entries long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
TRAILER = "<QQ8s"  # directory offset, its length, magic
MAGIC = b"CAPIDX1\n"


def reversed_host_key(url: str | None) -> str:
    """``https://www.Example.com:80/a?b`` as ``com,example)/a?b``; no url gives an empty key.

    Scheme, user, a leading ``www.`` and port go; a url without a host keeps its text behind ``)``.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return ")" + url
    if not host:
        return ")" + url.strip()
    path = parts.path or "/"
    return ",".join(reversed(host.rstrip(".").split("."))) + ")" + path + ("?" + parts.query if parts.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """The fields and payload of one record.  ValueError if it is cut off or its payload isn't what its digest says."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = lambda name: None if (x := fields[name][10:-1]) == "None" else int(x)
    out = {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_digest": digest, "payload_bytes": size, "refers_to": None, "payload": None}
    if out["record_type"] == "revisit":
        return out | {"refers_to": page("WARC-Refers-To")}
    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"record of page {out['page_id']} is damaged")
    return out | {"payload": payload}


def decide(pages: DataFrame, ws: Workspace, least: int = 1000) -> DataFrame:
    """Pages with their digest and the page that a revisit refers to.

    Of payloads of at least ``least`` bytes that occur in several rows, the largest page_id keeps the response.
    The groups are counted with partial sums and staged, so the join sees two plain sides: Spark broadcasts the
    staged one if its size allows and otherwise splits the partitions of a payload that many pages share.
    """
    html: Column = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    groups = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    keepers = ws.table(groups, "keepers")
    return rows.join(keepers, "digest", "left").withColumn("refers_to", F.when(F.col("keeper") != F.coalesce(F.col("page_id"), F.col("keeper") - 1), F.col("keeper")))


def write_archives(decided: DataFrame, ws: Workspace, date: str = "1970-01-01T00:00:00Z", target: int = 16 << 20) -> DataFrame:
    """Write the archives, list their captures.

    A file's name has the attempt's own suffix and its captures are listed by the attempt that commits, so what
    a lost or repeated task leaves behind is never referred to.
    """
    folder = ws.path("archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, at, seq, rows = TaskContext.get().partitionId(), [], 0, 0, []
        tag = uuid.uuid4().hex[:8]

        def close() -> pa.RecordBatch:
            nonlocal parts, at, seq, rows
            uri = put_file(folder, f"pages-{here:06d}-{seq:04d}-{tag}.warc.gz", parts)
            k, p, o, n, t = zip(*rows)
            out = pa.record_batch([pa.array(k), pa.array(p, pa.int64()), pa.array([uri] * len(k)), pa.array(o, pa.int64()), pa.array(n, pa.int64()), pa.array(t)], ["key", "page_id", "uri", "offset", "length", "record_type"])
            parts, at, seq, rows = [], 0, seq + 1, []
            return out

        for batch in batches:
            for piece in slices(batch, "html"):
                for page, url, html, digest, refers in zip(*(c.to_pylist() for c in piece.columns)):
                    member = record(page, url, html.encode(), digest, refers, date)
                    rows.append((reversed_host_key(url), page, at, len(member), "response" if refers is None else "revisit"))
                    parts.append(member)
                    at += len(member)
                    if at >= target:
                        yield close()
        if rows:
            yield close()

    return ws.table(decided.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, ENTRIES), "captures")


def write_index(captures: DataFrame, ws: Workspace, block: int = 1024, per_part: int = 1 << 20) -> DataFrame:
    """Sort all captures by key, write the index files and list them.  Ties of a key go by page, file and offset."""
    folder, order = ws.path("index"), ["key", "page_id", "uri", "offset"]
    parts = max(1, -(-captures.count() // per_part))
    dealt = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, out, at, directory, waiting, last, total = TaskContext.get().partitionId(), [], 0, [], [], ("", None), 0

        def flush() -> None:
            nonlocal at, waiting
            body = zlib.compress("\n".join(json.dumps(x) for x in waiting).encode(), 4)
            directory.append((*waiting[0][:2], at, len(body)))
            out.append(body)
            at, waiting = at + len(body), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                waiting.append(row)
                last, total = row[:2], total + 1
                if len(waiting) == block:
                    flush()
        if waiting:
            flush()
        if not total:
            return
        body = zlib.compress(json.dumps(directory).encode(), 4)
        uri = put_file(folder, f"captures-{here:06d}-{uuid.uuid4().hex[:8]}.idx", [*out, body, struct.pack(TRAILER, at, len(body), MAGIC)])
        row = [here, uri, *directory[0][:2], *last, total]
        types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array([v], t) for v, t in zip(row, types)], ["part", "uri", "first_key", "first_page", "last_key", "last_page", "entries"])

    return ws.table(dealt.mapInArrow(write, PARTS), "index_list")


Place = tuple[str, bool, int]


def _place(key: str, page: int | None) -> Place:
    """An entry's place in the index; nulls come first, as Spark sorts them."""
    return key, page is not None, page or 0


class CaptureIndex:
    """Lookups in the index files listed by write_index (rows of PARTS, one a file, sorted here by part)."""

    def __init__(self, parts: list[tuple]):
        self.parts = sorted(parts)
        self.firsts, self.lasts = [_place(*p[2:4]) for p in self.parts], [_place(*p[4:6]) for p in self.parts]
        self.read = RangeReader()
        self._directory: tuple[str, list[Place], list[tuple[int, int]]] = ("", [], [])
        self._block: tuple[str, int, list[Place], list[list]] = ("", -1, [], [])

    def directory(self, uri: str) -> tuple[list[Place], list[tuple[int, int]]]:
        """(first entries, byte ranges) of a file's blocks; the last file's are kept."""
        if uri != self._directory[0]:
            size = self.read.size(uri)
            tail = struct.calcsize(TRAILER)
            at, n, magic = struct.unpack(TRAILER, self.read(uri, size - tail, tail))
            if magic != MAGIC:
                raise ValueError(f"{uri} is no capture index")
            rows = json.loads(zlib.decompress(self.read(uri, at, n)))
            self._directory = uri, [_place(*r[:2]) for r in rows], [tuple(r[2:]) for r in rows]
        return self._directory[1:]

    def block(self, uri: str, at: int, n: int) -> tuple[list[Place], list[list]]:
        """(places, entries) of a block; the last one is kept."""
        if (uri, at) != self._block[:2]:
            rows = [json.loads(x) for x in zlib.decompress(self.read(uri, at, n)).split(b"\n")]
            self._block = uri, at, [_place(*r[:2]) for r in rows], rows
        return self._block[2:]

    def between(self, low: Place, high: Place) -> Iterator[list]:
        """All entries from one place to another, both included: two bisections, then a block at a time."""
        for p in range(bisect_left(self.lasts, low), bisect_right(self.firsts, high)):
            uri = self.parts[p][1]
            firsts, ranges = self.directory(uri)
            for at, n in ranges[max(0, bisect_left(firsts, low) - 1) : bisect_right(firsts, high)]:
                places, rows = self.block(uri, at, n)
                yield from rows[bisect_left(places, low) : bisect_right(places, high)]

    def lookup(self, url: str | None) -> list[list]:
        """All captures of a url: rows of key, page_id, uri, offset, length, record_type."""
        key = reversed_host_key(url)
        return list(self.between((key, False, 0), (key, True, 1 << 64)))

    def lookup_page(self, url: str | None, page: int | None) -> Iterator[list]:
        """The captures of a url that a page has."""
        place = _place(reversed_host_key(url), page)
        return self.between(place, place)

    def fetch(self, capture: list) -> dict:
        """The record of a capture, by one range read."""
        return parse(self.read(capture[2], capture[3], capture[4]))


def captures_of(pages: DataFrame, parts: DataFrame, per_task: int = 1 << 16) -> DataFrame:
    """Every page's captures, each found in the index by bisection of its url's key and its page_id.

    Lookups are dealt out by ranges of that order, so a task meets a few index files only and neighbours share blocks; a
    url that many pages share is spread over tasks.  What travels to them is one row an index file (a million captures).
    """
    listed = parts.sparkSession.sparkContext.broadcast([tuple(r) for r in parts.toLocalIterator()])

    def key(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array([reversed_host_key(u) for u in piece.column(1).to_pylist()]), piece.column(0)], ["key", "page_id"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, found = CaptureIndex(listed.value), []
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        out = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), types)], ["key", "page_id", "uri", "offset", "length", "record_type"])
        for batch in batches:
            for place in map(_place, *(c.to_pylist() for c in batch.columns)):
                for row in index.between(place, place):
                    found.append(row)
                    if len(found) == 4096:
                        yield out()
                        found = []
        if found:
            yield out()
        index.read.close()

    wanted = map_slices(pages.select("page_id", "url"), "url", key, "key string, page_id long")
    ws = Workspace(pages.sparkSession, "lookups")
    asked = ws.table(wanted.distinct(), "asked")
    tasks = max(1, -(-asked.count() // per_task))
    return asked.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(find, ENTRIES)


def read_records(captures: DataFrame, ws: Workspace, target: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """Range-read the records of captures, neighbours of a file together."""
    found = ws.table(captures.select("uri", "offset", "length"), "to_read")
    total = found.agg(F.sum("length")).first()[0] or 0
    dealt = found.repartitionByRange(max(1, -(-total // target)), "uri", "offset").sortWithinPartitions("uri", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = RangeReader()
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

        for batch in batches:
            for uri, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                row = parse(get(uri, at, n))
                if not payloads:
                    row["payload"] = None
                rows.append(row)
                held += 200 + len(row["payload"] or b"")
                if held > 2 << 20:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()
        get.close()

    return dealt.mapInArrow(read, READ)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives, index them, look every page's url up in the index and read its record back.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url.  Null html is an empty payload,
    a null url is kept out of its record (key ''), a null page_id is never a keeper.  Repeated rows give a record
    each; rows that share the keeper's page_id are responses too.  An empty table gives an empty result.
    """
    ws = Workspace(pages.sparkSession, "warc")
    captures = write_archives(decide(pages, ws), ws)
    parts = write_index(captures, ws)
    return read_records(captures_of(pages, parts), ws, payloads=False).drop("payload")
