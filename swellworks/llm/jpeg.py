"""Media columns: baseline JPEG written and read with numpy.

``encode_payload`` keeps bytes losslessly as quantised DCT coefficients of a 4:4:4 baseline JPEG (one byte a
coefficient, in zigzag order; the format's unit instead of samples, which JPEG would round).  Its Huffman
tables give every coefficient 16 bits in all, so a scan turns into coefficients by one table lookup for
each.  ``decode`` reads any baseline JPEG (own tables, subsampling, restart intervals, zero runs): scans
whose tables have no such constant width go through a bit reader.  ``thumbnail`` needs the luminance DC only.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from swellworks.llm.runtime import Workspace, map_slices, utf8

UNIT = 192
WIDTH = 16  # bits of Huffman code and extra bits together, for each coefficient


def _tables(sizes: list[int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A DHT body and {size: (code, length)}: the size-s category has a code of WIDTH - s bits."""
    counts, codes, code, last = [0] * 16, {}, 0, 0
    for s in sorted(sizes, reverse=True):
        n = WIDTH - s
        code = (code + 1) << (n - last) if codes else 0
        codes[s], last = (code, n), n
        counts[n - 1] += 1
    return bytes(counts) + bytes(sorted(sizes, reverse=True)), codes


def _fields(values: np.ndarray, codes: dict[int, tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(values), np.uint16)
    for i, v in enumerate(values.tolist()):
        s = abs(v).bit_length()
        code, _ = codes[s]
        out[i] = code << s | (v if v >= 0 else v + (1 << s) - 1)
    return out.astype(">u2")


AC_BODY, _AC = _tables(list(range(1, 9)))
DC_BODY, _DC = _tables(list(range(10)))
LEVEL = np.where(np.arange(256) < 128, np.arange(256) - 128, np.arange(256) - 127).astype(np.int16)  # never zero
AC_FIELD, DC_FIELD = _fields(LEVEL, _AC), _fields(np.arange(-256, 257), _DC)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


_QUANT = _segment(0xDB, bytes([0]) + bytes([8] + [1] * 63))
_HUFF = _segment(0xC4, b"\x00" + DC_BODY) + _segment(0xC4, b"\x10" + AC_BODY)
_SCAN = _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


def padded(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of UNIT bytes."""
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def encode_payload(payload: bytes) -> bytes:
    """A JPEG that holds a payload of a positive multiple of UNIT bytes; a COM segment has its length."""
    mcus = len(payload) // UNIT
    wide = max(1, min(8191, math.isqrt(mcus)))
    high = -(-mcus // wide)
    v = np.full(wide * high * UNIT, 0x20, np.uint8)
    v[: len(payload)] = np.frombuffer(payload, np.uint8)
    dc = np.zeros((wide * high + 1, 3), np.int16)
    dc[1:] = LEVEL[v[::64]].reshape(-1, 3)
    fields = AC_FIELD[v].reshape(-1, 64)
    fields[:, 0] = DC_FIELD[np.diff(dc, axis=0).ravel() + 256]
    data = fields.tobytes()
    if b"\xff" in data:
        data = data.replace(b"\xff", b"\xff\x00")
    frame = bytes([8]) + (high * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + bytes([3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(payload)) + _QUANT + _segment(0xC0, frame) + _HUFF + _SCAN + data + b"\xff\xd9"


class Huffman:
    """One table of a DHT segment: 16-bit lookahead to (code length, symbol)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length, self.symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code, k = 0, 0
        for n, c in enumerate(counts, 1):
            for _ in range(c):
                a, b = code << (16 - n), (code + 1) << (16 - n)
                self.length[a:b], self.symbol[a:b] = n, symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        used = [(n, s) for n, s in zip((n for n, c in enumerate(counts, 1) for _ in range(c)), symbols)]
        self.runs = any(s >> 4 for _, s in used)
        self.sizes = {s for _, s in used}
        self.constant = bool(used) and all(n + (s & 15) == WIDTH for n, s in used)
        self._values = None

    @property
    def values(self) -> np.ndarray:
        """The coefficient of every 16-bit field, for a table of constant width."""
        if self._values is None:
            s = self.symbol.astype(np.int32)
            raw = np.arange(1 << 16, dtype=np.int32) & ((1 << s) - 1)
            self._values = np.where((s > 0) & (raw < (1 << np.maximum(s - 1, 0))), raw - (1 << s) + 1, raw).astype(np.int16)
        return self._values


_KNOWN: dict[bytes, Huffman] = {}


def _huffman(body: bytes) -> Huffman:
    if body not in _KNOWN:
        if len(_KNOWN) > 64:
            _KNOWN.clear()
        _KNOWN[body] = Huffman(body[:16], body[16:])
    return _KNOWN[body]


@dataclass
class Component:
    h: int
    v: int
    quant: int
    dc: str = ""
    ac: str = ""
    blocks: tuple[int, int] = (0, 0)
    coefficients: np.ndarray = field(default_factory=lambda: np.empty((0, 64), np.int16))  # zigzag order, DC undone


@dataclass
class Image:
    width: int = 0
    height: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    components: dict[int, Component] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


def decode(data: bytes) -> Image:
    """Markers and coefficients of a baseline JPEG.  ValueError says what is malformed or not baseline."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    image, tables, restart, at = Image(), {}, 0, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _huffman(body[1:n])
                body = body[n:]
        elif marker == 0xC0:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for c in range(body[5]):
                name, hv, q = body[6 + 3 * c : 9 + 3 * c]
                image.components[name] = Component(hv >> 4, hv & 15, q)
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError(f"frame type {marker:#x} is not baseline")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            names = []
            for c in range(body[0]):
                name, t = body[1 + 2 * c], body[2 + 2 * c]
                comp = image.components[name]
                comp.dc, comp.ac = tables[0, t >> 4], tables[1, t & 15]
                names.append(name)
            at = _scan(data, at, image, names, restart)
    return image


def _scan_end(data: bytes, at: int) -> int:
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return len(data)
        if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def _scan(data: bytes, at: int, image: Image, names: list[int], restart: int) -> int:
    end = _scan_end(data, at)
    comps = [image.components[n] for n in names]
    hmax, vmax = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
    alone = len(comps) == 1
    for c in comps:
        w, h = -(-image.width * c.h // hmax), -(-image.height * c.v // vmax)
        c.blocks = (-(-h // 8), -(-w // 8)) if alone else (-(-image.height // (8 * vmax)) * c.v, -(-image.width // (8 * hmax)) * c.h)
        c.coefficients = np.zeros((c.blocks[0] * c.blocks[1], 64), np.int16)
    mcu_w, mcu_h = (comps[0].blocks[1], comps[0].blocks[0]) if alone else (-(-image.width // (8 * hmax)), -(-image.height // (8 * vmax)))
    total = mcu_w * mcu_h
    flat = not restart and all(c.dc.constant and c.ac.constant and not c.ac.runs and 0 not in c.ac.sizes for c in comps) and (alone or all(c.h == c.v == 1 for c in comps))
    if flat:
        body = data[at:end]
        if b"\xff" in body:
            body = body.replace(b"\xff\x00", b"\xff")
        if len(body) != total * len(comps) * 128:
            raise ValueError("the scan is cut off")
        fields = np.frombuffer(body, ">u2").astype(np.uint16).reshape(total, len(comps), 64)
        for k, c in enumerate(comps):
            c.coefficients = c.ac.values[fields[:, k]]
            c.coefficients[:, 0] = np.cumsum(c.dc.values[fields[:, k, 0]], dtype=np.int64)
        return end
    parts, a = [], at
    while restart and (b := next((i for i in range(a, end - 1) if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7), -1)) >= 0:
        parts.append(data[a:b])
        a = b + 2
    parts.append(data[a:end])
    mcu = 0
    for part in parts:
        bits, pred = _Bits(part.replace(b"\xff\x00", b"\xff")), [0] * len(comps)
        for _ in range(min(restart or total, total - mcu)):
            row, col = divmod(mcu, mcu_w)
            for k, c in enumerate(comps):
                for y in range(1 if alone else c.v):
                    for x in range(1 if alone else c.h):
                        block = c.coefficients[(row * (1 if alone else c.v) + y) * c.blocks[1] + col * (1 if alone else c.h) + x]
                        pred[k] += bits.value(bits.symbol(c.dc) & 15)
                        block[0], i = pred[k], 1
                        while i < 64:
                            s = bits.symbol(c.ac)
                            if s == 0:
                                break
                            i += s >> 4
                            if s & 15:
                                if i > 63:
                                    raise ValueError("a run leaves its block")
                                block[i] = bits.value(s & 15)
                            i += 1
            mcu += 1
    if mcu < total:
        raise ValueError("the scan is cut off")
    return end


class _Bits:
    """Bits of an entropy-coded part, most significant first; ones follow the last."""

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data + b"\xff" * 8, 0, 0, 0

    def _fill(self, need: int) -> None:
        while self.n < need:
            if self.at >= len(self.data):
                raise ValueError("the scan is cut off")
            self.acc = (self.acc << 8 | self.data[self.at]) & (1 << 40) - 1
            self.at, self.n = self.at + 1, self.n + 8

    def symbol(self, table: Huffman) -> int:
        self._fill(16)
        look = self.acc >> (self.n - 16) & 0xFFFF
        n = int(table.length[look])
        if not n:
            raise ValueError("no such Huffman code")
        self.n -= n
        return int(table.symbol[look])

    def value(self, size: int) -> int:
        if not size:
            return 0
        self._fill(size)
        self.n -= size
        raw = self.acc >> self.n & (1 << size) - 1
        return raw if raw >> (size - 1) else raw - (1 << size) + 1


def stored_payload(image: Image) -> bytes:
    """What encode_payload was given."""
    n = next(int(c[8:]) for c in image.comments if c.startswith(b"payload "))
    v = np.stack([c.coefficients for c in image.components.values()], axis=1).reshape(-1)[:n]
    return (v + np.where(v < 0, 128, 127)).astype(np.uint8).tobytes()


def thumbnail(image: Image) -> np.ndarray:
    """Luminance at an eighth of the size, from the first component's DC coefficients alone."""
    y = next(iter(image.components.values()))
    dc = y.coefficients[:, 0].astype(np.float32) * image.quant[y.quant][0] / 8 + 128
    return np.clip(dc, 0, 255).reshape(y.blocks)


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 cell means is below that of its right neighbour, over a 8 x 9 grid."""
    h, w = pixels.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = pixels.astype(np.float64).cumsum(0).cumsum(1)

    def cells(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        lo = np.arange(k) * n // k
        return lo, np.maximum(lo + 1, np.arange(1, k + 1) * n // k)

    (r0, r1), (c0, c1) = cells(h, 8), cells(w, 9)
    mean = (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / np.outer(r1 - r0, c1 - c0)
    return int.from_bytes(np.packbits((mean[:, :-1] + 1e-9 < mean[:, 1:]).ravel()).tobytes(), "big")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column of every row's whole text: (id, n_bytes, media).  Null text counts as empty."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = utf8(piece.column(1))
        media = [encode_payload(padded(buf[a:b].tobytes())) for a, b in zip(offs[:-1], offs[1:])]
        return pa.record_batch([piece.column(0), pa.array(np.diff(offs)), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    rows = docs.select(id_col, text_col)
    return map_slices(rows, text_col, work, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, n_bytes long, media binary", 4 << 20)


def describe(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode every stored JPEG and return digests, dimensions and the thumbnail hash.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, width, height,
    thumb_hash and feature (``<width>x<height>:<hash>``).
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = utf8(piece.column(2))
        rows = []
        for a, b in zip(offs[:-1], offs[1:]):
            data = buf[a:b].tobytes()
            image = decode(data)
            payload = stored_payload(image)
            thumb = f"{difference_hash(thumbnail(image)):016x}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), image.width, image.height, thumb, f"{image.width}x{image.height}:{thumb}"))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.record_batch([piece.column(0), piece.column(1), *cols], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "thumb_hash", "feature"])

    kind = media.schema[id_col].dataType.simpleString()
    return map_slices(media.select(id_col, "n_bytes", "media"), "media", work, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumb_hash string, feature string", 8 << 20)


def media_features(docs: DataFrame) -> DataFrame:
    """Write every text's JPEG to a media table in the shared store, read it back and describe it.

    Repeated rows stay rows; an empty table gives an empty result; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "media")
    return describe(ws.table(store_texts(docs), "jpeg"))
