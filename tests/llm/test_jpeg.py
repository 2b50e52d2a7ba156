from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pytest
from corpus_helpers import rows

from swellworks.llm import jpeg


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 5000, 100_000])
def test_payload_round_trip(size):
    payload = jpeg.padded(os.urandom(size))
    image = jpeg.decode(jpeg.encode_payload(payload))
    assert len(payload) % 192 == 0 and len(payload) >= 192 and jpeg.stored_payload(image) == payload
    assert jpeg.thumbnail(image).shape == (image.height // 8, image.width // 8)


def test_bit_reader_agrees_with_lookup():
    data = jpeg.encode_payload(jpeg.padded(os.urandom(3000)))
    fast = jpeg.decode(data)
    known = dict(jpeg._KNOWN)
    try:
        for t in jpeg._KNOWN.values():
            t.constant = False
        slow = jpeg.decode(data)
    finally:
        jpeg._KNOWN.clear()
    assert known and all((fast.components[c].coefficients == slow.components[c].coefficients).all() for c in fast.components)


def bits(*fields):
    text = "".join(f"{v:0{n}b}" for v, n in fields)
    text += "1" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")


def gray(scan, width, height, restart=0):
    """A one-component file with common tables: DC sizes 0-3 as 00 01 10 110; AC 0/0 as 00, 0/1 as 01, 1/2 as 10, 15/0 as 110."""
    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    counts = bytes([0, 3, 1] + [0] * 13)
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0" + bytes(9)) + seg(0xDB, bytes([0]) + bytes([4] * 64)) + seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    head += seg(0xC4, b"\x00" + counts + bytes([0, 1, 2, 3])) + seg(0xC4, b"\x10" + counts + bytes([0x00, 0x01, 0x12, 0xF0]))
    return head + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def test_runs_ends_and_restarts():
    # two blocks: DC +3, AC[2] = -3 after one zero, AC[19] = +1 after ZRL, end; then DC difference -1, end
    first = [(0b10, 2), (0b11, 2), (0b10, 2), (0b00, 2), (0b110, 3), (0b01, 2), (1, 1), (0b00, 2)]
    image = jpeg.decode(gray(bits(*first, (0b01, 2), (0, 1), (0b00, 2)), 16, 8))
    c = image.components[1].coefficients
    assert c[0, 0] == 3 and c[0, 2] == -3 and c[0, 19] == 1 and np.count_nonzero(c[0]) == 3 and c[1, 0] == 2
    assert jpeg.thumbnail(image).tolist() == [[3 * 4 / 8 + 128, 2 * 4 / 8 + 128]]
    again = jpeg.decode(gray(bits(*first) + b"\xff\xd0" + bits((0b01, 2), (0, 1), (0b00, 2)), 16, 8, restart=1))
    assert again.components[1].coefficients[1, 0] == -1


def test_malformed():
    good = jpeg.encode_payload(jpeg.padded(b"x"))
    for bad in (b"", b"GIF", good[:-40], good.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises((ValueError, KeyError)):
            jpeg.decode(bad)


def test_query(documents, odd, empty):
    for docs in (documents, odd):
        got = rows(jpeg.media_features(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
        want = []
        for r in docs.collect():
            p = jpeg.padded((r.text or "").encode())
            want.append((r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
        assert got == sorted(want, key=repr)
    assert jpeg.media_features(empty).count() == 0


def plain_feature(payload):
    """Dimensions and thumbnail hash from the payload: every third 64-byte run starts with a luminance DC coefficient."""
    mcus = len(payload) // 192
    wide = max(1, min(8191, int(mcus**0.5)))
    high = -(-mcus // wide)
    dc = [b - 128 if b < 128 else b - 127 for b in payload[::192]] + [0x20 - 128] * (wide * high - mcus)
    pixel = [[min(255, max(0, dc[y * wide + x] + 128)) for x in range(wide)] for y in range(high)]

    def mean(r, c):
        ys = range(r * high // 8, max(r * high // 8 + 1, (r + 1) * high // 8))
        xs = range(c * wide // 9, max(c * wide // 9 + 1, (c + 1) * wide // 9))
        return sum(pixel[y][x] for y in ys for x in xs) / (len(ys) * len(xs))

    value = 0
    for r in range(8):
        for c in range(8):
            value = value << 1 | (mean(r, c) + 1e-9 < mean(r, c + 1))
    return f"{wide * 8}x{high * 8}:{value:016x}"


def test_features_of_the_query(documents, odd):
    for docs in (documents, odd):
        want = sorted(((r.doc_id, plain_feature(jpeg.padded((r.text or "").encode()))) for r in docs.collect()), key=repr)
        assert rows(jpeg.media_features(docs), "doc_id", "feature") == want


def test_stored_forms_by_the_bit_reader(documents):
    """What the query stores decodes alike bit by bit, code after code."""
    for r in documents.limit(12).collect():
        data = jpeg.encode_payload(jpeg.padded((r.text or "").encode()[:20_000]))
        fast = jpeg.decode(data)
        try:
            for t in jpeg._KNOWN.values():
                t.constant = False
            slow = jpeg.decode(data)
        finally:
            jpeg._KNOWN.clear()
        assert jpeg.stored_payload(slow) == jpeg.stored_payload(fast) and (jpeg.thumbnail(slow) == jpeg.thumbnail(fast)).all()
