from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from corpus_helpers import rows
from tokenizers import Tokenizer

from swellworks.llm import bpe, token_files

WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["'", "s", "t", "re", "ll", "A", "É", "é", " ", "́", "  ", "\n", "\t", "1", "２", "!", "?", " ", "　", "漢", "😀", "\r\n", "\x1c", "\x85", "_", "​", "J", "̌", "İ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", ",", "a.b"]


def texts(n, seed=2):
    random.seed(seed)
    return ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 30))) for _ in range(n)] + ["", "a" * 3000, "!" * 500]


def flat(strings):
    data = [s.encode() for s in strings]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library():
    return Tokenizer.from_file(WORDS)


def regular(n, a="a", b="b"):
    """Words whose polynomials modulo 2^64 are those of their mirror image, whatever the odd base."""
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


def test_bpe_equals_library():
    enc, own, strings = encoding(), bpe.Ranks(bpe.read_vocabulary(RANKS)), texts(3000)
    ids, first, at = own.encode(*flat(strings))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [enc.encode_ordinary(s) for s in strings]
    assert own.decode(ids).tobytes() == flat(strings)[0].tobytes()
    assert (np.diff(np.append(at, len(flat(strings)[0]))) == own.sizes[ids]).all()


def test_word_chunks_equal_library():
    lib, own, strings = library(), token_files.WordTokenizer(open(WORDS, "rb").read()), texts(3000)
    ids, first = own.encode(*flat(strings))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [lib.encode(s, add_special_tokens=False).ids for s in strings]


def test_unequal_words_of_equal_polynomials():
    strings = [x + regular(n, *ab) for n in (512, 1024, 2048) for ab in ("ab", "ba") for x in ("", "abcdefgh")] + ["é" * k + "x" for k in range(40)] + ["a\0", "a", "a\0\0"]
    enc, own, lib, words_ = encoding(), bpe.Ranks(bpe.read_vocabulary(RANKS)), library(), token_files.WordTokenizer(open(WORDS, "rb").read())
    for _ in range(2):
        ids, first, _ = own.encode(*flat(strings))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [enc.encode_ordinary(s) for s in strings]
        ids, first = words_.encode(*flat(strings))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [lib.encode(s, add_special_tokens=False).ids for s in strings]


def test_equal_hashes_are_not_equal_pieces(monkeypatch):
    from swellworks.llm import piece_cache

    monkeypatch.setattr(piece_cache, "mix", lambda h: h * np.uint64(0) + np.uint64(5))
    own, strings = bpe.Ranks(bpe.read_vocabulary(RANKS)), texts(60)
    ids, first, _ = own.encode(*flat(strings))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [encoding().encode_ordinary(s) for s in strings]


def test_full_cache_changes_nothing(monkeypatch):
    own, strings = bpe.Ranks(bpe.read_vocabulary(RANKS)), texts(400)
    want = own.encode(*flat(strings))[0]
    own.cache.bits = 6
    own.cache.clear()
    assert (own.encode(*flat(strings))[0] == want).all()
    monkeypatch.setattr("swellworks.llm.piece_cache.LONG_BYTES", 100)
    for a in range(0, 400, 50):
        assert (own.encode(*flat(strings[a : a + 50]))[0] == bpe.Ranks.encode(bpe.Ranks(bpe.read_vocabulary(RANKS)), *flat(strings[a : a + 50]))[0]).all()


def test_packing():
    r = np.random.default_rng(0)
    v = r.integers(0, 2**32, 1001, dtype=np.uint32) >> r.integers(0, 32, 1001).astype(np.uint32)
    first = np.array([0, 0, 3, 7, 7, 500, 1001])
    blocks = token_files.pack(v, first)
    at = np.cumsum([0, *map(len, blocks)])[:-1]
    assert (token_files.unpack(np.frombuffer(b"".join(blocks), np.uint8), at, np.diff(first)) == v).all()


def test_token_files_round_trip(spark, documents, odd, empty):
    lib = library()
    for docs in (documents, odd.where("doc_id IS NOT NULL")):
        start, want = 0, []
        for i, text in sorted((r.doc_id, r.text or "") for r in docs.collect()):
            ids = lib.encode(text, add_special_tokens=False).ids + [2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert rows(token_files.with_digest(token_files.encode_corpus(docs, WORDS, shard_bytes_target=1 << 16))) == sorted(want, key=repr)
    assert token_files.encode_corpus(empty, WORDS).count() == 0


def test_bpe_queries(documents, odd, empty):
    enc = encoding()
    for docs in (documents, odd):
        want = []
        for r in docs.collect():
            ids = enc.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert rows(bpe.digests(docs, RANKS)) == sorted(want, key=repr)
    assert bpe.digests(empty, RANKS).count() == 0
    one = bpe.encode_texts(odd, RANKS).where("doc_id = 6").first()
    data = odd.where("doc_id = 6").first().text.encode()
    own = bpe.Ranks(bpe.read_vocabulary(RANKS))
    assert own.decode(np.array(one.ids[3:])).tobytes() == data[one.offsets[3] :]


def test_token_files_of_a_common_id(spark, monkeypatch):
    """Most rows share a doc_id: they lie in several parts and files, and starts run on over all."""
    monkeypatch.setattr(token_files, "GROUP", 2)
    made = [(7, f"some words {i % 50} here") for i in range(400)] + [(i, "x" * (i % 9)) for i in range(30)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    out = token_files.encode_corpus(df, WORDS, shard_bytes_target=200).collect()
    lib = library()
    assert sorted((r.doc_id, r.ids) for r in out) == sorted((i, np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in made)
    out.sort(key=lambda r: r.start)
    assert [r.start for r in out] == np.cumsum([0, *(r.n_tokens for r in out)])[:-1].tolist()
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in out)
