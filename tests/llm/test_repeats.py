from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus_helpers import rows

from swellworks.llm import rlz, suffix

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_removed(docs, k=13):
    own = [(i, WORD.findall((t or "").encode())) for i, t in docs]
    first = {}
    for i, w in own:
        if i is not None:
            for j in range(len(w) - k + 1):
                first[tuple(w[j : j + k])] = min(first.get(tuple(w[j : j + k]), i), i)
    out = []
    for i, w in own:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def bytes_removed(docs, n):
    count, out = Counter(), []
    for _, t in docs:
        b = (t or "").encode()
        count.update(b[j : j + n] for j in range(len(b) - n + 1))
    for i, t in docs:
        b = (t or "").encode()
        gone, end = bytearray(len(b)), 0
        for j in range(len(b) - n + 1):
            if count[b[j : j + n]] > 1:
                gone[max(j, end) : j + n] = b"\1" * (j + n - max(j, end))
                end = j + n
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def later_bytes_removed(docs, n):
    """Bytes of windows that start earlier too: places in order of id, hash of the text (given with it) and byte."""
    first, out = {}, []
    for i, h, t in sorted(docs, key=lambda x: (-(1 << 63) if x[0] is None else x[0], x[1])):
        b = (t or "").encode()
        gone, end = bytearray(len(b)), 0
        for j in range(len(b) - n + 1):
            w = b[j : j + n]
            if first.setdefault(w, (i, h, j)) != (i, h, j):  # documents come in order, so whoever came first is earlier
                gone[max(j, end) : j + n] = b"\1" * (j + n - max(j, end))
                end = j + n
        out.append((i, len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_rlz_real_texts(documents, odd, empty):
    for docs in (documents, odd):
        assert rows(rlz.removed(docs)) == words_removed(pairs(docs))
    assert rlz.removed(empty).count() == 0


def test_rlz_small_alphabet_and_edits(spark):
    random.seed(5)
    docs = [(i // 2, "  ".join(random.choice("ab") for _ in range(random.randint(0, 60)))) for i in range(40)]
    base = [f"w{i}" for i in range(300)]
    for i in range(40):
        x = base[:]
        for _ in range(random.randint(0, 12)):
            x[random.randrange(300)] = f"e{random.randrange(5)}"
        a = random.randrange(200)
        docs.append((100 + i, "\t".join(x[a : a + random.randint(5, 300)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(rlz.removed(df)) == words_removed(docs)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(t.split())
    for f in rlz.parse(df).collect():  # every factor stands at its source
        assert f.src_doc < f.doc_id and f.n_words >= 13
        piece = {tuple(w[f.start_word : f.start_word + f.n_words]) for w in texts[f.doc_id]}
        assert any(tuple(w[f.src_word : f.src_word + f.n_words]) in piece for w in texts[f.src_doc])


def test_rlz_unequal_words_of_equal_polynomials(spark):
    mirror = lambda n, a, b: "".join(b if bin(i).count("1") & 1 else a for i in range(n))
    docs = [(i, " ".join([*(f"w{j}" for j in range(6)), mirror(1024, *ab), *(f"w{j}" for j in range(6, 12))])) for i, ab in enumerate(["ab", "ba", "ab"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(rlz.removed(df)) == words_removed(docs)
    assert [r[2] for r in words_removed(docs)] == [0, 0, 13]


def test_rlz_factors_follow_the_reference():
    ref = [b"%d" % i for i in range(200)]
    blocks = {(1, k): {7: ref[64 * k : 64 * k + 64]} for k in range(4)}
    own = ref[50:140] + [b"x"] + ref[141:160]
    runs = np.array([[0, 20, 1, 50], [91, 7, 1, 141]])  # factors go on past the index's answers, over blocks
    assert rlz.factors(own, runs, blocks) == [(0, 90, 1, 50), (91, 19, 1, 141)]
    assert rlz.factors(own, np.array([[0, 5, 1, 51]]), blocks) == []  # an answer whose words differ is none
    assert rlz.factors(own, np.array([[0, 78, 2, 0]]), blocks) == []


def test_rlz_texts_of_one_id(spark):
    base = [f"w{i}" for i in range(400)]
    docs = [(1, " ".join(base[:150])), (1, " ".join(base[150:300])), (2, " ".join(base[100:200])), (2, " ".join(base[140:290])), (3, " ".join(base[20:280])), (3, " ".join(base[20:280]))]
    assert rows(rlz.removed(spark.createDataFrame(docs, "doc_id long, text string"))) == words_removed(docs)


def test_suffix_real_texts(documents, odd, empty):
    for docs in (documents, odd):
        assert rows(suffix.without_repeats(docs)) == bytes_removed(pairs(docs), 400)
    assert suffix.without_repeats(empty).count() == 0


@pytest.mark.parametrize(("length", "gram", "group"), [(60, 30, 256), (60, 30, 3), (40, 12, 2)])
def test_suffix_edits(spark, length, gram, group):
    random.seed(6)
    base, docs = "".join(random.choice("abcdé \n") for _ in range(900)), []
    for i in range(60):
        x = list(base)
        for _ in range(random.randint(0, 30)):
            x[random.randrange(900)] = random.choice("xyz")
        a = random.randrange(700)
        docs.append((i, "".join(x[a : a + random.randint(5, 900)])))
    docs += [(None, base[:300]), (None, base[100:400]), (5, None), (6, ""), (7, "ab" * 200), (8, "a" * 300), (9, "a" * 100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(suffix.without_repeats(df, length, gram, group)) == bytes_removed(docs, length)


def test_cleaned_text(spark, odd):
    docs = spark.createDataFrame([(1, "é" * 300 + "tail", "x", 3), (2, "b" + "é" * 300, "y", 4), (3, "alone", None, 5)], "doc_id long, text string, start string, n_bytes int")
    assert rows(suffix.cleaned(docs, 60, 30)) == [(1, "tail", "x", 3), (2, "b", "y", 4), (3, "alone", None, 5)]
    assert suffix.cleaned(odd).columns == odd.columns
    names = ["text", "_text", "d", "_d", "t", "_t", "size", "_size", "start", "a.b"]
    clash = docs.select("doc_id", *[docs.text.alias(n) for n in names])
    assert rows(suffix.cleaned(clash, 60, 30).select("doc_id", "text")) == [(1, "tail"), (2, "b"), (3, "alone")]


def test_suffix_common_passage_and_copies(spark):
    """A passage in most texts, many exact copies, and unequal passages whose polynomials are equal."""
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    passage, copy = " ".join(word() for _ in range(70)), " ".join(word() for _ in range(100))
    docs = [(i, " ".join(word() for _ in range(random.randint(1, 60))) + passage[random.randrange(20) :] + word()) for i in range(150)]
    docs += [(200 + i, copy) for i in range(150)] + [(400, copy[:399]), (401, passage[:400]), (402, "x" + passage[:399] + "y")]
    docs += [(500 + i, "".join(b if bin(j).count("1") & 1 else a for j in range(1024))) for i, (a, b) in enumerate(["ab", "ba"])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    for group in (256, 4):
        assert rows(suffix.without_repeats(df, group=group)) == bytes_removed(docs, 400)


def test_intervals():
    #                      banana's suffixes a, ana, anana, banana, na, nana
    assert sorted(suffix.intervals([1, 3, 0, 0, 2])) == [(0, 0, 5), (1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 1000)
    random.seed(7)
    buf = np.frombuffer(("".join(random.choice("abc") for _ in range(5000)) * 2).encode(), np.uint8)
    cut = suffix.anchor_runs(buf, np.array([0, len(buf)]), 60, 30)
    monkeypatch.setattr(suffix, "PIECE", 1 << 22)
    whole = suffix.anchor_runs(buf, np.array([0, len(buf)]), 60, 30)
    windows = lambda r: sorted((int(f) + k, int(h), int(p)) for h, p, f, n in zip(*r[1:5]) for k in range(n))
    assert windows(cut) == windows(whole)


def test_rlz_places(spark):
    """Ids too far apart for one number give what near ones give."""
    base = " ".join(f"w{i}" for i in range(60))
    for ids in ((-5, 3, 4), (-(1 << 63), 0, (1 << 63) - 1), (7, 8, 9)):
        docs = [(i, f"x{k} {base} y{k}") for k, i in enumerate(ids)]
        assert rows(rlz.removed(spark.createDataFrame(docs, "doc_id long, text string"))) == words_removed(docs)


@pytest.mark.parametrize("group", [256, 3])
def test_suffix_keeps_the_first(spark, group):
    random.seed(11)
    base, docs = "".join(random.choice("abcdé \n") for _ in range(900)), []
    for i in range(70):
        x = list(base)
        for _ in range(random.randint(0, 30)):
            x[random.randrange(900)] = random.choice("xyz")
        a = random.randrange(700)
        docs.append((i // 2, "".join(x[a : a + random.randint(5, 900)])))
    docs += [(None, base[:300]), (50, base[100:400]), (51, base[100:400]), (51, base[100:400]), (7, None), (8, ""), (90, "ab" * 200), (91, "a" * 300), (92, "a" * 100), (-4, base)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    hashed = [(r.doc_id, r.h, r.text) for r in df.selectExpr("doc_id", "xxhash64(text) AS h", "text").collect()]
    got = rows(suffix.without_repeats(df, 60, 30, group, keep_first=True).drop("n_spans"))
    assert got == later_bytes_removed(hashed, 60)
    kept = suffix.cleaned(df, 60, 30, group, keep_first=True).where("doc_id = -4").first().text
    assert 0 < len(kept) < len(base)  # a null id comes before, and has some of it
