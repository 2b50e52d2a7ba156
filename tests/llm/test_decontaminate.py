from __future__ import annotations

import random
import re

import numpy as np
from corpus_helpers import SF, rows

from swellworks.llm import decontaminate as dc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items):
    out = []
    for d, text in docs:
        w = WORD.findall(lower(text))
        for i, item in items:
            v = WORD.findall(lower(item))
            k = min(5, len(v))
            if not k:
                continue
            s = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
            n = len(s & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
            if n >= 0.8 * len(s) - 1e-9:
                out.append((d, i, n, len(s)))
    return sorted(out, key=repr)


def test_query_against_brute_force(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert rows(dc.contaminated(documents, bench), "doc_id", "item_id", "shared", "item_shingles") == want and want
    assert rows(dc.contaminated(documents, bench, block_bytes=500), "doc_id", "item_id", "shared", "item_shingles") == want


def test_planted_and_odd(spark, odd, empty):
    random.seed(8)
    prose = lambda n: " ".join(f"w{random.randrange(10_000)}" for _ in range(n))
    items = [(i, prose(random.choice([1, 3, 5, 9, 20, 40, 150]))) for i in range(40)] + [(50, None), (51, ""), (52, "one two three"), (52, "one two three"), (53, "A")]
    docs = [(i, prose(300) + " " + items[i % 40][1].upper().replace(" ", "\n", 3) + " " + prose(3000)) for i in range(40)]
    cut = items[20][1].split()
    docs += [(90, prose(50) + " " + " ".join(cut[: len(cut) * 9 // 10]) + " " + prose(50)), (91, " ".join(cut[: len(cut) // 2]))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "item_id", "shared", "item_shingles")
    assert rows(dc.contaminated(df, bench), *columns) == brute(docs, list(dict.fromkeys(items)))
    pairs = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows(dc.contaminated(odd, bench), *columns) == brute(pairs, list(dict.fromkeys(items)))
    hit = {d for d, *_ in brute(pairs, items)}
    assert {r.doc_id for r in dc.clean(odd, bench).collect()} == {d for d, _ in pairs} - hit
    clash = df.select("doc_id", "text", df.text.alias("_text"), df.text.alias("a.b"))
    assert rows(dc.contaminated(clash, bench, keep=clash.columns), *columns) == brute(docs, list(dict.fromkeys(items)))
    assert dc.clean(clash, bench).columns == clash.columns
    assert dc.contaminated(empty, bench).count() == 0 and dc.contaminated(df, bench.limit(0)).count() == 0


def test_recall_of_signatures():
    """Items of one shingle are the hardest to find, larger ones share more."""
    random.seed(9)
    word = lambda: f"w{random.randrange(100_000)}"
    for size, least in ((5, 0.999), (6, 1.0), (12, 1.0), (60, 1.0)):
        texts = [" ".join(word() for _ in range(size)) for _ in range(3000)]
        items = {i: dc.item_shingles(t) for i, t in enumerate(texts)}
        docs = [" ".join([*(word() for _ in range(random.randrange(200))), t, *(word() for _ in range(200))]).encode() for t in texts]
        offs = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        found = {f[:2] for f in dc.find(dc.build(items), items, np.frombuffer(b"".join(docs), np.uint8), offs)}
        assert sum((i, i) in found for i in range(3000)) >= least * 3000, size


def test_signatures_are_bounded():
    text = " ".join(f"w{i}" for i in range(20_000))
    part = dc.build({0: dc.item_shingles(text)})[0]
    assert [len(s.values) for s in part.signatures] == [dc.BINS] * dc.PERMUTATIONS
