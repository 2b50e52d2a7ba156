from __future__ import annotations

import random
import re
from itertools import combinations

import xxhash
from corpus_helpers import rows
from pyspark.sql import functions as F

from swellworks.llm import simhash
from swellworks.llm.components import components
from swellworks.llm.runtime import Workspace

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] * bool(w)


def fingerprint(text, k):
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, k)]
    return sum(1 << j for j in range(64) if 2 * sum(v >> j & 1 for v in h) > len(h))


def reach(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(nodes), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_query_against_brute_force(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    fp = {i: fingerprint(t, 3) for i, t in texts.items()}
    want = reach(texts, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(documents, 3, 2).collect()}
    assert got == {i: (fp[i], want[i]) for i in texts}


def test_covering_masks_leave_no_pair_out():
    for radius in (1, 2):
        masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(radius)]
        assert len(masks) == (1 << radius + 1) - 1
        assert all(any(not m & (1 << a | 1 << b) for m in masks) for a, b in combinations(range(64), 2)) or radius == 1
        assert all(any(not m >> a & 1 for m in masks) for a in range(64))


def test_large_buckets_lose_no_link(spark):
    random.seed(3)
    fps = []
    for base in [random.getrandbits(64) for _ in range(3)]:
        for _ in range(80):
            x = base
            for _ in range(random.randint(0, 6)):
                x ^= 1 << random.randrange(64)
            fps.append(x)
    want = reach(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    ws = Workspace(spark, "simhash-test")
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(fps)], "doc_id long, fp long")
    classes = ws.table(df.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    label = {r.node: r.label for r in components(simhash.links(classes, 2, ws, small=4), ws).collect()}
    rep = {r.fp: r.rep for r in classes.collect()}
    assert all(label.get(rep[r.fp], rep[r.fp]) == want[r.doc_id] for r in df.collect())


def test_components_of_odd_edges(spark):
    random.seed(10)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100 + 7 * i % 300, 99) for i in range(1, 200)]
    loose = [(random.randrange(1000, 1400), random.randrange(1000, 1400)) for _ in range(250)]
    pairs = chain + star + loose + [(5, 5), (2000, 2000), (None, 3), (4, None), (0, 1), (1, 0)]
    random.shuffle(pairs)
    ends = {x for p in pairs if None not in p and p[0] != p[1] for x in p}
    linked = {frozenset(p) for p in pairs}
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(5), Workspace(spark, "cc-test")).collect()}
    assert got == reach(ends, lambda a, b: frozenset((a, b)) in linked)
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "cc-test")).count() == 0


def test_similar_groups_against_brute_force(spark, documents):
    random.seed(4)
    base = [f"w{random.randrange(500)}" for _ in range(120)]
    more = []
    for i in range(30):
        x = base[:]
        for _ in range(random.randint(0, 3)):
            x[random.randrange(120)] = f"e{i}"
        more.append((10_000 + i, " ".join(x)))
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    sets = {r.doc_id: frozenset(shingles(r.text, 5)) for r in docs.collect()}
    want = reach(sets, lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert {r.doc_id: r.group_id for r in simhash.similar_groups(docs).collect()} == want


def test_odd_rows(odd, empty):
    got = rows(simhash.near_duplicates(odd, 3, 2), "doc_id", "component_id")
    assert len(got) == odd.count() and (None, None) in got and (3, 2) in got and (4, 2) in got and got.count((1, 1)) == 2
    assert simhash.near_duplicates(empty, 3, 2).count() == simhash.similar_groups(empty).count() == 0


def brute(docs, least=0.8):
    sets = {r.doc_id: frozenset(shingles(r.text, 5)) for r in docs.collect()}
    return reach(sets, lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))


def groups(docs, **more):
    return {r.doc_id: r.group_id for r in simhash.similar_groups(docs, **more).collect()}


def test_repeats_of_a_line_do_not_part_documents(spark):
    random.seed(5)
    made = []
    for d in range(20):
        own, line = ([f"w{random.randrange(10**6)}" for _ in range(n)] for n in (100, 8))
        made += [(2 * d, " ".join(own + line * 30)), (2 * d + 1, " ".join(own + line * 10))]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert groups(docs) == brute(docs) == {i: i - i % 2 for i in range(40)}


def test_short_documents_with_one_changed_word(spark):
    random.seed(6)
    made = []
    for d in range(400):
        x = [f"w{random.randrange(10**6)}" for _ in range(random.randint(13, 30))]
        made += [(2 * d, " ".join(x)), (2 * d + 1, " ".join([*x[:-1], "changed"] if d % 2 else ["changed", *x[1:]]))]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    want = brute(docs)
    assert groups(docs) == want and want == {i: i - i % 2 for i in range(800)}


def test_large_groups_lose_no_pair(spark):
    """Copies resemble their original only, and it isn't the smallest doc_id; another family is a chain."""
    random.seed(7)
    original, made = [f"w{random.randrange(10**6)}" for _ in range(200)], []
    for i in range(90):
        x = original[:]
        for at in random.sample(range(8, 190), 3):
            x[at] = f"e{i}x{at}"
        made.append((i if i < 40 else i + 1, " ".join(x)))
    made.append((40, " ".join(original)))
    chain = [f"c{i}" for i in range(400)]
    made += [(1000 + (i * 37) % 100, " ".join(chain[2 * i : 2 * i + 200])) for i in range(100)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    want = brute(docs)
    assert set(want.values()) == {0, 1000} and groups(docs, small=4) == groups(docs, small=64) == want
