from __future__ import annotations

import corpus_pipeline
from corpus_helpers import SF

from swellworks.llm import simhash


def test_stages_keep_columns_and_take_effect(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == documents.columns, name
        kept = out.collect()
        assert {r.doc_id for r in kept} <= {r.doc_id for r in docs.select("doc_id").collect()} and len(kept) <= docs.count()
        docs = spark.createDataFrame(kept, documents.schema)
    groups = simhash.similar_groups(documents)
    assert groups.where("doc_id <> group_id").count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and all(r.n_tokens == len(r.ids) for r in last.collect())


def test_odd_and_empty(spark, odd, empty):
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count()


def test_texts_of_one_id_are_documents(spark):
    from corpus_pipeline import near_dedup

    text = lambda a, n=60: " ".join(f"{a}{i}" for i in range(n))
    rows = [(5, text("a")), (5, text("b")), (6, text("a") + " more"), (6, text("c")), (7, text("c")), (7, text("c")), (8, None), (9, ""), (None, text("a")), (10, text("b", 59))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, t string, doc int")
    out = near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=repr) == sorted([(5, text("a")), (5, text("b")), (6, text("c")), (8, None), (None, text("a"))], key=repr)


def test_any_column_name(spark, documents):
    names = ["_text", "d", "_d", "t", "doc", "size", "_toxicity", "toxicity", "score", "component", "a.b"]
    docs = documents.limit(60).select("*", *[documents.lang.alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 60
