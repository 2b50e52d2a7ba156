from __future__ import annotations

import zlib

import numpy as np

from swellworks.llm import toxicity as tx


def test_scores_do_not_depend_on_batches():
    model = tx.Model.fresh(1)
    texts = [b"one two three", b"", b"four", b"five six seven eight nine", b"..."]
    buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = model.score_texts(buf, offs)
    alone = [model.score_texts(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone) and together[1] == together[4] and ((together >= 0) & (together <= 1)).all()


def test_forward_pass_plainly():
    """The scores of a plain reimplementation: word by word, window by window, filter by filter."""
    model = tx.Model.fresh(3)
    model.out_bias, model.slope, model.shift = 0.2, 1.3, -0.4
    for text in (b"one two three four two", b"", b"x", b"Word word WORD \xc3\xa9t\xc3\xa9"):
        rows, _ = tx.word_rows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        x = [sum(model.tables[t][r] for t, r in enumerate(row)) for row in rows.tolist()]
        n = max(len(x), 1)
        x += [np.zeros(tx.DIM)] * (n + tx.PAD - len(x))
        z = model.out_bias
        for k, (f, b) in enumerate(zip(model.filters, model.bias)):
            for c in range(tx.FILTERS):
                best = max(b[c] + sum(float(x[i + j] @ f[j][:, c]) for j in range(len(f))) for i in range(n))
                z += max(best, 0) * model.out[k * tx.FILTERS + c]
        want = 1 / (1 + np.exp(-(model.slope * z + model.shift)))
        assert np.allclose(model.score_texts(np.frombuffer(text, np.uint8), np.array([0, len(text)])), want, atol=1e-5)


def test_words_share_their_stems():
    text = b"achlichung achlichkeit ACHLICHUNG a\xc3\xa9 abc"
    rows, first = tx.word_rows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert first.tolist() == [0, 5] and (rows[0] == rows[2]).all() and (rows[0, 1:] == rows[1, 1:]).all() and rows[0, 0] != rows[1, 0]


def test_held_out_accuracy(spark):
    """Rows that train nothing: nearly no clean one is rejected, and nine in ten toxic ones are, in every language."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = tx.scored(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select("predicted", "toxic", "lang").collect()
    clean = [r.predicted for r in out if not r.toxic]
    assert sum(clean) < 0.01 * len(clean)
    for lang in ("en", "de", "fr", "es"):
        mine = [r.predicted for r in out if r.toxic and r.lang == lang]
        assert sum(mine) >= 0.9 * len(mine), lang


def test_sample_is_bounded_in_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "bad word " * 50 if i % 2 else "good day " * 50, "en") for i in range(60)] + [(100, "long " * 5000, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 1)], "doc_id long, toxic int")
    seen, real = [], tx.train
    monkeypatch.setattr(tx, "train", lambda features, *a: seen.append(features) or real(features, *a))
    tx.fit(docs, labels, most_words=1000)
    assert 0 < sum(map(len, seen[0])) <= 2000 and max(map(len, seen[0])) == 100


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None), (7, 0), (1, 0)], "doc_id long, toxic int")
    out = tx.scored(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert tx.scored(empty, labels).count() == 0 and tx.scored(odd, labels.limit(0)).count() == odd.count()
    kept = tx.accepted(odd, tx.fit(odd, labels))
    assert kept.columns == odd.columns
    names = ["text", "_text", "toxicity", "_toxicity", "score", "a.b"]
    clash = odd.select("doc_id", "lang", *[odd.text.alias(n) for n in names])
    assert tx.accepted(clash, tx.fit(odd, labels)).columns == clash.columns
