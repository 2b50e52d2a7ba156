"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (runs of ASCII letters and digits and all non-ASCII bytes, lower-cased) have hashed embeddings of the whole word
and of its first four and seven bytes, which are added: inflected words share their stem's, and words that share a row of
one table rarely share one of the others.  Filters of several widths run over the
sequence, a maximum over each document feeds a logistic output, and decision thresholds are calibrated by language.
A score never sees a label, language, source or id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from swellworks.llm.runtime import Workspace, column, extended, map_slices, ragged, spare, utf8
from swellworks.llm.words import IN_TERM, LOWER, Words, lanes, mix, piece_hashes

ROWS = 1 << 16  # of each embedding table
WIDTHS = (1, 2, 3)
DIM, FILTERS = 16, 16
STEMS = (4, 7)  # bytes of a word's beginning, one table each beside the whole word's; seven at most
PAD = max(WIDTHS) - 1
CUT = 0.7  # the score that decides


def word_rows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each table for every word, documents' first words)."""
    w, low = Words(buf, offs, IN_TERM), LOWER[buf]
    first, size = lanes(low, w.start, w.end)[0], w.end - w.start
    rows = [piece_hashes(low, w.start, w.end)]
    for k in STEMS:
        bits = np.minimum(size, k).astype(np.uint64) * np.uint64(8)
        rows.append(mix((first & ((np.uint64(1) << bits) - np.uint64(1))) * np.uint64(8) + np.uint64(k)))
    return np.stack([h & np.uint64(ROWS - 1) for h in rows], axis=1).astype(np.uint16), w.first


def _padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of every word among slots, documents' first slots, number of windows): PAD empty slots end a document."""
    n = np.diff(first)
    windows = np.maximum(n, 1)
    start = np.concatenate([[0], np.cumsum(windows + PAD)])
    return ragged(start[:-1], n), start, windows


@dataclass
class Model:
    """Weights; ``thresholds`` by language and "" for any other."""

    tables: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=lambda: {"": 0.7})

    @classmethod
    def fresh(cls, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        return cls(rng.normal(0, 0.05, (1 + len(STEMS), ROWS, DIM)).astype(np.float32), [f(w, DIM, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], f(FILTERS * len(WIDTHS)))

    def _slots(self, rows: np.ndarray, at: np.ndarray, total: int) -> np.ndarray:
        x = np.zeros((total, DIM), np.float32)
        x[at] = sum(table[rows[:, t]] for t, table in enumerate(self.tables))
        return x

    def _maps(self, x: np.ndarray) -> list[np.ndarray]:
        n = len(x) - PAD
        out = []
        for f, b in zip(self.filters, self.bias):
            z = x[:n] @ f[0]
            for j in range(1, len(f)):
                z += x[j : n + j] @ f[j]
            out.append(z + b)
        return out

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        at, start, windows = _padded(rows, first)
        maps = self._maps(self._slots(rows, at, int(start[-1])))
        # maxima over each document's windows: the slots between documents form segments of their own
        cuts = np.stack([start[:-1], start[:-1] + windows], axis=1).ravel()[:-1]
        pooled = np.concatenate([np.maximum.reduceat(z, cuts, axis=0)[::2] for z in maps], axis=1)
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def scores(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher for likelier toxic."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(rows, first).astype(np.float64) + self.shift, -40, 40)))

    def score_texts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return self.scores(*word_rows(buf, offs))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, {}, {}, 0

    def step(self, key: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = self.m.setdefault(key, np.zeros_like(value)), self.v.setdefault(key, np.zeros_like(value))
        i = slice(None) if rows is None else rows
        m[i] = 0.9 * m[i] + 0.1 * grad
        v[i] = 0.99 * v[i] + 0.01 * grad * grad
        value[i] -= self.rate * m[i] / (np.sqrt(v[i]) + 1e-6)


def _train_batch(model: Model, rows: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, adam: _Adam) -> None:
    at, start, windows = _padded(rows, first)
    x = model._slots(rows, at, int(start[-1]))
    maps = model._maps(x)
    best = [np.stack([a + z[a : a + n].argmax(0) for a, n in zip(start[:-1], windows)]) for z in maps]  # documents x filters
    pooled = np.concatenate([np.take_along_axis(z, p, 0) for z, p in zip(maps, best)], axis=1)
    act = np.maximum(pooled, 0)
    p = 1 / (1 + np.exp(-np.clip(act @ model.out + model.out_bias, -30, 30)))
    g = ((p - y) * weight / len(y)).astype(np.float32)
    back = g[:, None] * model.out * (pooled > 0)
    adam.step("out", model.out, act.T @ g + 1e-4 * model.out)
    model.out_bias -= adam.rate * float(g.sum()) * 4
    dx = np.zeros_like(x)
    for k, (f, q) in enumerate(zip(model.filters, best)):
        d = back[:, k * FILTERS : (k + 1) * FILTERS]
        grad = np.empty_like(f)
        for j in range(len(f)):
            seen = x[q + j]  # documents x filters x DIM
            grad[j] = np.einsum("bfd,bf->df", seen, d)
            np.add.at(dx, (q + j).ravel(), (f[j].T[None] * d[:, :, None]).reshape(-1, DIM))
        adam.step(f"bias{k}", model.bias[k], d.sum(0))
        adam.step(f"filter{k}", f, grad + 1e-4 * f)
    moved = dx[at]
    hit = np.flatnonzero(moved.any(1))
    for t in range(len(model.tables)):
        uniq, inv = np.unique(rows[hit, t], return_inverse=True)
        grad = np.zeros((len(uniq), DIM), np.float32)
        np.add.at(grad, inv, moved[hit])
        adam.step(f"table{t}", model.tables[t], grad, uniq)


def _associate(model: Model, features: list[np.ndarray], y: np.ndarray) -> None:
    """Start the first dimension of the embeddings from how much oftener a row's words stand in toxic documents of the
    sample than chance would have it (in standard deviations), and let one narrow filter look at it."""
    rate = y.mean()
    for t in range(len(model.tables)):
        seen, hit = np.zeros(ROWS), np.zeros(ROWS)
        for f, toxic in zip(features, y):
            rows = np.unique(f[:, t])
            seen[rows] += 1
            hit[rows] += toxic
        z = (hit - rate * seen) / np.sqrt(rate * (1 - rate) * seen + 0.5)
        model.tables[t][:, 0] = 0.15 * np.clip(z, -2, 8)
    model.filters[0][:, :, 0] = 0
    model.filters[0][0, 0, 0] = 1
    model.out[0] = 1


def train(features: list[np.ndarray], labels: np.ndarray, langs: list[str], base_rate: float, steps: int = 1200, batch: int = 32, seed: int = 7, cut: float = CUT) -> Model:
    """Fit on documents' word rows, ten times over or for ``steps`` batches; a fifth of them sets calibration and thresholds.

    Scores are scaled to probabilities first.  Deciding at half the best F1 gives the best F1 of a calibrated
    probability, so that point is moved to the score ``cut``.

    Without both labels the model scores the base rate for every text.
    """
    model, rng, y = Model.fresh(seed), np.random.default_rng(seed), labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        model.slope, rate = 0.0, min(max(base_rate if len(y) else 0.0, 1e-3), 1 - 1e-3)
        model.shift = float(np.log(rate / (1 - rate)))
        return model
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    if y[fit].min() == y[fit].max() or not len(held) or y[held].min() == y[held].max():
        held = fit = order
    weight = np.where(y > 0, 0.5 / y[fit].mean(), 0.5 / (1 - y[fit].mean()))
    adam = _Adam(3e-3)
    _associate(model, [features[i] for i in fit], y[fit])

    def pack(idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([features[i] for i in idx]), np.concatenate([[0], np.cumsum([len(features[i]) for i in idx])])

    epochs = max(10, -(-steps * batch // len(y)))
    for epoch in range(epochs):
        if epoch == epochs - 3:
            adam.rate /= 4
        mixed = rng.permutation(fit)
        for a in range(0, len(mixed), batch):
            idx = mixed[a : a + batch]
            _train_batch(model, *pack(idx), y[idx], weight[idx], adam)
    for weights in (model.tables, model.out, *model.filters, *model.bias):
        weights[np.abs(weights) < 1e-10] = 0  # products of such weights are denormal numbers, which processors are slow at
    z = np.concatenate([model.logits(*pack(held[a : a + 64])) for a in range(0, len(held), 64)]).astype(np.float64)
    # slope and shift by weighted logistic regression, with the sample weighted back to the base rate
    share = y[held].mean()
    w = np.where(y[held] > 0, base_rate / share, (1 - base_rate) / (1 - share))
    for _ in range(300):
        q = 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -30, 30)))
        e = w * (q - y[held])
        model.slope = float(np.clip(model.slope - 0.05 * ((e * z).mean() + 0.02 * (model.slope - 1)), 0.2, 5))
        model.shift -= float(0.5 * e.mean())
    score = lambda: 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -40, 40)))
    half = min(max(max(_f1(score(), y[held], w)) / 2, 0.1), 0.5)
    model.shift += float(np.log(cut / (1 - cut)) - np.log(half / (1 - half)))
    s, model.thresholds = score(), {"": cut}
    names = np.array([langs[i] or "" for i in held])
    for name in sorted(set(names.tolist()) - {""}):
        mine = names == name
        if mine.sum() >= 30 and 5 <= y[held][mine].sum() < mine.sum():
            model.thresholds[name] = _threshold(s[mine], y[held][mine], w[mine], cut)
    return model


GRID = np.linspace(0.05, 0.95, 91)


def _f1(s: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted F1 at every cut of the grid."""
    return np.array([2 * (w * y * (s >= t)).sum() / max((w * y).sum() + (w * (s >= t)).sum(), 1e-9) for t in GRID])


def _threshold(s: np.ndarray, y: np.ndarray, w: np.ndarray, near: float) -> float:
    """Of the cuts whose F1 is as good as the best, but for what a single toxic row makes, the one nearest to the common cut."""
    f1 = _f1(s, y, w)
    best = GRID[f1 >= f1.max() - max(0.01, 1 / y.sum())]
    return float(np.round(best[np.abs(best - near).argmin()], 2))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id's text leaves 1 modulo 3; such rows never train."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, positives: int = 4000, negatives: int = 6000, most_words: int = 4 << 20) -> Model:
    """Train on a bounded sample: at most ``positives`` and ``negatives`` labelled rows, the least by hash of their id, and
    of either only as many as have ``most_words`` words together.

    Null ids and labels don't count; an id with several labels is toxic if one says so, and one of several texts stands for
    an id; held-out ids never train.  Only the sample's word rows (six bytes a word) come to the driver, part by part.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = known.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0))).first()[0] or 0.0
    pick = lambda on, n: known.where(on).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = pick("toxic = 1", positives).union(pick("toxic <> 1", negatives))
    lang = F.col("lang") if "lang" in docs.columns else F.lit("")
    rows = docs.select("doc_id", "text", lang.cast("string").alias("lang")).join(F.broadcast(sample), "doc_id").select("text", "lang", F.col("toxic").cast("int").alias("toxic"), "doc_id")

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        words, first = word_rows(*utf8(piece.column(0)))
        n = np.diff(first)
        out = pa.record_batch([pa.array([words[a:b].tobytes() if b - a <= most_words else b"" for a, b in zip(first[:-1], first[1:])], pa.binary()), *piece.columns[1:], pa.array(n)], ["words", "lang", "toxic", "doc_id", "n"])
        return out.filter(pa.array(n <= most_words))

    ws = Workspace(docs.sparkSession, "toxicity")
    texts = map_slices(rows, "text", work, "words binary, lang string, toxic int, doc_id long, n long")
    one = ws.table(texts.groupBy("doc_id").agg(F.max(F.struct("words", "lang", "toxic", "n")).alias("r")).select("doc_id", "r.*"), "sample")
    held, ids = {True: 0, False: 0}, []
    for r in sorted(one.select(F.xxhash64("doc_id").alias("h"), "doc_id", "n", "toxic").collect()):  # numbers of the sample's rows
        held[r.toxic == 1] += r.n + 16
        if held[r.toxic == 1] <= most_words:
            ids.append((r.doc_id,))
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long")
    got = [(r.doc_id, np.frombuffer(r.words, np.uint16).reshape(-1, 1 + len(STEMS)), r.toxic == 1, r.lang) for r in one.join(F.broadcast(chosen), "doc_id").toLocalIterator()]
    got.sort(key=lambda r: r[0])
    return train([r[1] for r in got], np.array([r[2] for r in got], float), [r[3] for r in got], rate)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (default doc_id) and the score under ``name``, for every row's whole text; null text counts as empty.

    Columns of any name are kept; ``name`` must not be one of them.  Repeated rows stay rows, an empty table stays empty.
    """
    names = keep or ["doc_id"]
    (own,) = spare([*names, name], "text")
    rows = docs.select(*map(column, names), F.col("text").alias(own))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([*piece.columns[:-1], pa.array(shared.value.score_texts(*utf8(piece.column(len(names)))))], [*names, name])

    return map_slices(rows, own, work, StructType([*extended(docs, names).fields, StructField(name, DoubleType())]), 1 << 18)


def scored(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.  Repeated rows stay rows; an empty table gives an empty result."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose score stays below their language's threshold.

    Without a language, or with one that has no threshold of its own, the common one counts.  Null and empty texts are
    scored like any other; repeated rows go or stay alike; an empty table stays empty; column names may be any.
    """
    cuts = F.create_map(*[F.lit(x) for kv in model.thresholds.items() for x in kv])
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    cut = F.coalesce(F.try_element_at(cuts, lang), F.lit(model.thresholds[""]))
    (own,) = spare(docs.columns, "toxicity")
    return score(docs, model, docs.columns, own).where(F.col(own) < cut).select(*map(column, docs.columns))
