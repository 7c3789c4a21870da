"""A quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): all pairwise
interactions at a cost linear in the features, by the sum-of-squares identity. Features of a text:
its words, A-Z lower-cased and hashed into ``HASHED`` bins with the square roots of their shares of
the words; the shapes of its words (case, digits, symbols, accents) likewise; and binned statistics
of structure and length: symbols, capitals, digits, punctuation, repeated words and lines, word and
line lengths, number of characters. The model is fitted on at most ``SAMPLE_ROWS`` labelled documents
of each class, those with the smallest hashes of doc_id; the bias is then moved to the class shares
of all labelled rows.

Defined results: a null text counts as empty; a text without words is scored by its bias and length
features; repeated rows each give a row; very long texts are read whole; a doc_id with several
labels counts once with the smallest; labels of one class only, or none, give a constant score; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sent, WordTable, record_batch, staged, text_slices, xxh64_spans

HASHED, FACTORS = 1 << 14, 8
#: The bound of the fitted sample: labelled documents of each class.
SAMPLE_ROWS = 1500
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.08, 1e-5, 7
SHAPES, BINS = 64, 12
_STATS = ("symbol", "upper", "digit", "other", "punct", "distinct", "lines", "word_len", "chars", "line_repeat", "long_word")
#: Places of the feature groups: hashed words, word shapes, then BINS bins of each statistic.
_SHAPE_AT = HASHED
_STAT_AT = HASHED + SHAPES
FEATURES = _STAT_AT + BINS * len(_STATS)

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 sentence marks, 5 symbols, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5
#: Upper ends of the bins of each statistic.
_EDGES = {
    "symbol": (0, 0.001, 0.003, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.35, 0.6),
    "upper": (0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.15, 0.3, 0.5, 0.7, 0.9),
    "digit": (0, 0.001, 0.003, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.35, 0.6),
    "other": (0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.4, 0.6),
    "punct": (0, 0.003, 0.006, 0.01, 0.015, 0.02, 0.03, 0.05, 0.08, 0.15, 0.3),
    "distinct": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.95),
    "lines": (0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.4, 0.8),
    "word_len": (1.5, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6.5, 8, 12),
    "chars": (0, 10, 30, 100, 300, 700, 1500, 3000, 6000, 12_000, 50_000),
    "line_repeat": (0, 0.01, 0.03, 0.06, 0.1, 0.15, 0.25, 0.4, 0.6, 0.8, 0.95),
    "long_word": (0, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5),
}


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of whole numbers by rows."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def featurise(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the texts, sparse by rows: (first, feature, value). The values of each group of
    features have norm 1, so that none drowns the others."""
    w = WordTable(texts)
    n = np.diff(w.first)
    docs = len(texts)
    doc = np.repeat(np.arange(docs), n)
    hashed = (xxh64_spans(w.joined, w.start, w.size, 0) & np.uint64(HASHED - 1)).astype(np.int64)
    raw = np.frombuffer(b"".join(texts) or b" ", np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    kind = _CLASS[raw]
    chars = _sums((raw & 0xC0) != 0x80, at) if at[-1] else np.zeros(docs, np.int64)
    size = np.maximum(chars, 1)
    part = {c: (_sums(kind == c, at) if at[-1] else np.zeros(docs, np.int64)) / size for c in range(1, 7)}
    # shapes: the classes of a word's first and last byte, and whether it has capitals after the first
    words = _CLASS[np.frombuffer(b" ".join(x for t in texts for x in t.split()) + b" ", np.uint8)] if len(w.start) else np.zeros(0, np.uint8)
    shape = words[w.start].astype(np.int64) * 8 + words[w.start + w.size - 1] if len(w.start) else np.zeros(0, np.int64)
    lines = [t.split(b"\n") for t in texts]
    stats = {
        "symbol": part[5],
        "upper": part[2],
        "digit": part[3],
        "other": part[6] / 2,
        "punct": part[4],
        "lines": np.array([len(x) for x in lines]) / np.maximum(n, 1),
        "word_len": _sums(w.size, w.first) / np.maximum(n, 1) if len(n) else n,
        "chars": chars,
        "line_repeat": np.array([1 - len(set(x)) / len(x) for x in lines]),
        "long_word": _sums(w.size > 14, w.first) / np.maximum(n, 1),
    }
    rows, cols, vals = [], [], []
    distinct = np.zeros(docs)
    for base, ids, width in ((0, hashed, HASHED), (_SHAPE_AT, shape, SHAPES)):
        key, count = np.unique(doc * width + ids, return_counts=True)
        r = key // width
        rows.append(r)
        cols.append(base + key % width)
        vals.append(np.sqrt(count / np.maximum(n, 1)[r]))
        if base == 0:
            distinct = np.bincount(r, minlength=docs)
    stats["distinct"] = distinct / np.maximum(n, 1)
    for k, name in enumerate(_STATS):
        rows.append(np.arange(docs))
        cols.append(_STAT_AT + k * BINS + np.searchsorted(_EDGES[name], stats[name]))
        vals.append(np.full(docs, 1 / np.sqrt(len(_STATS))))
    r, c, v = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    order = np.argsort(r, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(r, minlength=docs))]).astype(np.int64), c[order].astype(np.int64), v[order]


class FactorisationMachine:
    def __init__(self, features: int = FEATURES, factors: int = FACTORS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(features)
        self.v = rng.normal(0, 0.05, (features, factors))

    def margin(self, first: np.ndarray, col: np.ndarray, val: np.ndarray) -> np.ndarray:
        """Sums run within a row in the order of its features, so equal texts have equal margins."""
        rows = len(first) - 1
        own = np.repeat(np.arange(rows), np.diff(first))
        xv = val[:, None] * self.v[col]
        sums = np.stack([np.bincount(own, xv[:, f], rows) for f in range(self.v.shape[1])], axis=1)
        squares = np.bincount(own, (xv * xv).sum(axis=1), rows)
        return self.w0 + np.bincount(own, val * self.w[col], rows) + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def predict(self, first: np.ndarray, col: np.ndarray, val: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(first, col, val), -40, 40)))

    def fit(self, first: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = SEED) -> FactorisationMachine:
        """AdaGrad on the logistic loss, in batches of whole rows in a seeded order."""
        rng = np.random.default_rng(seed)
        g0, gw, gv = 1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                rows = order[lo : lo + BATCH]
                n = first[rows + 1] - first[rows]
                own = np.repeat(np.arange(len(rows)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows], n)
                c, x = col[at], val[at]
                xv = x[:, None] * self.v[c]
                s = np.stack([np.bincount(own, xv[:, f], len(rows)) for f in range(xv.shape[1])], axis=1)
                m = self.w0 + np.bincount(own, x * self.w[c], len(rows)) + 0.5 * ((s * s).sum(axis=1) - np.bincount(own, (xv * xv).sum(axis=1), len(rows)))
                d = (1 / (1 + np.exp(-np.clip(m, -40, 40))) - y[rows]) / len(rows)
                used, back = np.unique(c, return_inverse=True)
                dx = d[own] * x
                dw = np.bincount(back, dx, len(used)) + decay * self.w[used]
                dv = np.stack([np.bincount(back, dx * (s[own, f] - xv[:, f]), len(used)) for f in range(xv.shape[1])], axis=1) + decay * self.v[used]
                g0 += d.sum() ** 2
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w0 -= rate * d.sum() / np.sqrt(g0)
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
        return self


_FEATURE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("col", pa.list_(pa.int32())), ("val", pa.list_(pa.float32()))])


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, col array<int>, val array<float>) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            first, col, val = featurise(texts)
            offset = pa.array(first.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offset, pa.array(x)) for x in (col.astype(np.int32), val.astype(np.float32))]
            yield record_batch({"doc_id": batch.column("doc_id"), "col": lists[0], "val": lists[1]}, _FEATURE_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, col array<int>, val array<float>")


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine | float:
    """The model from ``labels(doc_id, label 0 or 1)``, or a constant score if there is one class only.

    What reaches the driver is bounded by ``sample_rows`` feature rows of each class.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    known = staged(known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi"), "labels")
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        return float(next(iter(shares), 1))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("label = 0").orderBy(*by_hash).limit(sample_rows).unionByName(known.where("label = 1").orderBy(*by_hash).limit(sample_rows))
    picked = staged(picked, "sample")
    rows = feature_rows(docs.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi"))
    got = rows.join(F.broadcast(picked), "doc_id").toArrow().combine_chunks()
    ids = np.asarray(got.column("doc_id"))
    _, keep = np.unique(ids, return_index=True)  # a repeated row counts once, and the order is fixed
    got = got.take(pa.array(keep)).combine_chunks()
    y = np.asarray(got.column("label")).astype(np.float64)
    lists = got.column("col").combine_chunks()
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    model = FactorisationMachine().fit(first, np.asarray(lists.flatten()).astype(np.int64), np.asarray(got.column("val").combine_chunks().flatten()).astype(np.float64), y)
    # the sample's classes are nearer to even than the corpus: move the bias by the ratio of odds
    model.w0 += float(np.log(shares[1] / shares[0]) - np.log(max(y.sum(), 1) / max(len(y) - y.sum(), 1)))
    return model


def score_quality(docs: DataFrame, model: FactorisationMachine | float) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    sent = Sent(docs.sparkSession, model)  # FEATURES * (FACTORS + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            m = sent.value
            score = np.full(len(texts), m) if isinstance(m, float) else m.predict(*featurise(texts))
            yield record_batch({"doc_id": batch.column("doc_id"), "score": score}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def remainder(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo n (null: null)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row: labels of the held-out remainder aren't read."""
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(remainder(folds) != held)
    scored = score_quality(docs, fit_quality(docs, train))
    return scored.select("doc_id", F.coalesce(remainder(folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects. Scores are made in the same pass
    over the rows, so rows that repeat a doc_id are judged each by its own text."""
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(remainder(3) != 1)
    model = fit_quality(docs, train)
    sent = Sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            m = sent.value
            score = np.full(len(texts), m) if isinstance(m, float) else m.predict(*featurise(texts))
            yield part.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, docs.schema)
