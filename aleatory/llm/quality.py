"""Quality classifier: naive Bayes support vectors.

n-gram indicators (of words and of word shapes) are scaled by their class
log-count ratios; a linear hinge-loss model over them is fitted by dual
coordinate descent; Platt's sigmoid on documents left out of that fit turns
margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labelled import compact, distinct_ids, gather, labelled_sample, logistic_fit, score_texts
from ._spark import fold
from ._text import Words, grams, mix, text_slices, within

BITS = 20
#: Labelled documents to learn from, about.
SAMPLE = 4000
#: Features of fewer documents than this many, or than this share of the sample, are left out (parameters ``least`` and ``share``).
MIN_DOCS = 5
MIN_SHARE = 0.005
THRESHOLD = 0.3


def _shapes(w: Words, data: np.ndarray) -> np.ndarray:
    """A small code of each word: first and last byte's kind, capitals only, symbols in it, length class, same as the word before."""
    kind = np.full(256, 4)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 0, 1, 2, 1
    kind[[44, 46]] = 3
    k = kind[data]
    run = lambda x: np.append(0, np.cumsum(x))
    upper, lower, odd = run(k == 0), run(k == 1), run(k == 4)
    n = w.end - w.start
    capitals = (upper[w.end] - upper[w.start] > 1) & (lower[w.end] == lower[w.start])
    symbols = np.minimum(odd[w.end] - odd[w.start], 2)
    same = np.append(False, (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1]))[: len(w)]
    length = np.digitize(n, (3, 6, 11, 31))
    code = ((((k[w.start] * 5 + k[w.end - 1]) * 2 + capitals) * 3 + symbols) * 5 + length) * 2 + same
    return code.astype(np.uint64)


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the words and of the 1- to 4-grams of word shapes."""
    w = Words(data, bounds)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shift = np.uint64(64 - BITS)
    rows, buckets = [w.row], [w.hash >> shift]
    s = mix(_shapes(w, data) + np.uint64(1))
    for n in (1, 2, 3, 4):
        ok = within(w.row, n)
        rows.append(w.row[: len(ok)][ok])
        buckets.append((grams(s, n)[ok] if len(ok) else np.zeros(0, np.uint64)) >> shift)
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


class QualityModel:
    """``table``: bucket to feature id or -1; ``weight``: log-count ratio times hinge-loss weight; ``a``, ``b``: the sigmoid."""

    def __init__(self, table: np.ndarray, ratio: np.ndarray, weight: np.ndarray, bias: float, a: float = 1.0, b: float = 0.0) -> None:
        self.table, self.ratio, self.weight, self.bias, self.a, self.b = table, ratio.astype(np.float32), weight.astype(np.float32), bias, a, b

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        rows = len(bounds) - 1
        r, bucket = features(data, bounds)
        r, i = distinct_ids(r, self.table[bucket], rows, len(self.ratio))
        norm = np.sqrt(np.bincount(r, self.ratio[i] ** 2, rows))
        return np.bincount(r, self.ratio[i] * self.weight[i], rows) / np.maximum(norm, 1e-9) + self.bias

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(data, bounds) + self.b, -30, 30)))


def _log_ratios(ids: np.ndarray, ptr: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    good = np.repeat(y == 1, np.diff(ptr))
    p, q = 1 + np.bincount(ids[good], minlength=size), 1 + np.bincount(ids[~good], minlength=size)
    return np.log(p / (1 + (y == 1).sum())) - np.log(q / (1 + (y != 1).sum()))


def _descend(ids: np.ndarray, val: np.ndarray, ptr: np.ndarray, y: np.ndarray, size: int, cost: float, passes: int) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM by dual coordinate descent; the bias is a feature of value 1; classes weigh alike."""
    rng, w, bias = np.random.default_rng(5), np.zeros(size), 0.0
    sign, alpha = np.where(y == 1, 1.0, -1.0), np.zeros(len(y))
    top = np.where(y == 1, cost * len(y) / (2 * max((y == 1).sum(), 1)), cost * len(y) / (2 * max((y != 1).sum(), 1)))
    q = np.add.reduceat(np.append(val * val, 0), ptr[:-1]) * (np.diff(ptr) > 0) + 1
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            at = slice(ptr[i], ptr[i + 1])
            k, v = ids[at], val[at]
            g = sign[i] * (w[k] @ v + bias) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), top[i])
            if new != alpha[i]:
                d = (new - alpha[i]) * sign[i]
                w[k] += d * v
                bias += d
                alpha[i] = new
    return w, bias


def train(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, least: int = MIN_DOCS, share: float = MIN_SHARE, cost: float = 0.5, passes: int = 12) -> QualityModel:
    df = np.bincount(flat, minlength=1 << BITS)
    table = np.full(1 << BITS, -1, np.int32)
    kept = np.flatnonzero(df >= max(least, share * len(y)))
    table[kept] = np.arange(len(kept))
    ids, ptr = compact(flat, table, sizes)
    if len(set(y.tolist())) < 2 or not len(kept):  # nothing to tell apart: the share of label 1
        b = float(np.log((1 + (y == 1).sum()) / (1 + (y != 1).sum())))
        return QualityModel(np.where(table >= 0, 0, -1), np.zeros(1), np.zeros(1), 0.0, 1.0, b)
    cut = max(len(y) * 4 // 5, 1)
    ratio = _log_ratios(ids[: ptr[cut]], ptr[: cut + 1], y[:cut], len(kept))
    val = ratio.astype(np.float32)[ids]  # the largest arrays here: in single precision, scaled in place
    norm = np.sqrt(np.add.reduceat(np.append(val * val, np.float32(0)), ptr[:-1]) * (np.diff(ptr) > 0))
    val /= np.repeat(np.maximum(norm, 1e-9).astype(np.float32), np.diff(ptr))
    w, bias = _descend(ids[: ptr[cut]], val[: ptr[cut]], ptr[: cut + 1], y[:cut], len(kept), cost, passes)
    margin = np.add.reduceat(np.append(val * w[ids], 0), ptr[:-1]) * (np.diff(ptr) > 0) + bias
    rest = slice(cut, None) if len(set(y[cut:].tolist())) == 2 else slice(None)
    a, b = logistic_fit(margin[rest], y[rest])
    return QualityModel(table, ratio, w, bias, max(a, 1e-3), b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: int = MIN_DOCS, share: float = MIN_SHARE) -> QualityModel:
    """Learn ``labels.quality`` from at most about ``sample`` labelled documents, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = train(*gather(batches, features), least, share)
        kept = np.flatnonzero(m.table >= 0)
        parts = [kept.astype(np.int64), m.table[kept].astype(np.int64), m.ratio, m.weight, np.array([m.bias, m.a, m.b])]
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()]) for p in parts], names=list("ktrwc"))

    got = labelled_sample(docs, labels, "quality", sample, "quality").repartition(1).mapInArrow(run, "k binary, t binary, r binary, w binary, c binary").first()
    if got is None:  # no labelled document
        return train(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
    table = np.full(1 << BITS, -1, np.int32)
    table[np.frombuffer(got["k"], np.int64)] = np.frombuffer(got["t"], np.int64)
    bias, a, b = np.frombuffer(got["c"], float)
    return QualityModel(table, np.frombuffer(got["r"], np.float32), np.frombuffer(got["w"], np.float32), bias, a, b)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, least: int = MIN_DOCS, share: float = MIN_SHARE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; needs ``doc_id``, ``text`` and labels ``(doc_id, quality)``.

    Scores read the text alone. Null and empty texts have no features and get
    the bias's score. Without labels of both classes every row gets the share of
    label 1 (a half without any). Repeated rows score alike; other columns are
    not read; an empty table gives no rows. Texts are scored whole; ``sample``
    (labelled documents), ``least`` and ``share`` (features) bound the model.
    """
    model = fit(docs, labels, sample, least, share)
    base = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score_texts(base, model, QualityModel.scores, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted 1, with their columns as they are and of any names; a threshold of 0 keeps all.

    Null and empty texts get the bias's score; repeated rows stay or go alike;
    without labels of both classes all or none stay, as the share of label 1
    says; an empty table stays empty.
    """
    model = fit(docs, labels, sample)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_slices(batch.column(names.index("text"))):
                ok = shared.value.scores(data, bounds) >= threshold
                yield batch.slice(a, b - a).filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
