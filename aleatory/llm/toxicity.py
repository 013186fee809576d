"""Toxicity: a factorization machine over hashed terms, whose factors learn pairs of terms (an insult with a group's name)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labelled import compact, distinct_ids, gap_fit, gather, labelled_sample, score_texts
from ._spark import fold
from ._text import Words, mix, powers

BITS = 21
#: Labelled documents to learn from, about.
SAMPLE = 24000
#: Terms kept: at most so many, by their chi-square with the label, of those in MIN_DOCS documents or more (parameters ``most`` and ``least``).
#: A term's chi-square must pass twice the logarithm of the number of terms tried, which a term without meaning hardly does: else small samples learn noise.
TERMS = 4096
MIN_DOCS = 3
FACTORS = 8
THRESHOLD = 0.5


def terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the words (letters, digits and bytes over 127, A-Z folded) and of their first 4 and 5 bytes."""
    w = Words(data, bounds, "word")
    shift = np.uint64(64 - BITS)
    rows, buckets = [w.row], [w.hash >> shift]
    _, q = powers(len(data) + 1)
    for n in (4, 5):
        at = w.end - w.start > n
        start = w.start[at]
        h = mix((w.total[start + n] - w.total[start]) * q[start] + np.uint64(n))
        rows.append(w.row[at])
        buckets.append(h >> shift)
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


class FactorModel:
    """``bias + sum of linear weights + sum over pairs of factor products`` of a document's distinct terms, through a sigmoid."""

    def __init__(self, table: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray, a: float = 1.0, b: float = 0.0) -> None:
        self.table, self.bias, self.linear, self.factors, self.a, self.b = table, bias, linear.astype(np.float32), factors.astype(np.float32), a, b

    def margins(self, rows: int, r: np.ndarray, i: np.ndarray) -> np.ndarray:
        out = self.bias + np.bincount(r, self.linear[i], rows)
        for f in self.factors.T:
            v = f[i]
            out += 0.5 * (np.bincount(r, v, rows) ** 2 - np.bincount(r, v * v, rows))
        return out

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        rows = len(bounds) - 1
        r, bucket = terms(data, bounds)
        r, i = distinct_ids(r, self.table[bucket], rows, len(self.linear))
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(rows, r, i) + self.b, -30, 30)))


def train(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, most: int = TERMS, least: int = MIN_DOCS, passes: int = 16, batch: int = 64, rate: float = 0.1, decay: float = 3e-4) -> FactorModel:
    table = np.full(1 << BITS, -1, np.int32)
    if len(set(y.tolist())) < 2:  # nothing to tell apart: the share of label 1
        b = float(np.log((1 + (y == 1).sum()) / (1 + (y != 1).sum()))) if len(y) else 0.0
        return FactorModel(table, b, np.zeros(1), np.zeros((1, FACTORS)))
    df = np.bincount(flat, minlength=1 << BITS).astype(float)
    hit = np.bincount(flat[np.repeat(y == 1, np.diff(sizes))], minlength=1 << BITS)
    share, n = (y == 1).mean(), len(y)
    spread = np.maximum(df * share * (1 - share) * (1 - df / n), 1e-9)
    chi = np.where((df >= least) & (df < n), (hit - df * share) ** 2 / spread, 0)
    kept = np.sort(np.argsort(-chi, kind="stable")[:most])
    kept = kept[chi[kept] > 2 * np.log(max((chi > 0).sum(), 2))]
    table[kept] = np.arange(len(kept))
    ids, ptr = compact(flat, table, sizes)
    size = max(len(kept), 1)
    rng = np.random.default_rng(3)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.01, (size, FACTORS))
    gb, gw, gv = 1.0, np.full(size, 1e-2), np.full((size, FACTORS), 1e-2)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    cut = max(n * 4 // 5, 1)
    for _ in range(passes):
        order = rng.permutation(cut)
        for start in range(0, cut, batch):
            docs = order[start : start + batch]
            k = np.concatenate([ids[ptr[d] : ptr[d + 1]] for d in docs])
            r = np.repeat(np.arange(len(docs)), ptr[docs + 1] - ptr[docs])
            used, local = np.unique(k, return_inverse=True)
            x = np.zeros((len(docs), len(used)))
            x[r, local] = 1
            xv = x @ v[used]
            margin = bias + x @ w[used] + 0.5 * (xv**2 - x @ v[used] ** 2).sum(1)
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - (y[docs] == 1)) * weight[docs] / len(docs)
            dw = x.T @ g + decay * w[used]
            dv = x.T @ (g[:, None] * xv) - (x.T @ g)[:, None] * v[used] + decay * v[used]
            gb += g.sum() ** 2
            gw[used] += dw * dw
            gv[used] += dv * dv
            bias -= rate * g.sum() / np.sqrt(gb)
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
    model = FactorModel(table, bias, w, v)
    row = np.repeat(np.arange(n), np.diff(ptr))
    margin = model.margins(n, row, ids)
    rest = slice(cut, None) if len(set(y[cut:].tolist())) == 2 else slice(None)
    model.a, model.b = gap_fit(margin[rest], y[rest])
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = TERMS, least: int = MIN_DOCS) -> FactorModel:
    """Learn ``labels.toxic`` from at most about ``sample`` labelled documents, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = train(*gather(batches, terms), most, least)
        kept = np.flatnonzero(m.table >= 0)
        parts = [kept.astype(np.int64), m.linear, m.factors, np.array([m.bias, m.a, m.b])]
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()]) for p in parts], names=list("kwvc"))

    got = labelled_sample(docs, labels, "toxic", sample, "toxic").repartition(1).mapInArrow(run, "k binary, w binary, v binary, c binary").first()
    if got is None:  # no labelled document
        return train(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
    table = np.full(1 << BITS, -1, np.int32)
    kept = np.frombuffer(got["k"], np.int64)
    table[kept] = np.arange(len(kept))
    bias, a, b = np.frombuffer(got["c"], float)
    linear = np.frombuffer(got["w"], np.float32)
    return FactorModel(table, bias, linear, np.frombuffer(got["v"], np.float32).reshape(len(linear), FACTORS), a, b)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, most: int = TERMS, least: int = MIN_DOCS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; needs ``doc_id``, ``text`` and labels ``(doc_id, toxic)``.

    Scores read the text alone. Null and empty texts have no terms and get the
    bias's score. Without labels of both classes every row gets the share of
    label 1 (a half without any). Repeated rows score alike; other columns are
    not read; an empty table gives no rows. Texts are scored whole; ``sample``
    (labelled documents), ``most`` and ``least`` (terms) bound the model.
    """
    model = fit(docs, labels, sample, most, least)
    base = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score_texts(base, model, FactorModel.scores, threshold)
