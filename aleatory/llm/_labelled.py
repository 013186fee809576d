"""A bounded labelled sample for classifiers, and compact ids for hashed features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import fold, hash_unit
from ._text import text_slices


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, seed: str) -> DataFrame:
    """``(y, text)`` of about ``bound`` hash-chosen labelled documents outside the held-out fold (crc32 of the id divisible by 5).

    Repeated labels of one document count once, the smaller one; so does a document of several rows, by the
    row of the least text hash; null labels and ids teach nothing.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    share = bound / max(known.count(), 1)
    chosen = known.where(hash_unit("doc_id", seed=seed) < share)
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # about ``bound`` rows
    one = known.groupBy("doc_id").agg(F.min_by(F.struct("y", "text"), F.xxhash64("text")).alias("row"))
    return one.select("row.*", hash_unit("doc_id", seed=seed + "order").alias("u"))


#: Gets a slice, returns (row, bucket) of its features; pairs may repeat.
Extract = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def gather(batches: Iterator[pa.RecordBatch], extract: Extract) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR of the distinct buckets of each row, and y; rows ordered by their hash, so that reruns agree."""
    ys, us, flat, sizes = [], [], [], []
    for batch in batches:
        ys.append(batch.column("y").to_numpy())
        us.append(batch.column("u").to_numpy())
        for a, b, data, bounds in text_slices(batch.column("text")):
            row, bucket = extract(data, bounds)
            key = np.unique((row.astype(np.int64) << 32) | bucket)
            flat.append((key & 0xFFFFFFFF).astype(np.int32))
            sizes.append(np.bincount(key >> 32, minlength=b - a))
    if not ys:
        return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)
    y, u, f, ptr = np.concatenate(ys), np.concatenate(us), np.concatenate(flat), np.append(0, np.cumsum(np.concatenate(sizes)))
    order = np.argsort(u, kind="stable")
    parts = [f[ptr[i] : ptr[i + 1]] for i in order]
    return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts])), y[order]


def compact(flat: np.ndarray, table: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace buckets by their ids in ``table`` (-1 there: dropped); returns ids and CSR offsets."""
    ids = table[flat]
    keep = ids >= 0
    return ids[keep], np.append(0, np.cumsum(np.add.reduceat(np.append(keep, False).astype(np.int64), sizes[:-1]) * (np.diff(sizes) > 0)))


def distinct_ids(row: np.ndarray, ids: np.ndarray, rows: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, id) pairs, sorted, without those of id -1: by a bitmap, or by sorting where that would be large."""
    ok = ids >= 0
    row, ids = row[ok], ids[ok]
    some = max(1, (1 << 24) // max(features, 1))
    if rows <= some:
        seen = np.zeros(rows * features, bool)
        seen[row * features + ids] = True
        hit = np.flatnonzero(seen)
        return hit // features, hit % features
    key = np.unique(row.astype(np.int64) * features + ids)
    return key // features, key % features


def logistic_fit(margin: np.ndarray, y: np.ndarray, balance: bool = False) -> tuple[float, float]:
    """Platt's a, b with smoothed targets, by Newton steps; ``balance``: both classes weigh alike."""
    pos, neg = (y == 1).sum(), (y != 1).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.zeros(2)
    share = np.where(y == 1, len(y) / (2 * max(pos, 1)), len(y) / (2 * max(neg, 1))) if balance else np.ones(len(y))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (share * (p - t)) + 1e-6 * w)
        w -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def gap_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Balanced Platt a, b; where all but a few margins of the classes lie apart, a half is put in the middle of the gap."""
    a, b = logistic_fit(margin, y, balance=True)
    a = max(a, 1e-3)
    low, high = np.quantile(margin[y != 1], 0.999), np.quantile(margin[y == 1], 0.005)
    return (a, -a * (low + high) / 2) if high > low else (a, b)


def score_texts(docs: DataFrame, model, score: Callable[[object, np.ndarray, np.ndarray], np.ndarray], threshold: float) -> DataFrame:
    """All columns but ``text``, then ``score`` and ``predicted`` (score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, data, bounds in text_slices(batch.column("text")):
                s = score(m, data, bounds)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in rest], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*rest, "score", "predicted"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{types}, score double, predicted int")
