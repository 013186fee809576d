"""Language identification: multinomial naive Bayes over hashed character n-grams, all languages equally likely beforehand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import fold, hash_unit
from ._text import _byte_codes, mix, text_slices

ORDERS = (1, 2, 3, 4)
BITS = 16
#: Training documents of each language, about (a hash-chosen sample).
SAMPLE = 3000
#: Languages whose matrix (256 KB each) may be broadcast; more are an error.
LANGUAGES = 1000


def characters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code of each character (A-Z folded) and the bounds of rows among them."""
    codes = _byte_codes(True)[data]
    lead = (data & 0xC0) != 0x80
    lead[bounds[:-1][np.diff(bounds) > 0]] = True
    if lead.all():
        return codes, bounds
    at = np.flatnonzero(lead)
    place = np.arange(len(data)) - at[np.cumsum(lead) - 1]  # of a byte in its character
    return np.add.reduceat(codes * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), at), np.searchsorted(at, bounds)


def ngram_buckets(codes: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each character; ``2**BITS`` where it would leave its row."""
    out = np.full(len(codes), 1 << BITS, np.int32)
    if len(codes) < order:
        return out
    h = codes[: len(codes) - order + 1].copy()
    for i in range(1, order):
        h = h * np.uint64(0x9FB21C651E98DF25) + codes[i : len(codes) - order + 1 + i]
    out[: len(h)] = (mix(h + np.uint64(order)) >> np.uint64(64 - BITS)).astype(np.int32)
    for i in range(1, order):  # the last order - 1 characters of each row
        at = bounds[1:] - i
        out[at[(at >= bounds[:-1]) & (at >= 0)]] = 1 << BITS
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for a, b, data, bounds in text_slices(batch.column("text")):
            codes, bounds = characters(data, bounds)
            sizes = np.diff(bounds)
            names = sorted(set(langs[a:b]))
            owner = np.repeat(np.searchsorted(names, langs[a:b]), sizes)
            for order in ORDERS:
                bucket = ngram_buckets(codes, bounds, order)
                for i, name in enumerate(names):
                    c = np.bincount(bucket[owner == i], minlength=(1 << BITS) + 1)[:-1]
                    counts[name] = counts.get(name, 0) + c
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.astype(np.int64).tobytes() for c in counts.values()], pa.binary())], names=["lang", "counts"])


class LanguageModel:
    """Languages and their ``(2**BITS + 1, languages)`` matrix of log probabilities (the last row is 0)."""

    def __init__(self, languages: list[str], counts: np.ndarray, alpha: float = 0.5) -> None:
        self.languages = languages
        p = counts + alpha
        logp = np.log(p / p.sum(1, keepdims=True)) if len(languages) else np.zeros((0, 1 << BITS))
        self.logp = np.vstack([logp.T, np.zeros((1, len(languages)))]).astype(np.float32)

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        some = np.flatnonzero(np.diff(bounds))
        if not len(some):
            return out
        codes, bounds = characters(data, bounds)
        for order in ORDERS:
            bucket = ngram_buckets(codes, bounds, order)
            for i in range(0, len(self.languages), 16):
                out[some, i : i + 16] += np.add.reduceat(self.logp[:, i : i + 16][bucket], bounds[some], axis=0, dtype=np.float64)
        return out


def fit(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> LanguageModel:
    """Learn from ``text`` and non-null ``lang`` of about ``sample`` hash-chosen documents of each language.

    Counts of a language are added up in one task of at most its sample; the
    driver gets the finished count vectors.
    """
    known = docs.where("lang is not null")
    sizes = known.groupBy("lang").count().limit(languages + 1).collect()
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} languages: their matrix would take {len(sizes) >> 2} MB or more; raise the bound where executors have that")
    if not sizes:
        return LanguageModel([], np.zeros((0, 1 << BITS)))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(sample / r["count"]))])
    chosen = known.where(hash_unit("doc_id", F.xxhash64("text").cast("string"), seed="langid") < share[F.col("lang")]).select("lang", "text")
    rows = chosen.repartition(min(len(sizes), 64), "lang").mapInArrow(_count, "lang string, counts binary").collect()
    rows.sort(key=lambda r: r["lang"].encode())
    return LanguageModel([r["lang"] for r in rows], np.array([np.frombuffer(r["counts"], np.int64) for r in rows], float).reshape(len(rows), 1 << BITS))


def _has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    low = data | 32
    ascii_ = np.append(0, np.cumsum((low >= 97) & (low <= 122) & (data < 128)))
    high = np.append(0, np.cumsum(data >= 128))
    yes = ascii_[bounds[1:]] > ascii_[bounds[:-1]]
    for r in np.flatnonzero(~yes & (high[bounds[1:]] > high[bounds[:-1]])):
        yes[r] = any(ch.isalpha() for ch in data[bounds[r] : bounds[r + 1]].tobytes().decode("utf-8", "replace"))
    return yes


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds ``lang_pred`` (``und`` for texts that are null or without a letter) and ``score``, its posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = np.array([*m.languages, "und"], object)
        for batch in batches:
            for a, b, data, bounds in text_slices(batch.column("text")):
                s = m.scores(data, bounds)
                best = np.full(b - a, len(m.languages))
                p = np.zeros(b - a)
                if len(m.languages):
                    ok = _has_letter(data, bounds)
                    top = s.argmax(1)
                    best[ok] = top[ok]
                    p[ok] = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)[ok]
                kept = [batch.column(c).slice(a, b - a) for c in names if c != "text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(table[best], pa.string()), pa.array(p)], names=[*[c for c in names if c != "text"], "lang_pred", "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{types}, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row; needs ``doc_id``, ``text`` and ``lang``.

    Learns from rows whose crc32 of the id is not 1 modulo 3. A null text or one
    without a letter gets ``und`` and score 0; so does every row if no language
    can be learned. Ties go to the language that sorts first. Texts are read
    whole, n-grams are of characters; more than ``LANGUAGES`` languages are an
    error (a parameter of ``fit``). Repeated rows are
    judged alike; other columns are not read; an empty table gives no rows.
    """
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (fold("doc_id", 3) == 1).alias("held_out"))
    model = fit(base.where("not held_out"), sample)
    return predict(base.select("doc_id", "held_out", "text"), model)
