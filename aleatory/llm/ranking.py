"""Ranked lexical search by sort-based accumulation.

Every document's words are looked up in the items' terms. For each match the
term's items and the impact on the document's score are laid out as arrays;
keys packed of (item, row) are radix sorted, and the impacts of equal keys are
added up by one ``reduceat``. A document's impacts never leave its task. Each
task keeps the best k of each item; these are dealt out by range of the item
and met in heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut
from ._text import Words, text_slices
from .mixing import _running

#: Distinct terms of items, added up over items, that one index holds (16 bytes each); more take more passes over the documents.
TERMS = 1 << 20
#: Matches laid out at once in a task.
ROWS = 1 << 21
SALTS = 16


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys by least significant digits of 16 bits (numpy counts, not compares, at this width)."""
    order = np.arange(len(keys))
    top = int(keys.max()) if len(keys) else 0
    for shift in range(0, max(top.bit_length(), 1), 16):
        digit = (keys[order] >> np.uint64(shift)).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


class Terms(NamedTuple):
    """Distinct terms by hash; those of term t are items ``item[ptr[t]:ptr[t + 1]]``, each holding it ``times`` times."""

    hash: np.ndarray
    ptr: np.ndarray
    item: np.ndarray
    times: np.ndarray


def term_index(h: np.ndarray, item: np.ndarray, times: np.ndarray) -> Terms:
    order = np.argsort(h, kind="stable")
    distinct, first = np.unique(h[order], return_index=True)
    return Terms(distinct, np.append(first, len(h)), item[order], times[order])


def matches(w: Words, rows: int, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, term, tf)`` of the words that are terms, each row's terms once."""
    at = np.minimum(np.searchsorted(terms, w.hash), max(len(terms) - 1, 0))
    hit = np.flatnonzero(terms[at] == w.hash) if len(terms) else np.zeros(0, np.int64)
    key = w.row[hit].astype(np.uint64) * np.uint64(len(terms)) + at[hit].astype(np.uint64)
    key = key[radix_order(key)]
    first = np.flatnonzero(np.diff(key, prepend=key[0] + np.uint64(1) if len(key) else np.uint64(0)))
    tf = np.diff(np.append(first, len(key)))
    return (key[first] // np.uint64(max(len(terms), 1))).astype(np.int64), (key[first] % np.uint64(max(len(terms), 1))).astype(np.int64), tf


def accumulate(row: np.ndarray, term: np.ndarray, impact: np.ndarray, index: Terms, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(item, row, score)`` of every item and row that share a term, scores added up exactly."""
    count = np.diff(index.ptr)[term]
    through = np.cumsum(count)
    flat = np.repeat(index.ptr[:-1][term] - (through - count), count) + np.arange(through[-1] if len(through) else 0)
    key = index.item[flat].astype(np.uint64) * np.uint64(rows) + np.repeat(row, count).astype(np.uint64)
    add = np.repeat(impact, count) * index.times[flat]
    order = radix_order(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    score = np.add.reduceat(add[order], first) if len(first) else np.zeros(0, np.int64)
    return (key[first] // np.uint64(rows)).astype(np.int64), (key[first] % np.uint64(rows)).astype(np.int64), score


class Best:
    """The k best (score, then smaller id, null ids last) of each item, in heaps whose root is the worst of them."""

    def __init__(self, k: int, items: int) -> None:
        self.k, self.heaps, self.bar = k, {}, np.zeros(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: list) -> None:
        """``bar`` is an item's k-th score so far: what is under it needs no heap."""
        for j in np.flatnonzero((score > 0) & (score >= self.bar[item])):
            i = int(item[j])
            heap = self.heaps.setdefault(i, [])
            one = (int(score[j]), ids[j] is not None, -(ids[j] or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, one)
            else:
                heapq.heappushpop(heap, one)
            if len(heap) == self.k:
                self.bar[i] = heap[0][0]

    def batch(self) -> pa.RecordBatch:
        flat = [(i, -minus if some else None, score) for i, heap in self.heaps.items() for score, some, minus in heap]
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], pa.int64()) for j in range(3)], names=["item", "doc_id", "score"])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct terms and how often it holds them."""
    for batch in batches:
        for a, b, data, bounds in text_slices(batch.column("text")):
            w = Words(data, bounds, "word")
            order = np.lexsort((w.hash, w.row))
            row, h = w.row[order], w.hash[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
            item = np.asarray(batch.column("item").slice(a, b - a))[row[first]]
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(h[first].view(np.int64)), pa.array(np.diff(np.append(first, len(h))), pa.int64())], names=["item", "h", "times"])


def _counts(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    """How many documents hold each term; as term -1 the documents with a term, as -2 all their terms."""
    terms = index.value.hash
    df, some, words = np.zeros(len(terms), np.int64), 0, 0
    for batch in batches:
        for a, b, data, bounds in text_slices(batch.column("text")):
            w = Words(data, bounds, "word")
            some, words = some + int((np.diff(w.first) > 0).sum()), words + len(w)
            df += np.bincount(matches(w, b - a, terms)[1], minlength=len(terms))
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-1, -2])), pa.array(np.append(df[held], [some, words]))], names=["term", "n"])


def lengths(n: np.ndarray, docs: int, words: int, share: int) -> np.ndarray:
    """100 - share + (share * n * docs) div words, in Python's integers where 64 bits would not do."""
    if len(n) and int(n.max()) * share * docs >= 1 << 63:
        return np.array([100 - share + share * int(x) * docs // words for x in n], np.int64)
    return 100 - share + share * n * docs // max(words, 1)


def _search(batches: Iterator[pa.RecordBatch], index, weights, docs: int, words: int, items: int, k: int, share: int) -> Iterator[pa.RecordBatch]:
    terms, weight, best = index.value, weights.value, Best(k, items)
    for batch in batches:
        for a, b, data, bounds in text_slices(batch.column("text")):
            w = Words(data, bounds, "word")
            m = lengths(np.diff(w.first), docs, words, share)
            row, term, tf = matches(w, b - a, terms.hash)
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
            ids = batch.column("doc_id").slice(a, b - a).to_pylist()
            # A row's matches stay together; only so many are laid out at once.
            ends = np.cumsum(np.bincount(row, np.diff(terms.ptr)[term], b - a)).astype(np.int64)
            lo = 0
            while lo < b - a:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ROWS, "right")))
                x, y = np.searchsorted(row, [lo, hi])
                item, at, score = accumulate(row[x:y], term[x:y], impact[x:y], terms, b - a)
                best.add(item, score, [ids[r] for r in at])
                lo = hi
    yield best.batch()


def _meet(batches: Iterator[pa.RecordBatch], items: int, k: int) -> Iterator[pa.RecordBatch]:
    """The best of what several tasks kept."""
    best = Best(k, items)
    for batch in batches:
        best.add(np.asarray(batch.column("item")), np.asarray(batch.column("score")), batch.column("doc_id").to_pylist())
    yield best.batch()


def _rank(spark: SparkSession, docs: DataFrame, entries: list, k: int, share: int) -> DataFrame:
    """``(item, doc_id, score)``: the best of one index of items."""
    local = sorted({e[0] for e in entries})
    place = {x: i for i, x in enumerate(local)}
    index = term_index(np.array([e[1] for e in entries], np.int64).view(np.uint64), np.array([place[e[0]] for e in entries], np.int64), np.array([e[2] for e in entries], np.int64))
    held = spark.sparkContext.broadcast(index)
    counts = {r["term"]: r["n"] for r in docs.mapInArrow(lambda it: _counts(it, held), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most TERMS and one item's
    n, words = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(len(index.hash), np.int64)
    df[list(counts)] = list(counts.values())
    weights = spark.sparkContext.broadcast(np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64))
    many = len(local)
    kept = docs.mapInArrow(lambda it: _search(it, held, weights, n, words, many, k, share), "item long, doc_id long, score long")
    dealt = kept.repartitionByRange(F.col("item"), F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    met = dealt.mapInArrow(lambda it: _meet(it, many, k), "item long, doc_id long, score long")
    names = spark.createDataFrame(list(enumerate(local)), "item long, of long")
    return met.join(F.broadcast(names), "item").select(F.col("of").alias("item"), "doc_id", "score")  # at most TERMS rows


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, share: int = 25, terms: int = TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's k best documents; needs ``doc_id, text`` and ``item_id, text``.

    Terms are runs of letters, digits and characters outside ASCII, A-Z
    lower-cased. N documents have a term, L terms they have in all, n one of
    them; df documents hold a term, tf times each. A term weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))); a document's length counts as
    m = 100 - share + (share * n * N) div L; its score adds up
    weight * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms with their
    repeats, in 64-bit integers. Scores of 0 are no matches; equal scores go by
    ascending id, null ids last.

    Null and blank texts hold no terms. Repeated rows are documents of their
    own; repeated items count once, different texts of one item_id (also null)
    are ranked separately under it. Empty tables give no rows. Other columns
    aren't read. Words are compared by 64-bit hashes with the items' terms
    alone. Documents are read twice for each ``terms`` terms of items; nothing
    but k rows for each item and task is shuffled. Memory grows with the
    longest text and, per task, with k times the items of one index.
    """
    spark = docs.sparkSession
    asked = cut(items.select("item_id", F.col("text").cast("string").alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()))
    entries = cut(asked.select("item", "text").mapInArrow(_item_terms, "item long, h long, times long"))
    sizes = _running(entries.groupBy("item").agg(F.count("*").alias("size")), [F.col("item")], {"before": "size"})
    dealt = cut(sizes.select("item", F.floor(F.col("before") / terms).cast("int").alias("index")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for row in dealt.select("index").distinct().orderBy("index").collect():  # one row per index
        held = entries.join(dealt.where(F.col("index") == row["index"]), "item").select("item", "h", "times").collect()  # at most ``terms`` rows and one item's
        one = cut(_rank(spark, base, [tuple(e) for e in held], k, share))
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "item long, doc_id long, score long")
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


#: DuckDB's equivalent with its default parameters.
SQL = r"""
with doc_terms as (
  select row_number() over () as d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as l from documents),
item_terms as (
  select i, item_id, term, count(*) as times from (
    select row_number() over () as i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select distinct item_id, text from benchmark)) group by all),
whole as (select count(*)::bigint as docs, sum(len(l))::bigint as words from doc_terms where len(l) > 0),
postings as (select d, term, count(*)::bigint as tf from (select d, unnest(l) as term from doc_terms) where term in (select term from item_terms) group by all),
weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from postings, whole group by term),
scores as (
  select i, item_id, p.d, any_value(doc_id) as doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(l) * docs) // words))))::bigint as score
  from postings p join weights using (term) join item_terms t using (term) join doc_terms x on x.d = p.d, whole group by i, item_id, p.d)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from scores where score > 0) where rank <= 20
"""
