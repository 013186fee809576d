"""Repeated passages: sparse suffix arrays.

Only suffixes that start at content-selected places are kept: the minimisers
of 26-word hashes in windows of 25, so that any 50 words contain one, the same
one wherever these words stand. Suffixes whose 26 words occur in another text
too are sorted by what follows and what precedes them; neighbours are compared
and their match is extended word by word to both sides.

Nothing is lost where a key has many records: each window of 51 words of a
passage holds a key, at the same place in every text that has the window. So
two texts share a window if and only if their records of that key agree on some
split of the 25 words beside it, and all splits of all records of a key are
compared: inside a task up to GROUP records, by a Spark aggregate beyond. GROUP
decides only where the same comparison runs (tests compare both with brute
force).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, small
from ._text import Words, mix, powers, text_slices

#: Words of a suffix's key, and keys of which the least is taken; K + W - 1 = 50.
K = 26
W = 25
#: Passages over so many words count.
OVER = 50
_SIDE = W
#: Records of one key up to which they are compared as a whole, in one task; windows of larger groups are counted by Spark.
GROUP = 20_000


def keys_of(h: np.ndarray) -> np.ndarray:
    """Hashes of all K-word runs, from prefix sums."""
    p, q = powers(len(h) + 1)
    total = np.append(np.uint64(0), np.cumsum(h * p[: len(h)]))
    n = len(h) - K + 1
    return mix((total[K:] - total[:n]) * q[:n])


def _slide(x: np.ndarray, pick) -> np.ndarray:
    """pick (minimum or maximum) of each W consecutive values."""
    size = 1
    while size * 2 <= W:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = W - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def minimisers(h: np.ndarray) -> np.ndarray:
    """Places of one text whose key is the least of some window of W keys."""
    if len(h) <= OVER:
        return np.zeros(0, np.int64)
    keys = keys_of(h)
    least = _slide(keys, np.minimum)
    pad = np.zeros(W - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([pad, least, pad]), np.maximum) == keys)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key and place of each minimiser; a row of null key says how many words a text of over OVER words has."""
    for batch in batches:
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        for a, b, data, bounds in text_slices(batch.column("text")):
            w = Words(data, bounds)
            count = np.diff(w.first)
            long = np.flatnonzero(count > OVER)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(long), pa.int64()), pa.array(h1[a + long]), pa.array(h2[a + long]), pa.array(count[long].astype(np.int32))], names=["key", "h1", "h2", "place"])
            rows, places, keys = [], [], []
            for r in long.tolist():
                h = w.hash[w.first[r] : w.first[r + 1]]
                at = minimisers(h)
                if len(at):
                    rows.append(np.full(len(at), a + r))
                    places.append(at)
                    keys.append(keys_of(h)[at])
            row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            place = np.concatenate(places).astype(np.int32) if places else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h1[row]), pa.array(h2[row]), pa.array(place)], names=["key", "h1", "h2", "place"])


def _graded(x: np.ndarray) -> np.ndarray:
    """A sort key of which 16, 32, 48 and 64 bits tell the first 6, 12, 18 and all words: long agreements sort together."""
    out = np.zeros(len(x), np.uint64)
    for n in (6, 12, 18, _SIDE):
        h = mix((x[:, :n].astype(np.uint64) * powers(n)[0]).sum(1, dtype=np.uint64))
        out = (out << np.uint64(16)) | (h >> np.uint64(48))
    return out.view(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each repeated place: the _SIDE words before (nearest first) and after its key, as 32-bit hashes, and a hash of either."""
    for batch in batches:
        h1, h2, lists = batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), batch.column("places").to_pylist()
        for a, b, data, bounds in text_slices(batch.column("text")):
            w = Words(data, bounds)
            for r in range(b - a):
                h = w.hash[w.first[r] : w.first[r + 1]]
                at = np.array(sorted(lists[a + r]), np.int64)
                padded = np.concatenate([np.zeros(_SIDE, np.uint32), (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.zeros(_SIDE, np.uint32)])
                left = padded[at[:, None] + _SIDE - 1 - np.arange(_SIDE)]
                right = padded[at[:, None] + _SIDE + K + np.arange(_SIDE)]
                sums = [_graded(x) for x in (right, left)]
                flat = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * _SIDE), len(at), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary()) for x in (left, right)]
                key = keys_of(h)[at].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(sums[0]), pa.array(sums[1]), pa.array(np.full(len(at), h1[a + r])), pa.array(np.full(len(at), h2[a + r])), pa.array(at.astype(np.int32)), *flat],
                    names=["key", "rh", "lh", "h1", "h2", "place", "left", "right"],
                )


_RECORD = "key bigint, rh bigint, lh bigint, h1 bigint, h2 bigint, place int, left binary, right binary"
_SPAN = "h1 bigint, h2 bigint, start int, end int"
_SORT = ("key", "rh", "lh", "h1", "h2", "place")


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading words that agree (0 pads either end of a text)."""
    differ = (x != y) | (x == 0)
    return np.where(differ.any(1), differ.argmax(1), x.shape[1])


def _splits(key: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each split of the OVER + 1 - K words beside a key, a of them before it: (a, records whose text reaches so far, hashes of their windows)."""
    n, more = len(key), OVER + 1 - K
    c = np.uint64(0x9FB21C651E98DF25)

    def prefixes(side: np.ndarray) -> np.ndarray:
        out = np.zeros((more + 1, n), np.uint64)
        for i in range(more):
            out[i + 1] = mix(out[i] * c + side[:, i])
        return out

    before, behind = prefixes(left), prefixes(right)
    for a in range(more + 1):
        ok = np.ones(n, bool)
        if a:
            ok &= left[:, a - 1] != 0
        if a < more:
            ok &= right[:, more - a - 1] != 0
        idx = np.flatnonzero(ok)
        if len(idx):
            yield a, idx, mix(key[idx].view(np.uint64) + mix(before[a, idx] * c + behind[more - a, idx]))


def _windows(key: np.ndarray, text: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of OVER + 1 words around a key that another text at hand has too: (record, start, end) of joined ones, relative to the key's place.

    A record's nearest neighbours need not be those it shares most with on both
    sides together; windows of each split of the words before and after settle
    that among the records at hand.
    """
    shared = np.zeros((len(key), OVER + 1 - K + 3), bool)  # one column of no window at either end
    for a, idx, h in _splits(key, left, right):
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        t = text[idx][order]
        several = np.minimum.reduceat(t, first) != np.maximum.reduceat(t, first)
        shared[idx[order], a + 1] = np.repeat(several, np.diff(np.append(first, len(t))))
    edge = np.diff(shared.astype(np.int8), axis=1)
    row, least = np.nonzero(edge == 1)  # split a is column a + 1; a run of splits least..most
    _, most = np.nonzero(edge == -1)
    return row, -(most - 1), OVER + 1 - least


def _sides(table: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32).reshape(table.num_rows, _SIDE) for c in ("left", "right")}


def _all_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record's windows of OVER + 1 words, one row a split: (window's hash, text, start)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {c: batch.column(c).to_numpy() for c in ("key", "h1", "h2", "place")}
        for a, idx, h in _splits(col["key"], **_sides(batch)):
            start = (col["place"][idx] - a).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(col["h1"][idx]), pa.array(col["h2"][idx]), pa.array(start)], names=["window", "h1", "h2", "start"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted records, whole groups of a key in one partition: matches with the nearest records of another text on either side, and shared windows."""
    held: pa.Table | None = None

    def step(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        col = {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "h1", "h2", "place")}
        stop = table.num_rows if last else int(np.searchsorted(col["key"], col["key"][-1]))  # the last group may go on
        table, rest = table.slice(0, stop), table.slice(stop)
        col = {c: v[:stop] for c, v in col.items()}
        side = _sides(table)
        # Of each record: the first place and the end of the run of records of its key and text.
        everything = np.arange(stop)
        new = np.ones(stop, bool)
        new[1:] = np.logical_or.reduce([col[c][1:] != col[c][:-1] for c in ("key", "h1", "h2")])
        first = np.maximum.accumulate(np.where(new, everything, 0))
        after = np.append(np.flatnonzero(new)[1:], stop)[np.cumsum(new) - 1]
        out = []
        for other in (first - 1, after):
            x = np.flatnonzero((other >= 0) & (other < stop))
            y = other[x]
            same = col["key"][x] == col["key"][y]
            x, y = x[same], y[same]
            l, r = _common(side["left"][x], side["left"][y]), _common(side["right"][x], side["right"][y])
            keep = l + K + r > OVER
            x, l, r = x[keep], l[keep], r[keep]
            out.append([col["h1"][x], col["h2"][x], (col["place"][x] - l).astype(np.int32), (col["place"][x] + K + r).astype(np.int32)])
        x, start, end = _windows(col["key"], col["h1"], **side)
        out.append([col["h1"][x], col["h2"][x], (col["place"][x] + start).astype(np.int32), (col["place"][x] + end).astype(np.int32)])
        m = [np.concatenate(p) for p in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([*map(pa.array, m)], names=["h1", "h2", "start", "end"]), rest

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = table.column("key")
        if keys[0].as_py() == keys[-1].as_py():  # one group that may go on
            held = table
            continue
        res, held = step(table.combine_chunks(), False)
        yield res
    if held is not None:
        yield step(held.combine_chunks(), True)[0]


def _merge(spans: DataFrame) -> DataFrame:
    """Join the overlapping (start, end) of each text, by a running maximum; one row per joined span."""
    by = Window.partitionBy("h1", "h2").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    island = new.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("h1", "h2", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _of_large(records: DataFrame) -> DataFrame:
    """Spans of keys with very many records: any passage is covered by windows, and texts of a window are counted before the shuffle, so that no group is one task's."""
    windows = records.mapInArrow(_all_windows, "window bigint, h1 bigint, h2 bigint, start int")
    shared = cut(windows.groupBy("window").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("window"))
    return windows.join(small(shared), "window", "left_semi").select("h1", "h2", "start", (F.col("start") + OVER + 1).cast("int").alias("end"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, start_word, end_word, n_words)``: runs of over 50 words of a document that another document holds too (end exclusive).

    Words are runs of anything but space and \\t..\\r, A-Z folded; overlapping
    runs are joined. Documents are rows: equal texts of two rows repeat each
    other whole. Null and short texts have no passages; a null doc_id is passed
    on; other columns are not read; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    base = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit("again")).alias("h2")).where("text is not null")
    suffixes = cut(base.select("h1", "h2", "text").mapInArrow(_suffixes, "key bigint, h1 bigint, h2 bigint, place int"))
    keyed = suffixes.where("key is not null")
    shared = cut(keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key"))  # cut, so that the join's large partitions can be split
    places = cut(keyed.join(shared, "key").groupBy("h1", "h2").agg(F.collect_set("place").alias("places")))
    held = base.select("h1", "h2", "text").join(small(places.select("h1", "h2")), ["h1", "h2"], "left_semi")  # texts without a shared key stay where they are
    texts = places.join(held.dropDuplicates(["h1", "h2"]), ["h1", "h2"])  # copies are met before the shuffle
    records = cut(texts.mapInArrow(_contexts, _RECORD))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = cut(records.groupBy("key").count().where(F.col("count") > GROUP).select("key"))
    usual = records if large.isEmpty() else records.join(small(large), "key", "left_anti")
    found = usual.repartitionByRange(parts, "key").sortWithinPartitions(*_SORT).mapInArrow(_compare, _SPAN)
    if not large.isEmpty():
        found = found.unionByName(_of_large(records.join(small(large), "key", "left_semi")))
    copies = suffixes.where("key is null").groupBy("h1", "h2").agg(F.count("*").alias("c"), F.first("place").alias("end")).where("c > 1")
    found = found.unionByName(copies.select("h1", "h2", F.lit(0).alias("start"), "end"))
    spans = cut(_merge(found.distinct()))
    out = base.select("doc_id", "h1", "h2").join(small(spans), ["h1", "h2"])
    return out.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"))
