"""Continuous health tests: repetition count and adaptive proportion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chain import entries
from ..functions.chunks import each, haloed, lists, rechunk, records, slices
from ..functions.shared import cut


def rct_cutoff(h: float) -> int:
    return 1 + math.ceil(20 / h)


def apt_cutoff(h: float, window: int) -> int:
    """1 + the least k whose binomial CDF at 2**-h reaches 1 - 2**-20, by log-space terms."""
    p, total = 2.0**-h, 0.0
    for k in range(window + 1):
        rest = math.lgamma(window + 1) - math.lgamma(k + 1) - math.lgamma(window - k + 1)
        total += math.exp(rest + k * math.log(p) + (window - k) * math.log1p(-p))
        if total >= 1 - 2.0**-20:
            return k + 1
    return window + 1


def with_cutoffs(claims: DataFrame, window: int) -> DataFrame:
    """``claims(..., h)`` with the tests' cutoffs ``rct`` and ``apt`` at h bits of min-entropy per sample, worked out once for each value of h."""

    def cutoffs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf.dropna()
            yield pd.DataFrame({"h": pdf["h"], "rct": [rct_cutoff(h) for h in pdf["h"]], "apt": [apt_cutoff(h, window) for h in pdf["h"]]})

    return claims.join(claims.select("h").where("h > 0").distinct().mapInPandas(cutoffs, "h double, rct int, apt int"), "h")


def _run_starts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each byte: where its run of equal bytes starts, runs ending with their chunk."""
    new = np.ones(len(raw), bool)
    new[1:] = raw[1:] != raw[:-1]
    new[bounds[:-1][bounds[:-1] < len(raw)]] = True
    return np.maximum.accumulate(np.where(new, np.arange(len(raw)), 0))


def rct_alarms(data: DataFrame, cutoff: int, bucket: int = 1 << 16) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, pos, b)`` of each alarm: the place in a run reaches the cutoff, and every cutoff - 1 after.

    Runs are found in chunks of ``bucket`` bytes; a run that reaches a chunk's
    start is continued with the length that it has there, carried by one row per
    chunk.
    """
    chunks = rechunk(data, bucket)

    def ends(off: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        start = _run_starts(raw, bounds)
        last = bounds[1:] - 1
        columns = {"first": raw[bounds[:-1]], "last": raw[last], "tail": bounds[1:] - start[last], "whole": start[last] == bounds[:-1]}
        return np.arange(len(off)), {"k": pa.array(off // bucket), **{c: pa.array(v.astype(np.int64)) for c, v in columns.items()}}

    order = Window.partitionBy("source").orderBy("k")
    chain = each(chunks, ends, "k bigint, first bigint, last bigint, tail bigint, whole bigint").withColumn("prev", F.lag("last").over(order))
    chain = chain.withColumn("start", ((F.col("whole") == 0) | F.col("prev").isNull() | (F.col("prev") != F.col("first"))).cast("int"))
    chain = chain.withColumn("g", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    upto = Window.partitionBy("source", "g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    carry = chain.select("source", (F.col("k") + 1).alias("k"), F.sum("tail").over(upto).alias("carry"), "last")
    joined = chunks.withColumn("k", F.floor(F.col("off") / bucket)).join(carry, ["source", "k"], "left").select("source", "off", "bytes", F.coalesce("carry", F.lit(0)).alias("carry"), F.coalesce("last", F.lit(-1)).alias("last"))

    def alarms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, carried, last = (batch.column(c).to_numpy() for c in ("off", "carry", "last"))
            for a, b, raw, bounds in slices(batch.column("bytes")):
                row = np.repeat(np.arange(a, b), np.diff(bounds))
                start = _run_starts(raw, bounds)
                first = bounds[row - a]
                goes_on = (start == first) & (raw == last[row])
                length = np.arange(len(raw)) - start + 1 + np.where(goes_on, carried[row], 0)
                hit = np.flatnonzero((length >= cutoff) & ((length - cutoff) % (cutoff - 1) == 0))
                yield pa.RecordBatch.from_arrays([batch.column("source").take(pa.array(row[hit])), pa.array(off[row[hit]] + hit - first[hit]), pa.array(raw[hit].astype(np.int32))], names=["source", "pos", "b"])

    return joined.mapInArrow(alarms, f"source {dict(data.dtypes)['source']}, pos bigint, b int")


def apt_windows(data: DataFrame, window: int, cutoff: int) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, w, first, count, alarm)`` over fixed windows of bytes: how often the first one comes up. These are the test's windows up to a source's first alarm."""

    def count(row: np.ndarray, index: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        same = (record == record[:, :1]).sum(1)
        return row, {"w": pa.array(index), "first": pa.array(record[:, 0].astype(np.int32)), "count": pa.array(same), "alarm": pa.array(same >= cutoff)}

    return records(data, window, count, "w bigint, first int, count bigint, alarm boolean")


def _apt_steps(b: np.ndarray, window: int, cutoff: int) -> tuple[np.ndarray, np.ndarray]:
    """For a window that starts at each place: whether it alarms, and where the next one starts."""
    n = len(b)
    here, order = np.arange(n), np.argsort(b, kind="stable")
    last = np.full(n, n + window)  # place of the cutoff-th value like this one
    x, y = order[: max(n - cutoff + 1, 0)], order[cutoff - 1 :]
    same = b[x] == b[y]
    last[x[same]] = y[same]
    alarm = last - here < window
    return alarm, np.where(alarm, last + 1, here + window)


def apt_alarms(data: DataFrame, window: int, cutoff: int, segment: int = 1 << 16) -> DataFrame:
    """Chunks ``(source, off, bytes)`` without gaps to ``(source, pos)`` of each alarm of the sequential test on bytes, windows starting anew after one.

    A segment is walked from each of the ``window`` places at which its first
    window may start, and says where the next segment's first one then starts.
    These are composed by a tree (``chain.entries``); then each segment is walked
    once more from the place that really occurs. A segment also reads the
    window - 1 bytes after it.
    """
    segment = max(segment, window)
    dealt = haloed(data, segment, after=window - 1)
    source = dict(data.dtypes)["source"]

    def leave(off: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        out = []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            n = min(int(high - low), segment)
            _, after = _apt_steps(raw[low:high], window, cutoff)
            at = np.arange(window)
            while (inside := at < n).any():
                at[inside] = after[at[inside]]
            out.append(at - n)
        return np.arange(len(off)), {"leave": lists(np.concatenate(out), np.full(len(out), window), pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, enter = batch.column("off").to_numpy(), batch.column("enter").to_numpy()
            for a, b, raw, bounds in slices(batch.column("bytes")):
                row, pos = [], []
                for r in range(a, b):
                    x = raw[bounds[r - a] : bounds[r - a + 1]]
                    alarm, after = _apt_steps(x, window, cutoff)
                    at = int(enter[r])
                    while at < min(len(x), segment):
                        if alarm[at]:
                            row.append(r)
                            pos.append(int(off[r] + after[at] - 1))
                        at = int(after[at])
                yield pa.RecordBatch.from_arrays([batch.column("source").take(pa.array(row, pa.int64())), pa.array(pos, pa.int64())], names=["source", "pos"])

    starts = entries(cut(each(dealt, leave, "leave array<bigint>", ("source", "c")).withColumnRenamed("c", "b"))).withColumnRenamed("b", "c")
    return dealt.join(starts, ["source", "c"]).select("source", "off", "enter", "bytes").mapInArrow(run, f"source {source}, pos bigint")
