"""Casts that one reader draws from a whole stream, one after another, by exact draws.

A draw below n takes as many bytes as n - 1 has and starts anew if their value
is at or over the last full multiple of n, so where a cast begins hangs on
every byte before it. A block of the stream is parsed from every place that a
draw may have reached at its border; the places' exits are composed by a tree,
and each block is then read once more from the place that is the true one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chain import FAN, entries
from ..functions.chunks import each, lists, rechunk, slices
from ..functions.positions import offsets
from ..functions.shared import cut
from .draws import width

BLOCK = 1 << 20


class Reader:
    """The draws of one cast over a block: ``states`` are (draw, bytes of its trial already read)."""

    def __init__(self, bounds: tuple[int, ...]) -> None:
        if min(bounds) < 1 or max(bounds) > 1 << 48:
            raise ValueError("bounds are 1 to 2^48")
        self.bounds = bounds
        self.drawn = [i for i, n in enumerate(bounds) if n > 1]  # draws below 1 take no bytes
        if not self.drawn:
            raise ValueError("a cast without bytes never ends")
        self.live = self.drawn * 2 if len(self.drawn) == 1 else self.drawn  # so that the state after a draw isn't the one before it
        self.size = [width(bounds[i]) for i in self.live]
        self.states = [(p, j) for p, k in enumerate(self.size) for j in range(k)]
        self.place = {s: i for i, s in enumerate(self.states)}
        self.halo = max(self.size) - 1

    def steps(self, buf: np.ndarray) -> list[np.ndarray]:
        """For each draw: the place after it, if its first trial starts at a place of the buffer; n + s where it ends the block in state s."""
        n, out = len(buf), []
        for p, k in enumerate(self.size):
            bound = self.bounds[self.live[p]]
            whole = max(n - k + 1, 0)
            value = np.zeros(whole, np.int64)
            for i in range(k):
                value = value * 256 + buf[i : i + whole]
            fine = np.zeros(n, bool)
            fine[:whole] = value < 256**k // bound * bound
            to = np.empty(n + len(self.states), np.int64)
            to[n:] = np.arange(n, n + len(self.states))
            for r in range(min(k, n)):  # trials of one draw are k bytes apart
                at = np.arange(r, n, k)
                hit = np.where(fine[at], at + k, n + n + k)
                ahead = np.minimum.accumulate(hit[::-1])[::-1]
                ended = np.where(ahead == n, n + self.place[(p + 1) % len(self.size), 0], n + self.place[p, (n - r) % k])
                to[at] = np.where(ahead < n, ahead, ended)
            out.append(to)
        return out

    def leave(self, buf: np.ndarray, halo: int) -> np.ndarray:
        """The state at the end for each state on entering; ``halo`` bytes of the buffer belong to the block before."""
        n, to = len(buf), self.steps(buf)
        cast = to[0]
        for t in to[1:]:
            cast = t[cast]
        at = np.empty(len(self.states), np.int64)
        for i, (p, j) in enumerate(self.states):
            if j > halo:  # no reader comes so far before the first block
                at[i] = n
                continue
            x = np.array([halo - j]) if halo - j < n else np.array([n + i])
            for t in to[p:]:
                x = t[x]
            at[i] = x[0]
        while (at < n).any():  # doubling: as many casts at once as the step is long
            at = cast[at]
            if (at < n).any():
                cast = cast[cast]
        return at - n

    def read(self, buf: np.ndarray, halo: int, state: int) -> np.ndarray:
        """The draws that end in the block, by a reader that enters in ``state``."""
        n, to = len(buf), self.steps(buf)
        p, j = self.states[state]
        x, out = halo - j, []

        def value(end: np.ndarray, q: int) -> np.ndarray:
            """The draw whose last trial ends there; one that ends with the block leads to a place past its end."""
            k, end = self.size[q], np.minimum(end, n)
            v = np.zeros(len(end), np.int64)
            for i in range(k):
                v = v * 256 + buf[np.maximum(end - k + i, 0)]
            return v % self.bounds[self.live[q]]

        while p and x < n:
            x2 = int(to[p][x])
            if not self._done(x2, n, p):
                return np.array(out, np.int64)
            out.append(int(value(np.array([x2]), p)[0]))
            x, p = x2, (p + 1) % len(self.size)
        if x >= n:
            return np.array(out, np.int64)
        cast = to[0]
        for t in to[1:]:
            cast = t[cast]
        jump, starts = cast[:n].tolist(), []
        while x < n:
            starts.append(x)
            x = jump[x]
        y, columns = np.array(starts, np.int64), []
        many = 0
        for q, t in enumerate(to):
            y2 = t[y]
            done = self._done(y2, n, q) & (y < n)
            columns.append(np.where(done, value(y2, q), 0))
            many += int(done.sum())
            y = y2
        return np.concatenate([np.array(out, np.int64), np.stack(columns, 1).ravel()[:many]])

    def _done(self, x: np.ndarray | int, n: int, p: int) -> np.ndarray | bool:
        """Whether the draw ended in the block: within it, or at its end, ready for the next draw."""
        return (x < n) | (x == n + self.place[(p + 1) % len(self.size), 0])


def draws_of_casts(data: DataFrame, bounds: tuple[int, ...], block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, o, v)``: the draws that end in each block, ``o`` being the number of draws before them in the source."""
    reader = Reader(tuple(bounds))
    block = max(block, reader.halo + 1)
    kind = dict(data.dtypes)["source"]
    blocks = rechunk(data, block).select("source", F.floor(F.col("off") / block).alias("b"), "bytes")
    if reader.halo:
        tail = blocks.select("source", (F.col("b") + 1).alias("b"), F.substr("bytes", F.greatest(F.length("bytes") - reader.halo + 1, F.lit(1))).alias("tail"))
        blocks = blocks.join(tail, ["source", "b"], "left").select("source", "b", F.coalesce(F.length("tail"), F.lit(0)).alias("halo"), F.concat(F.coalesce("tail", F.lit(b"")), "bytes").alias("bytes"))
    else:
        blocks = blocks.withColumn("halo", F.lit(0))
    blocks = cut(blocks)

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halo = batch.column("halo").to_pylist()
            for a, b, raw, bounds_ in slices(batch.column("bytes")):
                leave = [reader.leave(raw[bounds_[r] : bounds_[r + 1]], halo[a + r]) for r in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column("source").slice(a, b - a), batch.column("b").slice(a, b - a), pa.array(leave, pa.list_(pa.int64()))], names=["source", "b", "leave"])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halo, enter = batch.column("halo").to_pylist(), batch.column("enter").to_pylist()
            for a, b, raw, bounds_ in slices(batch.column("bytes")):
                v = [reader.read(raw[bounds_[r] : bounds_[r + 1]], halo[a + r], enter[a + r]) for r in range(b - a)]
                n = np.array([len(x) for x in v])
                yield pa.RecordBatch.from_arrays([batch.column("source").slice(a, b - a), batch.column("b").slice(a, b - a), pa.array(n, pa.int64()), lists(np.concatenate(v), n, pa.int64())], names=["source", "b", "n", "v"])

    tables = cut(blocks.mapInArrow(exits, f"source {kind}, b bigint, leave array<bigint>"))
    known = blocks.join(entries(tables, 0, fan), ["source", "b"])
    out = cut(known.mapInArrow(drawn, f"source {kind}, b bigint, n bigint, v array<bigint>"))
    return offsets(out, ["source"], "b", "n", "o", FAN).where("n > 0").select("source", "o", "v")


def casts(data: DataFrame, bounds: list[int], block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, i, v)``: cast i of a source, as the draws below each of ``bounds`` in turn.

    One reader advances over each source: no byte is skipped between casts, a
    refused trial is drawn again, draws below 1 take none, and a last cast
    that the bytes don't suffice for is left out. Casts that lie in one block
    are whole there; only those over a border meet in a shuffle.
    """
    reader, kind = Reader(tuple(bounds)), dict(data.dtypes)["source"]
    per = len(reader.drawn)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, (o, v) in enumerate(zip(batch.column("o").to_pylist(), batch.column("v"), strict=True)):
                v = v.values.to_numpy()
                head = min(-o % per, len(v))
                whole = (len(v) - head) // per
                cut_ = np.array([0, head, *(head + per * np.arange(1, whole + 1)), len(v)])
                first = o + cut_[:-1]
                size = np.diff(cut_)
                keep = size > 0
                rows = pa.array(np.full(int(keep.sum()), r))
                yield pa.RecordBatch.from_arrays([batch.column("source").take(rows), pa.array(first[keep] // per), pa.array(first[keep] % per), lists(v, size[keep], pa.int64())], names=["source", "i", "p", "v"])

    parts = cut(draws_of_casts(data, tuple(bounds), block, fan).mapInArrow(part, f"source {kind}, i bigint, p bigint, v array<bigint>"))
    over = parts.where(F.size("v") < per).groupBy("source", "i").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"])).alias("v")).where(F.size("v") == per)
    out = parts.where(F.size("v") == per).select("source", "i", "v").unionByName(over)
    place = {q: j for j, q in enumerate(reader.drawn)}
    return out.select("source", "i", F.array(*[F.col("v")[place[q]] if q in place else F.lit(0).cast("bigint") for q in range(len(bounds))]).alias("v"))


def without_replacement(data: DataFrame, n: int, k: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Chunks to ``(source, i, drawn)``: cast i takes ``k`` of ``n`` by a partial Fisher-Yates shuffle, each source being read by one advancing reader."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max((1 << 22) // n, 1)  # decks held at a time
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                one = batch.slice(a, rows)
                v = one.column("v")
                j = v.flatten().to_numpy().reshape(-1, k)
                deck, at = np.tile(np.arange(n, dtype=np.int32), (len(j), 1)), np.arange(len(j))
                for i in range(k):
                    to = i + j[:, i]
                    deck[at, i], deck[at, to] = deck[at, to], deck[at, i]
                yield pa.RecordBatch.from_arrays([one.column("source"), one.column("i"), lists(deck[:, :k].ravel(), np.full(len(j), k), pa.int32())], names=["source", "i", "drawn"])

    return casts(data, [n - i for i in range(k)], block, fan).mapInArrow(deal, f"source {dict(data.dtypes)['source']}, i bigint, drawn array<int>")
