"""Randomness extraction and entropy accounting."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.chunks import LATIN, SLICE, each, rechunk, slices, strings
from ..functions.positions import offsets
from ..functions.shared import Kept, cut, small

#: Share of an output's bits that a vetted conditioner may claim.
VETTED = 0.999


def von_neumann(data: DataFrame) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, off, i, bits)``: pairs of bits 01 give 0, 10 give 1, others nothing; ``bits`` is a string of 0 and 1, ``i`` the place of its first bit in the output.

    A byte holds four whole pairs, so each chunk gives its own bits, and sums of
    their numbers give their places.
    """

    def debias(off: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        pairs = np.unpackbits(raw).reshape(-1, 2)
        kept = pairs[:, 0] != pairs[:, 1]
        upto = np.append(0, np.cumsum(kept))
        counts = upto[4 * bounds[1:]] - upto[4 * bounds[:-1]]
        return np.arange(len(off)), {"bits": strings(pairs[kept, 0] + 48, counts), "n": pa.array(counts)}

    out = each(data, debias, "bits string, n bigint", ("source", "off"))
    return offsets(out, ["source"], "off", "n", "i").where("n > 0").select("source", "off", "i", "bits")


#: Bits of a node that one task works on by itself, and of a piece of a stream.
NODE, PIECE = 1 << 20, 1 << 22


def _halves(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """One level of the iteration on sequences laid end to end: unequal pairs' first bits, XORs of pairs, and equal pairs' bits, with the number that each sequence has of them. An odd last bit is dropped."""
    start = np.cumsum(sizes) - sizes
    pairs = sizes // 2
    first = np.repeat(start - 2 * (np.cumsum(pairs) - pairs), pairs) + 2 * np.arange(pairs.sum())
    a, x = flat[first], flat[first] ^ flat[first + 1]
    upto = np.append(0, np.cumsum(x, dtype=np.int64))
    ends = np.cumsum(pairs)
    unequal = upto[ends] - upto[ends - pairs]
    return a[x == 1], unequal, x, pairs, a[x == 0], pairs - unequal


def _peres_rows(flat: np.ndarray, sizes: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The iterated output of sequences laid end to end, all sequences of a level at once.

    A sequence's output comes before that of its XORs, and that before its
    equal pairs': the order of a key that gains a digit of 2 bits per level.
    """
    row, key = np.arange(len(sizes)), np.zeros(len(sizes), np.uint64)
    out: list[tuple[np.ndarray, ...]] = []
    shift = 62
    while len(sizes) and shift > 0:
        alive = (sizes >= 2) & (depths >= 1)
        flat = flat[np.repeat(alive, sizes)]
        sizes, depths, row, key = sizes[alive], depths[alive], row[alive], key[alive]
        fresh, n, xors, pairs, equal, left = _halves(flat, sizes)
        out.append((np.repeat(row, n), np.repeat(key, n), fresh))
        shift -= 2
        one, two = key | np.uint64(1 << shift), key | np.uint64(2 << shift)
        flat, sizes = np.concatenate([xors, equal]), np.concatenate([pairs, left])
        row, key, depths = np.tile(row, 2), np.concatenate([one, two]), np.tile(depths - 1, 2)
    rows, keys, bits = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
    return rows, bits[np.lexsort((keys, rows))].astype(np.uint8)


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n)


class _Rows:
    """Rows of packed bits, given on in batches of some SLICE bytes; ``tag`` columns are taken from rows of the input."""

    def __init__(self, batch: pa.RecordBatch, tag: tuple[str, ...], kinds: bool = False):
        self.batch, self.tag, self.kinds = batch, tag, kinds
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, row: int, bits: np.ndarray, kind: int = 0) -> bool:
        """Whether it is time to give on what is held."""
        self.rows.append((row, kind, len(bits), int(bits[0]) if len(bits) else 0, np.packbits(bits).tobytes()))
        self.held += len(self.rows[-1][-1]) + 64
        return self.held > SLICE

    def give(self) -> pa.RecordBatch:
        row, kind, n, head, packed = zip(*self.rows, strict=True)
        columns = {c: self.batch.column(c).take(pa.array(row, pa.int64())) for c in self.tag}
        columns |= {"kind": pa.array(kind, pa.int32())} if self.kinds else {}
        columns |= {"n": pa.array(n, pa.int64()), "head": pa.array(head, pa.int32()), "bits": pa.array(packed, pa.binary())}
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _joined(data: DataFrame, size: int) -> DataFrame:
    """Chunks, those that follow on each other in a task laid together up to some ``size`` bytes; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        source, start, end = None, 0, 0  # of what is held

        def give() -> pa.RecordBatch:
            whole = b"".join(held)
            held.clear()
            return pa.RecordBatch.from_arrays([source, pa.array([start], pa.int64()), pa.array([whole], pa.binary())], names=["source", "off", "bytes"])

        for batch in batches:
            sources, offs = batch.column("source"), batch.column("off").to_numpy()
            for a, b, raw, bounds in slices(batch.column("bytes")):
                same = pc.fill_null(pc.equal(sources.slice(a + 1, b - a - 1), sources.slice(a, b - a - 1)), False).to_numpy(zero_copy_only=False)
                off = offs[a:b]
                follows = same & (off[1:] == off[:-1] + np.diff(bounds)[:-1]) & (bounds[1:-1] // size == bounds[:-2] // size)
                first = np.append(0, np.flatnonzero(~follows) + 1)
                for i, j in zip(first, np.append(first[1:], b - a), strict=True):
                    own = sources.slice(a + i, 1)
                    if held and not (own.equals(source) and off[i] == end and end - start < size):
                        yield give()
                    if not held:
                        source, start, end = own, int(off[i]), int(off[i])
                    held.append(raw[bounds[i] : bounds[j]].tobytes())
                    end += int(bounds[j] - bounds[i])
        if held:
            yield give()

    return data.select("source", "off", "bytes").where(F.length("bytes") > 0).mapInArrow(run, f"source {dict(data.dtypes)['source']}, off bigint, bytes binary")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece's own output (kind 0), its XORs (1) and its equal pairs' bits (2). Pairs start at even places of the sequence: an odd piece leaves its first bit to the piece before, which has it as ``next``."""
    for batch in batches:
        out = _Rows(batch, ("source", "k"), kinds=True)
        odd, after, n, packed = (batch.column(c) for c in ("odd", "next", "n", "bits"))
        for r in range(batch.num_rows):
            bits = _bits(packed[r].as_py(), n[r].as_py())[odd[r].as_py() :]
            if after[r].is_valid:
                bits = np.append(bits, np.uint8(after[r].as_py()))
            pairs = bits[: len(bits) // 2 * 2].reshape(-1, 2)
            a, x = pairs[:, 0], pairs[:, 0] ^ pairs[:, 1]
            out.add(r, a[x == 1], 0)
            out.add(r, x, 1)
            if out.add(r, a[x == 0], 2):
                yield out.give()
        if out.rows:
            yield out.give()


def _finish(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """The whole output of sequences given as their pieces in order."""
    for batch in batches:
        out, parts = _Rows(batch, ("source", "k")), batch.column("parts")
        rows: list[int] = []
        flats: list[np.ndarray] = []

        def work() -> None:
            row, bits = _peres_rows(np.concatenate(flats), np.array([len(f) for f in flats]), np.full(len(flats), depth))
            for r, b in zip(rows, np.split(bits, np.cumsum(np.bincount(row, minlength=len(flats)))[:-1]), strict=True):
                out.add(r, b)
            rows.clear(), flats.clear()

        for r in range(batch.num_rows):
            rows.append(r)
            flats.append(np.concatenate([_bits(p["bits"], p["n"]) for p in parts[r].as_py()]))
            if sum(map(len, flats)) > SLICE or r == batch.num_rows - 1:
                work()
                yield out.give()


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed bits as strings of 0 and 1."""
    for batch in batches:
        n, packed = batch.column("n"), batch.column("bits")
        at = 0
        while at < batch.num_rows:
            to, chars = at, []
            while to < batch.num_rows and (not chars or sum(map(len, chars)) < SLICE):
                chars.append(_bits(packed[to].as_py(), n[to].as_py()) + 48)
                to += 1
            text = strings(np.concatenate(chars), np.array([len(c) for c in chars]))
            yield pa.RecordBatch.from_arrays([batch.column("of").slice(at, to - at), batch.column("i").slice(at, to - at), text], names=["source", "i", "bits"])
            at = to


def peres(data: DataFrame, depth: int = 64, node: int = NODE, piece: int = PIECE) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, i, bits)``: Peres' iterated debiasing of each source's whole stream of bits; ``bits`` is a string of 0 and 1, ``i`` the place of its first bit.

    The output is von Neumann's, then that of the pairs' XORs, then that of the
    equal pairs, each debiased in the same way, ``depth`` levels deep. Sequences
    longer than ``node`` bits are halved by many tasks, level by level, in the
    pieces of the stream (``piece`` bits or so): a piece's XORs and equal pairs
    stay with it, and what it has to know of the others is whether it starts at
    an even place and which bit comes after it, from a table of a row per piece
    and sequence. Shorter sequences are finished by one task each. So the result
    doesn't hang on the chunks, and each level is about three quarters of the
    one before. Bits are kept packed, only those of sequences to be finished
    are shuffled (all, if chunks are small and lie in no order, or if the table
    has over BROADCAST_ROWS rows), and a level is dropped when the next is written.
    """
    kind = dict(data.dtypes)["source"]
    node, size = max(node, 2), max(piece // 8, 1)
    if depth < 1:
        return data.select("source", F.lit(0).cast("bigint").alias("i"), F.lit("").alias("bits")).limit(0)
    pieces = Kept(_joined(data, size))
    rows, total = pieces.read().agg(F.count("*"), F.sum(F.length("bytes"))).first()
    if rows and total * 4 < rows * size:  # chunks lay in no order
        last, pieces = pieces, Kept(rechunk(pieces.read(), size))
        last.drop()
    key = F.struct(F.col("source").alias("of"), F.lit("").alias("path")).alias("source")
    head = F.conv(F.hex(F.substring("bytes", 1, 1)), 16, 10).cast("int") >= 128
    now = pieces.read().select(key, F.col("off").alias("k"), (F.length("bytes") * 8).cast("bigint").alias("n"), head.cast("int").alias("head"), F.col("bytes").alias("bits"))
    gone: list[tuple[Kept, int | None]] = [(pieces, None)]
    found: list[DataFrame] = []
    upto = Window.partitionBy("source").orderBy("k")
    columns = f"source struct<of: {kind}, path: string>, k bigint, {{}}n bigint, head int, bits binary"
    for level in range(depth):
        now = now.where("n > 0")
        places = now.select("source", "k", "n", (F.sum("n").over(upto) % 2).alias("end"), F.lead("head").over(upto).alias("next"), F.sum("n").over(Window.partitionBy("source")).alias("size"))
        places = cut(places.select("source", "k", ((F.col("end") + F.col("n")) % 2).cast("int").alias("odd"), F.when(F.col("end") == 1, F.col("next")).alias("next"), "size"))
        large = cut(places.where(F.col("size") > node).drop("size"))
        short = small(cut(places.where(F.col("size") <= node).select("source").distinct()))
        rest = now.join(short, "source").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("k", "n", "bits"))).alias("parts")).withColumn("k", F.lit(0).cast("bigint"))
        found.append(Kept(rest.mapInArrow(lambda batches, left=depth - level: _finish(batches, left), columns.format(""))).read())
        parts = None if large.isEmpty() else Kept(now.join(small(large), ["source", "k"]).mapInArrow(_split, columns.format("kind int, ")), by="kind")
        for kept, part in gone:
            kept.drop(part)
        gone = [(parts, 1), (parts, 2)] if parts else []
        if not parts:
            break
        child = lambda digit: F.struct(F.col("source.of").alias("of"), F.concat("source.path", F.lit(str(digit))).alias("path")).alias("source")
        now = parts.read(1).select(child(1), "k", "n", "head", "bits").unionByName(parts.read(2).select(child(2), "k", "n", "head", "bits"))
        found.append(parts.read(0))
    for kept, part in gone:
        kept.drop(part)
    found = [f.where("n > 0") for f in found]
    # Paths in the order of the output: a sequence's own path comes before those under it. One row per piece and path of a source.
    before = Window.partitionBy("source.of").orderBy("source.path", "k").rowsBetween(Window.unboundedPreceding, -1)
    places = [f.select(F.lit(j).alias("level"), "source", "k", "n") for j, f in enumerate(found)]
    places = cut(reduce(DataFrame.unionByName, places).select("level", "source", "k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("i")))
    placed = [f.join(small(places.where(F.col("level") == j).drop("level")), ["source", "k"]) for j, f in enumerate(found)]
    out = reduce(DataFrame.unionByName, placed).select(F.col("source.of").alias("of"), "i", "n", "bits")
    return out.mapInArrow(_written, f"source {kind}, i bigint, bits string")


def bit_blocks(pieces: DataFrame, size: int) -> DataFrame:
    """``(source, i, bits)`` in pieces that start at multiples of ``size`` (the last of a source is shorter). Blocks within a piece are cut from it; only pieces' ends are shuffled."""

    def cut_(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("i").to_numpy()
            for a, b, raw, bounds in slices(batch.column("bits").cast(pa.binary())):
                i, n = places[a:b], np.diff(bounds)
                low = -(-i // size) * size
                high = np.maximum((i + n) // size * size, low)
                if whole:
                    count = (high - low) // size
                    row = np.repeat(np.arange(len(i)), count)
                    at = low[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
                    counts = np.full(len(row), size)
                    first = bounds[:-1][row] + at - i[row]
                else:
                    row = np.repeat(np.arange(len(i)), 2)
                    at = np.stack([i, high], 1).ravel()
                    counts = np.stack([np.minimum(low - i, n), np.maximum(i + n - high, 0)], 1).ravel()
                    row, at, counts = row[counts > 0], at[counts > 0], counts[counts > 0]
                    first = bounds[:-1][row] + at - i[row]
                chars = raw[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
                yield pa.RecordBatch.from_arrays([batch.column("source").take(pa.array(row + a)), pa.array(at), strings(chars, counts)], names=["source", "i", "bits"])

    pieces = pieces.select("source", "i", "bits").where(F.length("bits") > 0)
    whole, ends = (pieces.mapInArrow(lambda batches, w=w: cut_(batches, w), pieces.schema) for w in (True, False))
    ends = rechunk(ends.select("source", F.col("i").alias("off"), F.encode("bits", LATIN).alias("bytes")), size)
    return whole.unionByName(ends.select("source", F.col("off").alias("i"), F.decode("bytes", LATIN).alias("bits")))


def peres_rate(p: float, depth: int = 25) -> float:
    """Output bits per input bit at bias p."""
    if depth == 0 or p in (0.0, 1.0):
        return 0.0
    q = 1 - p
    same = p * p + q * q
    return p * q + peres_rate(2 * p * q, depth - 1) / 2 + same / 2 * peres_rate(p * p / same, depth - 1)


def pool_bytes(h: float, safety: float) -> int:
    """Bytes pooled for each 32-byte block at h bits of min-entropy per byte."""
    return math.ceil(safety * 256 / h)


def condition(data: DataFrame, block: int) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, block, digest)``: SHA-256 of each full pool, as hex."""
    pool = rechunk(data, block).where(F.length("bytes") == block)
    return pool.select("source", F.floor(F.col("off") / block).alias("block"), F.sha2("bytes", 256).alias("digest"))


def toeplitz(seed: str, inputs: int, outputs: int):
    """A UDF of a binary column of inputs bits to a string of outputs: y(i) = XOR over j of s(i - j + inputs - 1) * x(j), of a seed of inputs + outputs - 1 bits (0 and 1).

    Row i of the matrix is a reversed window of the seed; a bit is the parity of
    the ones that input and window share, counted in 64-bit words.
    """
    if len(seed) != inputs + outputs - 1:
        raise ValueError("a seed of inputs + outputs - 1 bits")
    width = -(-inputs // 64) * 8
    rows = np.packbits([[int(c) for c in seed[i : i + inputs][::-1].ljust(width * 8, "0")] for i in range(outputs)], axis=1).view(np.uint64)

    @F.pandas_udf(StringType())
    def run(data: pd.Series) -> pd.Series:
        out = []
        block = max(1, (1 << 22) // rows.size)  # inputs whose words are held at a time
        for i in range(0, len(data), block):
            x = np.frombuffer(b"".join(bytes(v)[:width].ljust(width, b"\0") for v in data[i : i + block]), np.uint64).reshape(-1, 1, width // 8)
            bits = np.bitwise_count(x & rows).sum(2, dtype=np.int64) & 1
            out += [bytes(r).decode() for r in (bits + 48).astype(np.uint8)]
        return pd.Series(out)

    return run


def toeplitz_output_bits(k: Column, epsilon: float) -> Column:
    return F.floor(k - 2 * F.log2(F.lit(1 / epsilon)))


def vetted_output_entropy(h: Column, bits: int) -> Column:
    return F.least(h, F.lit(VETTED * bits))


def claim(h_per_byte: Column, n: Column) -> Column:
    """Start of an account: h bits of min-entropy per byte (over 0, at most 8) over n bytes."""
    ok = (h_per_byte > 0) & (h_per_byte <= 8)
    return F.when(ok, h_per_byte * n).otherwise(F.raise_error(F.lit("invalid_claim: 0 < h <= 8")).cast("double"))


def debias_account(debiased: DataFrame) -> DataFrame:
    """``(source, off, bytes, bits, trace)`` of von Neumann's output: the bytes that each chunk completes in its source's stream of bits, all their bits credited, on a stated assumption.

    Only the bits after a source's last whole byte are left out, so a source is
    credited the same however its bytes were cut into chunks.
    """
    n = F.floor((F.col("i") + F.length("bits")) / 8) - F.floor(F.col("i") / 8)
    return debiased.select("source", "off", n.alias("bytes"), (n * 8).cast("double").alias("bits"), F.lit("input: independent bits of one bias; von-neumann").alias("trace"))
