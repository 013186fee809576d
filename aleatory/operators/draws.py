"""Draws that spend bytes exactly, casts built on them, and catalogue scans."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.bytes import fnv1a
from ..functions.chunks import each, lists, rechunk
from ..functions.positions import offsets
from .protocols import log_bayes_factor

# Fixed values. King Wen numbers by lower (row) and upper (column) trigram, both in the order of TRIGRAMS.
TRIGRAMS = ("111", "100", "010", "001", "000", "011", "101", "110")
KING_WEN = (
    (1, 34, 5, 26, 11, 9, 14, 43),
    (25, 51, 3, 27, 24, 42, 21, 17),
    (6, 40, 29, 4, 7, 59, 64, 47),
    (33, 62, 39, 52, 15, 53, 56, 31),
    (12, 16, 8, 23, 2, 20, 35, 45),
    (44, 32, 48, 18, 46, 57, 50, 28),
    (13, 55, 63, 22, 36, 37, 30, 49),
    (10, 54, 60, 41, 19, 61, 38, 58),
)
#: Weights of the line values 6, 7, 8, 9; they add up to a power of two.
LINE_WEIGHTS = {"coins": (1, 3, 3, 1), "yarrow": (1, 5, 7, 3)}


def width(n: int) -> int:
    """Bytes of one trial for a uniform draw below n (none for 1)."""
    return math.ceil((n - 1).bit_length() / 8)


def uniform_ints(data: DataFrame, n: int, chunk: int = 1 << 14) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, i, v)``: draws below n from consecutive big-endian values, those at or over the last full multiple of n refused.

    Each chunk (of ``chunk`` values) gives a list of draws; sums of their numbers give their places.
    A draw below 1 takes no bytes, so no stream says how many there are: each source gives one.
    """
    if n < 1:
        raise ValueError("a bound of at least 1")
    if n == 1:
        return data.select("source").distinct().select("source", F.lit(0).cast("bigint").alias("i"), F.lit(0).alias("v"))
    k = width(n)

    def draw(off: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        starts, counts = bounds[:-1], np.diff(bounds) // k  # a last value of too few bytes is left over
        row = np.repeat(np.arange(len(off)), counts)
        at = starts[row] + k * (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
        value = sum((raw[at + i].astype(np.int64) << (8 * (k - 1 - i)) for i in range(k)), np.zeros(len(at), np.int64))
        fine = value < 256**k // n * n
        drawn = np.bincount(row[fine], minlength=len(off))
        return np.arange(len(off)), {"v": lists((value[fine] % n).astype(np.int32), drawn, pa.int32()), "n": pa.array(drawn)}

    drawn = each(rechunk(data, chunk * k), draw, "v array<int>, n bigint", ("source", "off"))
    placed = offsets(drawn, ["source"], "off", "n", "o", bucket=chunk * k * 4096)
    return placed.select("source", "o", F.posexplode("v").alias("j", "v")).select("source", (F.col("o") + F.col("j")).alias("i"), "v")


class _Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def below(self, n: int) -> int:
        k = width(n)
        while k:
            if self.at + k > len(self.data):
                raise EOFError
            v = int.from_bytes(self.data[self.at : self.at + k], "big")
            self.at += k
            if v < 256**k // n * n:
                return v % n
        return 0


def _without_replacement(cursor: _Cursor, n: int, k: int) -> list[int]:
    deck = list(range(n))
    for i in range(k):
        j = i + cursor.below(n - i)
        deck[i], deck[j] = deck[j], deck[i]
    return deck[:k]


_DRAW = StructType([StructField("drawn", ArrayType(IntegerType())), StructField("used", IntegerType())])


def _rows(data: pd.Series, f) -> Iterator[tuple]:
    for x in data:
        c = _Cursor(bytes(x)) if x is not None else _Cursor(b"")
        try:
            out = f(c)
        except EOFError:
            out = None  # too few bytes
        yield out, c.at


def draw_without_replacement(n: int, k: int):
    """A UDF of a binary column: k of n by a partial Fisher-Yates shuffle, and the bytes used; null if they run out."""

    @F.pandas_udf(_DRAW)
    def draw(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(_rows(data, lambda c: _without_replacement(c, n, k))), columns=_DRAW.names)

    return draw


def energy_race(items: int):
    """A UDF of a binary column: a tenth of the items (12 at least, all at most) gain 0..10 a round; the round's first at 100 ends it."""
    size = max(min(int(0.1 * items + 0.5), items), min(12, items))

    def race(c: _Cursor) -> list[int]:
        chosen = _without_replacement(c, items, size)
        energy = [0] * size
        while True:
            for i in range(size):
                energy[i] += c.below(11)
                if energy[i] >= 100:
                    return [v for pair in zip(chosen, energy, strict=True) for v in pair]

    @F.pandas_udf(_DRAW)
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(_rows(data, race)), columns=_DRAW.names)

    return run


@F.pandas_udf(_DRAW)
def vitality(data: pd.Series) -> pd.DataFrame:
    """The largest of three draws of 0..1000; over 950, draws of 0..100 are added while they are at least 50."""

    def value(c: _Cursor) -> list[int]:
        v = max(c.below(1001) for _ in range(3))
        if v > 950:
            while (more := c.below(101)) >= 50:
                v += more
        return [v]

    return pd.DataFrame(list(_rows(data, value)), columns=_DRAW.names)


def hexagram(bits: Column, method: str = "coins") -> Column:
    """Lines (6 to 9, bottom up), primary and relating King Wen numbers and the changing places, from a string of 0 and 1."""
    weights = LINE_WEIGHTS[method]
    n = sum(weights).bit_length() - 1
    of = F.array(*[F.lit(v) for v, w in zip((6, 7, 8, 9), weights, strict=True) for _ in range(w)])
    lines = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.element_at(of, F.conv(F.substr(bits, i * n + 1, F.lit(n)), 2, 10).cast("int") + 1))
    place = {t: i for i, t in enumerate(TRIGRAMS)}
    wen = F.array(*[F.lit(KING_WEN[place[f"{v:06b}"[:3]]][place[f"{v:06b}"[3:]]]) for v in range(64)])
    number = lambda yang: F.element_at(wen, F.aggregate(yang, F.lit(0), lambda a, y: a * 2 + y) + 1)
    moving = lambda x: (x == 6) | (x == 9)

    def cast(ls: Column) -> Column:
        primary = number(F.transform(ls, lambda x: x % 2))
        relating = number(F.transform(ls, lambda x: F.when(moving(x), 1 - x % 2).otherwise(x % 2)))
        changing = F.filter(F.sequence(F.lit(1), F.lit(6)), lambda p: moving(F.element_at(ls, p)))
        return F.struct(ls.alias("lines"), primary.alias("primary"), F.when(F.exists(ls, moving), relating).alias("relating"), changing.alias("changing"))

    return F.transform(F.array(lines), cast)[0]  # so the lines are made once


def figures(n: Column) -> Column:
    """Figures of four rows (as numbers 0..15, the first row the highest bit) from a number of 16 bits: mothers, daughters (their transpose), nieces, witnesses and judge by XOR.

    Plain arithmetic, compiled as such; each figure reads ``n`` many times, so it should be a column.
    """
    row = lambda xs: xs[0] * 8 + xs[1] * 4 + xs[2] * 2 + xs[3]
    mothers = [F.shiftright(n, 12 - 4 * m).bitwiseAND(F.lit(15)) for m in range(4)]
    daughters = [row([F.shiftright(n, 15 - 4 * m - k).bitwiseAND(F.lit(1)) for m in range(4)]) for k in range(4)]
    pair = lambda x, i: x[2 * i].bitwiseXOR(x[2 * i + 1])
    nieces = [pair(mothers, 0), pair(mothers, 1), pair(daughters, 0), pair(daughters, 1)]
    right, left = pair(nieces, 0), pair(nieces, 1)
    return F.struct(F.array(*mothers).alias("mothers"), F.array(*daughters).alias("daughters"), F.array(*nieces).alias("nieces"), F.array(right, left).alias("witnesses"), right.bitwiseXOR(left).alias("judge"))


def shield(bits: Column) -> Column:
    """The figures of a string of 0 and 1, its first 16 characters; of a shorter one all are null."""
    b = F.substring(bits, 1, 16)
    return figures(F.when(F.length(b) == 16, F.conv(b, 2, 10).cast("int")))


def houses(cast: Column) -> Column:
    """The twelve houses of a shield: mothers, daughters, nieces."""
    return F.concat(cast["mothers"], cast["daughters"], cast["nieces"])


def scan_deviation(catalog: DataFrame, items: int, data: DataFrame, most: int | None = None) -> DataFrame:
    """``catalog(ord, name)`` ranked in each source by the Bayes factor of the low bits of bytes r * items + ord, over all full rounds that a source's chunks ``(source, off, bytes)`` hold (at most ``most``).

    Chunks count their bits per item before the shuffle.
    """

    def count(off: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        row = np.repeat(np.arange(len(off)), np.diff(bounds))
        item = (off[row] + np.arange(len(raw)) - bounds[row]) % items
        k = np.bincount(row * items + item, raw & 1, len(off) * items).astype(np.int64)
        return np.repeat(np.arange(len(off)), items), {"ord": pa.array(np.tile(np.arange(items), len(off))), "k": pa.array(k)}

    rounds = F.floor(F.max(F.col("off") + F.length("bytes")) / items)
    sizes = data.groupBy("source").agg((rounds if most is None else F.least(rounds, F.lit(most))).alias("rounds"))
    limited = data.join(sizes, "source").where(F.col("off") < F.col("rounds") * items)
    # A chunk over the end of the last full round is cut there.
    whole = limited.select("source", "rounds", "off", F.substr("bytes", F.lit(1), F.least(F.length("bytes"), F.col("rounds") * items - F.col("off")).cast("int")).alias("bytes"))
    hits = each(whole, count, "ord bigint, k bigint", ("source", "rounds")).groupBy("source", "rounds", "ord").agg(F.sum("k").alias("k"))
    n = F.col("rounds")
    out = catalog.join(hits, "ord").withColumn("z", (F.col("k") - n / 2) / F.sqrt(n / 4)).withColumn("ln_bf", log_bayes_factor(F.col("k"), n))
    order = Window.partitionBy("source").orderBy(F.desc(F.round("ln_bf", 9)), fnv1a(F.col("name")), "name")  # one row per item of a catalogue
    return out.select("source", "ord", "name", "rounds", "k", "z", "ln_bf", F.row_number().over(order).alias("rank"))


def scan_tripolar(catalog: DataFrame, items: int, data: DataFrame) -> DataFrame:
    """The catalogue scanned thrice, for high, low and baseline, on consecutive parts of a source of equally many full rounds; as ``scan_deviation``, with ``intention``."""
    size = data.groupBy("source").agg((F.floor(F.max(F.col("off") + F.length("bytes")) / (3 * items)) * items).alias("size"))
    held = data.join(size, "source")
    end = F.col("off") + F.length("bytes")
    parts = None
    for k, name in enumerate(("high", "low", "baseline")):
        low, high = F.greatest(F.col("off"), F.col("size") * k), F.least(end, F.col("size") * (k + 1))
        own = held.where(low < high).select("source", (low - F.col("size") * k).alias("off"), F.substr("bytes", (low - F.col("off") + 1).cast("int"), (high - low).cast("int")).alias("bytes"))
        one = scan_deviation(catalog, items, own).withColumn("intention", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return parts
