"""The seeded generator as a stream that any task can enter at any place.

A step of xorshift32 is linear over bits: a 32 x 32 matrix of 0 and 1. Powers of
the matrix skip ahead, so parts of one sequential chain are made by different
tasks; within a task many lanes step side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

GOLDEN = 0x9E3779B9
PERIOD = (1 << 32) - 1


def _step(s: np.ndarray) -> np.ndarray:
    s = s ^ (s << np.uint32(13))
    s = s ^ (s >> np.uint32(17))
    return s ^ (s << np.uint32(5))


def _apply(matrix: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A matrix, as the images of the 32 single bits, on states."""
    out = np.zeros_like(s)
    for i in range(32):
        out ^= np.where(s >> np.uint32(i) & np.uint32(1), matrix[i], np.uint32(0))
    return out


@cache
def _power(i: int) -> np.ndarray:
    """The matrix of 2**i steps."""
    if i == 0:
        return _step(np.uint32(1) << np.arange(32, dtype=np.uint32))
    half = _power(i - 1)
    return _apply(half, half)


def skip(state: np.ndarray, steps: int) -> np.ndarray:
    """States so many steps later."""
    steps, i = steps % PERIOD, 0
    while steps >> i:
        if steps >> i & 1:
            state = _apply(_power(i), state)
        i += 1
    return state


def states(seed: int, first: int, count: int) -> np.ndarray:
    """The generator's states ``first`` to ``first + count - 1``, as unsigned 32-bit numbers; state 0 is the first after the seed (0 counts as 1)."""
    length = max(int(count**0.5), 1)
    lanes = -(-count // length)
    starts = skip(np.array([seed & 0xFFFFFFFF or 1], np.uint32), first)
    jump = 1  # lanes double: the second half starts where the first half ends
    while len(starts) < lanes:
        starts = np.append(starts, skip(starts, length * jump))
        jump *= 2
    s, out = starts[:lanes], np.empty((length, lanes), np.uint32)
    for i in range(length):
        s = _step(s)
        out[i] = s
    return out.T.ravel()[:count]


def stream(spark: SparkSession, count: int, seed: int = GOLDEN, block: int = 1 << 16) -> DataFrame:
    """``(i, state)``: the first ``count`` states of the one chain that ``seed`` starts, made by as many tasks as there are blocks of it."""
    blocks = spark.range(0, -(-count // block), 1, min(max(-(-count // block), 1), 4096))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch["id"]:
                n = min(block, count - b * block)
                yield pd.DataFrame({"i": np.arange(b * block, b * block + n), "state": states(seed, int(b) * block, n).astype(np.int64)})

    return blocks.mapInPandas(run, "i long, state long")


def field(spark: SparkSession, runs: int, count: int, width: float, height: float, seed: int = GOLDEN, block: int = 1 << 15) -> DataFrame:
    """``(run, id, x, y)``: ``runs`` fields of ``count`` points of a rectangle, drawn one after another from one chain, two states a point as 32-bit fractions."""
    total = runs * count
    blocks = spark.range(0, -(-total // block), 1, min(max(-(-total // block), 1), 4096))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch["id"]:
                n = min(block, total - b * block)
                s = states(seed, 2 * int(b) * block, 2 * n).reshape(-1, 2) / 4294967296.0
                i = np.arange(b * block, b * block + n)
                yield pd.DataFrame({"run": i // count, "id": i % count, "x": s[:, 0] * width, "y": s[:, 1] * height})

    return blocks.mapInPandas(run, "run long, id long, x double, y double")


def unit(state):
    """A state (a column or a number) as a number between 0 and 1, both excluded."""
    return (state + 0.5) / 4294967296.0
