"""Trials, calibration and z-scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import each

BITS_PER_TRIAL = 200
MIN_CALIBRATION = 500


def trials_from_bytes(data: DataFrame, bits: int = BITS_PER_TRIAL) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, t, sum)``: one-bits of each ``bits`` consecutive bits; a partial last trial is dropped.

    A chunk gives one partial count for each trial that it touches; these are
    added up before the shuffle.
    """
    if bits < 8:
        raise ValueError("a trial has at least 8 bits")

    def count(off: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        ones = np.append(0, np.cumsum(np.unpackbits(raw), dtype=np.int32))
        start, size = off * 8, np.diff(bounds) * 8
        first = start // bits
        pieces = np.where(size > 0, (start + size - 1) // bits - first + 1, 0)
        row = np.repeat(np.arange(len(off)), pieces)
        t = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        low = np.maximum(t * bits, start[row]) - start[row]
        high = np.minimum((t + 1) * bits - start[row], size[row])
        at = 8 * bounds[row]
        return row, {"t": pa.array(t), "ones": pa.array((ones[at + high] - ones[at + low]).astype(np.int32)), "n": pa.array((high - low).astype(np.int32))}

    parts = each(data, count, "t bigint, ones int, n int")
    full = parts.groupBy("source", "t").agg(F.sum("ones").cast("int").alias("sum"), F.sum("n").alias("n")).where(F.col("n") == bits)
    return full.select("source", "t", "sum")


def theoretical_calibration(bits: int = BITS_PER_TRIAL) -> tuple[float, float]:
    """Mean and standard deviation of a fair trial."""
    return bits / 2, (bits / 4) ** 0.5


def calibrate(trials: DataFrame, least: int = MIN_CALIBRATION) -> DataFrame:
    """``(source, trials, mean, sd)`` with the sample sd; sources of fewer than ``least`` trials or of constant sums are left out."""
    out = trials.groupBy("source").agg(F.count("*").alias("trials"), F.avg("sum").alias("mean"), F.stddev_samp("sum").alias("sd"))
    return out.where((F.col("trials") >= least) & (F.col("sd") > 0))


def z_scores(trials: DataFrame, calibration: DataFrame) -> DataFrame:
    """``(source, t, z)`` by a source's calibration; one row per source, so its side is small."""
    return trials.join(calibration, "source").select("source", "t", ((F.col("sum") - F.col("mean")) / F.col("sd")).alias("z"))


def theoretical_z(trials: DataFrame, bits: int) -> DataFrame:
    mean, sd = theoretical_calibration(bits)
    return trials.select("source", "t", ((F.col("sum") - mean) / sd).alias("z"))


def aligned(trials: DataFrame) -> DataFrame:
    """Only the steps that every source has (from 0 to the shortest)."""
    steps = trials.groupBy("source").agg(F.max("t").alias("last")).agg(F.min("last").alias("last"))
    return trials.join(F.broadcast(steps), F.col("t") <= F.col("last")).drop("last")


def stouffer(z: Column) -> Column:
    return F.sum(z) / F.sqrt(F.count(z))
