"""Binary frames of dashboard channels: a 4-byte header (version, kind, channel), then bytes, series points or a matrix."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from ..functions.chunks import each, rechunk

VERSION = 1
KINDS = {"bytes": 1, "series": 2, "matrix": 3}


def encode_bytes(channel: int, data: bytes) -> bytes:
    return struct.pack("<BBH", VERSION, KINDS["bytes"], channel) + data


def encode_series(channel: int, points: list[tuple[float, float, float, float]]) -> bytes:
    """Points (x, y, low, high) of four doubles; NaN where there is no band."""
    return struct.pack("<BBH", VERSION, KINDS["series"], channel) + b"".join(struct.pack("<4d", *p) for p in points)


def encode_matrix(channel: int, rows: int, columns: int, values: list[float]) -> bytes:
    if len(values) != rows * columns:
        raise ValueError("a matrix has rows * columns values")
    return struct.pack("<BBHHH", VERSION, KINDS["matrix"], channel, rows, columns) + struct.pack(f"<{len(values)}f", *values)


def decode(frame: bytes) -> dict:
    """The inverse; an error for anything else."""
    if len(frame) < 4 or frame[0] != VERSION:
        raise ValueError("not a frame")
    kind, channel, body = frame[1], int.from_bytes(frame[2:4], "little"), frame[4:]
    if kind == KINDS["bytes"]:
        return {"kind": "bytes", "channel": channel, "data": body}
    if kind == KINDS["series"] and len(body) % 32 == 0:
        return {"kind": "series", "channel": channel, "points": [struct.unpack_from("<4d", body, i) for i in range(0, len(body), 32)]}
    if kind == KINDS["matrix"] and len(body) >= 4:
        rows, columns = struct.unpack_from("<HH", body)
        if len(body) == 4 + 4 * rows * columns:
            return {"kind": "matrix", "channel": channel, "rows": rows, "columns": columns, "values": list(struct.unpack_from(f"<{rows * columns}f", body, 4))}
    raise ValueError("malformed frame")


def series_frame(channel: int):
    """A UDF of an array of doubles [x, y, low, high, x, ...] to a frame."""

    @F.pandas_udf(BinaryType())
    def run(points: pd.Series) -> pd.Series:
        return pd.Series([encode_series(channel, [tuple(p[i : i + 4]) for i in range(0, len(p), 4)]) for p in points])

    return run


@F.pandas_udf(ArrayType(DoubleType()))
def frame_points(frame: pd.Series) -> pd.Series:
    return pd.Series([[v for p in decode(bytes(f))["points"] for v in p] for f in frame])


def last_n(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The ring buffer of each channel: its last n rows."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def decayed_histogram(data: DataFrame, chunk: int = 4096, bins: int = 32, decay: float = 0.9) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, bin, weight)``: counts of byte bins, each ``chunk`` bytes weighing ``decay`` times the next ones."""

    def count(off: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        row = np.repeat(np.arange(len(off)), np.diff(bounds))
        counts = np.bincount(row * bins + raw.astype(np.int64) * bins // 256, minlength=len(off) * bins)
        hit = np.flatnonzero(counts)
        return hit // bins, {"chunk": pa.array(off[hit // bins] // chunk), "bin": pa.array((hit % bins).astype(np.int32)), "c": pa.array(counts[hit])}

    counts = each(rechunk(data, chunk), count, "chunk bigint, bin int, c bigint")
    last = counts.groupBy("source").agg(F.max("chunk").alias("last"))
    return counts.join(last, "source").groupBy("source", "bin").agg(F.sum(F.col("c") * F.pow(F.lit(decay), F.col("last") - F.col("chunk"))).alias("weight"))


def linear_scale(x: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    return F.when(high == low, (to_low + to_high) / 2).otherwise(to_low + (x - low) / (high - low) * (to_high - to_low))


def auto_range(x: str, pad: float = 0.05) -> list[Column]:
    """Minimum and maximum of the finite values, padded."""
    v = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.col(x))
    span = F.max(v) - F.min(v)
    return [(F.min(v) - pad * span).alias("low"), (F.max(v) + pad * span).alias("high")]


def nice_step(low: Column, high: Column, count: int = 5) -> Column:
    """A step of 1, 2 or 5 times a power of ten for about so many ticks."""
    raw = (high - low) / count
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    m = raw / power
    return power * F.when(m < 1.5, 1).when(m < 3.5, 2).when(m < 7.5, 5).otherwise(10)
