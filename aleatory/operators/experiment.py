"""Registered experiments over recorded trials: calibrate, align, normalise, test events, combine."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numerics as nu
from ..functions.chunks import records
from . import network, trials


def analyse(data: DataFrame, events: DataFrame, bits: int, calibration: str = "theoretical", burn: int = 0) -> tuple[DataFrame, DataFrame]:
    """``trials(source, t, sum)`` and ``events(id, start_t, end_t)`` to a result per event and the composite.

    ``calibration``: theoretical, or burn: the first ``burn`` trials of each
    source give its mean and sd and the events index the rest. Steps that a
    source lacks are left out. Per event: netvar, devvar and correlation with
    p-values; the composite is Stouffer's z over the events' netvar.
    """
    if calibration == "burn":
        cal = trials.calibrate(data.where(F.col("t") < burn))
        z = trials.z_scores(trials.aligned(data.where(F.col("t") >= burn).withColumn("t", F.col("t") - burn)), cal)
    else:
        z = trials.theoretical_z(trials.aligned(data), bits)
    steps = network.steps(z)
    bucket = 256
    s = steps.withColumn("__b", F.floor(F.col("t") / bucket))
    e = events.where("end_t > start_t").withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_t") / bucket), F.floor((F.col("end_t") - 1) / bucket))))
    hit = s.join(e, "__b").where("t >= start_t and t < end_t")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    out = hit.groupBy("id").agg(
        F.count("*").alias("steps"),
        F.sum(F.col("zs") * F.col("zs")).alias("netvar"),
        F.sum("q").alias("devvar"),
        F.sum("n").alias("cells"),
        (F.sum((F.col("s") * F.col("s") - F.col("q")) / 2) / F.sqrt(F.sum(pairs))).alias("correlation"),
    )
    out = out.withColumn("p_netvar", nu.chi_square_p(F.col("netvar"), F.col("steps"))).withColumn("p_devvar", nu.chi_square_p(F.col("devvar"), F.col("cells"))).withColumn("p_correlation", nu.normal_p(F.col("correlation"), "upper"))
    z_event = -nu.norm_ppf(F.least(F.greatest(F.col("p_netvar"), F.lit(1e-300)), F.lit(1 - 1e-16)))
    composite = out.select(z_event.alias("z")).agg((F.sum("z") / F.sqrt(F.count("*"))).alias("z"), F.count("*").alias("events"))
    return out.drop("cells"), composite.withColumn("p", nu.normal_p(F.col("z"), "upper"))


def broadcast_rounds(data: DataFrame, size: int = 16, odds: int = 6765) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, round, resonance)`` of full rounds of an even number of bytes: the first accepted two-byte draw below ``odds`` within the round is the last value."""
    limit = 65536 // odds * odds

    def draw(row: np.ndarray, index: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        v = record.view(">u2").astype(np.int64)
        accepted = v < limit
        first = v[np.arange(len(v)), accepted.argmax(1)]
        return row, {"round": pa.array(index), "resonance": pa.array(accepted.any(1) & (first % odds == odds - 1))}

    return records(data, size, draw, "round bigint, resonance boolean")


def sample_field(data: DataFrame, width: float, height: float) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, id, x, y)``: eight bytes are two big-endian 32-bit fractions of a rectangle."""

    def points(row: np.ndarray, index: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        part = record.view(">u4").astype(np.float64) / 2.0**32
        return row, {"id": pa.array(index), "x": pa.array(part[:, 0] * width), "y": pa.array(part[:, 1] * height)}

    return records(data, 8, points, "id bigint, x double, y double")


def sample_disk(data: DataFrame, radius: float) -> DataFrame:
    """The same over a disk about the origin: a distance of radius times the root of the first fraction, a direction of the second."""
    unit = sample_field(data, 1.0, 1.0)
    r, turn = F.sqrt("x") * radius, F.col("y") * (2 * math.pi)
    return unit.select("source", "id", (r * F.cos(turn)).alias("x"), (r * F.sin(turn)).alias("y"))


def label_rotation_p(ep: DataFrame, labels: DataFrame, size: int, offsets: list[int]) -> DataFrame:
    """``epochs(id, phase, zs)`` and ``labels(i, target)`` of ids 0..size-1: per phase, dz of the labels and the share of rotations (a stated list) that reach it."""
    by_id = ep.groupBy("phase", "id").agg(F.sum("zs").alias("s"), F.count("*").alias("n"))
    turned = labels.select(F.posexplode(F.array(*map(F.lit, [0, *offsets]))).alias("k", "o"), "i", "target").select("k", F.pmod(F.col("i") - F.col("o"), F.lit(size)).alias("id"), "target")
    each = by_id.join(turned, "id")
    part = lambda c: F.sum(F.when(c, F.col("s")).otherwise(0.0)) / F.sqrt(F.sum(F.when(c, F.col("n")).otherwise(0)))
    dz = each.groupBy("phase", "k").agg(((part(F.col("target")) - part(~F.col("target"))) / 2**0.5).alias("dz"))
    own = dz.where("k = 0").select("phase", F.col("dz").alias("own"))
    return dz.where("k > 0").join(own, "phase").groupBy("phase", "own").agg(((1 + F.count_if(F.col("dz") >= F.col("own"))) / (1 + F.count("*"))).alias("p"))
