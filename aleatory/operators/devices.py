"""Bits of device readings: frames, audio samples, radio samples and sensors, as DataFrame expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import BUCKET, each, haloed


def sign_bits(data: DataFrame, pixels: int, stride: int = 1, bucket: int = BUCKET) -> DataFrame:
    """Chunks ``(source, off, bytes)`` of frames of so many bytes to ``(source, frame, pixel, bit)``: 1 where a strided pixel rose since the frame before, 0 where it fell, none where it is the same. A last frame that isn't whole is left out.

    A chunk of frames also carries the last frame before it: one shuffle of chunks, and rows are only the bits.
    """

    def compare(off: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        found: list[tuple[np.ndarray, ...]] = []
        for r, skip in enumerate(-off % pixels):
            low, n = bounds[r] + skip, max(bounds[r + 1] - bounds[r] - skip, 0) // pixels
            m = raw[low : low + n * pixels].reshape(n, pixels)[:, ::stride]
            frame, pixel = np.nonzero(m[1:] != m[:-1])
            found.append((np.full(len(frame), r), (off[r] + skip) // pixels + 1 + frame, pixel * stride, (m[1:] > m[:-1])[frame, pixel]))
        row, frame, pixel, bit = (np.concatenate(x) for x in zip(*found, strict=True))
        return row, {"frame": pa.array(frame), "pixel": pa.array(pixel), "bit": pa.array(bit.astype(np.int32))}

    size = pixels * max(bucket // pixels, 1)
    return each(haloed(data, size, before=pixels), compare, "frame bigint, pixel bigint, bit int")


def low_bits(value: Column, bits: int) -> Column:
    """The low bits of an integer, most significant first."""
    return F.transform(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftright", value, i).bitwiseAND(F.lit(1)))


def sample_bits(x: Column, bits: int) -> Column:
    """Low bits of a sample in [-1, 1] as a 16-bit integer (clamped)."""
    if bits not in (1, 2, 4):
        raise ValueError("1, 2 or 4 bits of a sample")
    return low_bits(F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767 + 0.5).cast("int"), bits)


def radio_bits(b: Column) -> Column:
    """The low six bits of a radio sample's byte."""
    return low_bits(b, 6)


def sensor_byte(x: Column, scale: float = 100.0) -> Column:
    """A reading times scale, rounded half up, modulo 256."""
    return F.floor(x * scale + 0.5).cast("bigint").bitwiseAND(F.lit(255)).cast("int")


def dithered_z(z: Column, u: Column, sd: Column) -> Column:
    """A trial's z with uniform dither u in (0, 1) over one step of its sum."""
    return z + (u - 0.5) / sd


def label_rotations(labels: list[str]) -> list[int]:
    """Offsets of the rotations of a list of labels that differ from it."""
    return [o for o in range(1, len(labels)) if labels[o:] + labels[:o] != labels]
