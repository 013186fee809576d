"""Byte streams as chunks ``(source, off, bytes)``, ``off`` being the place of a chunk's first byte in its source.

A stream of so many bytes is as many rows as it has chunks; bytes are worked on
inside a chunk, by numpy over Arrow buffers, and only chunks are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Bytes worked on at a time; one longer chunk is worked on alone.
SLICE = 1 << 20
#: Bytes of a chunk that records are cut from.
BUCKET = 1 << 16
LATIN = "ISO-8859-1"


def haloed(data: DataFrame, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """``(source, c, off, bytes)``: chunk c holds the bytes from c * size to (c + 1) * size, ``before`` bytes more in front and ``after`` behind, as far as there are such; ``off`` is the place of its first byte."""
    end = F.col("off") + F.length("bytes")
    chunks = F.sequence(F.greatest(F.floor((F.col("off") - after) / size), F.lit(0)), F.floor((end - 1 + before) / size))
    cut = data.where(F.length("bytes") > 0).select("source", "off", "bytes", F.explode(chunks).alias("c"))
    low, high = F.greatest(F.col("c") * size - before, F.col("off")), F.least((F.col("c") + 1) * size + after, end)
    part = F.decode(F.substr("bytes", (low - F.col("off") + 1).cast("int"), (high - low).cast("int")), LATIN)
    parts = cut.select("source", "c", F.struct(low.alias("low"), part.alias("part")).alias("p")).groupBy("source", "c").agg(F.array_sort(F.collect_list("p")).alias("p"))
    joined = F.encode(F.array_join(F.transform("p", lambda p: p["part"]), ""), LATIN)
    return parts.select("source", "c", F.col("p")[0]["low"].alias("off"), joined.alias("bytes"))


def rechunk(data: DataFrame, size: int) -> DataFrame:
    """The same bytes in chunks that start at multiples of ``size`` and hold so many bytes (the last of a source fewer, one beside a gap too)."""
    return haloed(data, size).drop("c")


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, data, bounds)`` of rows of a binary column; row r of a slice is ``data[bounds[r]:bounds[r + 1]]``."""
    column = column.cast(pa.binary())
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = min(max(int(np.searchsorted(off, off[at] + SLICE, "right")) - 1, at + 1), len(column))
        yield at, to, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def each(data: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, pa.Array]]], schema: str, keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """Run ``work(off, data, bounds)`` on slices of chunks; it returns the row of each result and the results' columns, to which ``keep`` of that row is added.

    ``schema`` names the result's columns; ``keep`` is in front.
    """
    types = ", ".join([*(f"{c} {dict(data.dtypes)[c]}" for c in keep), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs = batch.column("off").to_numpy()
            for a, b, raw, bounds in slices(batch.column("bytes")):
                row, out = work(offs[a:b], raw, bounds)
                index = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(index) for c in keep), *out.values()], names=[*keep, *out])

    return data.select(*dict.fromkeys([*keep, "off", "bytes"])).mapInArrow(run, types)


def records(data: DataFrame, size: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, pa.Array]]], schema: str, bucket: int = BUCKET) -> DataFrame:
    """Run ``work(row, index, record)`` on the whole records of ``size`` bytes, one row of ``record`` each; ``index`` is a record's number in its source, ``row`` its chunk's.

    As in ``each``, it returns the chunk's row of each result and the results' columns. Bytes after the last whole record are left over.
    """

    def cut(off: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        skip = -off % size
        count = np.maximum((np.diff(bounds) - skip) // size, 0)
        row = np.repeat(np.arange(len(off)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = (bounds[:-1] + skip)[row] + nth * size
        return work(row, (off + skip)[row] // size + nth, raw[start[:, None] + np.arange(size)])

    return each(rechunk(data, size * max(bucket // size, 1)), cut, schema)


def strings(chars: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One string of so many ASCII characters per row."""
    ends = np.append(0, np.cumsum(counts)).astype(np.int32)
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(ends), pa.py_buffer(chars.astype(np.uint8).tobytes()))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values, kind))


@F.pandas_udf(BinaryType())
def low_bits(data: pd.Series) -> pd.Series:
    """The lowest bit of each byte, as a byte."""
    return pd.Series([(np.frombuffer(x, np.uint8) & 1).tobytes() for x in data])


def xor_mask(mask: list[int]) -> Callable[[Column, Column], Column]:
    """A UDF of (bytes, off): each byte XOR the mask byte of its place, the mask repeating; applied twice it is undone."""
    period = np.array(mask, np.uint8)

    @F.pandas_udf(BinaryType())
    def run(data: pd.Series, off: pd.Series) -> pd.Series:
        return pd.Series([(np.frombuffer(x, np.uint8) ^ np.take(period, (o + np.arange(len(x))) % len(period))).tobytes() for x, o in zip(data, off, strict=True)])

    return run
