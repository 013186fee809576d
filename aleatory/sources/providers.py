"""Byte sources as Spark data sources.

``Recorded`` reads ``byte_chunks(source, seq, at, bytes)`` from anything Spark
reads; ``SystemBytes`` is a data source over the operating system's generator.
A live endpoint is a ``RestBytes``: its request and its decoding are options, so
one class serves all providers of that form. Without network it is tested with
a fetch function of recorded responses.
"""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.bytes import explode_bytes

CHUNKS = "source string, seq bigint, at timestamp, bytes binary"


class Slice(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


def _slices(options: dict) -> list[Slice]:
    chunks, parts = int(options.get("chunks", 1)), int(options.get("partitions", 1))
    step = -(-chunks // parts)
    return [Slice(i, min(i + step, chunks)) for i in range(0, chunks, step)]


class SystemBytes(DataSource):
    """``format("system_bytes")`` with chunks, chunk_bytes and partitions; not deterministic."""

    @classmethod
    def name(cls) -> str:
        return "system_bytes"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> DataSourceReader:
        return _SystemReader(dict(self.options))


class _SystemReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return _slices(self.options)

    def read(self, partition: Slice) -> Iterator[tuple]:
        for seq in range(partition.first, partition.last):
            yield "system", seq, datetime.now(timezone.utc).replace(tzinfo=None), os.urandom(int(self.options.get("chunk_bytes", 32)))


#: How a response gives bytes: a field's path, and its encoding.
DECODERS: dict[str, Callable[[object], bytes]] = {
    "hex": lambda v: bytes.fromhex(str(v)),
    "base64": lambda v: base64.b64decode(str(v)),
    "array": lambda v: bytes(v),
}


def fetch_json(url: str, headers: dict[str, str], timeout: float = 10.0) -> object:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
        return json.load(r)


def decode(response: object, path: str, encoding: str, expected: int) -> bytes:
    """The bytes at a dotted path of a response; an error if they are not of the length asked for."""
    for key in filter(None, path.split(".")):
        response = response[int(key)] if isinstance(response, list) else response[key]
    data = DECODERS[encoding](response)
    if len(data) != expected:
        raise ValueError(f"bad_response: {len(data)} bytes where {expected} were asked for")
    return data


class RestBytes(DataSource):
    """``format("rest_bytes")``: url (with {n} and {seq}), path, encoding (hex, base64, array), chunk_bytes, chunks, min_interval seconds, header.* options."""

    @classmethod
    def name(cls) -> str:
        return "rest_bytes"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> DataSourceReader:
        return RestReader(dict(self.options))


class RestReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[str, dict[str, str]], object] = fetch_json) -> None:
        self.options, self.fetch = options, fetch

    def partitions(self) -> list[InputPartition]:
        return _slices(self.options | {"partitions": 1})  # a provider's request rate is one queue

    def read(self, partition: Slice) -> Iterator[tuple]:
        o, n = self.options, int(self.options.get("chunk_bytes", 32))
        headers = {k.removeprefix("header."): v for k, v in o.items() if k.startswith("header.")}
        for seq in range(partition.first, partition.last):
            if seq > partition.first:
                time.sleep(float(o.get("min_interval", 0)))
            response = self.fetch(o["url"].format(n=n, seq=seq), headers)
            yield o.get("source", "rest"), seq, datetime.now(timezone.utc).replace(tzinfo=None), decode(response, o.get("path", ""), o.get("encoding", "hex"), n)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SystemBytes)
    spark.dataSource.register(RestBytes)


def bytes_of(chunks: DataFrame, chunk_bytes: int) -> DataFrame:
    """``(source, pos, b)`` of equal chunks: positions are seq * chunk_bytes + offset, so no order has to be found."""
    rows = explode_bytes(chunks.where(F.length("bytes") > 0), F.hex("bytes"), ["source", "seq"])
    return rows.select("source", (F.col("seq") * chunk_bytes + F.col("pos")).alias("pos"), "b")


def rechunk(data: DataFrame, size: int) -> DataFrame:
    """``(source, pos, b)`` to ``(source, seq, h)`` hex chunks of ``size`` bytes; the partial last one too."""
    g = data.groupBy("source", F.floor(F.col("pos") / size).alias("seq")).agg(F.array_sort(F.collect_list(F.struct("pos", "b"))).alias("x"))
    return g.select("source", "seq", F.array_join(F.transform("x", lambda s: F.lower(F.lpad(F.hex(s["b"]), 2, "0"))), "").alias("h"))


def new_rounds(polls: DataFrame) -> DataFrame:
    """Of polls ``(source, id, at, h)`` of a beacon: the first of each round."""
    return polls.groupBy("source", "id").agg(F.min_by(F.struct("at", "h"), "at").alias("p")).select("source", "id", "p.*")
