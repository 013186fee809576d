"""Public beacons as a data source: rounds by number, in batches and as a stream.

A beacon gives out a small payload per round, at an address for the latest round
and one for each round. As a stream its offsets are round numbers, so a
restarted query goes on with the round after the last one committed, a round
that was missed while nobody polled is fetched by its number, and one whose
batch was cut off is fetched again: each round comes once.
"""

from __future__ import annotations

import json
import time
import urllib.error
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader

from .providers import DECODERS, Slice, fetch_json

ROUNDS = "source string, round bigint, at timestamp, bytes binary"


def at_path(response: object, path: str) -> object:
    """The value at a dotted path; an error that names the path if there is none."""
    for key in filter(None, path.split(".")):
        try:
            response = response[int(key)] if isinstance(response, list) else response[key]
        except (KeyError, IndexError, TypeError, ValueError):
            raise ValueError(f"bad_response: nothing at {path}") from None
    return response


class Client:
    """Requests to one beacon, as its options say; requests that fail are tried ``tries`` times, ``pause`` seconds apart, twice as long each time."""

    def __init__(self, options: dict) -> None:
        o = self.options = dict(options)
        self.headers = {k.removeprefix("header."): v for k, v in o.items() if k.startswith("header.")}
        self.source, self.timeout = o.get("source", "beacon"), float(o.get("timeout", 10))
        self.tries, self.pause = int(o.get("tries", 3)), float(o.get("pause", 0.5))

    def get(self, url: str) -> object:
        for i in range(self.tries):
            try:
                return fetch_json(url, self.headers, self.timeout)
            except urllib.error.HTTPError as e:
                if e.code == 404 or i + 1 == self.tries:  # a round that isn't there doesn't come by asking again
                    raise
            except (OSError, json.JSONDecodeError):
                if i + 1 == self.tries:
                    raise
            time.sleep(self.pause * 2**i)
        raise AssertionError

    def latest(self) -> int:
        number = at_path(self.get(self.options["latest"]), self.options.get("id", "round"))
        if isinstance(number, bool) or not isinstance(number, int) and not str(number).isdigit():
            raise ValueError(f"bad_response: round {number!r}")
        return int(number)

    def rows(self, first: int, last: int) -> Iterator[tuple]:
        """Rounds first to last - 1. A round that the beacon doesn't have is an error, or left out with the option ``missing`` = skip."""
        o, n = self.options, int(self.options.get("round_bytes", 32))
        for number in range(first, last):
            try:
                response = self.get(o["round"].format(round=number))
            except (urllib.error.HTTPError, FileNotFoundError, urllib.error.URLError):
                if o.get("missing") == "skip":
                    continue
                raise
            if (own := at_path(response, o.get("id", "round"))) is not None and int(own) != number:
                raise ValueError(f"bad_response: round {own} where {number} was asked for")
            data = DECODERS[o.get("encoding", "hex")](at_path(response, o.get("path", "randomness")))
            if len(data) != n:
                raise ValueError(f"bad_response: {len(data)} bytes where {n} were asked for")
            yield self.source, number, datetime.now(timezone.utc).replace(tzinfo=None), data


def _slices(first: int, last: int, parts: int) -> list[Slice]:
    step = max(-(-(last - first) // max(parts, 1)), 1)
    return [Slice(i, min(i + step, last)) for i in range(first, last, step)]


class Beacon(DataSource):
    """``format("beacon")``: addresses ``latest`` and ``round`` (with {round}), paths ``id`` (round) and ``path`` (randomness), ``encoding`` (hex, base64, array), ``round_bytes``, ``source``, ``missing`` (fail or skip), ``partitions``, header.* options.

    In batches: the last ``rounds`` rounds; a chain that is too short is an
    error. As a stream: from round ``first``, or the latest when it starts.
    """

    @classmethod
    def name(cls) -> str:
        return "beacon"

    def schema(self) -> str:
        return ROUNDS

    def reader(self, schema) -> DataSourceReader:
        return _BeaconReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _BeaconStream(dict(self.options))


class _BeaconReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Slice]:
        latest, rounds = Client(self.options).latest(), int(self.options.get("rounds", 1))
        if latest - rounds + 1 < int(self.options.get("first", 1)):
            raise ValueError("insufficient_entropy: beacon chain too short")
        return _slices(latest - rounds + 1, latest + 1, int(self.options.get("partitions", 1)))

    def read(self, partition: Slice) -> Iterator[tuple]:
        return Client(self.options).rows(partition.first, partition.last)


class _BeaconStream(DataSourceStreamReader):
    """Offsets are the next round to come."""

    def __init__(self, options: dict) -> None:
        self.options, self.client = options, Client(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"round": int(self.options["first"]) if "first" in self.options else self.client.latest()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"round": self.client.latest() + 1}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return _slices(start["round"], end["round"], int(self.options.get("partitions", 1)))

    def read(self, partition: Slice) -> Iterator[tuple]:
        return Client(self.options).rows(partition.first, partition.last)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Beacon)


def byte_chunks(rounds: DataFrame, round_bytes: int, first: int) -> DataFrame:
    """``(source, off, bytes)`` of a beacon's rounds from ``first`` on, which streams and batches of chunks take: a round's place follows from its number."""
    return rounds.select("source", ((F.col("round") - first) * round_bytes).alias("off"), "bytes")
