"""Streams: trials from chunks with state, wall-clock trials, running network statistics, sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.shared import cut

_WAITING = "offs array<bigint>, chunks array<binary>"
#: Bytes given on at a time.
SLICE = 1 << 20


class _Ordered:
    """Chunks of one source in the order of their places: what follows on is joined, what comes early waits, in the state if need be."""

    def __init__(self, at: int, offs: list, chunks: list) -> None:
        self.at, self.waiting = at, dict(zip(offs, chunks, strict=True))

    def walk(self, frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        yield from self._ready()
        for frame in frames:
            chunks = sorted((int(o), bytes(c)) for o, c in zip(frame["off"], frame["bytes"], strict=True) if o >= self.at and len(c))  # what has been read is not read again
            run: list[bytes] = []
            start = end = -1
            for off, chunk in chunks:
                if off == end:
                    run.append(chunk)
                elif off < end:
                    continue  # a chunk that came twice
                else:
                    self._wait(start, run)
                    start, run = off, [chunk]
                end = off + len(chunk)
            self._wait(start, run)
            yield from self._ready()

    def _wait(self, start: int, run: list[bytes]) -> None:
        if run and len(self.waiting.get(start, b"")) < sum(map(len, run)):
            self.waiting[start] = b"".join(run)

    def _ready(self) -> Iterator[np.ndarray]:
        while here := [o for o in self.waiting if o <= self.at]:
            for off in here:
                chunk = self.waiting.pop(off)
                if off <= self.at < off + len(chunk):
                    fresh = np.frombuffer(chunk, np.uint8)[self.at - off :]
                    self.at = off + len(chunk)
                    for i in range(0, len(fresh), SLICE):
                        yield fresh[i : i + SLICE]

    def state(self) -> tuple[int, list[int], list[bytes]]:
        return self.at, list(self.waiting), list(self.waiting.values())


def trial_stream(chunks: DataFrame, bits: int) -> DataFrame:
    """A stream ``(source, off, bytes)`` to ``(source, t, sum)``: bits carry over from chunk to chunk, as in the batch operator.

    Chunks may come in any order and more than once; one whose predecessor is
    still to come waits in the state. A source's chunks are walked one by one.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, ones, have, at, offs, waiting = state.get if state.exists else (0, 0, 0, 0, [], [])
        reader = _Ordered(at, offs, waiting)
        for raw in reader.walk(frames):
            b = np.unpackbits(raw).astype(np.int64)
            total = np.append(0, np.cumsum(b))
            ends = np.arange(bits - have, len(b) + 1, bits)
            sums = np.diff(np.append(0, total[ends])) if len(ends) else np.zeros(0, np.int64)
            if len(sums):
                sums[0] += ones
                ones, have = int(total[-1] - total[ends[-1]]), int(len(b) - ends[-1])
                yield pd.DataFrame({"source": key[0], "t": np.arange(t, t + len(sums)), "sum": sums.astype(np.int32)})
            else:
                ones, have = int(ones + total[-1]), int(have + len(b))
            t += len(sums)
        state.update((int(t), ones, have, *reader.state()))

    return chunks.groupBy("source").applyInPandasWithState(run, "source string, t bigint, sum int", f"t bigint, ones bigint, have bigint, at bigint, {_WAITING}", "append", GroupStateTimeout.NoTimeout)


def interval_trials(chunks: DataFrame, every: str, late: str = "30 seconds") -> DataFrame:
    """``(source, start, n, sum)``: one-bits of each source and wall-clock interval, closed by the watermark; later chunks are dropped."""
    ones = F.aggregate(F.regexp_extract_all(F.hex("bytes"), F.lit(".{1,8}"), F.lit(0)), F.lit(0), lambda a, w: a + F.bit_count(F.conv(w, 16, 10).cast("bigint")))
    rows = chunks.withWatermark("at", late).select("source", "at", ones.alias("ones"), (8 * F.length("bytes")).alias("bits"))
    g = rows.groupBy("source", F.window("at", every).alias("w")).agg(F.sum("bits").alias("n"), F.sum("ones").alias("sum"))
    return g.select("source", F.col("w.start").alias("start"), "n", "sum")


class _Health:
    """Both continuous tests of one source, chunk by chunk; ``state`` is what the next chunk needs."""

    def __init__(self, rct: int, apt: int, window: int, state: tuple[int, ...]) -> None:
        self.rct, self.apt, self.window = rct, apt, window
        self.at, self.last, self.length, self.index, self.reference, self.count = state

    def push(self, b: np.ndarray) -> list[tuple[int, str, int, int]]:
        """Alarms as (sample, test, count, value). A long run alarms anew after each cutoff - 1 further samples; an alarm of the window test starts a new window."""
        place = np.arange(len(b))
        start = np.maximum.accumulate(np.where(np.append(True, b[1:] != b[:-1]), place, 0))
        runs = place - start + 1 + np.where((start == 0) & (b == self.last), self.length, 0)
        hit = np.flatnonzero((runs >= self.rct) & ((runs - self.rct) % (self.rct - 1) == 0))
        found = [(self.at + int(i), "rct", self.rct, int(b[i])) for i in hit]
        self.last, self.length = int(b[-1]), int(runs[-1])
        i = 0
        while i < len(b):
            if self.index == 0:
                self.reference, self.count, self.index = int(b[i]), 1, 1
                i += 1
                continue
            part = b[i : i + self.window - self.index]
            upto = self.count + np.cumsum(part == self.reference)
            if upto[-1] >= self.apt:
                i += int(np.searchsorted(upto, self.apt)) + 1
                found.append((self.at + i - 1, "apt", self.apt, self.reference))
                self.index = 0
            else:
                i += len(part)
                self.count, self.index = int(upto[-1]), (self.index + len(part)) % self.window
        self.at += len(b)
        return sorted(found, key=lambda x: (x[0], x[1] == "apt"))

    def state(self) -> tuple[int, ...]:
        return self.at, self.last, self.length, self.index, self.reference, self.count


def health_stream(chunks: DataFrame, rct: int, apt: int, window: int, strict: bool = False) -> DataFrame:
    """A stream ``(source, off, bytes)`` to ``(source, sample, test, count, value)``: alarms of the repetition count and adaptive proportion tests over each source's samples (bytes), as of one sequential run whatever the micro-batches.

    Chunks may come in any order and more than once. With ``strict`` a source is
    shut at its first alarm: nothing after it is tested or given out. Runs go on
    over chunks; only a chunk is held at a time.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *test, shut, offs, waiting = state.get if state.exists else (0, -1, 0, 0, -1, 0, False, [], [])
        health, reader = _Health(rct, apt, window, tuple(test)), _Ordered(test[0], offs, waiting)
        for b in reader.walk(frames):
            if shut:
                health.at += len(b)
                continue
            found = health.push(b)
            if strict and found:
                found, shut = found[:1], True
            if found:
                sample, kind, count, value = zip(*found, strict=True)
                yield pd.DataFrame({"source": key[0], "sample": sample, "test": kind, "count": np.array(count, np.int32), "value": np.array(value, np.int32)})
        state.update((*health.state(), shut, *reader.state()[1:]))

    kept = "at bigint, last bigint, length bigint, idx bigint, reference bigint, cnt bigint, shut boolean"
    return chunks.groupBy("source").applyInPandasWithState(run, "source string, sample bigint, test string, count int, value int", f"{kept}, {_WAITING}", "append", GroupStateTimeout.NoTimeout)


def alarm_stream(chunks: DataFrame, cutoff: int) -> DataFrame:
    """A stream ``(source, off, bytes)`` to ``(source, pos, b)`` of repetition alarms alone, as in the batch operator."""
    never = 1 << 31
    return health_stream(chunks, cutoff, never, 1 << 20).select("source", F.col("sample").alias("pos"), F.col("value").alias("b"))


class _Rounds:
    """A session's open rounds in blocks of rounds times sources, NaN where no trial has come; read from the state when touched and put back as the values that are there."""

    def __init__(self, state, width: int) -> None:
        self.state, self.width, self.size = state, width, max((1 << 14) // max(width, 1), 1)
        self.blocks = {k[0] for k in state.keys()}
        self.held: dict[int, np.ndarray] = {}

    def block(self, b: int) -> np.ndarray:
        if b not in self.held:
            m = np.full(self.size * self.width, np.nan)
            if b in self.blocks and (kept := self.state.getValue((b,))) is not None:
                m[np.frombuffer(kept[0], np.int32)] = np.frombuffer(kept[1], np.float64)
            self.held[b] = m
            self.blocks.add(b)
        return self.held[b]

    def add(self, t: np.ndarray, place: np.ndarray, z: np.ndarray) -> None:
        """What came first stays."""
        b = t // self.size
        order = np.argsort(b, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
            if len(self.held) >= 256:
                self.keep()
            m, rows = self.block(int(b[rows[0]])), rows[::-1]
            flat = t[rows] % self.size * self.width + place[rows]
            free = np.isnan(m[flat])
            m[flat[free]] = z[rows][free]

    def keep(self) -> None:
        for b, m in self.held.items():
            flat = np.flatnonzero(~np.isnan(m)).astype(np.int32)
            if len(flat):
                self.state.updateValue((b,), (flat.tobytes(), m[flat].tobytes()))
            else:
                self.state.removeKey((b,))
                self.blocks.discard(b)
        self.held = {}


class _Session(StatefulProcessor):
    """Rounds of one session: a round is closed when each source has given its trial or has ended, when it is ``late`` rounds behind, or when nothing has come for ``idle`` milliseconds."""

    def __init__(self, roster: list[str], bits: int, late: int | None, idle: int | None) -> None:
        self.roster, self.bits, self.late, self.idle = sorted(set(roster)), bits, late, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "next bigint, step bigint, netvar double, newest bigint")
        self.open = handle.getMapState("rounds", "block bigint", "place binary, z binary")
        self.ends = handle.getMapState("ends", "source string", "t bigint")

    def _close(self, key: tuple, rounds: _Rounds, ends: dict[str, int], state: tuple, everything: bool) -> pd.DataFrame:
        t, step, netvar, newest = state
        never = 1 << 62
        end = np.array([ends.get(s, never) for s in self.roster], np.int64)
        over = int(end.max(initial=-1))  # from here on no source is due
        limit = newest if everything else newest - self.late if self.late is not None else -1  # up to here a round is closed whatever it lacks
        out = []
        while t < over:
            b = t // rounds.size
            if b not in rounds.blocks:
                if t > limit:
                    break
                following = min((x for x in rounds.blocks if x > b), default=never) * rounds.size
                t = min(limit + 1, over, following)
                continue
            part = rounds.block(b).reshape(rounds.size, -1)[t % rounds.size :]
            ts, have = np.arange(t, t + len(part)), ~np.isnan(part)
            fine = ((have | (end <= ts[:, None])).all(axis=1) | (ts <= limit)) & (ts < over)
            count = len(fine) if fine.all() else int(np.argmin(fine))
            some = np.flatnonzero(have[:count].any(axis=1))
            if len(some):
                total = np.zeros(len(some))
                for i in range(len(self.roster)):  # in the sources' order
                    total = total + np.where(have[some, i], part[some, i], 0.0)
                z = total / have[some].sum(axis=1) ** 0.5
                sums = np.cumsum(np.append(netvar, z * z))[1:]
                steps = np.arange(step, step + len(some))
                kinds, kind = np.unique(have[some], axis=0, return_inverse=True)
                names = [[s for s, h in zip(self.roster, row, strict=True) if h] for row in kinds]
                out.append(pd.DataFrame({"session": key[0], "step": steps, "t": ts[some], "present": [names[k] for k in kind.ravel()], "stouffer": z, "netvar": sums, "cumdev": sums - steps - 1}))
                step, netvar = step + len(some), float(sums[-1])
            part[:count] = np.nan
            t += count
            if count < len(part):
                break
            if len(rounds.held) >= 256:
                rounds.keep()
        self.sums.update((int(t), int(step), netvar, int(newest)))
        return pd.concat(out) if out else pd.DataFrame(columns=["session", "step", "t", "present", "stouffer", "netvar", "cumdev"])

    def _state(self) -> tuple:
        return self.sums.get() if self.sums.exists() else (0, 0, 0.0, -1)

    @staticmethod
    def _unpacked(rows: Iterator[pd.DataFrame], names: pd.Index) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in the roster (-1 for others), rounds and sums, NaN for none, of each packed row."""
        for frame in rows:
            for sources, which, t, total in zip(frame["sources"], frame["which"], frame["t"], frame["sum"], strict=True):
                yield names.get_indexer(list(sources))[np.frombuffer(which, np.int32)], np.frombuffer(t, np.int64), np.frombuffer(total, np.float64)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, rounds = self._state(), _Rounds(self.open, len(self.roster))
        ends, names = {k[0]: v[0] for k, v in self.ends.iterator()}, pd.Index(self.roster)
        for place, t, total in self._unpacked(rows, names):
            for i in np.flatnonzero((place >= 0) & np.isnan(total)):  # the source has no trial from t on
                ends[self.roster[place[i]]] = int(t[i])
                self.ends.updateValue((self.roster[place[i]],), (int(t[i]),))
            use = (place >= 0) & ~np.isnan(total) & (t >= state[0])
            if use.any():
                rounds.add(t[use], place[use], (total[use] - self.bits / 2) / (self.bits / 4) ** 0.5)
                state = (*state[:3], max(state[3], int(t[use].max())))
            ticks = self._close(key, rounds, ends, state, False)
            if len(ticks):
                yield ticks
            state = self._state()
        rounds.keep()
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if rounds.blocks:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rounds = _Rounds(self.open, len(self.roster))
        ticks = self._close(key, rounds, {k[0]: v[0] for k, v in self.ends.iterator()}, self._state(), True)
        rounds.keep()
        if len(ticks):
            yield ticks

    def close(self) -> None:
        pass


def _packed(trials: DataFrame) -> DataFrame:
    """``(session, sources, which, t, sum)``: a row per batch and session instead of one per trial, since a stateful processor's rows are handed over one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            session, source = (batch.column(c).dictionary_encode(null_encoding="encode") for c in ("session", "source"))
            of, which = session.indices.to_numpy(), source.indices.to_numpy().astype(np.int32)
            t, total = batch.column("t").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("sum").cast(pa.float64()).to_numpy(zero_copy_only=False)
            order = np.argsort(of, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
            names = source.dictionary.to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "session": session.dictionary.take(pa.array([of[p[0]] for p in parts])),
                    "sources": pa.array([names] * len(parts), pa.list_(pa.string())),
                    **{c: pa.array([v[p].tobytes() for p in parts], pa.binary()) for c, v in (("which", which), ("t", t), ("sum", total))},
                }
            )

    return trials.select("session", "source", "t", "sum").mapInArrow(run, "session string, sources array<string>, which binary, t binary, sum binary")


def session_ticks(trials: DataFrame, roster: list[str], bits: int, late: int | None = None, idle: int | None = None) -> DataFrame:
    """A stream ``(session, source, t, sum)`` to ``(session, step, t, present, stouffer, netvar, cumdev)``: lock-step rounds of each live session with their running sums.

    Round t takes the trial t of each source of ``roster``; a null ``sum`` says
    that a source has none from t on. A round is given out, once, when all
    sources that haven't ended have come, when one has come ``late`` rounds
    further on, or when nothing has come for ``idle`` milliseconds. Sources that
    lack by then are skipped in that round and their later rows for it dropped;
    rounds that nobody has are no steps. ``netvar`` adds up the rounds' squared
    z, ``cumdev`` those less 1. So the ticks don't hang on the micro-batches.
    A session is one key; sessions are dealt over tasks. The state store has
    to be RocksDB (``rocksdb_state``).
    """
    schema = "session string, step bigint, t bigint, present array<string>, stouffer double, netvar double, cumdev double"
    return _packed(trials).groupBy("session").transformWithStateInPandas(_Session(list(roster), bits, late, idle), schema, "append", "ProcessingTime" if idle is not None else "None")


def active_events(ticks: DataFrame, events: DataFrame, bucket: int = 256) -> DataFrame:
    """``(session, step, id)``: the events ``(id, start, stop)``, a static table, in whose steps [start, stop) a tick falls, by an equi-join on buckets of steps."""
    spread = F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("stop") - 1) / bucket)))
    static = events.where(F.col("start") < F.col("stop")).select("id", "start", "stop", spread.alias("b"))
    joined = ticks.select("session", "step", F.floor(F.col("step") / bucket).alias("b")).join(static, "b")
    return joined.where((F.col("step") >= F.col("start")) & (F.col("step") < F.col("stop"))).select("session", "step", "id")


def rocksdb_state(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, which ``session_ticks`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replayed(rows: DataFrame, order: str, weight: Column | int, limit: int, folder: str, files: int = 8) -> DataFrame:
    """A table as a stream of files, one range of the integer ``order`` after another, so that a reader who needs rows in that order has to hold back one micro-batch's rows at most.

    There are as many ranges as bring the sum of ``weight`` in each down to
    ``limit``, if ``order`` is even. Files are read in the order of their times,
    so ranges are written one after another.
    """
    held = cut(rows)
    total, low, high = held.agg(F.sum(F.lit(weight) if isinstance(weight, int) else weight), F.min(order), F.max(order)).first()
    parts = max(-(-int(total or 0) // limit), 1)
    width = max(-(-(int(high or 0) + 1 - int(low or 0)) // parts), 1)
    if parts == 1:
        held.repartition(files).write.parquet(f"{folder}/in")
    else:
        dealt = held.withColumn("__part", F.floor((F.col(order) - int(low)) / width))
        dealt.repartitionByRange(parts * files, "__part", F.xxhash64(order)).write.partitionBy("__part").parquet(f"{folder}/staged")
        for i in sorted(r[0] for r in dealt.select("__part").distinct().collect()):  # a row per range
            rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/staged/__part={i}").repartition(files).write.mode("append").parquet(f"{folder}/in")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files if parts > 1 else -(-files // 2)).parquet(f"{folder}/in")


def new_name() -> str:
    return uuid.uuid4().hex


def run_available(stream: DataFrame, folder: str, tasks: int | None = None) -> DataFrame:
    """Process all that is there, exactly once, into a Parquet folder, and read it; ``tasks``, where keys are few, is the number of state stores, each of which costs time in every micro-batch."""
    at, conf = f"{folder}/{uuid.uuid4().hex}", stream.sparkSession.conf
    before = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", min(int(before), tasks or int(before)))  # fixed when a stream starts
    try:
        q = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        conf.set("spark.sql.shuffle.partitions", before)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")
