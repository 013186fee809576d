"""Live sessions and health tests against sequential loops, whatever the micro-batches."""

import math
import random
import time

import numpy as np
import pytest

from aleatory.streaming import live

SCHEMA = "session string, source string, t bigint, sum double"


def write(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def ticks(spark, folder, tmp_path, roster, **how):
    live.rocksdb_state(spark)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return live.run_available(live.session_ticks(stream, roster, 16, **how), str(tmp_path))


def plain(rows, bits=16):
    """Rounds of what each session's sources have, in order."""
    out, sessions = [], {r[0] for r in rows}
    for s in sessions:
        step, netvar = 0, 0.0
        for t in sorted({r[2] for r in rows if r[0] == s and r[3] is not None}):
            have = {r[1]: (r[3] - bits / 2) / math.sqrt(bits / 4) for r in rows if r[0] == s and r[2] == t and r[3] is not None}
            z = sum(have[x] for x in sorted(have)) / math.sqrt(len(have))
            netvar += z * z
            out.append((s, step, t, sorted(have), round(z, 9), round(netvar, 9), round(netvar - step - 1, 9)))
            step += 1
    return sorted(out)


@pytest.mark.parametrize("sources", [3, 7])
def test_ticks_are_those_of_the_batch(spark, tmp_path, sources):
    rng = random.Random(sources)
    names = [f"s{i}" for i in range(sources)]
    rows = [(se, s, t, float(rng.randrange(17))) for se in ("x", "y") for i, s in enumerate(names) for t in range(20 + 3 * i)]
    rows = [r for r in rows if r[1] != "s1" or r[2] != 7]  # a trial that never comes
    ends = [(se, s, 20 + 3 * i, None) for se in ("x", "y") for i, s in enumerate(names)] + [("x", "s1", 7, None), ("y", "s1", 7, None)]
    ends = [e for e in ends if e[1] != "s1" or e[2] == 7]
    rows = [r for r in rows if r[1] != "s1" or r[2] < 7]
    mixed = rows + ends + [("x", "stranger", 0, 3.0)]
    rng.shuffle(mixed)
    for i in range(0, len(mixed), 60):
        write(spark, mixed[i : i + 60], SCHEMA, tmp_path / "in")
    got = ticks(spark, tmp_path / "in", tmp_path, names).collect()
    assert sorted((r["session"], r["step"], r["t"], r["present"], round(r["stouffer"], 9), round(r["netvar"], 9), round(r["cumdev"], 9)) for r in got) == plain(rows)
    assert max(r["t"] for r in got) == 20 + 3 * (sources - 1) - 1


def test_a_replayed_table_comes_range_by_range(spark, tmp_path, monkeypatch):
    rows = [("x", s, t, float(t % 17)) for t in range(400) for s in "abc"] + [("x", s, 400 + i, None) for i, s in enumerate("abc")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    stream = live.replayed(table, "t", 1, 300, str(tmp_path), files=3)
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) == 15 and (tmp_path / "staged").is_dir()
    spans = [sorted(r[0] for f in files[i : i + 3] for r in spark.read.parquet(str(f)).select("t").collect()) for i in range(0, 15, 3)]
    assert all(a[-1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and sum(map(len, spans)) == len(rows)
    live.rocksdb_state(spark)
    got = live.run_available(live.session_ticks(stream, list("abc"), 16), str(tmp_path)).collect()
    assert sorted((r["session"], r["step"], r["t"], r["present"], round(r["stouffer"], 9), round(r["netvar"], 9), round(r["cumdev"], 9)) for r in got) == plain([r for r in rows if r[3] is not None])


def test_far_apart_rounds_are_not_walked_one_by_one(spark, tmp_path):
    ts = [0, 5, 10**12]
    write(spark, [("x", "a", t, 8.0) for t in ts] + [("x", "b", 10**12 + 3, 4.0)], SCHEMA, tmp_path / "in")
    got = ticks(spark, tmp_path / "in", tmp_path, ["a", "b"], late=3).collect()
    assert sorted(r["t"] for r in got) == ts


def test_chunks_are_given_on_in_slices(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(live, "SLICE", 4)
    reader = live._Ordered(0, [], [])
    parts = [p.tolist() for p in reader.walk(iter([pd.DataFrame({"off": [0, 7], "bytes": [b"abcdefg", b"hij"]})]))]
    assert max(map(len, parts)) == 4 and bytes(sum(parts, [])) == b"abcdefghij"


def test_a_late_source_is_skipped(spark, tmp_path):
    rows = [("x", s, t, float(4 + t % 3)) for t in range(30) for s in "ab"]
    late = [("x", "c", t, 9.0) for t in range(30)]
    write(spark, rows + [r for r in late if r[2] < 10], SCHEMA, tmp_path / "in")
    time.sleep(1.1)  # files are read in the order of their times
    write(spark, late, SCHEMA, tmp_path / "in")
    got = {r["t"]: r for r in ticks(spark, tmp_path / "in", tmp_path, list("abc"), late=5).collect()}
    assert sorted(got) == list(range(30)) and [got[t]["present"] for t in (9, 10, 24)] == [["a", "b", "c"], ["a", "b"], ["a", "b"]]
    assert got[25]["present"] == ["a", "b", "c"] and [got[t]["step"] for t in range(30)] == list(range(30))


def test_an_idle_session_gives_what_it_has(spark, tmp_path):
    live.rocksdb_state(spark)
    write(spark, [("x", s, t, 8.0) for t in range(5) for s in ("ab" if t < 3 else "a")], SCHEMA, tmp_path / "in")
    stream = live.session_ticks(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["a", "b"], 16, idle=500)
    q = stream.writeStream.format("memory").queryName("idle_ticks").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("idle_ticks").count() < 5:
            time.sleep(0.5)
    finally:
        q.stop()
    got = sorted((r["t"], r["present"]) for r in spark.table("idle_ticks").collect())
    assert got == [(t, ["a", "b"] if t < 3 else ["a"]) for t in range(5)]


def test_events_of_a_tick(spark):
    t = spark.createDataFrame([("x", i) for i in range(600)], "session string, step bigint")
    e = spark.createDataFrame([("a", 0, 1), ("b", 250, 520), ("c", 599, 2000), ("d", 5, 5)], "id string, start bigint, stop bigint")
    got = {(r["step"], r["id"]) for r in live.active_events(t, e).collect()}
    assert got == {(0, "a"), (599, "c")} | {(i, "b") for i in range(250, 520)}


def plain_health(b, rct, apt, window, strict):
    out, last, run, i, ref, count = [], -1, 0, 0, -1, 0
    for at, x in enumerate(b):
        if x == last:
            run += 1
            if run >= rct:
                out.append((at, "rct", rct, x))
                run = 1
        else:
            last, run = x, 1
        if i == 0:
            ref, count, i = x, 1, 1
        else:
            if x == ref:
                count += 1
                if count >= apt:
                    out.append((at, "apt", apt, x))
                    i = 0
                    continue
            i = (i + 1) % window
    return out[:1] if strict else out


@pytest.mark.parametrize("strict", [False, True])
def test_health_of_a_stream_is_that_of_one_run(spark, tmp_path, strict):
    rng = np.random.default_rng(6)
    data = {s: (rng.random(n) < p).astype(np.uint8).tolist() for s, p, n in (("a", 0.5, 500), ("b", 0.8, 333), ("c", 1.0, 100), ("d", 0.3, 5))}
    rows, r = [], random.Random(3)
    for s, b in data.items():
        at = 0
        while at < len(b):
            size = r.randrange(1, 40)
            rows.append((s, at, bytearray(b[at : at + size])))
            at += size
    rows += rows[3:6]
    r.shuffle(rows)  # chunks come early and twice
    for i in range(0, len(rows), 20):
        write(spark, rows[i : i + 20], "source string, off bigint, bytes binary", tmp_path / "in")
    stream = spark.readStream.schema("source string, off bigint, bytes binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = live.run_available(live.health_stream(stream, 5, 11, 16, strict), str(tmp_path)).collect()
    want = [(s, *x) for s, b in data.items() for x in plain_health(b, 5, 11, 16, strict)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= (3 if strict else 60)
