"""Operators whose work reaches over the borders of buckets and chunks, against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aleatory.operators import draws, extract, flow, lexicon, protocols


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(("size", "hop", "bucket"), [(8, 1, 4), (50, 3, 7), (5, 2, 64), (1, 1, 3)])
def test_rolling_windows_may_be_longer_than_a_bucket(spark, size, hop, bucket):
    z = np.random.default_rng(1).normal(size=200)
    got = {r["t"]: (r["stouffer"], r["chi"]) for r in protocols.rolling(frame(spark, [(i, float(v)) for i, v in enumerate(z)], "t long, zs double"), size, hop, bucket).collect()}
    want = {t: (z[t - size + 1 : t + 1].sum() / math.sqrt(size), (z[t - size + 1 : t + 1] ** 2).sum()) for t in range(size - 1, 200) if (t + 1 - size) % hop == 0}
    assert got.keys() == want.keys()
    for t, v in want.items():
        assert got[t] == pytest.approx(v)


def test_credit_of_a_stream_does_not_hang_on_its_chunks(spark):
    raw = np.random.default_rng(2).integers(0, 256, 4096).astype(np.uint8)
    pairs = np.unpackbits(raw).reshape(-1, 2)
    whole = int((pairs[:, 0] != pairs[:, 1]).sum()) // 8
    for size in (8, 32, 511):
        chunks = [("s", i, bytearray(raw[i : i + size].tobytes())) for i in range(0, 4096, size)]
        out = extract.debias_account(extract.von_neumann(frame(spark, chunks, "source string, off long, bytes binary"))).agg(F.sum("bytes").alias("b"), F.sum("bits").alias("h")).first()
        assert (out["b"], out["h"]) == (whole, 8.0 * whole)


def test_draws_below_one_take_no_bytes(spark):
    data = frame(spark, [("a", 0, bytearray(b"\x01\x02")), ("a", 2, bytearray(b"\x03")), ("b", 0, bytearray(b"\x07"))], "source string, off long, bytes binary")
    assert sorted(map(tuple, draws.uniform_ints(data, 1).collect())) == [("a", 0, 0), ("b", 0, 0)]
    words = frame(spark, [("x", 5), ("y", 7), ("z", 7)], "word string, value long")
    assert sorted(map(tuple, lexicon.draw_by_value(data, words, 5).select("source", "i", "word").collect())) == [("a", 0, "x"), ("b", 0, "x")]
    assert sorted(map(tuple, lexicon.draw_by_value(data, words, 7).select("source", "i", "word").collect())) == [("a", 0, "z"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "z")]
    assert lexicon.draw_by_value(data, words, 6).count() == 0
    with pytest.raises(ValueError):
        draws.uniform_ints(data, 0)


def test_casts_of_a_single_value_go_through_the_whole_stream(spark):
    data = frame(spark, [("a", 0, bytearray(b"\x01\x02")), ("a", 2, bytearray(b"\xff")), ("b", 0, bytearray(b"\x07"))], "source string, off long, bytes binary")
    words = frame(spark, [("x", 5), ("y", 5)], "word string, value long")
    assert sorted(map(tuple, lexicon.cast_values(data, words).collect())) == [("a", 0, 5, 2, 1.0), ("a", 1, 5, 2, 1.0), ("a", 2, 5, 2, 1.0), ("b", 0, 5, 2, 1.0)]
    assert lexicon.cast_values(data, words, 5, 5).count() == 4
    with pytest.raises(ValueError):
        lexicon.cast_values(data, words.limit(0))


def plain_te(x, y, k, l, u):  # noqa: E741
    """The predicted places, their local values and the correction, by counting tuples."""
    first = max(k - 1, u + l - 2) + 1
    rows = [(y[t], tuple(y[t - 1 - j] for j in range(k)), tuple(x[t - u - j] for j in range(l))) for t in range(first, len(y))]
    full, dp = Counter(rows), Counter(b for _, b, _ in rows)
    df, sp = Counter((a, b) for a, b, _ in rows), Counter((b, c) for _, b, c in rows)
    local = [math.log2(full[r] * dp[r[1]] / (sp[r[1], r[2]] * df[r[0], r[1]])) for r in rows]
    return first, local, (len(df) + len(sp) - len(full) - len(dp)) / (2 * len(rows) * math.log(2))


@pytest.mark.parametrize(("k", "l", "u", "kinds"), [(1, 1, 1, 2), (2, 1, 1, 3), (3, 2, 2, 3), (1, 2, 4, 5), (40, 1, 1, 3)])
def test_transfer_entropy_of_any_history(spark, k, l, u, kinds):  # noqa: E741
    rng = random.Random(k * 100 + l)
    x = [rng.randrange(kinds) for _ in range(700)]
    y = [x[t - u] if t >= u and rng.random() < 0.7 else rng.randrange(kinds) for t in range(700)]
    df = frame(spark, [(t, a, b) for t, (a, b) in enumerate(zip(x, y, strict=True))], "t long, x int, y int")
    first, local, fix = plain_te(x, y, k, l, u)
    mean = sum(local) / len(local)
    for bucket in (16, 1 << 16):
        e = flow.embed(df, u, k, l, bucket=bucket)
        assert sorted(r["t"] for r in e.collect()) == list(range(first, 700))
        n, te = flow.transfer_entropy(e).first()
        assert n == len(local) and te == pytest.approx(max(mean, 0), abs=1e-9)
        assert flow.transfer_entropy(e, miller_madow=True).first()["te"] == pytest.approx(mean + fix, abs=1e-9)
    got = dict(flow.local_transfer_entropy(df, u, k, l).collect())
    assert [got[t] for t in sorted(got)] == pytest.approx(local, abs=1e-9)


def test_transfer_entropy_by_key_with_gaps_and_bad_symbols(spark):
    df = frame(spark, [("a", t, t % 2, t % 3) for t in range(50)] + [("b", t, t % 2, t % 2) for t in range(60) if t != 30], "g string, t long, x int, y int")
    e = flow.embed(df, k=2, keys=["g"], alphabet=3)
    assert {(r["g"], r["count"]) for r in e.groupBy("g").count().collect()} == {("a", 48), ("b", 28 + 27)}
    assert flow.transfer_entropy(df.where("g = 'c'"), ["g"]).count() == 0
    with pytest.raises(ValueError):
        flow.embed(df, k=0)
    with pytest.raises(ValueError):
        flow.embed(df.withColumn("x", -F.col("x")))


def test_a_long_series_is_dealt_to_many_tasks(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("t"), F.pmod(F.hash("id"), F.lit(3)).alias("x"), F.pmod(F.hash(F.col("id") - 1), F.lit(3)).alias("y"))
    e = flow.embed(df, k=3, l=2, lag=1, bucket=1 << 14)
    rows = [r["n"] for r in e.groupBy(F.floor(F.col("t") / (1 << 14)).alias("b")).agg(F.count("*").alias("n")).collect()]
    assert sum(rows) == 1_000_000 - 3 and max(rows) <= 1 << 14
    assert flow.transfer_entropy(e).first()["te"] == pytest.approx(math.log2(3), abs=0.01)


def test_shifted_series_take_the_symbol_of_a_later_step(spark):
    df = frame(spark, [(t, t, 0) for t in range(10)], "t long, x int, y int")
    assert {(r["t"], r["x"]) for r in flow.shifted(df, [3], 10).collect()} == {(t, (t + 3) % 10) for t in range(10)}


@pytest.mark.parametrize(("k", "l", "u"), [(1, 1, 1), (2, 3, 2)])
def test_histories_of_shifted_series(spark, k, l, u):  # noqa: E741
    rng = random.Random(3)
    n, offsets = 60, [1, 17, 59]
    df = frame(spark, [(t, rng.randrange(3), rng.randrange(3)) for t in range(n)], "t long, x int, y int")
    key = lambda d: sorted(map(tuple, d.select("surrogate", "t", "y1", "y0", "x0").collect()))
    want = key(flow.embed(flow.shifted(df, offsets, n), u, k, l, ["surrogate"]))
    assert key(flow.shifted_embedding(df, offsets, n, u, k, l)) == want and len(want) == 3 * (n - max(k, u + l - 1))


@pytest.mark.parametrize(("k", "l", "u", "top"), [(1, 1, 1, 3), (2, 3, 2, 3), (9, 1, 1, 200)])
@pytest.mark.parametrize("block", [7, 40, None])
def test_states_of_shifted_series_are_counted_in_blocks(spark, k, l, u, top, block):  # noqa: E741
    from collections import Counter

    rng = np.random.default_rng(k)
    n, offsets = 101, [1, 37, 100]
    df = frame(spark, [(t, int(x), int(y)) for t, (x, y) in enumerate(rng.integers(0, top, (n, 2)))], "t long, x long, y long")
    want = Counter((r.surrogate, str(r.y1), str(r.y0), str(r.x0)) for r in flow.shifted_embedding(df, offsets, n, u, k, l).collect())
    got = flow.shifted_counts(df, offsets, n, u, k, l, block)
    rows = got.collect()
    assert sum(want.values()) == sum(r.c for r in rows) and sorted(want.values()) == sorted(r.c for r in rows)
    if top < 9:
        assert {(r.surrogate, str(r.y1), str(r.y0), str(r.x0)): r.c for r in rows} == want
    tes = {r.surrogate: r.te for r in flow.transfer_entropy(got, ["surrogate"]).collect()}
    for r in flow.transfer_entropy(flow.shifted_embedding(df, offsets, n, u, k, l), ["surrogate"]).collect():
        assert tes[r.surrogate] == pytest.approx(r.te, abs=1e-12)


@pytest.mark.parametrize("bucket_rows", [40, 1 << 16])
def test_ordinal_patterns_reach_over_buckets(spark, monkeypatch, bucket_rows):
    from aleatory.functions import positions

    monkeypatch.setattr(positions.haloed, "__defaults__", (bucket_rows,))
    rng = np.random.default_rng(4)
    x = {s: rng.integers(0, 5, n) for s, n in (("a", 150), ("b", 7), ("c", 2))}
    df = frame(spark, [(s, t, float(v)) for s, xs in x.items() for t, v in enumerate(xs)], "series string, t long, x double")
    got = {(r["series"], r["t"]): (r["s"], r["weight"]) for r in flow.ordinal_patterns(df, 4, 2).collect()}
    want = {}
    for s, xs in x.items():
        for t in range(len(xs) - 6):
            v = xs[t : t + 7 : 2]
            want[s, t] = (sum(math.factorial(3 - i) * sum(v[j] < v[i] for j in range(i + 1, 4)) for i in range(4)), v.var())
    assert got.keys() == want.keys() and all(got[i][0] == w[0] and got[i][1] == pytest.approx(w[1]) for i, w in want.items())


def plain_peres(bits, depth):
    if depth < 1 or len(bits) < 2:
        return []
    pairs = list(zip(bits[::2], bits[1::2], strict=False))
    return [a for a, b in pairs if a != b] + plain_peres([a ^ b for a, b in pairs], depth - 1) + plain_peres([a for a, b in pairs if a == b], depth - 1)


@pytest.mark.parametrize(("depth", "node", "piece"), [(64, 1 << 20, 1 << 18), (64, 64, 16), (2, 64, 32), (1, 8, 2), (3, 2, 2), (64, 100, 1000)])
def test_peres_of_a_stream_does_not_hang_on_its_chunks(spark, depth, node, piece):
    rng = np.random.default_rng(7)
    whole = {"x": (rng.random(8 * 150) < 0.3).astype(int), "y": np.ones(8 * 40, int), "z": (rng.random(8) < 0.5).astype(int), "w": np.zeros(0, int)}
    want = {s: "".join(map(str, plain_peres(b.tolist(), depth))) for s, b in whole.items()}
    for size in (1, 13, 1000):
        rows = []
        for s, b in whole.items():
            raw = np.packbits(b).tobytes()
            rows += [(s, i, bytearray(raw[i : i + size])) for i in range(0, len(raw), size)]
        got = {}
        out = extract.peres(frame(spark, rows, "source string, off long, bytes binary"), depth, node, piece)
        for r in sorted(out.collect()):
            assert r["i"] == len(got.get(r["source"], ""))
            got[r["source"]] = got.get(r["source"], "") + r["bits"]
        assert got == {s: w for s, w in want.items() if w}
    blocks = {(r["source"], r["i"]): r["bits"] for r in extract.bit_blocks(out, 50).collect()}
    assert blocks == {(s, i): w[i : i + 50] for s, w in want.items() for i in range(0, len(w), 50)}


def test_peres_keeps_its_levels_packed_and_drops_them(spark):
    """Each level was checkpointed twice, a byte per bit: some 40 times the stream stayed on disk. Also of chunks in no order."""
    from pathlib import Path

    from aleatory.functions.shared import folder

    rng = np.random.default_rng(8)
    whole = {"x": (rng.random(1 << 22) < 0.4).astype(np.uint8), None: (rng.random((1 << 15) + 8) < 0.5).astype(np.uint8)}
    want = {s: "".join(map(str, extract._peres_rows(b, np.array([len(b)]), np.array([64]))[1])) for s, b in whole.items()}
    for size, mixed in ((1 << 13, False), (1 << 10, True)):
        rows = [(s, i, bytearray(raw[i : i + size])) for s, b in whole.items() for raw in [np.packbits(b).tobytes()] for i in range(0, len(raw), size)]
        if mixed:
            rows = [rows[i] for i in rng.permutation(len(rows))]
        kept = lambda: sum(f.stat().st_size for f in Path(folder(spark).removeprefix("file:")).rglob("*") if f.is_file())
        before = kept()
        out = extract.peres(frame(spark, rows, "source string, off long, bytes binary"), node=1 << 19, piece=1 << 17)
        got = {}
        for r in sorted(out.collect(), key=lambda r: r["i"]):
            assert r["i"] == len(got.get(r["source"], ""))
            got[r["source"]] = got.get(r["source"], "") + r["bits"]
        assert got == want
        assert kept() - before < 3 * (1 << 19)


def test_peres_of_an_empty_stream(spark):
    assert extract.peres(frame(spark, [], "source string, off long, bytes binary")).count() == 0


def test_states_are_those_of_the_sequential_chain(spark):
    from itertools import islice

    from aleatory.functions import skip
    from aleatory.functions.bytes import xorshift32

    for seed in (skip.GOLDEN, 1, 12345):
        chain = list(islice(xorshift32(seed), 3000))
        for first, count in ((0, 3000), (1, 1), (777, 0), (1234, 1500), (2999, 1)):
            assert skip.states(seed, first, count).tolist() == chain[first : first + count]
        got = skip.stream(spark, 3000, seed, block=256).orderBy("i").collect()
        assert [r["i"] for r in got] == list(range(3000)) and [r["state"] for r in got] == chain
    assert skip.skip(np.array([5], np.uint32), skip.PERIOD).tolist() == [5]
    points = {(r["run"], r["id"]): (r["x"], r["y"]) for r in skip.field(spark, 7, 30, 2.0, 3.0, 12345, block=64).collect()}
    assert points == {(i // 30, i % 30): (chain[2 * i] / 2**32 * 2.0, chain[2 * i + 1] / 2**32 * 3.0) for i in range(210)}


def test_the_envelope_is_that_of_the_fields(spark):
    from aleatory.functions import skip
    from aleatory.operators import spatial

    radii, n, runs = [0.05, 0.3], 40, 9
    s = skip.states(99, 0, 2 * n * runs).reshape(runs, n, 2) / 2**32
    l = []  # noqa: E741
    for f in s:
        d2 = ((f[:, None] - f[None]) ** 2).sum(2)
        np.fill_diagonal(d2, 9)
        l.append([math.sqrt((d2 <= r * r).sum() / n / n / math.pi) - r for r in radii])
    got = {r["radius"]: (r["low"], r["high"]) for r in spatial.csr_envelope(spark, n, 1.0, 1.0, radii, runs, 99).collect()}
    for r, low, high in zip(radii, np.min(l, axis=0), np.max(l, axis=0), strict=True):
        assert got[r] == pytest.approx((low, high))
    blob = frame(spark, [(i, 0.5 + i * 1e-4, 0.5) for i in range(n)], "id long, x double, y double")
    assert all(r["outside"] for r in spatial.csr_test(blob, n, 1.0, 1.0, radii, runs, 99).collect())


@pytest.mark.parametrize("tile", [1, 8, 1 << 16])
def test_transforms_of_any_length(spark, tile):
    from aleatory.operators import spectrum

    rng = np.random.default_rng(tile)
    x = {f"s{n}": rng.normal(size=n) + 1j * rng.normal(size=n) for n in (1, 2, 3, 8, 17, 30, 64, 97)}
    df = frame(spark, [(s, t, float(v.real), float(v.imag)) for s, vs in x.items() for t, v in enumerate(vs)], "series string, t long, re double, im double")
    got = {(r["series"], r["k"]): complex(r["re"], r["im"]) for r in spectrum.fft(df, tile).collect()}
    want = {(s, k): v for s, vs in x.items() for k, v in enumerate(np.fft.fft(vs))}
    assert got.keys() == want.keys() and all(abs(got[i] - w) < 1e-9 for i, w in want.items())


@pytest.mark.parametrize("most", [0, 50, 1 << 16])
def test_spectral_estimates_of_short_and_long_series(spark, most):
    from aleatory.operators import estimators, spectrum

    rng = np.random.default_rng(3)
    x = {"a": rng.normal(size=200), "b": np.sin(np.arange(128)), "c": rng.normal(size=31), "d": rng.integers(0, 3, 77).astype(float)}
    df = frame(spark, [(s, t, float(v)) for s, vs in x.items() for t, v in enumerate(vs)], "series string, t long, x double")
    got = {r["series"]: r for r in spectrum.spectral_estimates(df, most).collect()}
    for s, v in x.items():
        assert got[s]["n"] == len(v) and got[s]["spectral_entropy"] == pytest.approx(estimators._spectral_entropy(v), abs=1e-9)
        assert got[s]["spectral_d"] == pytest.approx(estimators._spectral_test(v)[0])


def test_a_transform_of_a_million_values_is_dealt_to_many_tasks(spark):
    from aleatory.operators import spectrum

    n = 1 << 20
    df = spark.range(n).select(F.lit("s").alias("series"), F.col("id").alias("t"), (F.pmod(F.hash("id"), F.lit(1000)) / 1000.0).alias("re"), F.lit(0.0).alias("im"))
    x = np.array([r[0] for r in df.select("re").collect()])
    got = spectrum.fft(df).toPandas().sort_values("k")
    want = np.fft.fft(x)
    assert np.abs(got["re"].to_numpy() + 1j * got["im"].to_numpy() - want).max() < 1e-6


def plain_casts(raw, bounds):
    cursor, out = draws._Cursor(raw), []
    while True:
        try:
            out.append(tuple(cursor.below(n) for n in bounds))
        except EOFError:
            return out


@pytest.mark.parametrize("bounds", [(78, 77, 76), (256, 3), (1000, 2, 70_000), (200, 60_000), (3,)])
def test_a_reader_goes_on_from_block_to_block(bounds):
    from aleatory.operators import casts

    raw, reader = np.random.default_rng(11).integers(0, 256, 900).astype(np.uint8), casts.Reader(bounds)
    want = [v for c in plain_casts(raw.tobytes(), bounds) for v in c]
    for block in range(reader.halo + 1, 40):
        state, out = 0, []
        for i in range(0, len(raw), block):
            halo = min(reader.halo, i)
            buf = raw[i - halo : i + block]
            out += reader.read(buf, halo, state).tolist()
            state = int(reader.leave(buf, halo)[state])
        assert out[: len(want)] == want and len(out) - len(want) < len(bounds)


@pytest.mark.parametrize(("bounds", "block", "fan"), [([24, 23, 22, 1], 7, 2), ([1000, 2, 70_000], 64, 3), ([3], 1 << 20, 1024)])
def test_casts_of_a_stream_are_those_of_one_reader(spark, bounds, block, fan):
    from aleatory.operators import casts

    rng = np.random.default_rng(11)
    whole = {"x": rng.integers(0, 256, 300).astype(np.uint8), "y": np.full(50, 255, np.uint8), "z": rng.integers(200, 256, 90).astype(np.uint8), "w": np.array([1], np.uint8)}
    rows = [(s, i, bytearray(b[i : i + 33].tobytes())) for s, b in whole.items() for i in range(0, len(b), 33)]
    want = {(s, i, c) for s, b in whole.items() for i, c in enumerate(plain_casts(b.tobytes(), bounds))}
    got = [(r["source"], r["i"], tuple(r["v"])) for r in casts.casts(frame(spark, rows, "source string, off long, bytes binary"), bounds, block, fan).collect()]
    assert len(got) == len(want) and set(got) == want


def test_spreads_of_a_stream(spark):
    from aleatory.operators import casts

    raw = np.random.default_rng(12).integers(0, 256, 2000).astype(np.uint8).tobytes()
    data = frame(spark, [("s", i, bytearray(raw[i : i + 100])) for i in range(0, 2000, 100)], "source string, off long, bytes binary")
    cursor, want = draws._Cursor(raw), []
    while True:
        try:
            want.append(draws._without_replacement(cursor, 78, 10))
        except EOFError:
            break
    got = casts.without_replacement(data, 78, 10, block=128, fan=2).orderBy("i").collect()
    assert [r["drawn"] for r in got] == want
    for bad in ([1, 1], [0], [1 << 49]):
        with pytest.raises(ValueError):
            casts.casts(data, bad)
