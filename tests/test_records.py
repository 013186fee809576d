"""Records and frames cut from byte streams, against plain loops over whole streams at several chunk sizes."""

import math
import random
from collections import Counter
from statistics import NormalDist

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aleatory.functions import chunks
from aleatory.operators import devices, estimators, experiment, health, rates

STREAMS = {"a": 1000, "b": 333, "c": 64, "d": 5}


@pytest.fixture(scope="module", params=[7, 32, 400])
def data(spark, request):
    rng = random.Random(1)
    whole = {s: bytes(rng.choice((0, 1, 1, 200, rng.randrange(256))) for _ in range(n)) for s, n in STREAMS.items()}
    rows = [(s, i, bytearray(b[i : i + request.param])) for s, b in whole.items() for i in range(0, len(b), request.param)]
    rng.shuffle(rows)
    return whole, spark.createDataFrame([*rows, ("e", 0, bytearray()), ("e", 0, None)], "source string, off bigint, bytes binary").repartition(3)


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_haloed_chunks_carry_what_is_beside_them(data):
    whole, df = data
    got = {(r.source, r.c): (r.off, bytes(r.bytes)) for r in chunks.haloed(df, 50, before=9, after=120).collect()}
    for s, b in whole.items():
        for c in range((len(b) + 49) // 50):
            low = max(c * 50 - 9, 0)
            assert got[s, c] == (low, b[low : (c + 1) * 50 + 120])


def test_records_of_any_size(data):
    whole, df = data
    for size, bucket in ((6, 30), (64, 10), (7, 1 << 16)):
        out = chunks.records(df, size, lambda row, index, record: (row, {"i": pa.array(index), "h": pa.array([r.tobytes() for r in record], pa.binary())}), "i bigint, h binary", bucket)
        assert [(s, i, bytes(h)) for s, i, h in _rows(out)] == sorted((s, i, b[i * size : (i + 1) * size]) for s, b in whole.items() for i in range(len(b) // size))
        count = {(s, w): b[w * size : (w + 1) * size].count(b[w * size]) for s, b in whole.items() for w in range(len(b) // size)}
        assert _rows(health.apt_windows(df, size, 3)) == sorted((s, w, whole[s][w * size], n, n >= 3) for (s, w), n in count.items())


def test_points_rounds_and_pi(data):
    whole, df = data
    number = lambda x: int.from_bytes(x, "big")
    got = _rows(experiment.sample_field(df, 3.0, 2.0))
    want = sorted((s, i, number(b[8 * i : 8 * i + 4]) / 2**32 * 3, number(b[8 * i + 4 : 8 * i + 8]) / 2**32 * 2) for s, b in whole.items() for i in range(len(b) // 8))
    assert got == want
    draws = lambda x, odds: next((v % odds == odds - 1 for v in (number(x[k : k + 2]) for k in range(0, len(x), 2)) if v < 65536 // odds * odds), False)
    for size, odds in ((16, 6765), (2, 3), (4, 60000)):
        assert _rows(experiment.broadcast_rounds(df, size, odds)) == sorted((s, i, draws(b[i * size : (i + 1) * size], odds)) for s, b in whole.items() for i in range(len(b) // size))
    pi = {s: [number(b[i : i + 3]) ** 2 + number(b[i + 3 : i + 6]) ** 2 <= (2**24 - 1) ** 2 for i in range(0, len(b) - 5, 6)] for s, b in whole.items()}
    assert _rows(estimators.monte_carlo_pi(df)) == sorted((s, len(x), 4 * sum(x) / len(x)) for s, x in pi.items() if x)


@pytest.mark.parametrize(("pixels", "stride", "bucket"), [(32, 2, 64), (5, 1, 1), (10, 3, 1 << 16)])
def test_bits_of_frames_over_borders(data, pixels, stride, bucket):
    whole, df = data
    want = []
    for s, b in whole.items():
        frames = [b[i : i + pixels] for i in range(0, len(b) - pixels + 1, pixels)]
        want += [(s, f + 1, p, int(y[p] > x[p])) for f, (x, y) in enumerate(zip(frames, frames[1:], strict=False)) for p in range(0, pixels, stride) if x[p] != y[p]]
    assert _rows(devices.sign_bits(df, pixels, stride, bucket)) == sorted(want)


def test_quality_of_each_stretch_the_last_one_too(data):
    whole, df = data
    want = []
    for s, b in whole.items():
        for i in range(0, len(b), 100):
            c = Counter(b[i : i + 100])
            n = sum(c.values())
            want.append((s, i // 100, n, pytest.approx(-sum(v / n * math.log2(v / n) for v in c.values()), abs=1e-12), max(c.values())))
    assert _rows(estimators.rolling_quality(df, 100)) == sorted(want, key=lambda r: r[:2])


def test_quantiles_and_phases_of_every_byte(data):
    whole, df = data
    z = {s: [] for s in whole}
    for r in estimators.probit_bytes(df, 3).orderBy("off").collect():
        z.setdefault(r.source, []).extend(r.z)
    theta = {s: [] for s in whole}
    for r in rates.phase_modulate(df, [7, 40, 23, 1]).orderBy("off").collect():
        theta.setdefault(r.source, []).extend(r.theta)
    for s, b in whole.items():
        assert z[s] == [NormalDist().inv_cdf((x + 0.5) / 256) for x in b[::3]]
        assert theta[s] == pytest.approx([(math.tau * x / 256 + (7, 40, 23, 1)[i % 4] * math.tau / 44) % math.tau for i, x in enumerate(b)])
    assert z["e"] == [] and theta["e"] == []


def test_streams_without_bytes(spark):
    none = spark.createDataFrame([("e", 0, bytearray()), ("e", 0, None)], "source string, off bigint, bytes binary")
    for df in (none, none.limit(0)):
        for out in (health.apt_windows(df, 4, 2), health.apt_alarms(df, 4, 2), experiment.sample_disk(df, 1.0), estimators.monte_carlo_pi(df), estimators.rolling_quality(df, 4), devices.sign_bits(df, 4)):
            assert out.count() == 0
        assert estimators.probit_bytes(df).agg(F.sum(F.size("z"))).first()[0] in (0, None)
