"""Bits of device readings."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import devices as dv
from ..operators import estimators as es
from .registry import BYTES, byte_stream, chunk_stream, query, read, rounded


@query("sensor_bytes", "select event_id, (floor(value * 100 + 0.5)::bigint & 255)::int as b from events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", dv.sensor_byte(F.col("value")).alias("b"))


@query("sample_lsb_bits", "select event_id, i::int as i, ((floor(greatest(-1, least(1, value / 100)) * 32767 + 0.5)::int >> (3 - i)::int) & 1)::int as bit from events, range(0, 4) r(i)")
def _(spark, d):
    return read(spark, d, "events").select("event_id", F.posexplode(dv.sample_bits(F.col("value") / 100, 4)).alias("i", "bit"))


@query("iq_lsb_bits", f"with {BYTES} select source, pos, i::int as i, ((b >> (5 - i)::int) & 1)::int as bit from byt, range(0, 6) r(i)")
def _(spark, d):
    return byte_stream(spark, d).select("source", "pos", F.posexplode(dv.radio_bits(F.col("b"))).alias("i", "bit"))


@query("frame_sign_bits", f"with {BYTES}, f as (select source, pos // 32 as frame, pos % 32 as pixel, b as v from byt where pos % 32 % 2 = 0), w as (select *, lag(v) over (partition by source, pixel order by frame) as before from f) select source, frame, pixel, (v > before)::int as bit from w where v <> before")
def _(spark, d):
    return dv.sign_bits(chunk_stream(spark, d), 32, 2)


_PROBIT = [NormalDist().inv_cdf((b + 0.5) / 256) for b in range(256)]


@query("probit_bytes", f"with {BYTES}, x as (select source, ({_PROBIT}::double[])[b + 1] as x from byt where pos % 2 = 0) select source, round(avg(x), 6) + 0.0 as mean, round(stddev_pop(x), 6) as sd, count(*) as n from x group by source")
def _(spark, d):
    z = es.probit_bytes(chunk_stream(spark, d), 2)
    part = [F.sum(F.aggregate("z", F.lit(0.0), f)) for f in (lambda a, v: a + v, lambda a, v: a + v * v)]
    m = z.groupBy("source").agg(part[0].alias("s"), part[1].alias("q"), F.sum(F.size("z")).alias("n"))
    mean = F.col("s") / F.col("n")
    return rounded(m.select("source", mean.alias("mean"), F.sqrt(F.col("q") / F.col("n") - mean * mean).alias("sd"), "n"))


@query("rolling_quality", f"with {BYTES}, c as (select source, pos // 4096 as chunk, b, count(*) as c from byt group by all), n as (select source, chunk, sum(c) as n, max(c) as m, -sum(c * log2(c)) as l from c group by all) select source, chunk, n::bigint as n, round(log2(n) + l / n, 6) + 0.0 as entropy, m::bigint as most from n")
def _(spark, d):
    return rounded(es.rolling_quality(chunk_stream(spark, d), 4096))
