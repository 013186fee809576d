"""Entropy and randomness estimators over texts, digests and user series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bytes import byte_histogram
from ..functions.positions import positions
from ..operators import estimators as es
from ..operators import spectrum
from .registry import BYTES, chunk_stream, query, read, rounded

_DOC = """raw as (select doc_id, regexp_extract_all(hex(encode(text)), '..') as l from documents where text is not null and text <> ''),
byt as (select doc_id, unnest(range(0, len(l))) as pos, ('0x' || unnest(l))::int as b from raw),
hist as (select doc_id, b, count(*) as c, sum(count(*)) over (partition by doc_id) as n from byt group by doc_id, b)"""
_BITS = f"""{_DOC}, bits as (select doc_id, pos * 8 + i as p, (b >> (7 - i)::int) & 1 as bit from byt, range(0, 8) r(i)),
nxt as (select *, lead(bit) over (partition by doc_id order by p) as nb from bits),
cnt as (select doc_id, count(*)::double as n, sum(bit)::double as ones, count(*) filter (bit = 0 and nb = 0)::double as n00, count(*) filter (bit = 0 and nb = 1)::double as n01,
  count(*) filter (bit = 1 and nb = 0)::double as n10, count(*) filter (bit = 1 and nb = 1)::double as n11 from nxt group by doc_id)"""
_SERIES = "ser as (select user_id as series, row_number() over (partition by user_id order by event_id) - 1 as t, value as x from events)"


def series(spark, d):
    """``(series, t, x)``: values of each user, in order."""
    e = read(spark, d, "events").select(F.col("user_id").alias("series"), "event_id", F.col("value").alias("x"))
    return positions(e, ["series"], "event_id").select("series", "t", "x")


def _hist(spark, d):
    docs = read(spark, d, "documents").where("text is not null and text <> ''")
    return docs.select("doc_id", byte_histogram("text").alias("h"))


def _counts(spark, d):
    return read(spark, d, "documents").where("text is not null and text <> ''").select("doc_id", es.byte_counts("text").alias("c"))


@query("shannon_bytes", f"with {_DOC} select doc_id, round(-sum(c / n * log2(c / n)), 6) + 0.0 as entropy from hist group by doc_id")
def _(spark, d):
    return rounded(_hist(spark, d).select("doc_id", es.histogram_entropy(F.col("h")).alias("entropy")))


@query("mcv_min_entropy", f"with {_DOC}, m as (select doc_id, max(c) / max(n) as p, max(n) as n from hist group by doc_id) select doc_id, round(-log2(least(1.0::double, p + 2.576::double * sqrt(p * (1 - p) / (n - 1)))), 6) + 0.0 as min_entropy from m where n > 1")
def _(spark, d):
    return rounded(_hist(spark, d).where(F.aggregate("h", F.lit(0), lambda a, c: a + c) > 1).select("doc_id", es.most_common_min_entropy(F.col("h")).alias("min_entropy")))


@query("chi_square_bytes", f"with {_DOC}, s as (select doc_id, sum((c - n / 256) * (c - n / 256) / (n / 256)) as x, count(*) as k, max(n) as n from hist group by doc_id) select doc_id, round(x + (256 - k) * n / 256, 4) as statistic from s")
def _(spark, d):
    return rounded(_hist(spark, d).select("doc_id", es.chi_square(F.col("h")).alias("statistic")), 4)


@query(
    "serial_correlation",
    f"""with {_DOC}, n as (select doc_id, b, coalesce(lead(b) over (partition by doc_id order by pos), first_value(b) over (partition by doc_id order by pos)) as b2 from byt),
    s as (select doc_id, count(*)::double as n, sum(b)::double as s, sum(b * b)::double as ss, sum(b * b2)::double as l from n group by doc_id)
    select doc_id, round(case when n * ss - s * s = 0 then 1 else (n * l - s * s) / (n * ss - s * s) end, 6) + 0.0 as r from s""",
)
def _(spark, d):
    return rounded(_counts(spark, d).select("doc_id", es.serial_correlation(F.col("c")).alias("r")))


@query("monobit", f"with {_BITS} select doc_id, round(ones / n, 6) as ones, round((2 * ones - n) / sqrt(n), 6) + 0.0 as z from cnt")
def _(spark, d):
    return rounded(_counts(spark, d).select("doc_id", (F.col("c.ones") / (8 * F.col("c.n"))).alias("ones"), es.monobit_z(F.col("c")).alias("z")))


@query("runs_test", f"with {_BITS}, m as (select *, 2 * ones * (n - ones) / n + 1 as mu from cnt), v as (select *, (mu - 1) * (mu - 2) / (n - 1) as var from m) select doc_id, round(case when var > 0 then (n01 + n10 + 1 - mu) / sqrt(var) else 0 end, 6) + 0.0 as z from v where ones > 0 and ones < n")
def _(spark, d):
    return rounded(_counts(spark, d).where("c.ones > 0 and c.ones < 8 * c.n").select("doc_id", es.runs_z(F.col("c")).alias("z")))


@query(
    "markov_min_entropy",
    f"""with recursive {_BITS},
    p as (select doc_id, n, case when n00 + n01 > 0 then n00 / (n00 + n01) else 0 end as p00, case when n00 + n01 > 0 then n01 / (n00 + n01) else 0 end as p01,
      case when n10 + n11 > 0 then n10 / (n10 + n11) else 0 end as p10, case when n10 + n11 > 0 then n11 / (n10 + n11) else 0 end as p11, ones / n as one from cnt),
    l as (select doc_id, n, {", ".join(f"case when {c} > 0 then log2({c}) else '-infinity'::double end as {n}" for n, c in (("l00", "p00"), ("l01", "p01"), ("l10", "p10"), ("l11", "p11"), ("a", "(1 - one)"), ("b", "one")))} from p),
    path as (select doc_id, 1 as k, a, b from l union all select doc_id, k + 1, greatest(path.a + l00, path.b + l10), greatest(path.a + l01, path.b + l11) from path join l using (doc_id) where k < 128)
    select doc_id, round(case when greatest(a, b) = '-infinity'::double then 0 else greatest(0, least(1, -greatest(a, b) / 128)) end, 6) + 0.0 as min_entropy from path where k = 128""",
)
def _(spark, d):
    return rounded(_counts(spark, d).select("doc_id", es.markov_min_entropy(F.col("c")).alias("min_entropy")))


@query(
    "acf",
    f"""with {_SERIES}, m as (select series, avg(x) as m from ser group by series), c as (select series, t, x - m as y from ser join m using (series)),
    v as (select series, sum(y * y) as v from c group by series having sum(y * y) > 1e-12)
    select a.series, lag::int as lag, round(sum(a.y * b.y) / max(v), 6) + 0.0 as acf from c a, range(0, 6) l(lag), c b, v where a.series = b.series and v.series = a.series and b.t = a.t + lag group by a.series, lag""",
)
def _(spark, d):
    return rounded(es.autocorrelation(series(spark, d), 5))


@query(
    "vasicek",
    f"""with {_SERIES}, s as (select series, count(*) as n, var_pop(x) as var, floor(sqrt(count(*)) + 0.5)::bigint as m from ser group by series having floor(sqrt(count(*)) + 0.5) < count(*) / 2),
    r as (select series, x, row_number() over (partition by series order by x, t) as r from ser),
    e as (select a.series, n, m, var, h.x - l.x as gap from r a join s using (series) join r h on h.series = a.series and h.r = least(a.r + m, n) join r l on l.series = a.series and l.r = greatest(a.r - m, 1)),
    o as (select series, n, max(var) as var, avg(case when gap > 0 then ln(n / (2 * m) * gap) end) as h from e group by series, n having min(gap) > 0)
    select series, n, round(h, 6) + 0.0 as entropy, round(0.5 * ln(2 * pi() * exp(1) * var) - h, 6) + 0.0 as negentropy from o""",
)
def _(spark, d):
    return rounded(es.vasicek(series(spark, d)))


_MOM = "mom as (select series, count(*) as n, avg(x) as m, stddev_pop(x) as sd from ser group by series having stddev_pop(x) > 0), std as (select series, n, (x - m) / sd as y from ser join mom using (series))"


@query("neg_kurtosis", f"with {_SERIES}, {_MOM} select series, n, round(avg(y ** 3) ** 2 / 12 + (avg(y ** 4) - 3) ** 2 / 48, 6) as j from std where n >= 8 group by series, n")
def _(spark, d):
    m = series(spark, d).groupBy("series").agg(*es.moments()).where("n >= 8 and var > 0")
    return rounded(m.select("series", "n", es.moment_negentropy(F.col("skew"), F.col("kurt")).alias("j")))


@query("neg_logcosh", f"with {_SERIES}, {_MOM}, e as (select series, n, avg(ln(cosh(y))) - 0.37456720749143796::double as d from std group by series, n) select series, n, round(d * d, 9) as j, round(d / sqrt(0.0063278669911599715::double / n), 6) + 0.0 as z from e")
def _(spark, d):
    return es.contrast_negentropy(series(spark, d), "logcosh").select("series", "n", F.round("j", 9).alias("j"), (F.round("z", 6) + 0.0).alias("z"))


@query("neg_exp", f"with {_SERIES}, {_MOM}, e as (select series, n, avg(-exp(-y * y / 2)) + 1 / sqrt(2) as d from std group by series, n) select series, n, round(d * d, 9) as j, round(d / sqrt(0.014850269189625764::double / n), 6) + 0.0 as z from e")
def _(spark, d):
    return es.contrast_negentropy(series(spark, d), "exp").select("series", "n", F.round("j", 9).alias("j"), (F.round("z", 6) + 0.0).alias("z"))


@query(
    "windowed_negentropy",
    f"""with {_SERIES}, w as (select series, w, x from ser, lateral (select unnest(range(greatest(ceil((t - 31) / 8.0), 0)::bigint, (t // 8 + 1)::bigint)) as w)),
    m as (select series, w, avg(x) as m, stddev_pop(x) as sd from w group by all having count(*) = 32 and stddev_pop(x) > 0),
    y as (select series, w, (x - m) / sd as y from w join m using (series, w)) select series, w, round(avg(y ** 3) ** 2 / 12 + (avg(y ** 4) - 3) ** 2 / 48, 6) as j from y group by all""",
)
def _(spark, d):
    return rounded(es.windowed_negentropy(series(spark, d)))


@query("monte_carlo_pi", f"with {BYTES}, p as (select source, pos // 6 as p, sum(case when pos % 6 < 3 then b * (1 << (16 - 8 * (pos % 3))::int) else 0 end)::double as x, sum(case when pos % 6 >= 3 then b * (1 << (16 - 8 * (pos % 3))::int) else 0 end)::double as y from byt group by all having count(*) = 6) select source, count(*) as points, round(4 * avg((x * x + y * y <= 16777215.0::double * 16777215)::int), 6) as pi from p group by source")
def _(spark, d):
    return rounded(es.monte_carlo_pi(chunk_stream(spark, d)))


@query("compression_ratio")
def _(spark, d):
    return read(spark, d, "documents").where("text <> ''").select("doc_id", F.round(es.compression_ratio("text"), 6).alias("ratio"))


@query("quality_grade", f"with {_DOC}, m as (select doc_id, max(c) / max(n) as p, max(n) as n from hist group by doc_id), e as (select doc_id, -log2(least(1.0::double, p + 2.576::double * sqrt(p * (1 - p) / (n - 1)))) as h from m where n > 1) select doc_id, case when h >= 6.5 then 'excellent' when h >= 3 then 'moderate' else 'weak' end as grade from e")
def _(spark, d):
    h = _hist(spark, d).where(F.aggregate("h", F.lit(0), lambda a, c: a + c) > 1)
    return h.select("doc_id", es.grade(F.lit(False), es.most_common_min_entropy(F.col("h"))).alias("grade"))


@query("series_estimates")
def _(spark, d):
    return rounded(es.series_estimates(series(spark, d)))


def type_series(spark, d):
    """``(series, t, x)``: values of each event type, in order: few series, whose length grows with the table."""
    e = read(spark, d, "events").select(F.col("event_type").alias("series"), "event_id", F.col("value").alias("x"))
    return positions(e, ["series"], "event_id").select("series", "t", "x")


def _dft(series: str, out: str, half: bool = False) -> str:
    """DuckDB's equivalent of a transform, by its sums: ``out`` is (series, n, k, re, im)."""
    last = "n // 2 + 1" if half else "n"
    turn = "2 * pi() * ((k * t) % n) / n"
    return f"{out} as (select series, n, k, sum(x * cos({turn})) as re, -sum(x * sin({turn})) as im from (select *, unnest(range(0, {last})) as k from (select *, count(*) over (partition by series) as n from {series})) group by all)"


_TYPES = "tys as (select event_type as series, row_number() over (partition by event_type order by event_id) - 1 as t, value as x from events)"


@query("power_spectrum", f"with {_SERIES}, {_dft('ser', 'ft', True)} select series, n, k, round(sqrt(re * re + im * im), 6) + 0.0 as magnitude from ft")
def _(spark, d):
    p = spectrum.power_spectrum(series(spark, d))
    return rounded(p.select("series", "n", "k", F.sqrt("power").alias("magnitude")))


@query("fourier_transform", f"with {_TYPES}, {_dft('tys', 'ft')} select series, k, round(re, 3) + 0.0 as re, round(im, 3) + 0.0 as im from ft")
def _(spark, d):
    s = type_series(spark, d).select("series", "t", F.col("x").alias("re"), F.lit(0.0).alias("im"))
    return rounded(spectrum.fft(s), 3)


@query(
    "spectral_estimates",
    f"""with {_TYPES}, {_dft('tys', 'ft', True)}, sg as (select series, t, case when x > m then 1.0::double else -1.0::double end as x from (select *, median(x) over (partition by series) as m from tys)), {_dft('sg', 'sf', True)},
    pw as (select series, n, re * re + im * im as p from ft), e as (select series, n, log2(sum(p)) - sum(case when p > 0 then p * log2(p) else 0 end) / sum(p) as h from pw group by series, n),
    t as (select series, (count(*) filter (k < n // 2 and sqrt(re * re + im * im) < sqrt(ln(20) * n)) - 0.95 * n / 2) / sqrt(n * (0.95 * 0.05 / 4)) as d from sf group by series, n)
    select series, n, round(h, 6) + 0.0 as spectral_entropy, round(d, 6) + 0.0 as spectral_d from e join t using (series)""",
)
def _(spark, d):
    return rounded(spectrum.spectral_estimates(type_series(spark, d), most=1 << 10))
