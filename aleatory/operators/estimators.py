"""Entropy and randomness estimators: one Arrow pass counts bytes and bits, the estimators are expressions over the counts."""

from __future__ import annotations

import gzip
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.chunks import each, lists, rechunk, records
from ..functions.numerics import erfc
from ..functions.positions import ranked
from . import spectrum

#: Means and null variances of the contrasts for a Gaussian.
LOGCOSH_MEAN, LOGCOSH_NULL = 0.37456720749143796, 0.0063278669911599715
EXP_MEAN, EXP_NULL = -1 / math.sqrt(2), 0.014850269189625764

_COUNTS = StructType([StructField(c, LongType()) for c in ("n", "s", "ss", "lag", "ones", "n00", "n01", "n10", "n11")])


@F.pandas_udf(_COUNTS)
def byte_counts(text: pd.Series) -> pd.DataFrame:
    """Per text's UTF-8: bytes, their sum and square sum, circular lag-1 product sum, one-bits, bit transitions."""
    rows = []
    for t in text:
        b = np.frombuffer((t or "").encode(), np.uint8).astype(np.int64)
        bits = np.unpackbits(b.astype(np.uint8))
        pair = np.bincount(2 * bits[:-1].astype(np.int64) + bits[1:], minlength=4) if len(bits) > 1 else np.zeros(4, np.int64)
        rows.append((len(b), b.sum(), (b * b).sum(), (b * np.roll(b, -1)).sum(), bits.sum(), *pair))
    return pd.DataFrame(rows, columns=_COUNTS.names, dtype=np.int64)


def total(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0).cast("bigint"), lambda a, c: a + c)


def histogram_entropy(hist: Column) -> Column:
    """Shannon entropy in bits of an array of counts: log2(n) - sum of c * log2(c) / n."""
    n = total(hist)
    logs = F.aggregate(hist, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c)).otherwise(0.0))
    return F.when(n > 0, F.log2(n) - logs / n).otherwise(0.0)


def most_common_min_entropy(hist: Column) -> Column:
    """-log2 of the upper bound of the most common value's share."""
    n = total(hist)
    p = F.array_max(hist) / n
    return -F.log2(F.least(F.lit(1.0), p + 2.576 * F.sqrt(p * (1 - p) / (n - 1))))


def chi_square(hist: Column) -> Column:
    """Chi-square against uniform over all bins, zero bins too: bins / n * sum of c**2 - n."""
    n = total(hist)
    squares = F.aggregate(hist, F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    return squares * F.size(hist) / n - n


def serial_correlation(c: Column) -> Column:
    n, s = c["n"].cast("double"), c["s"].cast("double")
    below = n * c["ss"] - s * s
    return F.when(below == 0, 1.0).otherwise((n * c["lag"] - s * s) / below)


def monobit_z(c: Column) -> Column:
    return (2 * c["ones"] - 8 * c["n"]) / F.sqrt(8 * c["n"])


def runs_z(c: Column) -> Column:
    """Wald-Wolfowitz z over bits; infinite if all bits are alike."""
    n, one = (8 * c["n"]).cast("double"), c["ones"].cast("double")
    mean = 2 * one * (n - one) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z = F.when(var > 0, (c["n01"] + c["n10"] + 1 - mean) / F.sqrt(var)).otherwise(0.0)
    return F.when((one == 0) | (one == n), float("inf")).otherwise(z)


def markov_min_entropy(c: Column, steps: int = 128) -> Column:
    """Min-entropy per bit of the likeliest path of a first-order chain; clamped to [0, 1]."""
    n = 8 * c["n"]
    log = lambda p: F.when(p > 0, F.log2(p)).otherwise(float("-inf"))
    share = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    l00, l01, l10, l11 = (log(share(c[x], c[y])) for x, y in (("n00", "n01"), ("n01", "n00"), ("n10", "n11"), ("n11", "n10")))
    start = F.struct(log(1 - c["ones"] / n).alias("a"), log(c["ones"] / n).alias("b"))
    step = lambda s, _: F.struct(F.greatest(s["a"] + l00, s["b"] + l10).alias("a"), F.greatest(s["a"] + l01, s["b"] + l11).alias("b"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps - 1)), start, step)
    return F.when((n < 2) | (F.greatest(end["a"], end["b"]) == float("-inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -F.greatest(end["a"], end["b"]) / steps)))


def autocorrelation(series: DataFrame, lags: int) -> DataFrame:
    """``(series, t, x)`` to ``(series, lag, acf)``, biased; constant series are left out."""
    mean = series.groupBy("series").agg(F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    mean = mean.withColumn("v", F.col("q") - F.col("n") * F.col("m") * F.col("m")).where(F.col("v") > 1e-12 * F.greatest(F.col("q"), F.lit(1.0)))
    c = series.join(mean.select("series", "m", "v"), "series").select("series", "t", (F.col("x") - F.col("m")).alias("y"), "v")
    later = c.select("series", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), (F.col("t") - F.col("lag")).alias("t"), F.col("y").alias("y2"))
    return c.join(later, ["series", "t"]).groupBy("series", "lag").agg((F.sum(F.col("y") * F.col("y2")) / F.first("v")).alias("acf"))


def vasicek(series: DataFrame) -> DataFrame:
    """``(series, n, entropy, negentropy)`` by m-spacings, m = floor(sqrt(n) + 1/2); a series with ties in a spacing is left out."""
    r = ranked(series, ["series"], "x", "t").select("series", "x", "n", (F.col("r") + 1).alias("r"), F.floor(F.sqrt("n") + 0.5).alias("m")).where("m < n / 2")
    # A value is the lower end of the place m above it and the upper end of the place m below; the first and last value are so for all places beyond.
    i, none = F.col("r"), F.array().cast("array<bigint>")
    low = F.when(i == 1, F.sequence(F.lit(1).cast("bigint"), F.col("m") + 1)).when(i + F.col("m") <= F.col("n"), F.array(i + F.col("m"))).otherwise(none)
    high = F.when(i == F.col("n"), F.sequence(F.col("n") - F.col("m"), F.col("n"))).when(i > F.col("m"), F.array(i - F.col("m"))).otherwise(none)
    end = lambda places, up: F.transform(places, lambda p: F.struct(p.alias("place"), F.lit(up).alias("up")))
    ends = r.select("series", "x", "n", "m", F.explode(F.concat(end(low, 0), end(high, 1))).alias("e"))
    gaps = ends.groupBy("series", "n", "m", "e.place").agg((F.max(F.when(F.col("e.up") == 1, F.col("x"))) - F.max(F.when(F.col("e.up") == 0, F.col("x")))).alias("gap"))
    out = gaps.groupBy("series", "n").agg(F.avg(F.log(F.col("n") / (2 * F.col("m")) * F.col("gap"))).alias("entropy"), F.min("gap").alias("g")).where("g > 0")
    spread = series.groupBy("series").agg(F.var_pop("x").alias("var"))
    return out.join(spread, "series").select("series", "n", "entropy", (0.5 * F.log(F.lit(2 * math.pi * math.e) * F.col("var")) - F.col("entropy")).alias("negentropy"))


def moments(x: str = "x") -> list[Column]:
    """n and the population mean, variance, skewness and excess kurtosis."""
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt")]


def moment_negentropy(skew: Column, kurt: Column) -> Column:
    return skew * skew / 12 + kurt * kurt / 48


def contrast_negentropy(series: DataFrame, contrast: str) -> DataFrame:
    """``(series, n, j, z)`` with the log-cosh or exp contrast of the standardised series."""
    m = series.groupBy("series").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).where("sd > 0")
    y = (F.col("x") - F.col("mean")) / F.col("sd")
    value, mean, null = (F.log(F.cosh(y)), LOGCOSH_MEAN, LOGCOSH_NULL) if contrast == "logcosh" else (-F.exp(-y * y / 2), EXP_MEAN, EXP_NULL)
    d = F.col("e") - mean
    return series.join(m, "series").groupBy("series").agg(F.count("*").alias("n"), F.avg(value).alias("e")).select("series", "n", (d * d).alias("j"), (d / F.sqrt(null / F.col("n"))).alias("z"))


def count_windows(series: DataFrame, size: int, hop: int) -> DataFrame:
    """``(series, t, x)`` to ``(series, w, t, x)``: every row in each window [w * hop, w * hop + size) that holds it."""
    first = F.greatest(F.ceil((F.col("t") - size + 1) / hop), F.lit(0))
    return series.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("t") / hop))))


def windowed_negentropy(series: DataFrame, size: int = 32, hop: int = 8) -> DataFrame:
    """``(series, w, j)`` of the moment negentropy over full count windows."""
    w = count_windows(series, size, hop).groupBy("series", "w").agg(*moments()).where((F.col("n") == size) & (F.col("var") > 0))
    return w.select("series", "w", moment_negentropy(F.col("skew"), F.col("kurt")).alias("j"))


def monte_carlo_pi(data: DataFrame) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, points, pi)``: six bytes are a point of two 24-bit coordinates; a source of under six bytes has no row."""

    def count(row: np.ndarray, index: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        x, y = (record[:, [i, i + 1, i + 2]].astype(np.int64) @ np.array([1 << 16, 1 << 8, 1]) for i in (0, 3))
        inside = x * x + y * y <= ((1 << 24) - 1) ** 2
        points = np.bincount(row)
        at = np.flatnonzero(points)
        return at, {"points": pa.array(points[at]), "hits": pa.array(np.bincount(row, inside)[at].astype(np.int64))}

    total = records(data, 6, count, "points bigint, hits bigint").groupBy("source").agg(F.sum("points").alias("points"), F.sum("hits").alias("hits"))
    return total.select("source", "points", (4 * F.col("hits") / F.col("points")).alias("pi"))


def rolling_quality(data: DataFrame, size: int) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, chunk, n, entropy, most)`` of each ``size`` bytes: Shannon entropy per byte and the count of the commonest byte. The last chunk of a source may hold fewer bytes: ``n``."""

    def count(off: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        n = np.diff(bounds)
        key, c = np.unique(np.repeat(np.arange(len(off)), n) * 256 + raw, return_counts=True)
        first = np.searchsorted(key, np.arange(len(off)) * 256)
        entropy = np.log2(n) - np.add.reduceat(c * np.log2(c), first) / n
        columns = {"chunk": off // size, "n": n, "entropy": entropy, "most": np.maximum.reduceat(c, first)}
        return np.arange(len(off)), {k: pa.array(v) for k, v in columns.items()}

    return each(rechunk(data, size), count, "chunk bigint, n bigint, entropy double, most bigint")


def probit_bytes(data: DataFrame, stride: int = 1) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, off, z)``: the normal quantiles of (b + 0.5) / 256 of each ``stride``-th byte of the stream, as an array per chunk."""
    z = np.array([NormalDist().inv_cdf((b + 0.5) / 256) for b in range(256)])

    def turn(off: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        row = np.repeat(np.arange(len(off)), np.diff(bounds))
        take = (off[row] + np.arange(len(raw)) - bounds[row]) % stride == 0
        return np.arange(len(off)), {"z": lists(z[raw[take]], np.bincount(row[take], minlength=len(off)), pa.float64())}

    return each(data.where("bytes is not null"), turn, "z array<double>", ("source", "off"))


@F.pandas_udf(DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    return pd.Series([len(gzip.compress(b, mtime=0)) / len(b) if (b := (t or "").encode()) else float("nan") for t in text])


def grade(conditioned: Column, min_entropy: Column) -> Column:
    return F.when(conditioned, "pass").when(min_entropy >= 6.5, "excellent").when(min_entropy >= 3, "moderate").otherwise("weak")


def _spectral_entropy(x: np.ndarray) -> float:
    p = np.abs(np.fft.rfft(x)) ** 2
    p = p[p > 0] / p.sum() if p.sum() > 0 else p[:0]
    return float(-(p * np.log2(p)).sum())


def _spectral_test(x: np.ndarray) -> tuple[float, float]:
    """SP 800-22's discrete Fourier test over the series' signs about its median."""
    s = np.where(x > np.median(x), 1.0, -1.0)
    n = len(s)
    peaks = np.abs(np.fft.rfft(s))[: n // 2]
    d = ((peaks < math.sqrt(math.log(1 / 0.05) * n)).sum() - 0.95 * n / 2) / math.sqrt(n * 0.95 * 0.05 / 4)
    return float(d), math.erfc(abs(d) / math.sqrt(2))


def _template_counts(x: np.ndarray, m: int, r: float, count: int) -> np.ndarray:
    """Of each of the first ``count`` templates of length m: how many are within r (itself too), in blocks of rows."""
    block = max(1, (1 << 21) // max(len(x), 1))  # rows whose distances are held at a time: 16 MB
    out = []
    for i in range(0, count, block):
        near = np.ones((min(block, count - i), count), bool)
        for k in range(m):
            near &= np.abs(x[i + k : i + k + len(near), None] - x[None, k : k + count]) <= r
        out.append(near.sum(1))
    return np.concatenate(out) if out else np.zeros(0)


def _sample_entropy(x: np.ndarray, m: int = 2) -> float:
    r, n = 0.2 * x.std(), len(x)
    b = (_template_counts(x, m, r, n - m + 1) - 1).sum() / 2
    a = (_template_counts(x, m + 1, r, n - m) - 1).sum() / 2
    return math.inf if a == 0 else float(-math.log(a / b))


def _approximate_entropy(x: np.ndarray, m: int = 2) -> float:
    r, n = 0.2 * x.std(), len(x)
    phi = lambda k: float(np.log(_template_counts(x, k, r, n - k + 1) / (n - k + 1)).mean())
    return phi(m) - phi(m + 1)


def _whole_template_counts(series: DataFrame, sizes: DataFrame, block: int = 256) -> DataFrame:
    """``(series, t, c2, c3)``: of each template of length 2, and of length 3, how many are within r = sd / 5 (itself too).

    Templates are bucketed by r in their first two values, so that only
    neighbouring buckets can match; these meet in blocks, dealt by the join.
    ``sizes`` is (series, n, mean, sd).
    """
    x = series.select("series", "t", "x")
    t = x.join(x.select("series", (F.col("t") - 1).alias("t"), F.col("x").alias("y")), ["series", "t"])
    t = t.join(x.select("series", (F.col("t") - 2).alias("t"), F.col("x").alias("z")), ["series", "t"], "left").join(sizes, "series")
    bucket = lambda c: F.floor((F.col(c) - F.col("mean")) / (0.2 * F.col("sd") * (1 + 1e-9)))  # noqa: E731  (a little wider than r, against rounding)
    t = t.select("series", "t", "x", "y", F.coalesce("z", F.lit(float("nan"))).alias("z"), (0.2 * F.col("sd")).alias("r"), bucket("x").alias("gx"), bucket("y").alias("gy"))
    key = ["series", "gx", "gy"]
    count = t.groupBy(key).agg(F.ceil(F.count("*") / block).alias("k"))
    cells = t.join(count, key).groupBy(*key, F.pmod(F.xxhash64("t"), F.col("k")).alias("part"), "r").agg(F.collect_list(F.struct("t", "x", "y", "z")).alias("a"))
    side = lambda to: [F.col(f"a.{c}").alias(f"{to}{c}") for c in ("t", "x", "y", "z")]
    near = F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))
    ours = cells.withColumn("dx", near).withColumn("dy", near).select("series", (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"), "r", *side("a"))
    pairs = ours.join(cells.select(*key, *side("b")), key).select("series", "r", "at", "ax", "ay", "az", "bx", "by", "bz")

    def compare(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                near = lambda a, b: np.abs(np.asarray(a)[:, None] - np.asarray(b)) <= row.r  # noqa: E731, B023
                two = near(row.ax, row.bx) & near(row.ay, row.by)
                out.append(pd.DataFrame({"series": row.series, "t": row.at, "c2": two.sum(1), "c3": (two & near(row.az, row.bz)).sum(1)}))
            if out:
                yield pd.concat(out)

    kind = dict(series.dtypes)["series"]
    found = pairs.mapInPandas(compare, f"series {kind}, t bigint, c2 bigint, c3 bigint")
    return found.groupBy("series", "t").agg(F.sum("c2").alias("c2"), F.sum("c3").alias("c3"))


def _whole_entropies(series: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(series, sample_entropy, approximate_entropy)`` of whole series, with templates of length 2 and 3."""
    c = _whole_template_counts(series, sizes).join(sizes.select("series", "n"), "series")
    c = c.groupBy("series").agg(
        F.sum(F.col("c2") - 1).alias("b"),
        F.sum(F.when(F.col("c3") > 0, F.col("c3") - 1)).alias("a"),
        F.avg(F.log(F.col("c2") / (F.col("n") - 1))).alias("two"),
        F.avg(F.when(F.col("c3") > 0, F.log(F.col("c3") / (F.col("n") - 2)))).alias("three"),
    )
    return c.select("series", F.when(F.col("a") == 0, float("inf")).otherwise(-F.log(F.col("a") / F.col("b"))).alias("sample_entropy"), (F.col("two") - F.col("three")).alias("approximate_entropy"))


def series_estimates(series: DataFrame, least: int = 8, most: int = 1 << 16) -> DataFrame:
    """``(series, segment, n, spectral_entropy, spectral_d, spectral_p, sample_entropy, approximate_entropy)`` of whole series; ``segment`` is 0, ``t`` is dense.

    Template pairs of series longer than ``most``, whose number grows with the
    square of the length, are counted by many tasks, and such series are
    transformed by many tasks too (``spectrum.fft``).
    """
    names = ["series", "segment", "n", "spectral_entropy", "spectral_d", "spectral_p", "sample_entropy", "approximate_entropy"]

    def estimate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["x"].to_numpy(float)
        if len(x) < least or x.std() == 0:
            return pd.DataFrame([], columns=names)
        return pd.DataFrame([(key[0], 0, len(x), _spectral_entropy(x), *_spectral_test(x), _sample_entropy(x), _approximate_entropy(x))], columns=names)

    kind = dict(series.dtypes)["series"]
    schema = ", ".join([f"series {kind}", "segment bigint", "n bigint", *[f"{c} double" for c in names[3:]]])
    series = series.select("series", "t", "x")
    sizes = series.groupBy("series").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    long = sizes.where(F.col("n") > most)
    if long.isEmpty():
        return series.groupBy("series").applyInPandas(estimate, schema)
    short = series.join(long, "series", "left_anti").groupBy("series").applyInPandas(estimate, schema)
    long = long.where("sd > 0")
    large = series.join(long, "series", "left_semi")
    p = erfc(F.abs("spectral_d") / math.sqrt(2))
    spectra = spectrum.spectral_estimates(large, most).select("series", F.lit(0).cast("bigint").alias("segment"), "n", "spectral_entropy", "spectral_d", p.alias("spectral_p"))
    return short.unionByName(spectra.join(_whole_entropies(large, long), "series"))
