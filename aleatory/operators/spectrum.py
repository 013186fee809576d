"""Fourier transforms of series of any length, dealt to many tasks.

A series of M = M1 * M2 values (a power of two) is a matrix with M2 columns:
its columns are transformed, each value is turned by its twiddle factor, and
after one shuffle its rows are transformed. A task holds a few columns or rows,
about TILE values or the longer side of the matrix. Other lengths become a
convolution with a chirp, which takes three such transforms.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.positions import ranked
from ..functions.shared import cut

#: Values in a task's part of the matrix, where its longer side isn't longer.
TILE = 1 << 16


def _sides(m: int) -> tuple[int, int]:
    """Rows and columns of the matrix of 2**m values."""
    return 1 << m // 2, 1 << m - m // 2


def _power_of_two(m: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), m.cast("int"))


def _four_step(x: DataFrame, tile: int = TILE) -> DataFrame:
    """``(key, m, t, re, im)`` to ``(key, k, re, im)``: the transform of each key's 2**m values; absent ones are 0."""
    kind = dict(x.dtypes)["key"]
    rows = _power_of_two(F.floor(F.col("m") / 2))
    columns = _power_of_two(F.ceil(F.col("m") / 2))
    per = lambda side: F.greatest(F.floor(F.lit(tile) / side), F.lit(1))
    x = x.withColumn("part", F.floor(F.pmod("t", columns) / per(rows)))

    def along_columns(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, m, part = key
        r, c = _sides(m)
        width = min(max(tile // r, 1), c)
        t = pdf["t"].to_numpy()
        a = np.zeros((r, width), complex)
        a[t // c, t % c - part * width] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        k1, t2 = np.arange(r)[:, None], np.arange(part * width, part * width + width)[None]
        a = np.fft.fft(a, axis=0) * np.exp(-2j * math.pi * (t2 * k1 % (r * c)) / (r * c))
        return pd.DataFrame({"key": name, "m": m, "k1": np.repeat(k1.ravel(), width), "t2": np.tile(t2.ravel(), r), "re": a.real.ravel(), "im": a.imag.ravel()})

    def along_rows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, m, part = key
        r, c = _sides(m)
        height = min(max(tile // c, 1), r)
        a = np.zeros((height, c), complex)
        a[pdf["k1"].to_numpy() - part * height, pdf["t2"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        a = np.fft.fft(a, axis=1)
        k = (np.arange(part * height, part * height + height)[:, None] + r * np.arange(c)[None]).ravel()
        return pd.DataFrame({"key": name, "k": k, "re": a.real.ravel(), "im": a.imag.ravel()})

    turned = x.groupBy("key", "m", "part").applyInPandas(along_columns, f"key {kind}, m int, k1 bigint, t2 bigint, re double, im double")
    turned = turned.withColumn("part", F.floor(F.col("k1") / per(columns)))
    return turned.groupBy("key", "m", "part").applyInPandas(along_rows, f"key {kind}, k bigint, re double, im double")


def _times(re: Column, im: Column, a: Column, b: Column) -> list[Column]:
    return [(re * a - im * b).alias("re"), (re * b + im * a).alias("im")]


def fft(x: DataFrame, tile: int = TILE) -> DataFrame:
    """``(series, t, re, im)`` to ``(series, k, re, im)``: the discrete Fourier transform of each series, of any length.

    ``t`` runs from 0 to n - 1. Nothing but columns and rows of the matrix is
    held by a task, so the longest series needs memory for the square root of
    its length (or ``tile`` values). Series of other lengths than powers of two
    are padded to the next power of two over twice their length.
    """
    x = x.select(F.col("series").alias("key"), F.col("t").cast("bigint").alias("t"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    sizes = x.groupBy("key").agg((F.max("t") + 1).alias("n"))
    sizes = sizes.withColumn("plain", F.bit_count("n") == 1)
    m = F.length(F.bin(F.when(F.col("plain"), F.col("n") - 1).otherwise(2 * F.col("n") - 2)))  # bits up to the next power of two
    sizes = sizes.withColumn("m", F.when(F.col("n") == 1, 0).otherwise(m).cast("int"))
    x = cut(x.join(sizes, "key"))
    plain = _four_step(x.where("plain").select("key", "m", "t", "re", "im"), tile).select(F.col("key").alias("series"), "k", "re", "im")
    odd = x.where("not plain")
    if odd.isEmpty():
        return plain
    # Convolution with a chirp: X(k) = w(k) * sum over t of x(t) w(t) * conj(w(k - t)), w(t) = exp(-pi i t^2 / n).
    square = lambda t: F.when(F.col("n") < 3_000_000_000, F.pmod(t * t, 2 * F.col("n"))).otherwise(F.pmod(t.cast("decimal(19,0)") * t.cast("decimal(19,0)"), 2 * F.col("n").cast("decimal(19,0)")).cast("bigint"))
    angle = lambda t: square(t) * math.pi / F.col("n")
    at = odd.withColumn("a", angle(F.col("t")))
    signal = at.select("key", "m", "t", *_times(F.col("re"), F.col("im"), F.cos("a"), -F.sin("a")))
    both = F.when(F.col("t") > 0, F.array(F.col("t"), _power_of_two(F.col("m")) - F.col("t"))).otherwise(F.array("t"))
    chirp = at.select("key", "m", F.explode(both).alias("t"), F.cos("a").alias("re"), F.sin("a").alias("im"))
    b = _four_step(chirp, tile).select("key", "k", F.col("re").alias("a"), F.col("im").alias("b"))
    product = _four_step(signal, tile).join(b, ["key", "k"]).join(sizes.select("key", "m"), "key")
    re, im = _times(F.col("re"), F.col("im"), F.col("a"), F.col("b"))
    back = _four_step(product.select("key", "m", F.col("k").alias("t"), re, (-im).alias("im")), tile)  # the inverse, by conjugates
    out = back.join(sizes, "key").where(F.col("k") < F.col("n")).withColumn("a", angle(F.col("k")))
    out = out.withColumn("length", F.pow(F.lit(2.0), "m"))
    re, im = _times(F.col("re") / F.col("length"), -F.col("im") / F.col("length"), F.cos("a"), -F.sin("a"))
    return plain.unionByName(out.select(F.col("key").alias("series"), "k", re, im))


def power_spectrum(series: DataFrame, most: int = TILE, tile: int = TILE) -> DataFrame:
    """``(series, t, x)`` to ``(series, n, k, power)``: squared magnitudes for k = 0 .. floor(n / 2). Series of up to ``most`` values are transformed in one task each."""
    kind = dict(series.dtypes)["series"]
    series = series.select("series", "t", F.col("x").cast("double").alias("x"))
    sizes = cut(series.groupBy("series").agg(F.count("*").alias("n")))

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["x"].to_numpy(float)
        p = np.abs(np.fft.rfft(x)) ** 2
        return pd.DataFrame({"series": key[0], "n": len(x), "k": np.arange(len(p)), "power": p})

    short = series.join(sizes.where(F.col("n") <= most), "series", "left_semi").groupBy("series").applyInPandas(whole, f"series {kind}, n bigint, k bigint, power double")
    long = sizes.where(F.col("n") > most)
    if long.isEmpty():
        return short
    large = fft(series.join(long, "series", "left_semi").select("series", "t", F.col("x").alias("re"), F.lit(0.0).alias("im")), tile)
    large = large.join(long, "series").where(F.col("k") <= F.floor(F.col("n") / 2))
    return short.unionByName(large.select("series", "n", "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power")))


def spectral_entropy(spectrum: DataFrame) -> DataFrame:
    """``(series, spectral_entropy)`` in bits of each power spectrum's shares; 0 where there is no power."""
    total = F.sum("power")
    h = F.log2(total) - F.sum(F.when(F.col("power") > 0, F.col("power") * F.log2("power")).otherwise(0.0)) / total
    return spectrum.groupBy("series").agg(F.when(total > 0, h).otherwise(0.0).alias("spectral_entropy"))


def signs_about_median(series: DataFrame) -> DataFrame:
    """``(series, t, x)``: 1 over the series' median, else -1. Ranks are dealt over buckets, so no series is sorted by one task."""
    r = ranked(series.select("series", "t", "x"), ["series"], "x", "t")
    middle = (F.col("r") == F.floor((F.col("n") - 1) / 2)) | (F.col("r") == F.floor(F.col("n") / 2))
    median = r.where(middle).groupBy("series").agg(F.avg("x").alias("median"))
    return series.join(median, "series").select("series", "t", F.when(F.col("x") > F.col("median"), 1.0).otherwise(-1.0).alias("x"))


def spectral_test(signs: DataFrame) -> DataFrame:
    """``(series, n, power, k)`` of a series of signs to ``(series, spectral_d)``: SP 800-22's discrete Fourier test, how far the number of low peaks (k below floor(n / 2)) is from the 95 % expected, in standard deviations."""
    low = (F.col("k") < F.floor(F.col("n") / 2)) & (F.sqrt("power") < F.sqrt(math.log(1 / 0.05) * F.col("n")))
    n = F.first("n")
    return signs.groupBy("series").agg(((F.count_if(low) - 0.95 * n / 2) / F.sqrt(n * (0.95 * 0.05 / 4))).alias("spectral_d"))


def spectral_estimates(series: DataFrame, most: int = TILE, tile: int = TILE) -> DataFrame:
    """``(series, n, spectral_entropy, spectral_d)`` of whole series of any length."""
    own = cut(power_spectrum(series, most, tile))
    test = spectral_test(power_spectrum(signs_about_median(series), most, tile))
    sizes = own.groupBy("series").agg(F.first("n").alias("n"))
    return sizes.join(spectral_entropy(own), "series").join(test, "series")
