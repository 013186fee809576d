"""Statistics over several aligned sources: ``z(source, t, z)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerics import chi2_ppf


def steps(z: DataFrame) -> DataFrame:
    """``(t, n, s, q, zs)``: sources, sum, sum of squares and Stouffer z of each step."""
    return z.groupBy("t").agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q")).withColumn("zs", F.col("s") / F.sqrt("n"))


def netvar(z: DataFrame) -> DataFrame:
    """``(statistic, df)``: sum of squared Stouffer z over steps."""
    return steps(z).agg(F.sum(F.col("zs") * F.col("zs")).alias("statistic"), F.count("*").alias("df"))


def devvar(z: DataFrame) -> DataFrame:
    return z.agg(F.sum(F.col("z") * F.col("z")).alias("statistic"), F.count("*").alias("df"))


def pairs(z: DataFrame) -> DataFrame:
    """``(a, b, r)``: mean product of each pair of sources; a join on t, sources being few."""
    other = z.select("t", F.col("source").alias("b"), F.col("z").alias("zb"))
    return z.select("t", F.col("source").alias("a"), F.col("z").alias("za")).join(other, "t").where("a < b").groupBy("a", "b").agg(F.avg(F.col("za") * F.col("zb")).alias("r"))


def correlation(z: DataFrame) -> DataFrame:
    """``(statistic, steps)``: standardised sum of pair products, by ((sum z)**2 - sum z**2) / 2 instead of a pair join."""
    s = steps(z)
    product = (F.col("s") * F.col("s") - F.col("q")) / 2
    return s.agg((F.sum(product) / F.sqrt(F.sum(F.col("n") * (F.col("n") - 1) / 2))).alias("statistic"), F.count("*").alias("steps"))


def coherence(z: DataFrame) -> DataFrame:
    """``(t, coherence)``: mean pairwise product of each step."""
    return steps(z).select("t", ((F.col("s") * F.col("s") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))


def clustered(z: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(within, between, steps)`` for ``clusters(source, cluster)``: squares of the clusters' Stouffer z, and of the Stouffer z over clusters."""
    cz = z.join(clusters, "source").groupBy("t", "cluster").agg((F.sum("z") / F.sqrt(F.count("*"))).alias("cz"))
    per = cz.groupBy("t").agg(F.sum(F.col("cz") * F.col("cz")).alias("w"), (F.sum("cz") / F.sqrt(F.count("*"))).alias("b"))
    return per.agg(F.sum("w").alias("within"), F.sum(F.col("b") * F.col("b")).alias("between"), F.count("*").alias("steps"))


def onsite_vs_global(onsite: DataFrame, rest: DataFrame) -> DataFrame:
    """``(r, statistic, n)`` of two series ``(t, x)``: Pearson r and Fisher's z = atanh(r) * sqrt(n - 3)."""
    both = onsite.join(rest.select("t", F.col("x").alias("y")), "t").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))
    r = F.greatest(F.least(F.col("r"), F.lit(1 - 1e-15)), F.lit(-1 + 1e-15))
    return both.select("r", (F.atanh(r) * F.sqrt(F.col("n") - 3)).alias("statistic"), "n")


def cumulative_deviation(series: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """``(t, zs)`` to ``(t, cumdev)``: running sum of zs**2 - 1, in buckets of t whose totals are added."""
    d = series.select("t", F.floor(F.col("t") / bucket).alias("__b"), (F.col("zs") * F.col("zs") - 1).alias("__d"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offset = d.groupBy("__b").agg(F.sum("__d").alias("__s")).withColumn("__o", F.coalesce(F.sum("__s").over(before), F.lit(0.0))).drop("__s")
    inside = F.sum("__d").over(Window.partitionBy("__b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("__c", inside).join(offset, "__b").select("t", (F.col("__c") + F.col("__o")).alias("cumdev"))


def envelope(last: DataFrame, p: float = 0.05) -> DataFrame:
    """``(t)`` of steps 1..T to ``(t, bound)``: chi-square quantile less t."""
    return last.select("t", (chi2_ppf(F.lit(1 - p), F.col("t").cast("double")) - F.col("t")).alias("bound"))


def event_windows(z: DataFrame, events: DataFrame) -> DataFrame:
    """``(id, statistic, df)`` of netvar over each event's half-open [start_t, end_t).

    An interval join by buckets of steps: each event lists the buckets it
    touches, so it meets only their steps.
    """
    bucket = 256
    s = steps(z).select("t", "zs", F.floor(F.col("t") / bucket).alias("__b"))
    e = events.where("end_t > start_t").withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_t") / bucket), F.floor((F.col("end_t") - 1) / bucket))))
    hit = s.join(e, "__b").where("t >= start_t and t < end_t")
    return hit.groupBy("id").agg(F.sum(F.col("zs") * F.col("zs")).alias("statistic"), F.count("*").alias("df"))
