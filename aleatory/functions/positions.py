"""Dense positions within groups without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16


def positions(df: DataFrame, group: list[str], order: str, out: str = "t", bucket: int = BUCKET) -> DataFrame:
    """Add ``out`` = 0, 1, ... within each group by the integer column ``order`` (unique in a group).

    Rows are numbered inside buckets of ``order``; the buckets' sizes, one row
    per group and bucket, are summed up and joined, so that a group that holds
    most rows is still numbered by many tasks.
    """
    cut = df.withColumn("__b", F.floor(F.col(order) / bucket))
    inside = Window.partitionBy(*group, "__b").orderBy(order)
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    offsets = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    numbered = cut.withColumn("__r", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [*group, "__b"]).withColumn(out, (F.col("__r") + F.col("__o")).cast("bigint")).drop("__b", "__r", "__o")


def offsets(df: DataFrame, group: list[str], order: str, count: str, out: str, bucket: int = BUCKET) -> DataFrame:
    """Add ``out`` = the sum of ``count`` over the rows before, within each group by ``order``; dealt as in ``positions``."""
    cut = df.withColumn("__b", F.floor(F.col(order) / bucket))
    inside = Window.partitionBy(*group, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*group, "__b").agg(F.sum(count).alias("__n"))
    starts = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    summed = cut.withColumn("__r", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return summed.join(starts, [*group, "__b"]).withColumn(out, (F.col("__r") + F.col("__o")).cast("bigint")).drop("__b", "__r", "__o")


def ranked(df: DataFrame, group: list[str], order: str, tie: str, out: str = "r", buckets: int = 128, bucket: int = BUCKET) -> DataFrame:
    """Add ``out`` = 0, 1, ... within each group by a number ``order``, then ``tie`` (unique among equal ones), and ``n``, the group's size.

    Rows of a group over BUCKET rows are numbered inside buckets between its
    approximate quantiles; the buckets' sizes, one row each, are summed up and
    joined. So a group that holds most rows is numbered by many tasks (rows of
    one very common value share a bucket).
    """
    bounds = df.groupBy(*group).agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)]).alias("__q"), F.count("*").alias("n"))
    place = F.size(F.filter("__q", lambda q: q < F.col(order)))
    dealt = df.join(bounds, group).withColumn("__b", F.when(F.col("n") > bucket, place).otherwise(0)).drop("__q")
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    starts = sizes.select(*group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    numbered = dealt.withColumn("__r", F.row_number().over(Window.partitionBy(*group, "__b").orderBy(order, tie)) - 1)
    return numbered.join(starts, [*group, "__b"]).withColumn(out, (F.col("__r") + F.col("__o")).cast("bigint")).drop("__b", "__r", "__o")


def haloed(df: DataFrame, keys: list[str], order: str, reach: int, bucket: int = BUCKET) -> DataFrame:
    """Add ``__b`` and ``__own``: each row in its range bucket of the integer ``order`` and, where later rows reach back over the border, in the next one too (there ``__own`` is false).

    A window over (keys, ``__b``) by ``order`` then sees, for every own row,
    the ``reach`` places before it, whatever the length of the series: one
    shuffle, and a series is dealt to as many tasks as it has buckets.
    """
    size = max(bucket, reach)  # so that no row is needed by more than two buckets
    b = F.floor(F.col(order) / size)
    to = F.when(F.col(order) % size >= size - reach, F.array(b, b + 1)).otherwise(F.array(b))
    return df.withColumn("__b", F.explode(to)).withColumn("__own", F.floor(F.col(order) / size) == F.col("__b"))
