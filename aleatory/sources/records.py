"""Recorded sessions: JSON lines written by Spark's committing sinks, and read back with the place and the fault of every bad line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.protocols import record_lines


def write_session(trials: DataFrame, folder: str, bits: int) -> None:
    """``(source, t, sum)`` as lines in ``folder``, in order of t in each file. Files appear when the whole job is committed; a failed task leaves none."""
    dealt = trials.repartitionByRange("t", "source").sortWithinPartitions("t", "source")
    record_lines(dealt, bits).write.mode("append").text(folder)


def record_stream(trials: DataFrame, folder: str, bits: int, state: str, available_now: bool = False) -> StreamingQuery:
    """A stream of trials as lines in ``folder``, each once: a batch's files count once they are in the sink's log, whatever failed and ran again before."""
    out = record_lines(trials, bits).writeStream.format("text").option("path", folder).option("checkpointLocation", state).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value)``: lines and their numbers, from 1, in their files. Splits are numbered by themselves; their sizes, one row each, are summed up."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("i"))
    sizes = rows.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    inside = F.row_number().over(Window.partitionBy("file", "start").orderBy("i"))
    return rows.withColumn("r", inside).join(starts, ["file", "start"]).select("file", (F.col("o") + F.col("r")).cast("bigint").alias("line"), "value")


def _whole(c: Column) -> Column:
    """A JSON number without a fraction, as a number; null for anything else."""
    n = F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), c.try_cast("double"))
    return F.when(n == F.floor(n), n.cast("bigint"))


def read_session(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, t, source, sum, bitsPerTrial, error)``, one row per line that isn't blank.

    ``error`` is null for a good record, else the first fault: ``not JSON``, ``version``,
    ``timestamp``, ``source``, ``bitsPerTrial`` (a whole number from 8),
    ``sum`` (a whole number from 0 to bitsPerTrial), or ``changes
    bitsPerTrial``: not that of its source's first good record.
    """
    rows = numbered_lines(spark, path).where(F.trim(F.regexp_replace("value", r"\r", "")) != "")
    field = lambda name: F.get_json_object("value", f"$.{name}")
    is_text = F.try_parse_json("value")
    kind = lambda name: F.schema_of_variant(F.try_variant_get(is_text, f"$.{name}", "variant"))
    number = lambda name: kind(name).rlike("BIGINT|DECIMAL|DOUBLE")
    r = rows.select("file", "line", is_text.alias("whole"), *[field(c).alias(f"r_{c}") for c in ("v", "t", "source", "sum", "bitsPerTrial")], *[F.coalesce(number(c), F.lit(False)).alias(f"n_{c}") for c in ("v", "t", "sum", "bitsPerTrial")], F.coalesce(kind("source") == "STRING", F.lit(False)).alias("named"))
    bits, total = _whole(F.col("r_bitsPerTrial")), _whole(F.col("r_sum"))
    object_ = F.coalesce(F.schema_of_variant("whole").startswith("OBJECT"), F.lit(False))
    fault = (
        F.when(~object_, "not JSON")
        .when(~F.col("n_v") | F.coalesce(_whole(F.col("r_v")) != 1, F.lit(True)), "version")
        .when(~F.col("n_t"), "timestamp")
        .when(~F.col("named") | F.coalesce(F.length("r_source") == 0, F.lit(True)), "source")
        .when(~F.col("n_bitsPerTrial") | F.coalesce(bits < 8, F.lit(True)), "bitsPerTrial")
        .when(~F.col("n_sum") | F.coalesce((total < 0) | (total > bits), F.lit(True)), "sum")
    )
    good = r.select("file", "line", F.col("r_t").try_cast("double").alias("t"), F.col("r_source").alias("source"), total.alias("sum"), bits.alias("bitsPerTrial"), fault.alias("error"))
    first = good.where("error is null").groupBy("source").agg(F.min_by("bitsPerTrial", F.struct("file", "line")).alias("own"))
    joined = good.join(first, "source", "left")
    error = F.coalesce("error", F.when(F.col("bitsPerTrial") != F.col("own"), "changes bitsPerTrial"))
    return joined.select("file", "line", "t", "source", "sum", "bitsPerTrial", error.alias("error"))
