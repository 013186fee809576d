"""Session helpers: a shared checkpoint folder, and joins whose small side is broadcast only behind a size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of narrow columns may be broadcast (some 20 MB).
BROADCAST_ROWS = 200_000


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where it is unset, in tests on one machine, a folder of this machine."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="checkpoint-")


def ready(spark: SparkSession) -> None:
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; what follows survives lost executors without the work above."""
    ready(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS, items: str | None = None) -> DataFrame:
    """A broadcast hint where the frame (already cut) has at most ``rows`` rows; else as it is, for a shuffled join. Elements of the array column ``items`` count as rows."""
    if items is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    return F.broadcast(df) if (df.agg(F.sum(F.size(items) + 1)).first()[0] or 0) <= rows else df


def hash_unit(*cols, seed: str = "") -> "F.Column":
    """A uniform number in [0, 1) from 52 bits of the MD5 of the columns, the same in every run and engine."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("null")) for c in cols]
    h = F.md5(F.concat_ws("|", F.lit(seed), *parts))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def fold(col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def table(df: DataFrame, name: str) -> DataFrame:
    """Write Parquet to a new folder beside the checkpoints and read it back."""
    spark = df.sparkSession
    ready(spark)
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
