"""The folder that the driver and all executors share, and cuts of lineage in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of narrow columns may be broadcast (some 20 MB).
BROADCAST_ROWS = 200_000


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only on one machine, if none is named, a folder of it."""
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
    """Materialise in the shared folder: loops don't repeat the work above, and what follows survives lost executors."""
    ready(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint where the frame (already cut) has few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


class Kept:
    """A frame written to the shared folder, by the values of an integer column ``by`` if one is named; parts that nothing reads any more can be dropped, which those of checkpoints can't."""

    def __init__(self, df: DataFrame, by: str | None = None):
        self.spark, self.by = df.sparkSession, by
        ready(self.spark)
        self.schema = df.drop(by).schema if by else df.schema
        self.path = f"{folder(self.spark)}/kept-{uuid.uuid4().hex}"
        # Readers hold up to 4096 rows of a row group, of which long binaries would fill the heap: groups of some 4 MB.
        write = df.write.option("parquet.block.size", 1 << 22).option("parquet.page.size.row.check.min", 1)
        (write.partitionBy(by) if by else write).parquet(self.path)

    def _path(self, part: int | None) -> str:
        return self.path if part is None else f"{self.path}/{self.by}={part}"

    def read(self, part: int | None = None) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._path(part))

    def drop(self, part: int | None = None) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(part))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
