"""From raw documents to a training mix: five stages, each an operator of ``aleatory.llm``.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps or
changes, in their own columns; the last one repeats documents by its mix and
adds ``copy``. Between stages the rows are written as Parquet and read again.
Null texts and ids, repeated rows and empty tables have the results that the
operators state; a stage never drops a row for one of these reasons alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aleatory.llm._spark import table
from aleatory.llm.decontam import drop_contaminated
from aleatory.llm.mixing import emit_mix
from aleatory.llm.neardup import keep_one
from aleatory.llm.pii import mask_personal_data
from aleatory.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts 1."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at 0.8 on five-word shingles, the one of the smallest id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return mask_personal_data(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, copies numbered."""
    return emit_mix(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: SQL can't express the classifier; tests compare run() with a brute-force version of the other stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs, name)
    return docs
