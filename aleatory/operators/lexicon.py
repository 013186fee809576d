"""Draws over a lexicon: words, words of a value, and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .draws import uniform_ints
from .letters import digit_root


def _numbered(rows: DataFrame, order: str) -> tuple[DataFrame, int]:
    """A lexicon's rows with their places; a lexicon is a parameter's size, counted once."""
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy(order)) - 1)
    return placed, rows.count()


def draw_words(data: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Chunks ``(source, off, bytes)`` and ``lexicon(word, ...)`` to ``(source, i, word, ...)``: each uniform draw takes a word, the lexicon being in order of its words.

    An empty lexicon is an error.
    """
    placed, n = _numbered(lexicon, "word")
    if not n:
        raise ValueError("empty_lexicon")
    return uniform_ints(data, n).join(F.broadcast(placed.withColumnRenamed("place", "v")), "v").drop("v")


def draw_by_value(data: DataFrame, lexicon: DataFrame, value: int) -> DataFrame:
    """The same among the words ``(word, value)`` of one value; without such a word there is no draw, and a single one takes no bytes: each source gives it once."""
    fitting = lexicon.where(F.col("value") == value)
    if fitting.isEmpty():
        return data.select("source", F.lit(0).cast("bigint").alias("i"), F.lit("").alias("word"), F.lit(value).cast("bigint").alias("value")).limit(0)
    return draw_words(data, fitting.select("word", F.col("value").cast("bigint").alias("value")))


def cast_words(data: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(source, i, word, value, root, matches)``: a drawn word of ``lexicon(word, value)``, and how many others have its value."""
    shared = lexicon.groupBy("value").agg((F.count("*") - 1).alias("matches"))
    return draw_words(data, lexicon.join(shared, "value").select("word", "value", digit_root(F.col("value")).alias("root"), "matches"))


def _casts(data: DataFrame, n: int) -> DataFrame:
    """Draws below n, as many as the bytes give. A draw below 1 takes no byte, so any number could be made: there is one for each byte."""
    if n == 1:
        return uniform_ints(data, 256).select("source", "i", F.lit(0).alias("v"))
    return uniform_ints(data, n)


def cast_values(data: DataFrame, lexicon: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """``(source, i, value, words, share)``: a value drawn from the distinct values in their order, or from low..high; how many words have it, and their share of the lexicon.

    Where there is one value only, each byte of the stream still gives a cast.
    """
    total = lexicon.count()
    counts = lexicon.groupBy("value").agg(F.count("*").alias("words"))
    if low is not None and high is not None:
        drawn = _casts(data, high - low + 1).select("source", "i", (F.col("v") + low).cast("bigint").alias("value"))
        out = drawn.join(F.broadcast(counts), "value", "left")  # a row per value of a lexicon
    else:
        placed, n = _numbered(counts, "value")
        out = _casts(data, n).join(F.broadcast(placed.withColumnRenamed("place", "v")), "v")
    words = F.coalesce("words", F.lit(0)).cast("bigint")
    return out.select("source", "i", F.col("value").cast("bigint").alias("value"), words.alias("words"), (words / total).alias("share"))
