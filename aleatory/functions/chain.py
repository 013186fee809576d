"""Where a sequential reader enters each block, without reading block after block.

Each block says, for every state in which a reader may enter it, in which state
it leaves; these tables are composed by a tree, so no task holds more than
``fan`` of them however many blocks a source has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

FAN = 1024


def entries(exits: DataFrame, start: int = 0, fan: int = FAN) -> DataFrame:
    """``(source, b, leave)`` to ``(source, b, enter)``: the state in which a reader that enters the first block in ``start`` enters each block. Blocks are numbered from 0 without gaps; ``leave`` is an array of states."""
    kind = dict(exits.dtypes)["source"]
    fan = max(fan, 2)
    exits = exits.select("source", "b", "leave")

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The table of a group of blocks."""
        at = None
        for to in pdf.sort_values("b")["leave"]:
            to = np.asarray(to, np.int64)
            at = to if at is None else to[at]
        return pd.DataFrame({"source": [key[0]], "b": [key[1]], "leave": [at]})

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """States on entering the blocks of a group, from that of the group."""
        pdf = pdf.sort_values("b")
        at, out = int(pdf["enter"].iloc[0]), []
        for to in pdf["leave"]:
            out.append(at)
            at = int(to[at])
        return pd.DataFrame({"source": pdf["source"], "b": pdf["b"], "enter": out})

    schema = f"source {kind}, b bigint, enter bigint"
    grouped = exits.withColumn("g", F.floor(F.col("b") / fan))
    if not (exits.agg(F.max("b")).first()[0] or 0) >= fan:
        return grouped.withColumn("enter", F.lit(start)).groupBy("source", "g").applyInPandas(walk, schema)
    groups = cut(grouped.groupBy("source", "g").applyInPandas(compose, f"source {kind}, b bigint, leave array<bigint>"))
    entered = entries(groups, start, fan).withColumnRenamed("b", "g")
    return grouped.join(entered, ["source", "g"]).groupBy("source", "g").applyInPandas(walk, schema)
