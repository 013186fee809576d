"""The registered queries against DuckDB, on the smallest tables."""

import os

import pandas as pd
import pytest

from aleatory.llm import queries

from ..compare import connect, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    if name in queries.oracle_sql():
        want = connect(SF).execute(queries.oracle_sql()[name]).fetchdf()
        for c in want.columns:  # a column of whole numbers and nulls is of another type in each
            if pd.api.types.is_extension_array_dtype(want[c]):
                got[c] = got[c].astype(want[c].dtype)
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        table = {"op6": "pages"}.get(name.split("_")[0], "documents")
        many = connect(SF).execute(f"select count(*) from {table}").fetchone()[0]
        assert name.startswith("op2_") or len(got) == many
