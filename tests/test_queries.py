"""Every registered query of the reference's operators against DuckDB, on the smallest tables."""

import os

import pytest

from aleatory import plans

from .compare import connect, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name not in plans.SQL:
        assert len(got.columns)
        return
    want = connect(SF).execute(plans.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
