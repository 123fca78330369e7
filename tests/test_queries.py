"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from basalt.plans import analysis_queries  # noqa: E402,F401
from basalt.plans.queries import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    cell = lambda x: "null" if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert normal(got) == normal(duck.execute(SQL[name]).df())
    else:
        assert len(got)
