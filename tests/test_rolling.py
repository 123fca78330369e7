"""Rolling means: sums of whole runs and of what is left at both ends, to the last digit of the SQL."""

import math
import os

import duckdb
import pytest
from test_queries import QUERIES, SQL

from basalt.operators import labels

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_ties_fall_as_in_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM read_parquet('{SF}/events.parquet')")
    want = {r[0]: r[1:] for r in con.execute(SQL["series_rolling"]).fetchall()}
    got = {r["event_id"]: (r["rolling_mean"], r["rolling_max"]) for r in QUERIES["series_rolling"](spark, SF).collect()}
    assert len(got) == len(want) and {k: (got[k], want[k]) for k in want if got.get(k) != want[k]} == {}


@pytest.mark.parametrize("n", [1, 5, 15, 16, 17, 31, 32, 33, 100])
def test_any_width(spark, n):
    v = [None if i % 13 == 5 or 40 <= i < 75 else i * 7 % 11 / 4 for i in range(250)]
    df = spark.createDataFrame(list(enumerate(v)), "id long, v double")
    seen = [[x for x in v[max(0, i - n + 1) : i + 1] if x is not None] for i in range(250)]
    want = [(i, math.fsum(x) / len(x) if x else None, max(x) if x else None) for i, x in enumerate(seen)]
    got = [(r["id"], r["rolling_mean"], r["rolling_max"]) for r in labels.rolling(df, ["id"], "v", n).orderBy("id").collect()]
    assert got == want
