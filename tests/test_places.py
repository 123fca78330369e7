"""Queries on places of rows, where ranges are many and hold more rows than Spark samples: no row is lost or placed twice."""

import os

import duckdb
import pytest
from test_queries import QUERIES, SQL, normal

SF = "/root/testdata/sf0.01"
SETTINGS = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "4k"}
NAMES = ["kfold_stratified", "collate", "dynamic_batches", "leakage_report", "leakage_splits", "mix_oversample", "mix_proportional", "mix_round_robin", "sampler_subset", "series_aligned", "series_rolling", "shards_shuffled", "shards_streamed", "split_stratified"]
TABLES = {"customer": "c_custkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}
TIMES = 4


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """The tables repeated with shifted keys, as files and in DuckDB."""
    con, folder = duckdb.connect(), tmp_path_factory.mktemp("grown")
    con.execute("SET TimeZone='UTC'")
    for t, key in TABLES.items():
        own = f"read_parquet('{SF}/{t}.parquet')"
        con.execute(f"COPY (SELECT * EXCLUDE (r, m) REPLACE ({key} + r * m AS {key}) FROM {own}, range({TIMES}) t(r), (SELECT max({key}) + 1 AS m FROM {own})) TO '{folder}/{t}.parquet' (ROW_GROUP_SIZE 4096)")
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{folder}/{t}.parquet')")
    return con, str(folder)


@pytest.fixture
def ranges(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_places(spark, ranges, grown, name):
    con, folder = grown
    assert normal(QUERIES[name](spark, folder).toPandas()) == normal(con.execute(SQL[name]).df())
