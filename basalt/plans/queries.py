"""Registered queries over the test tables: the plan algebra, profiles, preparation, splits and mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import sql_hash
from ..operators import mixing, prep, profile, splits
from ..session import ship
from ..sources import files
from .plan import Agg, Aggregate, And, Distinct, Filter, Limit, Not, Or, Project, Sample, Sort, compile_plan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan(name: str, source: str, operations: list, sql: str, columns: dict | None = None) -> None:
    """A plan over one table; columns: derived columns that come first."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, source)
        return compile_plan(operations, df.withColumns({k: F.expr(v) for k, v in columns.items()}) if columns else df)

    add(name, query, sql)


# --- filters; `seg` and `bal` hold NULLs -----------------------------------------------------------------------------
_NULLS = {"seg": "nullif(c_mktsegment, 'BUILDING')", "bal": "case when c_acctbal < 0 then null else c_acctbal end", "nat": "nullif(c_nationkey, 3)"}
_C = "(SELECT *, nullif(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal, nullif(c_nationkey, 3) AS nat FROM customer)"
for _name, _filter, _where in (
    ("eq_string", Filter("seg", "Eq", "MACHINERY"), "seg = 'MACHINERY'"),
    ("neq_string", Filter("seg", "Neq", "MACHINERY"), "seg IS DISTINCT FROM 'MACHINERY'"),
    ("contains", Filter("seg", "Contains", "HOLD"), "contains(seg, 'HOLD')"),
    ("starts_with", Filter("seg", "StartsWith", "AUTO"), "starts_with(seg, 'AUTO')"),
    ("ends_with", Filter("seg", "EndsWith", "E"), "ends_with(seg, 'E')"),
    ("in_list", Filter("seg", "In", '["MACHINERY","FURNITURE"]'), "seg IN ('MACHINERY', 'FURNITURE')"),
    ("not_in_list", Filter("seg", "NotIn", '["MACHINERY","FURNITURE"]'), "seg IS NULL OR seg NOT IN ('MACHINERY', 'FURNITURE')"),
    ("regex", Filter("seg", "Regex", "^(AUTO|FURN)"), "regexp_matches(seg, '^(AUTO|FURN)')"),
    ("int_eq", Filter("nat", "Eq", 5), "nat = 5"),
    ("int_neq", Filter("nat", "Neq", 5), "nat IS DISTINCT FROM 5"),
    ("int_gt", Filter("nat", "Gt", 12), "nat > 12"),
    ("int_gte", Filter("nat", "Gte", 12), "nat >= 12"),
    ("int_lt", Filter("nat", "Lt", 4), "nat < 4"),
    ("int_lte", Filter("nat", "Lte", 4), "nat <= 4"),
    ("int_in", Filter("nat", "In", [1, 3, 5]), "nat IN (1, 3, 5)"),
    ("float_gt", Filter("bal", "Gt", 5000.5), "bal > 5000.5"),
    ("float_lte", Filter("bal", "Lte", 5000.5), "bal <= 5000.5"),
    ("float_between", Filter("bal", "Between", (100, 2000)), "bal BETWEEN 100 AND 2000"),
    ("is_null", Filter("bal", "IsNull"), "bal IS NULL"),
    ("is_not_null", Filter("bal", "IsNotNull"), "bal IS NOT NULL"),
    ("and", And((Filter("seg", "Neq", "MACHINERY"), Filter("bal", "Gt", 0))), "seg IS DISTINCT FROM 'MACHINERY' AND bal > 0"),
    ("or", Or((Filter("seg", "Eq", "MACHINERY"), Filter("bal", "Gt", 9000))), "coalesce(seg = 'MACHINERY', false) OR coalesce(bal > 9000, false)"),
    ("not", Not(Filter("bal", "Gt", 1000)), "NOT coalesce(bal > 1000, false)"),
    ("nested", And((Or((Filter("nat", "Lt", 3), Filter("nat", "Gt", 20))), Not(Filter("seg", "In", ["MACHINERY"])))), "coalesce(nat < 3 OR nat > 20, false) AND NOT coalesce(seg IN ('MACHINERY'), false)"),
):
    plan(f"filter_{_name}", "customer", [_filter, Project(("c_custkey", "seg", "bal"))], f"SELECT c_custkey, seg, bal FROM {_C} WHERE {_where}", _NULLS)

plan("filter_float_eq", "lineitem", [Filter("l_discount", "Eq", 0.05), Project(("l_orderkey", "l_linenumber", "l_discount"))], "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE abs(l_discount - 0.05::double) < 1e-10")
plan("filter_timestamp", "orders", [Filter("o_orderdate", "Gte", "2000-01-01 00:00:00"), Project(("o_orderkey",))], "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
plan("plan_project", "nation", [Project(("n_name", "n_regionkey"))], "SELECT n_name, n_regionkey FROM nation")
plan("plan_sort_asc", "nation", [Sort("n_name"), Limit(10)], "SELECT * FROM nation ORDER BY n_name LIMIT 10")
plan("plan_sort_desc", "orders", [Sort("o_orderkey", False), Limit(50)], "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 50")
plan("plan_limit_offset", "orders", [Sort("o_orderkey"), Limit(25, 100), Project(("o_orderkey", "o_totalprice"))], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100")
plan("plan_distinct", "lineitem", [Project(("l_returnflag", "l_linestatus")), Distinct()], "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
plan("plan_distinct_columns", "orders", [Distinct(("o_custkey",), ("o_orderkey",)), Project(("o_custkey", "o_orderkey"))], "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
plan("plan_sample", "orders", [Sample(0.1, ("o_orderkey",)), Project(("o_orderkey",))], f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {sql_hash(42, 'o_orderkey')}, o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= ceil(n * 0.1::double)")
_AGGS = [Agg(f, "bal", f"bal_{f}") for f in ("count", "sum", "mean", "min", "max", "std_dev", "distinct_count")]
_ALL = "coalesce(round(sum(bal), 4), 0) AS bal_sum, coalesce(round(avg(bal), 6), 0) AS bal_mean, coalesce(min(bal), 0) AS bal_min, coalesce(max(bal), 0) AS bal_max, coalesce(round(stddev_samp(bal), 6), 0) AS bal_std_dev"


def _rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, p) for c, p in places.items()})


_PLACES = {"bal_sum": 4, "bal_mean": 6, "bal_std_dev": 6}
add("agg_global", lambda s, d: _rounded(compile_plan([Aggregate(_AGGS)], table(s, d, "customer").withColumns({k: F.expr(v) for k, v in _NULLS.items()})), _PLACES), f"SELECT count(bal)::double AS bal_count, {_ALL}, count(DISTINCT bal)::double AS bal_distinct_count FROM {_C}")
add("agg_grouped", lambda s, d: _rounded(compile_plan([Aggregate(_AGGS, ("seg",))], table(s, d, "customer").withColumns({k: F.expr(v) for k, v in _NULLS.items()})), _PLACES), f"SELECT seg, count(*)::double AS bal_count, {_ALL}, (count(DISTINCT bal) + max(CASE WHEN bal IS NULL THEN 1 ELSE 0 END))::double AS bal_distinct_count FROM {_C} GROUP BY seg")
plan("agg_empty", "customer", [Filter("c_custkey", "Lt", 0), Aggregate([Agg("sum", "c_acctbal"), Agg("count", "c_acctbal")])], "SELECT 0.0::double AS sum_c_acctbal, 0.0::double AS count_c_acctbal")
_FLAG = [Filter("l_quantity", "Gte", 10), Aggregate([Agg("count", "l_orderkey", "n"), Agg("sum", "l_extendedprice", "s"), Agg("mean", "l_quantity", "m"), Agg("std_dev", "l_discount", "sd"), Agg("min", "l_tax", "mn"), Agg("max", "l_tax", "mx")], ("l_returnflag", "l_linestatus"))]
add("plan_filter_sort_limit", lambda s, d: _rounded(compile_plan([*_FLAG, Sort("l_returnflag"), Limit(100)], table(s, d, "lineitem")), {"s": 2, "m": 6, "sd": 6}), "SELECT l_returnflag, l_linestatus, count(*)::double AS n, round(sum(l_extendedprice), 2) AS s, round(avg(l_quantity), 6) AS m, round(stddev_samp(l_discount), 6) AS sd, min(l_tax) AS mn, max(l_tax) AS mx FROM lineitem WHERE l_quantity >= 10 GROUP BY ALL")

# --- profiles --------------------------------------------------------------------------------------------------------
_PROFILED = {"o_custkey": True, "o_totalprice": True, "o_orderstatus": False, "o_orderpriority": False}
add("column_profiles", lambda s, d: _rounded(profile.column_profiles(table(s, d, "orders"), list(_PROFILED)), {"mean": 4, "std": 4, "median": 4}), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS total, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", " + (f"min({c})::double AS min, max({c})::double AS max, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, round(quantile_cont({c}::double, 0.5), 4) AS median" if n else "NULL::double AS min, NULL::double AS max, NULL::double AS mean, NULL::double AS std, NULL::double AS median") + " FROM orders" for c, n in _PROFILED.items()))
add("column_stats", lambda s, d: _rounded(profile.column_stats(table(s, d, "lineitem"), "l_extendedprice"), {"mean": 6, "q25": 6, "median": 6, "q75": 6}), 'SELECT count(*) AS total, 0::bigint AS nulls, count(DISTINCT l_extendedprice) AS "distinct", min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 6) AS mean, ' + ", ".join(f"round(list_sort(list(l_extendedprice))[count(*) * {q} // 4 + 1], 6) AS {n}" for q, n in ((1, "q25"), (2, "median"), (3, "q75"))) + " FROM lineitem")
add("histogram", lambda s, d: profile.histogram(table(s, d, "lineitem"), "l_quantity", 20).select("bin", "n"), "SELECT least(floor((l_quantity - lo) / ((hi - lo) / 20)), 19)::int AS bin, count(*) AS n FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) GROUP BY 1")
add("top_values", lambda s, d: profile.top_values(table(s, d, "part"), "p_brand", 10), "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")


def _strings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_acctbal").cast("string").alias("balance"), F.lower((F.col("c_acctbal") > 0).cast("string")).alias("owes"), F.col("c_mktsegment").alias("segment"))


_TYPES = "SELECT * FROM (VALUES ('key', 'integer'), ('balance', 'float'), ('owes', 'boolean'), ('segment', '{}')) AS v(\"column\", type)"
add("strict_types", lambda s, d: profile.strict_types(_strings(s, d)), _TYPES.format("string"))
add("majority_types", lambda s, d: profile.majority_types(_strings(s, d)), _TYPES.format("categorical"))

# --- preparation -----------------------------------------------------------------------------------------------------
add("prep_normalize", lambda s, d: _rounded(prep.normalize(table(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), {"c_acctbal": 6}), "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS c_acctbal FROM customer")
add("prep_standardize", lambda s, d: _rounded(prep.standardize(table(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), {"c_acctbal": 6}), "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
for _how, _stat in (("mean", "(SELECT avg(bal) FROM c)"), ("median", "(SELECT quantile_cont(bal, 0.5) FROM c)"), ("zero", "0.0"), ("min", "(SELECT min(bal) FROM c)"), ("max", "(SELECT max(bal) FROM c)")):
    add(f"prep_fill_{_how}", lambda s, d, how=_how: _rounded(prep.fill_missing(table(s, d, "customer").select("c_custkey", F.expr(_NULLS["bal"]).alias("bal")), ["bal"], how), {"bal": 6}), f"WITH c AS (SELECT c_custkey, bal FROM {_C}) SELECT c_custkey, round(coalesce(bal, {_stat}), 6) AS bal FROM c")
add("prep_fill_mode", lambda s, d: prep.fill_missing(table(s, d, "customer").select("c_custkey", F.expr(_NULLS["seg"]).alias("seg")), ["seg"], "mode"), f"WITH c AS (SELECT c_custkey, seg FROM {_C}) SELECT c_custkey, coalesce(seg, (SELECT seg FROM c WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1)) AS seg FROM c")
add("prep_drop_missing", lambda s, d: prep.drop_missing(table(s, d, "customer").select("c_custkey", *(F.expr(v).alias(k) for k, v in _NULLS.items()))), f"SELECT c_custkey, seg, bal, nat FROM {_C} WHERE seg IS NOT NULL AND bal IS NOT NULL AND nat IS NOT NULL")
add("prep_one_hot", lambda s, d: prep.one_hot(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"]), "SELECT o_orderkey, (o_orderstatus = 'F')::int AS \"o_orderstatus_F\", (o_orderstatus = 'O')::int AS \"o_orderstatus_O\", (o_orderstatus = 'P')::int AS \"o_orderstatus_P\" FROM orders")
add("prep_label_encode", lambda s, d: prep.label_encode(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority"), "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders")
add("prep_tokenize", lambda s, d: prep.tokenize_column(table(s, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "p_name_tokenized"), r"""
WITH w AS (SELECT p_partkey, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(lower(p_name), '\s+'), lambda x: regexp_replace(x, '[^\p{L}\p{N}_-]', '', 'g')), lambda x: x <> '') AS w FROM part)),
v AS (SELECT word, row_number() OVER (ORDER BY f) + 1 AS id FROM (SELECT word, min((p_partkey, pos)) AS f FROM w GROUP BY word))
SELECT p_partkey, string_agg(id::varchar, ',' ORDER BY pos) AS p_name_tokenized FROM w JOIN v USING (word) GROUP BY p_partkey""")
add("prep_pad", lambda s, d: table(s, d, "orders").select("o_orderkey", prep.pad_sequence(F.concat_ws(",", "o_orderkey", "o_custkey"), 4).alias("padded")), "SELECT o_orderkey, o_orderkey || ',' || o_custkey || ',0,0' AS padded FROM orders")

# --- splits, folds, samplers, shards ---------------------------------------------------------------------------------
_RANK = f"row_number() OVER (ORDER BY {sql_hash(42, 'o_orderkey')}, o_orderkey) - 1"
_CUT = "CASE WHEN r < floor(n * 0.6::double) THEN 'train' WHEN r < floor(n * 0.6::double) + floor(n * 0.2::double) THEN 'val' ELSE 'test' END AS split"
add("split_random", lambda s, d: splits.random_split(table(s, d, "orders").select("o_orderkey"), "o_orderkey"), f"SELECT o_orderkey, {_CUT} FROM (SELECT o_orderkey, {_RANK} AS r, count(*) OVER () AS n FROM orders)")
add("split_temporal", lambda s, d: splits.temporal_split(table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "split"), f"SELECT o_orderkey, {_CUT} FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)")
add("split_stratified", lambda s, d: splits.stratified_split(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus"), f"SELECT o_orderkey, o_orderstatus, {_CUT} FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_hash(42, 'o_orderkey')}, o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)")
add("split_group", lambda s, d: splits.group_split(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey"), f"SELECT o_orderkey, o_custkey, split FROM orders JOIN (SELECT o_custkey, {_CUT} FROM (SELECT o_custkey, row_number() OVER (ORDER BY {sql_hash(42, 'o_custkey')}, o_custkey) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))) USING (o_custkey)")
add("kfold", lambda s, d: splits.kfold(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 7), f"SELECT o_orderkey, (ntile(7) OVER (ORDER BY {sql_hash(42, 'o_orderkey')}, o_orderkey) - 1)::int AS fold FROM orders")
add("kfold_last", lambda s, d: splits.kfold(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 7, remainder="last"), f"SELECT o_orderkey, least(r // (n // 7), 6)::int AS fold FROM (SELECT o_orderkey, {_RANK} AS r, count(*) OVER () AS n FROM orders)")
add("kfold_stratified", lambda s, d: splits.stratified_kfold(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus"), f"SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_hash(42, 'o_orderkey')}, o_orderkey) - 1) % 5)::int AS fold FROM orders")
add("kfold_group", lambda s, d: splits.group_kfold(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey"), f"SELECT o_orderkey, o_custkey, fold FROM orders JOIN (SELECT o_custkey, least(r // greatest(n // 5, 1), 4)::int AS fold FROM (SELECT o_custkey, row_number() OVER (ORDER BY {sql_hash(42, 'o_custkey')}, o_custkey) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))) USING (o_custkey)")
add("kfold_summary", lambda s, d: splits.fold_summary(splits.kfold(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 7)), "SELECT count(*) AS folds, avg(n) AS mean, var_pop(n) AS variance, (max(n) - min(n)) / avg(n) < 0.1 AS balanced FROM (SELECT count(*) AS n FROM (SELECT ntile(7) OVER (ORDER BY o_orderkey) AS f FROM orders) GROUP BY f)")
_RI = "row_number() OVER (ORDER BY o_orderkey) - 1"
add("sampler_distributed", lambda s, d: splits.distributed_sample(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 7), "SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::int AS replica FROM orders")
add("sampler_drop_last", lambda s, d: splits.distributed_sample(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 7, True), f"SELECT o_orderkey, (r // (n // 7))::int AS replica FROM (SELECT o_orderkey, {_RI} AS r, count(*) OVER () AS n FROM orders) WHERE r < n // 7 * 7")
add("sampler_weighted", lambda s, d: splits.weighted_sample(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 100), f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 ORDER BY -ln(greatest({sql_hash(42, 'o_orderkey')} / 1152921504606846976.0::double, 1e-18)) / o_totalprice, o_orderkey LIMIT 100")
add("sampler_draws", lambda s, d: splits.weighted_draws(table(s, d, "nation"), "n_nationkey", "n_regionkey", 200), f"WITH w AS (SELECT n_nationkey, sum(n_regionkey) OVER (ORDER BY n_nationkey) AS hi, n_regionkey AS w FROM nation), u AS (SELECT i AS draw, {sql_hash(42, 'i')} / 1152921504606846976.0::double * (SELECT sum(n_regionkey) FROM nation) AS u FROM range(200) t(i)) SELECT draw, n_nationkey FROM u JOIN w ON u >= hi - w AND u < hi")
add("batches", lambda s, d: splits.batches(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 32), f"SELECT o_orderkey, ({_RI}) // 32 AS batch FROM orders")
add("batches_drop_last", lambda s, d: splits.batches(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 32, True), f"SELECT o_orderkey, r // 32 AS batch FROM (SELECT o_orderkey, {_RI} AS r, count(*) OVER () AS n FROM orders) WHERE r // 32 < n // 32")
add("shards_interleaved", lambda s, d: splits.shards(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 6, "interleaved"), f"SELECT o_orderkey, (({_RI}) % 6)::int AS shard FROM orders")
add("shards_hashed", lambda s, d: splits.shards(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 6, "hashed"), f"SELECT o_orderkey, ({sql_hash('shard', 'o_orderkey')} % 6)::int AS shard FROM orders")
add("shards_shuffled", lambda s, d: splits.shuffled_shards(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], "o_orderkey", 4, 3), f"SELECT o_orderkey, shard, row_number() OVER (PARTITION BY shard ORDER BY {sql_hash(45, 'o_orderkey')}, o_orderkey) - 1 AS place FROM (SELECT o_orderkey, (ntile(4) OVER (ORDER BY o_orderkey) - 1)::int AS shard FROM orders)")
add("shard_of_index", lambda s, d: splits.shard_of(table(s, d, "nation").select(F.col("n_nationkey").alias("shard_id"), (F.col("n_regionkey") + 1).alias("num_samples")), s.range(60).withColumnRenamed("id", "index")), "WITH m AS (SELECT n_nationkey AS shard_id, sum(n_regionkey + 1) OVER (ORDER BY n_nationkey) AS hi, n_regionkey + 1 AS n FROM nation) SELECT i AS index, shard_id, (i - (hi - n))::bigint AS local FROM range(60) t(i) JOIN m ON i >= hi - n AND i < hi")
add("dynamic_batches", lambda s, d: splits.dynamic_batches(table(s, d, "documents").select("doc_id", F.col("n_chars").alias("n")), "doc_id", "n", (500, 1000, 2000, 4000), 40000), "SELECT doc_id, n, bucket, (row_number() OVER (PARTITION BY bucket ORDER BY n, doc_id) - 1) // greatest(floor(40000 / bucket * 1.25), 1)::bigint AS batch FROM (SELECT doc_id, n_chars AS n, CASE WHEN n_chars <= 500 THEN 500 WHEN n_chars <= 1000 THEN 1000 WHEN n_chars <= 2000 THEN 2000 ELSE 4000 END AS bucket FROM documents)")
add("collate", lambda s, d: splits.collate(splits.batches(table(s, d, "orders").select("o_orderkey", F.sequence(F.lit(1), (F.col("o_orderkey") % 11 + 1).cast("int")).alias("ids")), ["o_orderkey"], 8), "batch", "ids").select("o_orderkey", F.size("ids").alias("n"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("own")), f"SELECT o_orderkey, (ceil(max(k) OVER (PARTITION BY b) / 8.0) * 8)::int AS n, k AS own FROM (SELECT o_orderkey, (o_orderkey % 11 + 1)::int AS k, ({_RI}) // 8 AS b FROM orders)")
add("page", lambda s, d: files.page(table(s, d, "orders"), ["o_orderkey"], 200, 20), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 200")
add("chunks", lambda s, d: files.chunks(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 1000), f"SELECT c AS chunk_index, min(r) AS start_row, max(r) + 1 AS end_row, count(*) AS rows, c = max(c) OVER () AS is_last FROM (SELECT r // 1000 AS c, r FROM (SELECT {_RI} AS r FROM orders)) GROUP BY c")
add("rows_at", lambda s, d: files.rows_at(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], [5, 17, 900, 10**9]), f"SELECT r AS row_index, o_orderkey FROM (SELECT o_orderkey, {_RI} AS r FROM orders) WHERE r IN (5, 17, 900)")
add("search_cells", lambda s, d: files.search(table(s, d, "nation"), "AN"), "SELECT * FROM nation WHERE contains(lower(n_name), 'an') OR contains(n_nationkey::varchar, 'an')")
add("sync_plan", lambda s, d: files.sync_plan(table(s, d, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size")), table(s, d, "part").filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 10 == 1, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"))), "SELECT p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN 'upload' WHEN p_partkey % 3 = 0 THEN 'download' WHEN p_partkey % 10 = 1 THEN 'conflict' ELSE 'unchanged' END AS action FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 4 <> 0")
add("format_of_url", lambda s, d: table(s, d, "pages").select("page_id", files.format_of(F.concat("url", F.element_at(F.array(*map(F.lit, (".csv", ".JSONL", ".png", ".txt", ".zzz"))), (F.col("page_id") % 5 + 1).cast("int")))).alias("format")), "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'image' WHEN 3 THEN 'text' END AS format FROM pages")
add("human_size", lambda s, d: table(s, d, "orders").select("o_orderkey", files.human_size((F.col("o_orderkey") * F.col("o_orderkey")).cast("long")).alias("size")), "SELECT o_orderkey, CASE WHEN k < 1024 THEN k || ' B' WHEN k < 1048576 THEN printf('%.2f KB', k / 1024.0::double) WHEN k < 1073741824 THEN printf('%.2f MB', k / 1048576.0::double) ELSE printf('%.2f GB', k / 1073741824.0::double) END AS size FROM (SELECT o_orderkey, o_orderkey * o_orderkey AS k FROM orders)")

# --- mixing ----------------------------------------------------------------------------------------------------------
_MIX = {"en": 0.5, "de": 0.3, "fr": 0.2}


def _by_lang(s: SparkSession, d: str) -> DataFrame:
    return splits.hash_rank(table(s, d, "documents").filter(F.col("lang").isin(list(_MIX))).select("doc_id", F.col("lang").alias("dataset")), "doc_id", "42", "row_index", ["dataset"])


_LANG = f"(SELECT doc_id, lang AS dataset, row_number() OVER (PARTITION BY lang ORDER BY {sql_hash(42, 'doc_id')}, doc_id) - 1 AS row_index, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS d FROM documents WHERE lang IN ('en', 'de', 'fr'))"
add("mix_round_robin", lambda s, d: mixing.round_robin(_by_lang(s, d), _MIX, 150).select("doc_id", "dataset", "position"), f"SELECT doc_id, dataset, position FROM (SELECT *, row_number() OVER (ORDER BY row_index, d) - 1 AS position FROM {_LANG} WHERE row_index < CASE d WHEN 0 THEN 75 WHEN 1 THEN 45 ELSE 30 END) WHERE position < 150")
add("mix_proportional", lambda s, d: mixing.proportional(_by_lang(s, d), _MIX, 150).select("doc_id", "dataset", "position"), f"SELECT doc_id, dataset, position FROM (SELECT *, row_number() OVER (ORDER BY row_index // CASE d WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 2 END, d, row_index) - 1 AS position FROM {_LANG}) WHERE position < 150")
add("mix_contribution", lambda s, d: _rounded(mixing.contribution(_by_lang(s, d), _MIX), {"actual": 6, "match": 6}), f"SELECT dataset, n, round(n / t, 6) AS actual, w AS target, round(1 - abs(n / t - w), 6) AS match FROM (SELECT dataset, count(*) AS n, sum(count(*)) OVER ()::double AS t, CASE dataset WHEN 'en' THEN 0.5::double WHEN 'de' THEN 0.3::double ELSE 0.2::double END AS w FROM {_LANG} GROUP BY dataset)")


def _oversampled(s: SparkSession, d: str) -> DataFrame:
    """All documents, with targets at fixed ratios to each dataset's size."""
    rows = _by_lang(s, d)
    n = dict.fromkeys(_MIX, 0) | {r["dataset"]: r["count"] for r in rows.groupBy("dataset").count().collect()}
    return mixing.oversample(rows, n, {"en": n["en"] * 20 // 7, "de": n["de"], "fr": n["fr"] * 3 // 7}).select("doc_id", "dataset", "copy")


add("mix_oversample", _oversampled, f"SELECT doc_id, dataset, c::int AS copy FROM (SELECT *, count(*) OVER (PARTITION BY dataset) AS n FROM {_LANG}), range(3) t(c) WHERE row_index + n * c < CASE dataset WHEN 'en' THEN n * 20 // 7 WHEN 'de' THEN n ELSE n * 3 // 7 END")
_STEP = f"{sql_hash(42, 'step')} / 1152921504606846976.0::double"
_PICK = "CASE WHEN u < 0.5::double THEN 'en' WHEN u < 0.5::double + 0.3::double THEN 'de' ELSE 'fr' END"
add("recipe_interleaved", lambda s, d: mixing.steps(s, mixing.Recipe(_MIX, "interleaved", run=5), 500), "SELECT i AS step, (['en', 'de', 'fr'])[i // 5 % 3 + 1] AS dataset FROM range(500) t(i)")
add("recipe_sequential", lambda s, d: mixing.steps(s, mixing.Recipe(_MIX, "sequential"), 500), "SELECT i AS step, (['en', 'de', 'fr'])[i % 3 + 1] AS dataset FROM range(500) t(i)")
add("recipe_proportional", lambda s, d: mixing.steps(s, mixing.Recipe(_MIX), 500), f"SELECT step, {_PICK} AS dataset FROM (SELECT step, {_STEP} AS u FROM range(500) t(step))")
add("recipe_weighted", lambda s, d: mixing.steps(s, mixing.Recipe(_MIX, "weighted", temperature=0.5), 500), f"SELECT step, CASE WHEN u < exp(1.0) / z THEN 'en' WHEN u < (exp(1.0) + exp(0.6)) / z THEN 'de' ELSE 'fr' END AS dataset FROM (SELECT step, {_STEP} AS u, exp(1.0) + exp(0.6) + exp(0.4) AS z FROM range(500) t(step))")
add("recipe_staged", lambda s, d: mixing.steps(s, mixing.Recipe(_MIX, "staged", stages=(("easy", 0, 100, {"en": 1.0}), ("hard", 100, 300, {"de": 1.0, "fr": 1.0}))), 400), f"SELECT step, CASE WHEN step < 100 THEN 'en' WHEN step < 300 THEN CASE WHEN u < 0.5 THEN 'de' ELSE 'fr' END END AS dataset FROM (SELECT step, {_STEP} AS u FROM range(400) t(step))")
for _p, _f in (("linear", "p"), ("exponential", "(pow(10.0, p) - 1) / 9.0"), ("cosine", "0.5 * (1 - cos(p * pi()))"), ("step", "1 - pow(0.9, floor((i - 100) / 100))")):
    add(f"pacing_{_p}", lambda s, d, p=_p: s.range(1200).select(F.col("id").alias("step"), F.round(mixing.difficulty(F.col("id"), 1100, 100, 0.1, 0.9, p), 6).alias("difficulty")), f"SELECT i AS step, round(CASE WHEN i < 100 THEN 0.1::double ELSE 0.1::double + 0.8::double * ({_f}) END, 6) AS difficulty FROM (SELECT i, least((i - 100) / 1000.0::double, 1.0) AS p FROM range(1200) t(i))")
for _p, _f in (("linear", "p"), ("cosine", "0.5 * (1 - cos(p * pi()))"), ("exponential", "1 - exp(-5.0 * p)")):
    add(f"ratio_{_p}", lambda s, d, p=_p: s.range(1100).select(F.col("id").alias("step"), F.round(mixing.ratio(F.col("id"), 0.7, 0.5, 1000, p), 6).alias("ratio")), f"SELECT i AS step, round(CASE WHEN i >= 1000 THEN 0.5::double ELSE 0.7::double + (0.5::double - 0.7::double) * ({_f}) END, 6) AS ratio FROM (SELECT i, i / 1000.0::double AS p FROM range(1100) t(i))")
add("learning_rate", lambda s, d: s.range(100).select(F.col("id").alias("epoch"), F.round(mixing.learning_rate(F.col("id"), 0.1, "cosine", 100), 8).alias("rate")), "SELECT i AS epoch, round(0.1::double * 0.5 * (1 + cos(i / 100.0::double * pi())), 8) AS rate FROM range(100) t(i)")
