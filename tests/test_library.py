"""Unit tests of the library: rules, edge cases and invariants on small tables."""

import pytest
from pyspark.sql import functions as F

from basalt.functions import chat, text
from basalt.operators import analysis, catalog, dedup, labels, mixing, packing, prep, profile, quality, splits
from basalt.plans import plan as P
from basalt.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_predicates_are_two_valued(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, None), (3, "b", 2.0)], "k int, s string, x double")
    keys = lambda *ops: [r["k"] for r in P.compile_plan(ops, df).orderBy("k").collect()]
    assert keys(P.Filter("s", "Neq", "a")) == [2, 3]
    assert keys(P.Filter("s", "NotIn", '["a"]')) == [2, 3]
    assert keys(P.Not(P.Filter("x", "Gt", 1.5))) == [1, 2]
    assert keys(P.Filter("x", "Eq", 1.0 + 1e-12)) == [1]
    assert keys(P.Filter("s", "In", [])) == []
    assert keys(P.Sort("k"), P.Limit(5, 10)) == []
    with pytest.raises(ValueError):
        keys(P.Filter("x", "Gt", "no number"))
    with pytest.raises(Exception):
        keys(P.Project(("missing",)))


def test_aggregates_of_nothing_are_zero(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert rows(P.compile_plan([P.Aggregate([P.Agg("sum", "x"), P.Agg("mean", "x"), P.Agg("std_dev", "x")])], empty)) == [(0.0, 0.0, 0.0)]
    nulls = spark.createDataFrame([("a", None), ("a", 1.0), (None, None)], "g string, x double")
    got = {r["g"]: (r["count_x"], r["distinct_count_x"]) for r in P.compile_plan([P.Aggregate([P.Agg("count", "x"), P.Agg("distinct_count", "x")], ("g",))], nulls).collect()}
    assert got == {"a": (2.0, 2.0), None: (1.0, 1.0)}


def test_plan_from_json(spark):
    p = P.from_json('[{"And": {"conditions": [{"Filter": {"column": "id", "operator": "Gt", "value": 3}}]}}, {"Aggregate": {"aggregations": [{"function": "max", "column": "id"}]}}]')
    assert rows(P.compile_plan(p, spark.range(10))) == [(9.0,)]
    assert P.estimated_cost(p, 100) == pytest.approx(11.0)


def test_sample_is_exact(spark):
    assert P.sample(spark.range(101), 0.1, ["id"]).count() == 11
    assert P.sample(spark.range(0), 0.5, ["id"]).count() == 0
    assert P.sample(spark.range(10), 1.0, ["id"]).count() == 10


def test_personal_data(spark):
    df = spark.createDataFrame([("Contact me at john.doe@example.com",), ("Call me at 555-123-4567",), ("Server at 192.168.1.1 is down",)], "t string")
    assert [r[0] for r in df.select(text.detect_pii(F.col("t"))).collect()] == [["email"], ["phone"], ["ip_address"]]
    assert df.select(text.mask_pii(F.col("t"))).first()[0] == "Contact me at *****@*****.***"


def test_language_and_quality(spark):
    df = spark.createDataFrame([("The quick brown fox jumps over the lazy dog",), ("这是一个中文测试句子，用于检测语言",), ("too short",), ("",)], "t string")
    got = df.select(text.detect_language(F.col("t"))["lang"], text.quality(F.col("t"))["passed"], text.repetition_ratio(F.col("t"))).collect()
    assert [r[0] for r in got] == ["en", "zh", "unknown", "unknown"]
    assert [r[1] for r in got] == [False, False, False, False]
    same = spark.createDataFrame([("a b c d a b c d",)], "t string").select(text.repetition_ratio(F.col("t")), text.jaccard(text.char_ngrams(F.col("t"), 3), text.char_ngrams(F.col("t"), 3))).first()
    assert same[0] == pytest.approx(1 / 5) and same[1] == 1.0


def test_chat(spark):
    df = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", "ho"), (2, 1, "system", "s")], "conv_id int, turn int, role string, text string")
    got = dict(chat.render(df, chat.template("qwen"), True).collect())
    assert got[1] == "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nho<|im_end|>\n<|im_start|>assistant\n"
    assert got[2].startswith("<|im_start|>system\ns")
    assert chat.template("none") is None


def test_splits_and_folds(spark):
    df = spark.range(103).withColumn("g", F.col("id") % 7).withColumn("s", F.col("id") % 2)
    assert dict(splits.random_split(df, "id").groupBy("split").count().collect()) == {"train": 61, "val": 20, "test": 22}
    assert splits.group_split(df, "g").groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert sorted(r["count"] for r in splits.kfold(df, "id", 5).groupBy("fold").count().collect()) == [20, 20, 21, 21, 21]
    assert sorted(r["count"] for r in splits.kfold(df, "id", 5, remainder="last").groupBy("fold").count().collect()) == [20, 20, 20, 20, 23]
    with pytest.raises(ValueError):
        splits.random_split(df, "id", (0.5, 0.2, 0.2))
    indexed = splits.indexed(df.repartition(5), ["id"])
    assert indexed.filter("row_index <> id").count() == 0
    assert [r[0] for r in splits.batches(df, ["id"], 32).groupBy("batch").count().orderBy("batch").select("count").collect()] == [32, 32, 32, 7]
    assert splits.weighted_sample(df, "id", "id", 10).filter("id = 0").count() == 0


def test_preparation(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, " "), (3, 3.0, "a"), (4, 5.0, "b")], "k int, x double, s string")
    assert [r[0] for r in prep.normalize(df, ["x"]).orderBy("k").select("x").collect()] == [0.0, None, 0.5, 1.0]
    assert [r[0] for r in prep.fill_missing(df, ["x"], "median").orderBy("k").select("x").collect()] == [1.0, 3.0, 3.0, 5.0]
    assert [r[0] for r in prep.fill_missing(df, ["s"], "mode").orderBy("k").select("s").collect()] == ["a", "a", "a", "b"]
    assert prep.drop_missing(df).count() == 3
    assert prep.one_hot(df, ["s"]).columns == ["k", "x", "s_a", "s_b"]
    with pytest.raises(ValueError):
        prep.fill_missing(df, ["x"], "guess")
    with pytest.raises(ValueError):
        prep.run_steps(df, [("custom", {})])


def test_keep_first_matches_the_loop(spark):
    import random

    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(40)}
    kept, keeper = set(), {}
    for b in range(30):
        near = [a for a in kept if (a, b) in edges]
        keeper[b] = min(near) if near else b
        if not near:
            kept.add(b)
    nodes, pairs = spark.range(30), spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")
    assert dict(dedup.keep_first(nodes, pairs).collect()) == keeper
    parent = list(range(30))
    for _ in range(30):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert dict(dedup.clusters(pairs).collect()) == {n: parent[n] for e in edges for n in e}


def test_digest_ignores_order(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    assert dedup.dataset_digest(df).first() == dedup.dataset_digest(df.repartition(7)).first() != dedup.dataset_digest(df.filter("id < 49")).first()


def test_packing_keeps_tokens(spark):
    df = spark.createDataFrame(list(enumerate([5, 4, 4, 3, 3, 1])), "id long, n long")
    for how in ("first_fit", "best_fit", "greedy"):
        got = packing.pack(df, "id", "n", 8, how)
        assert got.groupBy("shard", "bin").agg(F.sum("length").alias("t")).filter("t > 8").count() == 0
        assert packing.report(got, 8).first()["tokens"] == 20
    points = spark.createDataFrame([("s", i, float(i % 10)) for i in range(100)], "s string, t long, v double")
    picked = [r["step"] for r in packing.lttb(points, "s", "t", "v", 10).orderBy("step").collect()]
    assert picked[0] == 0 and picked[-1] == 99 and len(picked) <= 10


def test_mixing(spark):
    assert mixing.normalized({"a": 7, "b": 2, "c": 1}) == {"a": 0.7, "b": 0.2, "c": 0.1}
    with pytest.raises(ValueError):
        mixing.normalized({"a": 0})
    got = [r["dataset"] for r in mixing.steps(spark, mixing.Recipe({"a": 1, "b": 1}, "interleaved", run=5), 12).orderBy("step").collect()]
    assert (got[0], got[5], got[10]) == ("a", "b", "a")
    pace = [r[0] for r in spark.createDataFrame([(50,), (600,), (1100,)], "s int").select(mixing.difficulty(F.col("s"), 1100, 100)).collect()]
    assert pace == [0.0, 0.5, 1.0]


def test_labels(spark):
    one = spark.createDataFrame([(1, "a", "x", 0.9), (1, "b", "x", 0.4), (2, "a", "y", 0.8), (2, "b", "y", 0.6)], "sample_id int, annotator string, label string, confidence double")
    assert labels.pairwise_agreement(one).first()[0] == 1.0 and labels.fleiss_kappa(one, 2).first()[0] == 1.0 and labels.cohen_kappa(one, "a", "b").first()[0] == 1.0 and labels.krippendorff_alpha(one).first()[0] == 1.0
    series = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 2.0), ("s", 3, 3.0)], "n string, t int, v double")
    assert [r["ema"] for r in labels.ema(series, "n", "t", "v", 0.5).orderBy("step").collect()] == [1.0, 1.5, 2.25]
    assert [r["ema"] for r in labels.ema(series, "n", "t", "v", 1.0).orderBy("step").collect()] == [1.0, 2.0, 3.0]


def test_quality_and_analysis(spark):
    assert [r[0] for r in spark.createDataFrame([(95.0,), (80.0,), (65.0,), (50.0,), (30.0,)], "s double").select(quality.grade(F.col("s"))).collect()] == ["excellent", "good", "fair", "poor", "critical"]
    assert analysis.volume_drift(100, 110)[1] == "low"
    df = spark.createDataFrame([(1, None), (2, 3.0)], "k int, x double")
    assert rows(quality.check(df, [quality.Expectation("not_null", "x"), quality.Expectation("unique", "k")]).select("expectation", "passed")) == [("not_null", False), ("unique", True)]
    assert rows(analysis.row_diff(df, df, ["k"])) == [("unchanged", 2)]
    assert profile.histogram(df.filter("k = 2"), "x").count() == 0


def test_catalogue(spark):
    assert catalog.levels([("a", "b"), ("b", "c"), ("a", "c")]) == [["a"], ["b"], ["c"]]
    with pytest.raises(ValueError):
        catalog.levels([("a", "b"), ("b", "a")])
    assert catalog.grid(spark, {"lr": [0.1, 0.2], "b": [1, 2]}).count() == 4
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    assert rows(catalog.reachable(edges, spark.createDataFrame([("a",)], "node string"))) == [("a", 0), ("b", 1), ("c", 2)]


def test_sources(spark, tmp_path):
    spark.createDataFrame([("1", "x,y"), ("2", None)], "a string, b string").coalesce(1).write.option("header", True).csv(str(tmp_path / "t.csv"))
    df = files.read(spark, str(tmp_path / "t.csv"))
    assert rows(files.typed(df, {"a": "integer"}).select("a")) == [(1,), (2,)]
    assert dict(profile.strict_types(df).collect()) == {"a": "integer", "b": "string"}
    assert files.format_of_content(b"PAR1...") == "parquet" and files.format_of_content(b"a,b\n1,2") == "csv"
    assert files.object_url("s3", "b", "k", "p") == "https://b.s3.us-east-1.amazonaws.com/p/k"
    assert files.transfer(125_000 * 700, 1) == (700.0, 4)
    assert rows(files.rows_at(spark.range(10), ["id"], [3, 99]).select("id")) == [(3,)]


def test_versions_and_lifecycles(spark, tmp_path):
    from basalt.operators import records

    v = records.Versions(spark, str(tmp_path / "versions"))
    one = v.commit(spark.range(5), "first")
    two = v.commit(spark.range(6), "second")
    v.tag("old", one)
    assert v.checkout("old").count() == 5 and v.checkout("main").count() == 6 and v.ancestry(two) == [two, one]
    assert v.commit(spark.range(5).repartition(3)) == 3 and v.log().select("digest").distinct().count() == 2
    model = records.Lifecycle(records.MODEL, "none")
    model.move("staging")
    with pytest.raises(ValueError):
        records.Lifecycle(records.EXPERIMENT, "completed").move("running")
    assert records.bumped("1.2.3", "minor") == "1.3.0"
    state = records.LoaderState().after(4, 10)
    assert records.LoaderState.load(state.dump()) == state and state.rest(spark.range(10), "id").count() == 6
    assert records.budget(3.6e9, 1e6)["hours"] == 1.0 and records.validate_phases([]) == ["no phases"]


def test_curriculum_and_pairs(spark):
    rows_ = spark.createDataFrame([(d, i) for d in "ab" for i in range(10)], "dataset string, row_index long")
    got = mixing.curriculum(rows_, {"a": 10, "b": 10}, {"a": 0.5, "b": 0.5}).groupBy("phase").count()
    assert dict(got.collect()) == {0: 6, 1: 10, 2: 4}
    assert mixing.weighted_random(rows_, {"a": 1, "b": 1}, 12).count() == 12
    pairs = spark.createDataFrame([(0, [1, 2], [3]), (0, [1], [4, 5, 6])], "b int, x array<int>, y array<int>")
    got = splits.collate_pairs(pairs, "b", "x", "y", multiple=4).collect()
    assert all(len(r["x"]) == len(r["y"]) == len(r["mask"]) == 4 for r in got) and got[0]["y"][-1] == -100


def test_jaccard_of_whole_texts(spark, tmp_path):
    from basalt.plans import analysis_queries  # noqa: F401
    from basalt.plans.queries import QUERIES

    opening = "the same opening of two hundred characters " * 6
    rows = [(1, opening + "alpha beta gamma"), (2, opening + "quite another, much longer ending " * 9), (3, ""), (4, ""), (5, "ab")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    grams = {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, t in rows}
    want = {i: round(len(grams[i] & grams[i + 1]) / len(grams[i] | grams[i + 1]), 6) if grams[i] | grams[i + 1] else 1.0 for i in range(1, 5)}
    assert dict(QUERIES["text_jaccard_next"](spark, str(tmp_path)).collect()) == want and want[1] < 0.9


def test_oversample_takes_all_documents(spark, tmp_path):
    from basalt.plans.queries import QUERIES

    langs = ["en"] * 14 + ["de"] * 9 + ["fr"] * 21 + ["it"]
    spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["mix_oversample"](spark, str(tmp_path)).toPandas()
    assert got.groupby("dataset").size().to_dict() == {"en": 40, "de": 9, "fr": 9}
    assert got[got.dataset == "en"].doc_id.nunique() == 14 and got[got.dataset == "de"].doc_id.nunique() == 9


def test_keep_first_leaves_nothing_undecided(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "id long")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long")
    with pytest.raises(RuntimeError):
        dedup.keep_first(nodes, pairs, most_rounds=2)
    assert dict(dedup.keep_first(nodes, pairs).collect()) == {i: i - i % 2 for i in range(7)}


def test_ema_of_all_events(spark, tmp_path):
    from basalt.plans import analysis_queries  # noqa: F401
    from basalt.plans.queries import QUERIES

    rows = [(i, "ab"[i % 7 < 2], float(i * 37 % 101)) for i in range(5000)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want, last = {}, {}
    for i, kind, v in rows:
        last[kind] = 0.3 * v + 0.7 * last[kind] if kind in last else v
        want[kind, i] = last[kind]
    got = {(r["series"], r["step"]): r["ema"] for r in QUERIES["series_ema"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_catalogue_search_ranks_equal_points_by_id(spark):
    # 0.4 + 0.1 + 0.1 and 0.4 + 0.2 differ as doubles by their order
    kinds = "id long, name string, description string, tags array<string>, tasks array<string>, format string, rows long, created_at string"
    df = spark.createDataFrame([(1, "corn set", None, ["corn"], ["corn"], "csv", 10, ""), (2, "corn", "", [], None, "csv", 10, ""), (3, "corn set", "Corn", None, [], "csv", 10, ""), (4, "rye", "rye", [], [], "csv", 10, "")], kinds)
    assert [(r["id"], r["relevance"]) for r in catalog.search(df, "Corn").collect()] == [(2, 0.7), (1, 0.6), (3, 0.6)]
