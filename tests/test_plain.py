"""Operators of the library against plain Python on small tables, and streams run as streams."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from basalt import storage
from basalt.functions import hashing, text
from basalt.operators import catalog, dedup, labels, mixing, packing, prep, provenance, quality, records, safety, slices, splits
from basalt.sources import files
from basalt.streaming import streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def uniform(seed, key):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:15], 16) / 16**15


def test_slices(spark):
    df = spark.createDataFrame([("10", "a"), ("9", None), ("x", "null"), ("", "b"), (None, "NULL"), ("1e1", "c")], "v string, w string")
    of = lambda *a: [r[0] for r in df.select(slices.matches(F.col("v"), *a)).collect()]
    assert of("gt", "9.5") == [True, False, True, False, False, True]  # by number, else by text
    assert of("between", "9, 10") == [True, True, False, False, False, True] and of("between", "1") == [False] * 6
    assert of("in", "x, 9") == [False, True, True, False, False, False] and of("is_null") == [False, False, False, True, True, False]
    assert [r[0] for r in df.select(slices.matches(F.col("w"), "is_not_null")).collect()] == [True, False, False, True, False, True]


def test_safety():
    parts = dict.fromkeys(safety.READINESS, 100.0)
    assert safety.readiness(parts) == safety.Readiness(100.0, "A", True)
    bad = safety.readiness(parts | {"split_safety": safety.split_safety("critical"), "leakage_safety": safety.leakage_safety(["high"]), "documentation": 30.0})
    assert bad.blockers == ["split_safety", "leakage_safety"] and bad.warnings == ["documentation"] and not bad.ready and bad.grade == "D"
    assert safety.collinear_groups([("a", "b", 0.97), ("b", "c", -0.9), ("c", "d", 0.8), ("x", "y", 0.99)]) == [(["a", "b", "c"], pytest.approx(0.935), "a"), (["x", "y"], 0.99, "x")]
    assert safety.overall_severity(["low", "high"]) == "high" and safety.overall_severity([], True) == "critical" and safety.overall_severity([]) == "none"


def test_feature_leakage(spark):
    df = spark.createDataFrame([("label", 10, 2, None, ["a", "b"]), ("label_copy", 10, 3, None, None), ("row_id", 10, 10, None, None), ("kind", 10, 2, None, ["a", "b"]), ("other", 10, 5, None, ["q"])], "column string, total long, distinct long, mean double, values array<string>")
    assert rows(safety.feature_leakage(df, "label")) == [("kind", "high"), ("label_copy", "high"), ("row_id", "medium")]


def test_provenance(spark):
    schema = "row_index int, source_type string, source_name string, license string, consent boolean, commercial boolean, attribution boolean, restrictions array<string>"
    one = lambda *r: provenance.issues(spark.createDataFrame(list(r), schema)).first()["score"]
    assert one((1, "web", "s", "mit", None, True, False, ["no_commercial_use"])) == 1.0
    assert one((1, "web", "s", None, None, True, False, [])) == 0.8
    assert one((1, "user_generated", "s", "unknown", None, True, False, [])) == 0.5
    assert provenance.attribution(spark.createDataFrame([], schema)).first()[0] == "No attribution required"


def test_mixes_that_run_out(spark):
    sizes, weights = {"a": 20, "b": 5, "c": 0}, {"a": 0.5, "b": 0.3, "c": 0.2}
    left, place, want = dict(sizes), 0, []
    gone = set()
    for step in range(60):  # a dataset that is out gives its steps to the first live one; finding it out costs a step
        u, upto = uniform("42", step), 0.0
        pick = "c"
        for k, w in list(weights.items())[:-1]:
            upto += w
            if u < upto:
                pick = k
                break
        if pick in gone:
            pick = next((k for k in weights if k not in gone), None)
            if pick is None:
                break
        if left[pick] == 0:
            gone.add(pick)
            continue
        want.append((place, pick, sizes[pick] - left[pick]))
        left[pick], place = left[pick] - 1, place + 1
    data = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)], "dataset string, row_index long")
    got = mixing.weighted_random(data, weights, 60)
    assert rows(got.select("position", "dataset", "row_index")) == want
    again = mixing.executed(spark, mixing.Recipe({"a": 1, "b": 1}, "interleaved", run=2), {"a": 3, "b": 2}, 20, {"a": 2, "b": 1}).orderBy("step").collect()
    assert [(r["dataset"], r["row_index"], r["epoch"]) for r in again] == [("a", 0, 0), ("a", 1, 0), ("b", 0, 0), ("b", 1, 0), ("a", 2, 0), ("a", 0, 1), ("a", 1, 1), ("a", 2, 1)]
    assert mixing.executed(spark, mixing.Recipe({"a": 1}), {"a": 2}, 7, {"a": None}).count() == 7
    assert mixing.validate(mixing.Recipe({"a": -1}, run=0)) == ["negative weight: a", "weights add up to 0", "run: at least 1"]


def test_ranks_within_hot_groups(spark):
    df = spark.createDataFrame([("hot" if i % 3 else None if i % 2 else "x", i) for i in range(300)], "g string, part long").withColumn("first", F.lit("mine"))
    got = splits.hash_rank(df, "part", "1", "rank", ["g"]).collect()
    for g in ("hot", None, "x"):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own))) and [r["part"] for r in own] == sorted((r["part"] for r in own), key=lambda k: (uniform("1", k), k))
    assert {r["first"] for r in got} == {"mine"}


def test_draws(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(40)], "k long, w double")
    total = sum(i % 4 for i in range(40))
    ends, upto = [], 0.0
    for i in range(40):
        upto += i % 4
        ends.append(upto)
    want = [(d, next(i for i, e in enumerate(ends) if uniform("42", d) * total < e)) for d in range(500)]
    for buckets in (1, 7, 10_000):
        assert rows(splits.weighted_draws(df, "k", "w", 500, buckets=buckets)) == want
    assert splits.weighted_draws(df.filter("w = 0"), "k", "w", 5).count() == 0
    assert splits.shard_sizes(10, 3) == [4, 3, 3]
    with pytest.raises(ValueError):
        splits.shard_sizes(10, 3, 3)


def brute_signature(t, n=5, permutations=128):
    one = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    h = [one(t[i : i + n]) % dedup.PRIME for i in range(len(t) - n + 1)]
    return [min(((one(f"a|{p}") % (dedup.PRIME - 1) + 1) * x + one(f"b|{p}") % dedup.PRIME) % dedup.PRIME for x in h) for p in range(permutations)]


def _family(rng, base, n):
    out = []
    for _ in range(n):
        w = base.split()
        w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_of_texts(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in "bnrst"]
    texts = []
    for _ in range(8):
        base = " ".join(rng.choice(vocabulary) for _ in range(80))
        texts += [base, base, *_family(rng, base, 6)]
    df = spark.createDataFrame([*enumerate(texts), (900, "short"), (901, None)], "id long, text string")
    signed = dedup.minhash(df, "id", "text")
    held = {r["id"]: r["signature"] for r in signed.collect()}
    assert held[0] == brute_signature(texts[0]) and set(held) == set(range(len(texts)))
    alike = lambda a, b: sum(x == y for x, y in zip(held[a], held[b], strict=True)) >= 0.8 * 128
    banded = lambda a, b: any(held[a][8 * k : 8 * k + 8] == held[b][8 * k : 8 * k + 8] for k in range(16))
    reps = sorted({min(j for j in held if held[j] == held[i]) for i in held})
    links = {(a, b) for a in reps for b in reps if a < b and alike(a, b) and banded(a, b)}
    for block in (3, 1000):  # hot buckets are searched block against block
        assert set(rows(dedup.similar_pairs(signed, "id", block=block))) == links
        roots = dict(dedup.components(dedup.similar_pairs(signed, "id", block=block, forest=True)).collect())
        parent = {i: i for i in reps}
        for _ in reps:
            for a, b in links:
                parent[a] = parent[b] = min(parent[a], parent[b])
        assert {i: roots.get(i, i) for i in reps} == parent
    kept = []
    keeper = {}
    for b in reps:
        near = [a for a in kept if (a, b) in links]
        keeper[b] = min(near) if near else b
        kept += [b] * (not near)
    first = {i: min(j for j in held if held[j] == held[i]) for i in held}
    assert dict(dedup.similar_leaders(signed, "id").collect()) == {i: keeper[first[i]] for i in held}
    index = dedup.SignatureIndex(spark, str(tmp_path / "index"))
    index.insert(df.filter("id < 40"), "id", "text")
    dedup.SignatureIndex(spark, str(tmp_path / "index")).insert(df.filter("id >= 40"), "id", "text")
    asked = spark.createDataFrame([(1, texts[0]), (2, "short"), (3, "nothing like the others in any way, at all, whatsoever")], "q long, text string")
    got = dedup.SignatureIndex(spark, str(tmp_path / "index")).query(asked, "q", "text").collect()
    assert {r["match"] for r in got if r["q"] == 1} == {i for i in held if i in (0, 1) or (alike(0, i) and banded(0, i))}
    assert [(r["match"], r["similarity"]) for r in got if r["q"] == 2] == [(900, 1.0)] and not [r for r in got if r["q"] == 3]
    with pytest.raises(ValueError):
        dedup.SignatureIndex(spark, "x", n_bands=32, rows=8)


def test_text_hashes(spark):
    df = spark.createDataFrame([("a",), ("",), ("foobar",), (None,)], "t string")
    assert [r[0] if r[0] is None else r[0] % 2**64 for r in df.select(hashing.fnv1a(F.col("t"))).collect()] == [0xAF63DC4C8601EC8C, 0xCBF29CE484222325, 0x85944171F73967E8, None]
    two = spark.createDataFrame([("hello world", "hello world"), ("hello world", "completely different text"), ("", "")], "a string, b string")
    got = two.select(text.hamming(text.simhash(F.col("a")), text.simhash(F.col("b"))).alias("h"), text.shingle_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [(r["h"] == 0, r["s"] == 1.0) for r in got] == [(True, True), (False, False), (True, True)]
    grams = spark.createDataFrame([("hello world"[i : i + 3],) for i in range(9)], "g string").select(F.xxhash64("g")).collect()
    bits = sum(1 << b for b in range(64) if sum(1 if r[0] >> b & 1 else -1 for r in grams) > 0)
    assert two.select(text.simhash(F.col("a"))).first()[0] % 2**64 == bits


def test_packing_is_the_plain_loop(spark):
    rng = random.Random(8)
    lengths = [rng.choice([1, 3, 7, 7, 7, 20, 41, 63, 64, 90]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, n long").repartition(5)
    for how in ("best_fit", "greedy"):
        room = []
        for n in sorted((min(n, 64) for n in lengths), reverse=True):
            fits = [(r if how == "best_fit" else 0, i) for i, r in enumerate(room) if r >= n]
            i = min(fits)[1] if fits else len(room)
            room += [64] * (i == len(room))
            room[i] -= n
        got = packing.pack(df, "id", "n", 64, how)
        assert got.count() == 700 and sorted(64 - r["t"] for r in got.groupBy("bin").agg(F.sum("length").alias("t")).collect()) == sorted(room)


def test_lttb_is_the_plain_loop(spark):
    rng = random.Random(1)
    points = [(i, rng.random()) for i in range(200)]
    size, chosen = 198 / 18, [0]
    for i in range(18):
        lo, hi = int(i * size) + 1, min(int((i + 1) * size) + 1, 199)
        ax, ay = points[chosen[-1]]
        mx, my = sum(p[0] for p in points[lo:hi]) / (hi - lo), sum(p[1] for p in points[lo:hi]) / (hi - lo)
        area = [abs((ax - mx) * (points[j][1] - ay) - (ax - points[j][0]) * (my - ay)) for j in range(lo, hi)]
        chosen.append(lo + area.index(max(area)))
    df = spark.createDataFrame([("s", *p) for p in points], "s string, t long, v double")
    assert [r["step"] for r in packing.lttb(df, "s", "t", "v", 20).orderBy("step").collect()] == [*chosen, 199]
    assert packing.lttb(df, "s", "t", "v", 2).count() == 200


def test_rolling_windows(spark):
    df = spark.range(53).withColumn("v", (F.col("id") * 7 % 11).cast("double"))
    v = [i * 7 % 11 for i in range(53)]
    want = [(i, v[i], pytest.approx(sum(v[max(0, i - 9) : i + 1]) / len(v[max(0, i - 9) : i + 1])), max(v[max(0, i - 9) : i + 1])) for i in range(53)]
    assert rows(labels.rolling(df, ["id"], "v", 10)) == want


def test_files(spark, tmp_path):
    df = spark.range(25).withColumn("at", F.lit("mine"))
    chunks = files.Chunks(df.repartition(4), ["id"], 10)
    got = [(n, a, b, last, [r["id"] for r in c.orderBy("id").collect()]) for n, a, b, last, c in iter(chunks.next, None)]
    assert got == [(0, 0, 10, False, [*range(10)]), (1, 10, 20, False, [*range(10, 20)]), (2, 20, 25, True, [*range(20, 25)])] and chunks.exhausted
    chunks.reset()
    assert chunks.next()[4].columns == ["id", "at"] and chunks.position == 10
    out, head = files.write_prepared(df, str(tmp_path / "t.csv"))
    assert out == str(tmp_path / "t_preprocessed.csv") and files.read(spark, out).count() == 25 and head.count() == 25
    assert files.validate(df, ["id", "x"], 24, "0") == [("error", "digest differs"), ("error", "missing column: x"), ("warning", "extra column: at"), ("warning", "row count differs")]
    assert [r["k"] for r in files.grid_sorted(spark.createDataFrame([(None,), (2,), (1,)], "k int"), "k", True).collect()] == [2, 1, None]
    assert files.storage_problems("s3") == ["bucket", "region"] and files.storage_problems("hdfs", endpoint="x") == []
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    back = prep.null_as_nan(prep.normalize(prep.nan_as_null(nan, ["x"]), ["x"]), ["x"])
    assert [r["x"] if not math.isnan(r["x"]) else None for r in back.collect()] == [0.0, None, 1.0]


def test_storage(spark, tmp_path):
    path = str(tmp_path / "a.txt")
    storage.put_text(spark, path, "one")
    with pytest.raises(FileExistsError):
        storage.put_text(spark, path, "two")
    assert storage.get_text(spark, path) == "one" and storage.names(spark, str(tmp_path)) == ["a.txt"]
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    assert storage.written(spark.range(100).repartition(3, "id"), str(tmp_path / "t")).count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
    storage.dropped(spark, str(tmp_path / "t"))
    assert storage.names(spark, str(tmp_path)) == ["a.txt"]


def test_schema_expectations(spark):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    e = quality.Expectation
    got = {(r["expectation"], r["column"]): r["failures"] for r in quality.check(df, [e("type_match", "k", values=("int",)), e("type_match", "s", values=("int",)), e("no_duplicate_columns"), e("schema_match", values=("k", "t"))]).collect()}
    assert got == {("type_match", "k"): 0, ("type_match", "s"): 1, ("no_duplicate_columns", ""): 0, ("schema_match", ""): 2}
    assert quality.token_alerts(spark.createDataFrame([(0.2, 0.1, 0.0)], "padding double, oov double, empty double")).first()[0] == ["oov"]
    assert catalog.reproducibility(True, False, True) == 70


def test_near_rows_say_what_they_skip(spark):
    df = spark.createDataFrame([(i, "same", "x") for i in range(30)] + [(100, "a", "b"), (101, "a", "b")], "k long, p string, q string")
    assert rows(dedup.near_rows(df, "k", ["p", "q"], 0.5, most=20)) == [(100, 101, 1.0)] and dedup.near_rows_skipped(df, "k", ["p", "q"], 20).first() == (1, 30)
    assert dedup.near_rows(df, "k", ["p", "q"], 0.5, most=None).count() == 30 * 29 // 2 + 1


def run_stream(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_streams_run_as_streams(spark, tmp_path):
    data = [(i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", "ab"[i % 2], float(i), f"text {i % 7}") for i in range(300)]
    table = spark.createDataFrame(data, "id long, t string, k string, v double, text string").withColumn("t", F.to_timestamp("t"))
    for i in range(3):
        table.filter(F.col("id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: streams.read_stream(spark, str(tmp_path / "in"), "id long, t timestamp, k string, v double, text string")
    assert rows(run_stream(streams.windowed(stream(), "t", "k", "v", late="1 day"), "w", "complete")) == rows(streams.windowed(table, "t", "k", "v"))
    assert sorted(r["text"] for r in run_stream(streams.unique_texts(stream(), "text"), "u", "append").collect()) == sorted({d[4] for d in data})
    ids = stream().select("k", F.array("id").alias("input_ids"))
    assert rows(run_stream(streams.running_monitor(ids, "k"), "m", "complete")) == [("a", 150, 150), ("b", 150, 150)]
    whole = rows(streams.sessions(table, "t", "k", "3 minutes"))
    assert len(whole) == 2 and set(rows(run_stream(streams.sessions(stream(), "t", "k", "3 minutes", late="1 day"), "s", "append"))) <= set(whole)


def test_shards_of_workers(spark):
    shards = spark.createDataFrame([(i,) for i in range(6)], "shard_id long")
    told = [(0, 1, "claimed", 1.0), (0, 1, "completed", 2.0), (1, 1, "processing", 3.0), (2, 2, "claimed", 3.0), (3, 2, "claimed", 1.0), (3, 2, "failed", 1.0), (4, 3, "claimed", 1.0)]
    events = spark.createDataFrame(told, "shard_id long, worker long, event string, at double")
    beats = spark.createDataFrame([(1, 5.0), (1, 90.0), (2, 10.0)], "worker long, at double")
    states = splits.shard_states(shards, events, beats, 100.0, 30.0)
    assert rows(states.select("shard_id", "state")) == [(0, "completed"), (1, "processing"), (2, "available"), (3, "failed"), (4, "claimed"), (5, "available")]
    assert rows(states.filter("worker is null").select("shard_id")) == [(2,), (5,)]
    assert rows(splits.shard_progress(states)) == [(6, 1, 2, 1, 2, pytest.approx(100 / 6))]
    assert rows(splits.shard_progress(states.filter("false"))) == [(0, 0, 0, 0, 0, 0.0)]
    assert splits.bottleneck(3, 2, 1) == ("data_loading", pytest.approx(1 / 3)) and splits.bottleneck(1, 1, 1)[0] == "collation" and splits.bottleneck(0, 0, 0)[1] == 0.0


def test_pipeline_graph():
    edges = [("load", "clean"), ("clean", "train"), ("load", "report")]
    assert catalog.stale_steps(edges, {"load": "a", "clean": "b"}, {"load": "a", "clean": "c"}) == {"clean": "changed", "train": "upstream"}
    assert catalog.stale_steps(edges, {}, {"load": "a"}) == {"load": "changed", "clean": "upstream", "report": "upstream", "train": "upstream"}
    assert catalog.graph_problems(["a", "a", "b"], [("a", "x"), ("x", "a")]) == ["repeated: a", "unknown: x", "isolated: b", "cycle"]
    assert catalog.graph_problems(["a"], []) == []


def test_storage_class():
    assert files.storage_class("archive", 10**12) == ("GLACIER", pytest.approx(4.0), 0.01)


def test_versions_survive_sessions(spark, tmp_path):
    v = records.Versions(spark, str(tmp_path))
    one = v.commit(spark.range(3).selectExpr("id", "id % 2 AS x"))
    v.tag("first", one)
    v.branch("try", one)
    two = v.commit(spark.range(1, 4).selectExpr("id", "id % 2 + id div 2 AS x"), branch="try")
    again = records.Versions(spark, str(tmp_path))
    assert again.branches == {"main": one, "try": two} and again.tags == {"first": one}
    assert again.ancestry(two) == [two, one] and again.checkout("first").count() == 3
    assert again.diff("main", "try", ["id"]).count() > 0 and again.diff(one, "first", ["id"]).filter("change <> 'unchanged'").count() == 0
    with pytest.raises(ValueError):
        again.branch("try", one)
    again.drop_branch("try")
    assert v.branches == {"main": one}
    with pytest.raises(ValueError):
        v.drop_branch("main")


def test_masking_keeps_special_tokens(spark):
    df = spark.createDataFrame([(1, [0, 5, 6, 7, 8, 9, 0]), (2, []), (3, [0]), (4, None)], "k long, ids array<int>")
    for r in df.select("ids", splits.mask_tokens(F.col("ids"), F.col("k"), 100, 99, 0.5, special=[0]).alias("m")).collect():
        if r["ids"] is None:
            assert r["m"]["ids"] is None and r["m"]["labels"] is None
            continue
        hit = [i for i, y in enumerate(r["m"]["labels"]) if y != -100]
        assert len(hit) == math.ceil(sum(x != 0 for x in r["ids"]) * 0.5) and all(r["ids"][i] == r["m"]["labels"][i] != 0 for i in hit)
        assert all(r["ids"][i] == r["m"]["ids"][i] for i in range(len(r["ids"])) if i not in hit)


def test_jaccard(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4, 5]), ([], []), ([1], []), ([None, 1], [None]), (None, [1]), ([1, 1, 2], [1, 2, 2])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [0.4, 1.0, 0.0, 0.5, None, 1.0]
    pairs = spark.createDataFrame([("abcdefg", "abcdefg"), ("abcdef", "bcdefg"), ("ab", "cd"), ("ab", "abcdefg")], "a string, b string")
    assert [r[0] for r in pairs.select(text.shingle_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, pytest.approx(1 / 3), 1.0, 0.0]
