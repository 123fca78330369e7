"""The operators' queries against brute force over the whole contract, and the pipeline's stages on edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from basalt.llm import byte_bpe, language, license_scan, packing, permutation_index, queries, quality, simhash, substring_dedup, token_store, toxicity  # noqa: E402
from basalt.llm.license_rules import rules  # noqa: E402

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
#: Nulls, empty, blank, repeated rows and ids, letterless texts, and a null id.
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "Same text here"), (5, "Same text here"), (5, "Same text here"), (5, "other text under one id"), (6, " ".join(f"w{i % 97}" for i in range(3000))), (None, "no id"), (7, "é漢字 <|endoftext|> 😀"), (8, "½ ² ① 3")]
CLASH = ("n_words", "ids", "score", "fp", "rep", "_b", "_word", "key", "row", "covered", "language", "toxicity", "Language", "at", "word", "bits", "maybe", "tag", "count", "root", "a", "b", "digest", "length", "kept")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def scanned(text):
    """Base columns and kept detections by the contract's words and the stated order, with plain loops."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = sorted((i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    joined = f" {' '.join(words)} "
    hits = [(m.start(), m.end(), r.priority, r.label) for r in rules() for m in re.finditer(r.pattern, joined, re.S)]
    rank = {h: min(y[2] for y in hits if h[0] <= y[0] and y[1] <= h[1]) for h in hits}
    kept = []
    for h in sorted(set(hits), key=lambda h: (rank[h], h[0] - h[1], h[0], h[2])):
        if all(h[1] <= y[0] or y[1] <= h[0] for y in kept):
            kept.append(h)
    labels = {x for _, x in base}
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {h[3] for h in kept})))


def test_licenses_by_brute_force(spark, docs):
    rng = random.Random(3)
    bits = ["GNU General Public License", "version 2", "either version 3 of the license or at your option any later version", "under the terms of the", "MIT License", "mit license mit", "Apache License, Version 2.0", "CC-BY-NC-SA 4.0", "Creative Commons Attribution 4.0", "SPDX-License-Identifier: GPL-2.0-or-later", "https://www.gnu.org/licenses/gpl-3.0", "released under the", "GNU Lesser General Public License v2.1", "all rights reserved", "BSD 3-Clause", "word", "ſ ½ été", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"]
    rows = [(10_000 + i, "; ".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(20_000, None), (20_001, "")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    held = texts(df)
    got = license_scan.scan(df).collect()
    assert len(got) == len(held)
    for r in got:
        assert tuple(r)[1:7] == scanned(held[r["doc_id"]]), held[r["doc_id"]]


def test_licenses_that_overlap(spark):
    """A part of a detection that goes comes back, unless it overlaps a kept one."""
    one = lambda a, b, p: F.struct(F.lit(a).alias("at"), F.lit(-b).alias("ends"), F.lit(p).alias("priority"), F.lit(f"{a}").alias("label"), F.lit(1.0).alias("score"))
    resolved = lambda *h: [(r["at"], -r["ends"]) for r in spark.range(1).select(license_scan._resolved(F.array(*h)).alias("r")).first()["r"]]
    assert resolved(one(0, 10, 5), one(1, 4, 3), one(8, 15, 1)) == [(1, 4), (8, 15)]
    assert resolved(one(0, 10, 5), one(1, 4, 3), one(8, 15, 4)) == [(0, 10)]  # with its part's rule the whole comes first
    assert resolved(one(0, 4, 2), one(0, 4, 1), one(4, 8, 3)) == [(0, 4), (4, 8)]  # equal places: the earlier rule's


def test_packing_by_the_library(docs):
    from tokenizers import Tokenizer

    t, held = Tokenizer.from_file(WORDS), texts(docs)
    t.encode_special_tokens = True
    got = packing.pack(docs, WORDS).toPandas()
    want = {}
    for i, text in held.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[i, k] = (a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    own = got.sort_values(["sequence_id", "offset"])
    assert (own.groupby("sequence_id").length.cumsum() - own.length == own.offset).all() and own.groupby("sequence_id").length.sum().max() <= 4096
    assert got.sequence_id.nunique() <= -(-sum(n for _, n, _ in want.values()) // 4096) + 1


def test_token_store_by_the_library(spark, docs):
    from tokenizers import Tokenizer

    t, held, at = Tokenizer.from_file(BYTES), texts(docs), 0
    t.encode_special_tokens = True
    for r in sorted(queries.op6_token_orc(spark, SF).collect()):
        ids = np.array([*t.encode(held[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (r["doc_id"], at, len(ids), zlib.crc32(ids))
        at += len(ids)


def scanned_rows(df):
    """Rows that the scan returned, after stripes and row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_orc_skips_by_index_and_bloom_filter(spark, tmp_path):
    df, path = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text")), str(tmp_path / "t")
    token_store.write_tokens(df, BYTES, path, partitions=2)
    assert scanned_rows(token_store.read_tokens(spark, path)) == 20_000
    assert 0 < scanned_rows(token_store.read_tokens(spark, path, 500, 600)) <= 2000  # row index
    assert scanned_rows(token_store.read_tokens(spark, path, 501, 501)) == 0  # within the statistics; only the Bloom filter knows
    assert [r["doc_id"] for r in token_store.read_tokens(spark, path, 500, 500).collect()] == [500]


def test_ranges(spark):
    rng = random.Random(5)
    for n in (0, 1, 2, 7, 50):
        bounds, ids = sorted(rng.sample(range(-100, 100), n)), [None, *range(-110, 110, 3)]
        df = spark.createDataFrame([(i,) for i in ids], "k long")
        assert [r[0] for r in df.select(token_store.range_of(F.col("k"), bounds)).collect()] == [0 if i is None else sum(b < i for b in bounds) for i in ids]


def test_edge_rows_of_the_store(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH[:6]})
    got = token_store.store_digests(df, BYTES).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in EDGES)
    null = next(r for r in got if r["doc_id"] is None)
    assert null["start"] == 0 and {r["start"] for r in got if r["doc_id"] == 1} == {null["n_tokens"]}
    by = sorted((r for r in got), key=lambda r: r["start"])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(by[:-1], by[1:], strict=True))


def test_decoder_holds_back_split_characters(spark):
    text = "naïve 漢字 😀 ﷽ ​ end"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (1, text)], "doc_id long, text string")
    enc = byte_bpe.encode_documents(df, BYTES, offsets=True)
    for part in (1, 2, 3, 4096):
        got = enc.select("doc_id", byte_bpe.string_column(F.col("ids"), BYTES, part).alias("t"), byte_bpe.text_column(F.col("ids"), BYTES).alias("b")).collect()
        assert Counter((r["doc_id"], r["t"], bytes(r["b"]).decode()) for r in got) == Counter({(1, text, text): 2, (2, "", ""): 1, (3, "", ""): 1})
    d = byte_bpe.decoder(BYTES)
    assert list(d.texts([b"\xe6", b"\xbc\xa2x", b"\xf0\x9f"])) == ["", "漢x", "", "�"]
    r = enc.filter("doc_id = 1").first()
    assert all(text[a:b] for a, b in zip(r["starts"], r["ends"], strict=True)) and r["ends"][-1] == len(text)
    own = {r["doc_id"]: r for r in byte_bpe.round_trip_digests(df, BYTES).collect()}
    assert own[1]["n_chars"] == len(text) and own[1]["n_split"] == sum(a < b for a, b in zip(r["starts"][1:], r["ends"][:-1], strict=True)) > 0
    assert own[3]["n_tokens"] == own[2]["n_tokens"] == 0 and byte_bpe.round_trip_digests(df.limit(0), BYTES).count() == 0


def test_noisy_or(spark):
    """A score is one minus the chance that neither the leak nor any sentence is toxic, from the model's own weights."""
    rows = [(i, f"good day {i} here. {'bad fool' if i % 3 == 0 else 'fine tree'} sits. {'bad fool' if i % 6 == 0 else 'more'} words!", int(i % 3 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    for _, text, _ in rows[:30]:
        clean = 1 - model.leak
        for s in re.split(r"[.!?\n]", text.lower()):
            own = [model.weights[model.code[f]] for w in re.findall(r"[^\W_]+", s) for f in toxicity.features(w) if f in model.code]
            if own:
                clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(own))))
        assert abs(model.score(text) - (1 - clean)) < 1e-12
    again = toxicity.fit(df.repartition(7), df.select("doc_id", "toxic").repartition(3))
    assert again.code == model.code and np.array_equal(again.weights, model.weights)  # whatever the partitions
    held = [(t, model.score(t)) for _, t, _ in rows]
    assert all((p >= 0.5) == ("bad" in t) for t, p in held)
    # equal sentences count as often as they come
    assert toxicity.bag("a x. a x! b", {"a": 0, "x": 1, "b": 2}) == Counter({(0, 1): 2, (2,): 1})


def test_repeated_ids_with_other_texts_in_toxicity(spark):
    rows = [(i // 2, f"text {'bad' if i % 4 < 2 else 'good'} number {i}", int(i % 4 < 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    one, two = (toxicity.fit(d, df.select("doc_id", "toxic")) for d in (df, df.orderBy(F.rand(5))))
    assert one.code == two.code and np.array_equal(one.weights, two.weights)


def brute_language(rows, text):
    """Word first, then the longest n-grams, from (language, text) rows, with dictionaries."""
    word = lambda t: [w for w in re.findall(r"[^\W\d_]+", t.lower()) if w.isalpha()]
    cut = lambda w, s: [w] if s == 0 else [f" {w} "[i : i + s] for i in range(len(w) + 3 - s)] if s > 1 else list(w)
    languages = sorted({x for x, _ in rows})
    tables = {}
    for s in (0, 5, 4, 3, 2, 1):
        counts = Counter((x, g) for x, t in rows for w in word(t) for g in cut(w, s))
        grams = {g for _, g in counts}
        total = {x: sum(n for (y, _), n in counts.items() if y == x) for x in languages}
        logs = {g: np.array([np.log((counts[x, g] + 0.5) / (total[x] + 0.5 * len(grams))) for x in languages]) for g in grams}
        tables[s] = {g: v - v.mean() for g, v in logs.items()}
    total, share, words = np.zeros(len(languages)), np.zeros(len(languages)), word(text)
    for w in words:
        for s in (0, 5, 4, 3, 2, 1):
            found = [tables[s][g] for g in cut(w, s) if g in tables[s]]
            if found:
                v = np.mean(found, axis=0)
                total += v
                share += np.exp(v) / np.exp(v).sum()
                break
    return (languages[int(total.argmax())], float(share[total.argmax()]) / len(words)) if words else ("und", 0.0)


def test_language_by_brute_force(spark, docs):
    some = docs.filter(F.length("text") < 1500).limit(120)
    model = language.fit(some)
    rows = [(r["lang"], r["text"]) for r in some.filter(~language.held_out("doc_id")).collect()]
    asked = [(i, t) for i, t in texts(some).items()][:40] + [(-1, "unseen zzyzx wörter été 漢字"), (-2, "½ ² 3"), (-3, "①Ⅷ"), (-4, None), (-5, "漢字 пример"), (-6, "a½b c")]
    df = spark.createDataFrame(asked, "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    for i, t in asked:
        lang, score = brute_language(rows, (t or "").replace("½", " "))
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-5, t
    assert {got[i]["lang_pred"] for i in (-2, -3, -4)} == {"und"} and got[-5]["score"] == 0.0


def test_language_score_tells_foreign_text(spark, docs):
    import corpus_pipeline

    junk = [(900_000, "пример текста на другом языке"), (900_001, "漢字仮名交じり文"), (900_002, "пример текста на другом языке и ещё немного слов the end")]
    df = docs.unionByName(spark.createDataFrame(junk, "doc_id long, text string"), allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, df, SF).select("doc_id").collect()}
    gone = {r["doc_id"] for r in docs.select("doc_id").collect()} - kept
    assert not kept & {i for i, _ in junk}
    lettered = {i for i, t in texts(docs).items() if any(c.isalpha() for c in t or "")}
    assert not gone & lettered


@pytest.mark.skipif(not __import__("os").path.exists(f"{SF01}/embeddings.parquet"), reason="no test tables")
@pytest.mark.parametrize("segment", [8192, 500])
def test_recall_on_embeddings(spark, segment):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = permutation_index.nearest(df, df.filter("vec_id % 20 = 0"), 20, segment).toPandas()
    hits = 0
    for q, part in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.argsort(-s, kind="stable")[:20]]) & set(part.vec_id))
    assert len(got) == 20 * (ids % 20 == 0).sum() and hits / len(got) >= 0.9


def test_edges_of_the_permutation_index(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(5, rng.normal(size=8).tolist()), (5, [1.0] * 8), (61, [1.0, 2.0]), (62, [2.0, 1.0]), (63, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "v", "dim", "segment", "kind", "pivots", "rank", "score")})
    got = permutation_index.nearest(df, df.filter("vec_id in (5, 40, 61)"), 100, segment=16).toPandas()
    by = {q: p.sort_values("rank") for q, p in got.groupby("query_id")}
    assert by[61].vec_id.tolist() == [62] and by[61].score.tolist() == [4.0]
    assert sorted(by[40].vec_id) == sorted([i for i in range(60) if i != 40] + [5, 5]) and len(by[5]) == 59  # no candidate has the query's id
    assert by[40]["rank"].tolist() == list(range(1, 62))


def test_simhash_edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH if c != "Language"})
    got = simhash.near_duplicates(df).collect()
    of = {r["doc_id"]: r for r in got}
    assert len(got) == len(EDGES) and {of[i]["component_id"] for i in (1, 2, 3)} == {1} and of[1]["fingerprint"] == "0" * 16
    assert of[4]["component_id"] == 4 and {r["component_id"] for r in got if r["doc_id"] == 5} >= {4} and of[None]["component_id"] is None


def test_hot_centres_are_spread(spark):
    """A star, a chain, and random links, with every key hot, against union-find."""
    rng = np.random.default_rng(9)
    edges = [(0, i) for i in range(5, 300)] + [(400 + i, 401 + i) for i in range(60)] + [(int(a), int(b)) for a, b in rng.integers(500, 700, (120, 2))] + [(250, 460), (299, 299)]
    parent = np.arange(1000)
    simhash.joined(parent, *(np.array(x) for x in zip(*edges, strict=True)))
    want = {i: int(r) for i, r in enumerate(simhash._roots(parent, parent)) if any(i in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(edges, "a long, b long")
    for share in (50, 1000):
        assert dict(simhash.components(df, share).collect()) == want
    assert simhash.components(df.limit(0)).count() == 0


def test_quality_repeats_by_brute_force(spark):
    """Repeated windows in longer texts, and the path for texts whose places do not fit the packed hashes."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdef") + rng.choice(["", "x", "yy"]) for _ in range(rng.randint(0, 900)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (quality.PLACE_BITS, 4):
        old, quality.PLACE_BITS = quality.PLACE_BITS, bits
        try:
            got = {r["doc_id"]: r["n_repeat_words"] for r in quality.quality(df).collect()}
        finally:
            quality.PLACE_BITS = old
        for i, t in rows:
            w = t.split()
            n = Counter(zip(w, w[1:], w[2:]))
            assert got[i] == len({i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)})


def test_repeated_ids_keep_their_own_cuts(spark):
    p, q = " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(30))
    rows = [(1, f"{p} x"), (2, f"a b {p}"), (2, f"{q} {p} z"), (2, f"{q} {p} z"), (3, f"{q}"), (None, p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in substring_dedup.deduplicated(df).collect())
    assert got == Counter([(1, f"{p} x"), (2, "a b"), (2, f"{q} z"), (2, f"{q} z"), (None, p)])  # 3 loses all its words to 2


def test_a_very_long_text(spark):
    """A million words, with a copy of its middle in another document."""
    words = [f"w{i * 7919 % 50021}x{i % 31}" for i in range(1_000_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "start " + " ".join(words[400_000:400_100]) + " end")], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:3] for r in substring_dedup.dedup_digests(df).collect()}
    assert got == {1: (1_000_000, 0), 2: (102, 100)}
    assert quality.quality(df).filter("doc_id = 1").first()["n_words"] == 1_000_000
    assert license_scan.scan(df).filter("doc_id = 1").first()["n_words"] == 1_000_000
    assert simhash.near_duplicates(df).count() == 2 and packing.pack(df, WORDS).filter("doc_id = 1").agg(F.sum("length")).first()[0] > 1_000_000
    assert token_store.store_digests(df, BYTES).count() == 2 and byte_bpe.round_trip_digests(df, BYTES).filter("doc_id = 1").first()["n_chars"] == len(" ".join(words))


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


def test_stages_on_edges(spark, docs, stages, tmp_path):
    own = docs.limit(60).select("doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id") + 1000)
    df = own.unionByName(spark.createDataFrame(EDGES, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))).withColumns({c: F.lit("x") for c in CLASH if c not in ("Language",)})
    df.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    want = {"language_id": {None, 4, 5, 6, 7}, "toxicity": {i for i, _ in EDGES}, "simhash_near_dedup": {i for i, _ in EDGES} - {5}, "substring_dedup": {i for i, _ in EDGES}}
    for name, stage in list(stages.items())[:-1]:
        got = stage(spark, df, SF)
        assert got.columns == df.columns and [f.dataType for f in got.schema] == [f.dataType for f in df.schema], name
        rows = got.collect()
        assert {r[c] for r in rows for c in CLASH if c != "Language"} == {"x"}, name
        edge = {r["doc_id"] for r in rows if (r["doc_id"] or 0) < 1000}
        assert edge <= want[name] and (name == "language_id" or edge == want[name]), (name, edge)
        assert stage(spark, df.limit(0), SF).count() == 0, name
    packed = stages["best_fit_packing"](spark, df, SF)
    assert Counter(r["doc_id"] for r in packed.filter("piece = 0 and (doc_id < 1000 or doc_id is null)").collect()) == Counter(i for i, _ in EDGES)
    assert stages["best_fit_packing"](spark, df.limit(0), SF).count() == 0


def test_pipeline_by_brute_force(spark, docs, stages):
    """Each stage of a run against plain Python on what the stage before it kept."""
    import corpus_pipeline

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    now = docs
    model, toxic = language.Scorer(language.fit(now)), None
    held = texts(now)
    kept = [i for i in held if (lambda p: p[0] != "und" and p[1] >= corpus_pipeline.SURE)(model.predict([held[i]])[0])]
    now = stages["language_id"](spark, now, SF).cache()
    assert sorted(texts(now)) == sorted(kept)
    toxic, held = toxicity.fit(now, labels), texts(now)
    now = stages["toxicity"](spark, now, SF).cache()
    assert sorted(texts(now)) == sorted(i for i in held if toxic.score(held[i]) < toxicity.TOXIC)
    held = texts(now)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else None for i, t in held.items()}
    root = {i: i for i in held}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in held:
        for j in held:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    now = stages["simhash_near_dedup"](spark, now, SF).cache()
    assert sorted(texts(now)) == sorted(i for i in held if find(i) == i)
    held, first, want = texts(now), {}, {}
    for i in sorted(held):
        w = held[i].split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
        gone = {k + j for k in range(len(w) - 12) for j in range(13) if first[tuple(w[k : k + 13])] < i}
        if left := [x for k, x in enumerate(w) if k not in gone]:
            want[i] = left
    now = stages["substring_dedup"](spark, now, SF).cache()
    assert {i: t.split() for i, t in texts(now).items()} == want and all(r["n_chars"] == len(r["text"]) for r in now.collect())
    own = stages["best_fit_packing"](spark, now, SF).toPandas().sort_values(["doc_id", "piece"])
    run = corpus_pipeline.run(spark, SF).toPandas().sort_values(["doc_id", "piece"])
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert run[cols].values.tolist() == own[cols].values.tolist() and run.sequence_id.nunique() == own.sequence_id.nunique()
