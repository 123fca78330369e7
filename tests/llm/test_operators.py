"""The training-data operators against brute force, exact round trips and held-out accuracy, and on edge cases."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from basalt.llm import byte_bpe, language, license_scan, packing, permutation_index, quality, simhash, substring_dedup, token_store, toxicity  # noqa: E402
from basalt.llm.encoding import PieceEncoder  # noqa: E402

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 97}" for i in range(3000))
#: Nulls, empty, blank, repeated and long texts, repeated ids, and columns whose names clash with the operators' own.
EDGES = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "Same text here"), (5, "Same text here"), (5, "Same text here"), (6, LONG), (None, "no id"), (7, "é漢字 <|endoftext|> 😀")]


#: Names that operators use for columns of their own.
CLASH = ("lang", "n_words", "ids", "score", "fp", "rep", "_b", "_word", "_covered", "key", "length", "window", "row", "covered", "at", "word", "bits", "maybe", "hi", "lo", "language", "toxicity", "count", "root", "node", "n_chars")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in CLASH})


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_quality_rules(spark, docs, edges):
    def brute(t):
        w = WORD.findall(t or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + k for i, g in enumerate(grams) for k in range(3) if grams.count(g) > 1} if len(w) < 400 else None
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), covered and len(covered) or 0 if covered is not None else None

    own = texts(docs)
    for r in quality.quality(docs).collect():
        want = brute(own[r["doc_id"]])
        assert tuple(r)[1:5] == want[:4] and want[4] in (None, r["n_repeat_words"])
    got = quality.quality(edges).collect()
    assert len(got) == len(EDGES) and not any(r["kept"] for r in got if r["n_words"] < 50)
    assert next(r for r in got if r["doc_id"] == 6)["n_repeat_words"] == 3000
    assert quality.quality(edges.limit(0)).count() == 0


def test_license_scan(spark, edges):
    df = spark.createDataFrame([(1, "GNU general PUBLIC license v3, cc-by; MIT\nLicense MIT license"), (2, None), (3, "SPDX-License-Identifier: GPL-2.0-or-later"), (4, "GNU Lesser General Public License version 2.1"), (5, "nothing")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (4, 0, 9, "cc-by,gpl,mit")
    assert got[2]["n_words"] == 0 and got[2]["labels"] == "" and got[2]["score"] == 0.0
    assert got[3]["labels"] == "gpl-2.0" and got[3]["score"] == 1.0 and got[3]["n_base"] == 0
    assert got[4]["labels"] == "lgpl-2.1"  # the shorter detections inside it are suppressed
    assert got[5]["first_word"] is None
    assert license_scan.scan(edges).count() == len(EDGES) and license_scan.scan(edges.limit(0)).count() == 0
    assert len(license_scan.rules()) >= 200


def test_fingerprints_and_components(spark, docs, edges):
    def brute(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    df = docs.select("doc_id", "text").union(edges.filter("doc_id < 5").select(F.col("doc_id") + 1000, "text"))
    own, got = texts(df), {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    ids = sorted(own)
    prints = np.array([brute(own[i]) for i in ids], np.uint64)
    assert [f"{p:016x}" for p in prints.tolist()] == [got[i]["fingerprint"] for i in ids]
    parent = np.arange(len(ids))
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]) <= 2)
    simhash.joined(parent, a, b)
    assert [ids[k] for k in simhash._roots(parent, parent)] == [got[i]["component_id"] for i in ids]
    assert simhash.near_duplicates(edges).count() == len(EDGES) and simhash.near_duplicates(edges.limit(0)).count() == 0


def test_gray_index_finds_every_link(spark):
    rng = np.random.default_rng(5)
    v = np.unique(np.concatenate([rng.integers(0, 1 << 63, 200, dtype=np.uint64)] + [np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 60, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 60, 300).astype(np.uint64)) for _ in range(2)]))
    rng.shuffle(v)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None]) <= 2), strict=True) if a < b}
    assert {(min(x), max(x)) for a, b in simhash.GrayIndex(v, np.zeros(len(v), int)).links(2) for x in zip(a.tolist(), b.tolist(), strict=True)} == want
    # routed over tasks, with every key hot: the same components
    df = spark.createDataFrame([(int(x), i) for i, x in enumerate(v.view(np.int64).tolist())], "fp long, rep long")
    parent = np.arange(len(v))
    simhash.joined(parent, *map(np.array, zip(*want, strict=True)))
    roots = simhash._roots(parent, parent)
    for hot in (2, 10_000):
        got = dict(simhash.components(simhash.links(df, 2, hot)).collect())
        assert all(got.get(i, i) == roots[i] for i in range(len(v)))


def test_similar_groups(spark):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("a", "e", "i", "o", "u", "an", "el", "or")]
    base = [[words[k] for k in rng.integers(0, len(words), 400)] for _ in range(20)]
    near = [[*x[:200], "changed", *x[201:]] for x in base]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(base + near)] + [(90, ""), (91, None)], "doc_id long, text string")
    got = dict(simhash.similar_groups(df).collect())
    assert all(got[i] == i % 20 for i in range(40)) and 90 not in got


def _edited(rng, rows, kinds=("appended", "replaced")):
    """Texts of random words, each with a copy that has a passage appended or replaced, at similarity 0.80 to 0.90 or below."""
    words = [f"{a}{b}{c}" for a in "bcdfghklmnprst" for b in "aeiou" for c in ("", "n", "rk", "st", "lo")]
    draw = lambda n: [words[k] for k in rng.zipf(1.3, n) % len(words)]
    out = []
    for i in range(rows):
        x, n = draw(500), int(rng.integers(20, 130))
        at = int(rng.integers(0, 500 - n))
        y = [*x, *draw(n)] if kinds[i % len(kinds)] == "appended" else [*x[:at], *draw(n), *x[at + n :]]
        out += [(2 * i, " ".join(x)), (2 * i + 1, " ".join(y))]
    return out


def _jaccard(a, b):
    cut = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b))


def test_similar_groups_of_passages(spark):
    rows = _edited(np.random.default_rng(5), 300)
    got = dict(simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [_jaccard(a[1], b[1]) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert sum(0.8 <= j <= 0.9 for j in want) > 100 and sum(0.6 <= j < 0.8 for j in want) > 50
    assert [got[2 * i + 1] == got[2 * i] for i in range(300)] == [j >= 0.8 for j in want]


def test_similar_groups_come_through_the_fingerprint_index(spark, monkeypatch):
    # without any shared MinHash key, what lies within 2 bits is still found, all of it, and nothing else
    monkeypatch.setattr(simhash, "bands", lambda h: [int.from_bytes(simhash.digest(h)[:7], "little") * simhash.BANDS + i for i in range(simhash.BANDS)])
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        words = [f"w{k}" for k in rng.integers(0, 5000, 500)]
        words[0] = f"first{i}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([f"other{i}", *words[1:]]))]
    fp = {i: simhash.signature(simhash.shingled(t.encode(), 5))[0] for i, t in rows}
    near = {2 * i for i in range(60) if ((fp[2 * i] ^ fp[2 * i + 1]) & ((1 << 64) - 1)).bit_count() <= 2}
    got = dict(simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(near) > 20 and {i for i in range(0, 120, 2) if got[i] == got[i + 1]} == near


def test_similar_groups_of_hot_keys(spark):
    rng = np.random.default_rng(6)
    rows = _edited(np.random.default_rng(50), 60)
    base = rows[0][1].split()
    rows += [(1000 + i, " ".join([*base[:k], "new", *base[k + 1 :]])) for i, k in enumerate(rng.integers(0, 500, 60))]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [dict(simhash.similar_groups(df, hot=hot).collect()) for hot in (1, 2, 7, 20_000)]
    assert got[0] == got[1] == got[2] == got[3] and max(map(list(got[0].values()).count, got[0].values())) > 60


def test_permutation_index(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 32))
    x[100:140] = x[7]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9000, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = permutation_index.nearest(df, df.filter("vec_id % 20 = 0"), segment=3000).toPandas()
    hits = total = 0
    for q, part in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -np.round(s, 9)))[:20]
        hits += len(set(want) & set(part.vec_id))
        total += 20
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and (np.diff(part.score) <= 0).all() and np.allclose(part.score, s[part.vec_id])
    assert got.query_id.nunique() == 200 and hits / total >= 0.9
    copies = got[got.query_id == 120].sort_values("rank").vec_id.tolist()
    assert copies == [7, *(i for i in range(100, 140) if i != 120)][:20]
    assert permutation_index.nearest(df.limit(0), df.limit(0)).count() == 0


def test_encoders_match_the_libraries():
    import random

    from tokenizers import Tokenizer

    rng = random.Random(4)
    letters = [*"abAB'sStTrevm l  \n\t\r\x0b\x0c\xa009²½éÉßſñ!?._<|>“”İʼn漢😀\x1c\x85", "<|endoftext|>", "'RE"]
    some = ["", None, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000))]
    for path in (BYTES, WORDS):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        e = PieceEncoder(path, remember=500, chars=20_000)
        got = [x.tolist() for at in range(0, len(some), 100) for x in e.encode(some[at : at + 100])]
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in some]
    decode = byte_bpe.ByteDecoder(BYTES)
    ids = PieceEncoder(BYTES).encode(["naïve 漢字 😀"])[0]
    assert decode.decode(ids.tolist()).decode() == "naïve 漢字 😀"
    spans = decode.offsets("naïve 漢字 😀", ids)
    assert spans[0][0] == 0 and spans[-1][1] == 10 and (np.diff(spans[:, 0]) >= 0).all()


def test_bpe_digests(spark, docs, edges):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = docs.select("doc_id", "text").union(edges.select(F.col("doc_id") + 1000, "text").filter("doc_id is not null").dropDuplicates())
    held = texts(df)
    for r in byte_bpe.round_trip_digests(df, BYTES).collect():
        t = held[r["doc_id"]] or ""
        ids = own.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_token_store(spark, docs, edges, tmp_path):
    path = str(tmp_path / "tokens")
    got = token_store.store_digests(docs, BYTES, path=path).orderBy("doc_id").collect()
    e, held, at = PieceEncoder(BYTES), texts(docs), 0
    for r in got:
        ids = np.append(e.encode([held[r["doc_id"]]])[0], 2).astype("<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert [r["doc_id"] for r in token_store.read_tokens(spark, path, 5, 7).orderBy("doc_id").collect()] == [5, 6, 7]
    assert token_store.store_digests(edges, BYTES).count() == len(EDGES) and token_store.store_digests(edges.limit(0), BYTES).count() == 0


def test_packing(spark, docs, edges):
    for df in (docs, edges):
        got = packing.pack(df, WORDS, 256, with_ids=True).toPandas().sort_values(["sequence_id", "offset"])
        assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 256
        assert (got.ids.map(len) == got.length).all() and all(zlib.crc32(np.array(i, "<u4")) == c for i, c in zip(got.ids, got.ids_crc32, strict=True))
        assert len(got.groupby(got.doc_id.fillna(-1)).size()) == len({r["doc_id"] for r in df.select("doc_id").collect()})
        assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 256 + 1
    assert packing.pack(edges.limit(0), WORDS).count() == 0


def test_best_fit_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = sorted(rng.integers(1, 60, rng.integers(1, 400)).tolist(), reverse=True)
        room: list[int] = []
        for n in lengths:
            fits = [(r, i) for i, r in enumerate(room) if r >= n]
            i = min(fits)[1] if fits else len(room)
            room += [64] * (i == len(room))
            room[i] -= n
        plan, bins = packing.best_fit_plan({n: lengths.count(n) for n in set(lengths)}, 64)
        assert bins == len(room)
        left = np.full(bins, 64)
        for n in set(lengths):
            where, _ = packing.placed(plan, n, np.arange(lengths.count(n)))
            np.subtract.at(left, where, n)
        assert sorted(left.tolist()) == sorted(room)


def test_toxicity(spark, docs, edges):
    rng = np.random.default_rng(6)
    clean = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(900):
        t = [" ".join(rng.choice(clean, 8)) for _ in range(5)]
        if bad := i % 6 == 0:
            t[2] += f" scum{'ing' * (i % 2)} fool"
        rows.append((i, ". ".join(t), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score_documents(df, df.select("doc_id", "toxic")).join(df.select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 200 and (got.predicted == got.toxic).mean() > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.to_dict("records"))
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    where = model.locate(rows[0][1])
    assert len(where) == 1 and "fool" in rows[0][1][where[0][0] : where[0][1]]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score_documents(edges, none).collect()} == {0}
    assert toxicity.score_documents(edges.limit(0), none).count() == 0


def test_language(spark, docs, edges):
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()
    model = language.fit(docs)
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(edges.filter("doc_id <> 5"), model).collect()}
    assert found[1] == found[2] == found[3] == "und"
    assert language.identify(edges.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language.identify(edges.limit(0)).count() == 0


def brute_removed(held):
    first, out = {}, {}
    for i in sorted(held):
        w = WORD.findall(held[i] or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
        gone = {k + j for k in range(len(w) - 12) for j in range(13) if first[tuple(w[k : k + 13])] < i}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_substring_dedup(spark, docs, edges):
    passage = " ".join(f"p{i}" for i in range(20))
    extra = spark.createDataFrame([(1001, f"a b {passage} c"), (1002, f"d\n{passage}"), (1003, " ".join(f"p{i}" for i in range(13))), (1004, " ".join(f"p{i}" for i in range(12))), (1005, None), (1006, f"{passage}\n\n new {passage} end")], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra)
    want = brute_removed(texts(df))
    for parts in (1, 4):
        got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.dedup_digests(df, parts=parts).collect()}
        assert got == want
    cut = texts(substring_dedup.deduplicated(df))
    assert cut[1002] == "d" and 1003 not in cut and cut[1004] == "p0 p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 p11" and cut[1005] is None and cut[1006] == "new end"
    assert substring_dedup.dedup_digests(edges).count() == len(EDGES) and substring_dedup.dedup_digests(edges.limit(0)).count() == 0


def test_index_runs_are_compacted(spark, docs):
    index = substring_dedup.FingerprintIndex(spark, bits=4, fan=2)
    levels = []
    for i in range(7):
        index.append(docs.filter(F.col("doc_id") % 7 == i)).count()
        levels.append(list(index.levels.values()))
    assert levels == [[0], [1], [1, 0], [2], [2, 0], [2, 1], [2, 1, 0]]
    for row in index.blocks().collect():
        keys = np.frombuffer(row["keys"], "<u8")
        assert (np.diff(keys.astype(object)) >= 0).all() and ((keys >> np.uint64(60)) == row["bucket"]).all()


def grams(df):
    return {tuple(r) for r in df.collect()}


def test_index_is_opened_again(spark, docs, tmp_path):
    """Appends through fresh handles find what one handle finds, and a merge leaves other levels' files alone."""
    parts = [docs.filter(F.col("doc_id") % 6 == i) for i in range(6)]
    one, path = substring_dedup.FingerprintIndex(spark, bits=4), str(tmp_path / "index")
    runs = []
    for part in parts:
        want = grams(one.append(part))
        index = substring_dedup.FingerprintIndex(spark, path, bits=4 if not runs else None)
        assert grams(index.append(part)) == want
        runs.append(set(index.levels.items()))
    assert {x for x in runs[3] if x[1] == 2} <= runs[5] and index.runs == one.runs and index.bits == 4
    held = {i for row in index.blocks().collect() for i in substring_dedup._unplaned(row["docs"]).tolist()}
    assert held == {i for i, t in texts(docs).items() if len(WORD.findall(t or "")) >= 13}
    assert sorted(n for n in os.listdir(path) if n.startswith("run-")) == sorted(index.runs) and len([n for n in os.listdir(f"{path}/manifest") if n.endswith(".json")]) == 1
    late = substring_dedup.FingerprintIndex(spark, path)
    index.append(parts[0])
    with pytest.raises(FileExistsError):
        late.append(parts[1])
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark, path, bits=5)


def test_a_failed_batch_leaves_the_index(spark, docs, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    substring_dedup.FingerprintIndex(spark, path, bits=4).append(docs.filter("doc_id % 2 = 0"))
    broken = substring_dedup.FingerprintIndex(spark, path)
    monkeypatch.setattr(broken, "_shared_with", lambda name: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken.append(docs.filter("doc_id % 2 = 1"))
    again = substring_dedup.FingerprintIndex(spark, path)
    assert again.runs == ["run-1"]
    got = again.append(docs.filter("doc_id % 2 = 1"))
    whole = substring_dedup.FingerprintIndex(spark, bits=4)
    whole.append(docs.filter("doc_id % 2 = 0"))
    assert grams(got) == grams(whole.append(docs.filter("doc_id % 2 = 1")))


def test_callers_columns_come_back(spark, edges):
    passage = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(100, passage), (101, f"x {passage}")], "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH}).unionByName(edges)
    got = substring_dedup.deduplicated(df)
    assert got.schema == df.schema or [f.dataType for f in got.schema] == [f.dataType for f in df.schema]
    rows = got.collect()
    assert len(rows) == len(EDGES) + 2 and {r[c] for r in rows for c in CLASH} == {"x"}
    assert {r["doc_id"]: r["text"] for r in rows}[101] == "x"
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in rows if (r["doc_id"] or 0) < 100) == sorted((str(a), str(b)) for a, b in EDGES)


def test_pipeline(spark):
    import corpus_pipeline

    df = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, df, SF)
        assert after.columns == df.columns and 0 < after.count() <= df.count(), name
        df = after
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.columns) >= {"doc_id", "sequence_id", "offset", "length"} and got.groupby("sequence_id").length.sum().max() <= 4096
