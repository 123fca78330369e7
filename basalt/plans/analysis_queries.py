"""Registered queries: text, dedup, packing, quality, analysis, labels, metrics, chat, catalogue and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chat
from ..functions import text as X
from ..functions.hashing import hash_key, sql_hash
from ..operators import analysis, catalog, dedup, labels, packing, prep, profile, quality, splits
from ..sources import files
from ..storage import written
from ..streaming import streams
from .queries import _rounded, add, table

_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"
_W = _WORDS.format("text")


def _docs(s: SparkSession, d: str, *columns) -> DataFrame:
    return table(s, d, "documents").select("doc_id", *columns)


def _alternatives(pattern: str) -> str:
    return pattern.replace("'", "''")


# --- text ------------------------------------------------------------------------------------------------------------
_PII_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{_alternatives(p)}') THEN '{k}' END" for k, p in X.PII.items()) + "], lambda x: x IS NOT NULL)"
add("text_pii", lambda s, d: _docs(s, d, F.array_join(X.detect_pii(F.col("text")), ",").alias("pii")), f"SELECT doc_id, array_to_string({_PII_SQL}, ',') AS pii FROM documents")
_MASK_SQL = "text"
for _k, _m in X.MASKS.items():
    _MASK_SQL = f"regexp_replace({_MASK_SQL}, '{_alternatives(X.PII[_k])}', '{_m}', 'g')"
add("text_mask_pii", lambda s, d: _docs(s, d, F.md5(X.mask_pii(F.col("text"))).alias("masked")), f"SELECT doc_id, md5({_MASK_SQL}) AS masked FROM documents")
_TOX_SQL = f"""least(least(({" + ".join(f"contains(lower(text), '{p}')::int" for p in X.TOXIC)}) / 12.0::double
 + CASE WHEN length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / greatest(length(text), 1) > 0.5 AND len({_W}) > 5 THEN 0.2::double ELSE 0 END, 1.0)
 + CASE WHEN length(regexp_replace(text, '[^!]', '', 'g')) / greatest(length(text), 1) > 0.05 THEN 0.1::double ELSE 0 END, 1.0)"""
add("text_toxicity", lambda s, d: _docs(s, d, F.round(X.toxicity_score(F.col("text")), 6).alias("toxicity")), f"SELECT doc_id, round({_TOX_SQL}, 6) AS toxicity FROM documents")
_SCORES = {k: f"least(({' + '.join(f"contains(lower(text), '{w}')::int" for w in v.split())}) / greatest(greatest(strlen(text), 1) / 10.0::double, 1.0), 1.0::double)" for k, v in X.LANGUAGES.items()}
_BEST = f"greatest({', '.join(_SCORES)})"
add("text_language", lambda s, d: _docs(s, d, X.detect_language(F.col("text")).alias("l")).select("doc_id", "l.lang", F.round("l.confidence", 6).alias("confidence")), f"SELECT doc_id, CASE WHEN {_BEST} <= 0 THEN 'unknown' {' '.join(f"WHEN {k} = {_BEST} THEN '{k}'" for k in _SCORES)} END AS lang, round({_BEST}, 6) AS confidence FROM (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _SCORES.items())} FROM documents)")


def _grams(n: int, text: str = "text") -> str:
    """(doc_id, g): every window of n words."""
    lead = ", ".join(f"lead(w, {k}) OVER o" for k in range(1, n))
    rows = f"SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {_WORDS.format(text)} AS w FROM documents)"
    return f"(SELECT doc_id, g FROM (SELECT doc_id, concat_ws(' ', w, {lead}) AS g, lead(w, {n - 1}) OVER o AS z FROM ({rows}) WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE z IS NOT NULL)"


_REP = f"(SELECT doc_id, (count(*) - count(DISTINCT g)) / count(*) AS r FROM {_grams(4)} GROUP BY doc_id)"
add("text_repetition", lambda s, d: _docs(s, d, F.round(X.repetition_ratio(F.col("text")), 6).alias("repetition")), f"SELECT doc_id, round(coalesce(r, 0.0), 6) AS repetition FROM documents LEFT JOIN {_REP} USING (doc_id)")
_LEN = "length(text)"
_ISSUES = {
    "text_too_short": (0.3, f"{_LEN} < 50"),
    "text_too_long": (0.2, f"{_LEN} > 100000"),
    "too_few_words": (0.3, "len(w) < 10"),
    "high_repetition": (0.3, "coalesce(r, 0.0) > 0.3"),
    "high_special_chars": (0.2, rf"({_LEN} - length(regexp_replace(text, '[^\p{{L}}\p{{N}}\s]', '', 'g'))) / greatest({_LEN}, 1) > 0.3"),
    "low_alphanumeric": (0.2, rf"length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) / greatest({_LEN}, 1) < 0.5"),
    "too_many_urls": (0.2, r"len(regexp_extract_all(text, 'https?://[^\s]+')) / greatest(len(w), 1) > 0.2"),
    "no_sentence_endings": (0.1, "length(regexp_replace(text, '[^.!?。]', '', 'g')) = 0 AND len(w) > 20"),
}
_QUALITY_SQL = f"SELECT doc_id, round(greatest(1.0::double - {' - '.join(f'CASE WHEN {c} THEN {p}::double ELSE 0 END' for p, c in _ISSUES.values())}, 0.0), 6) AS score, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, (_, c) in _ISSUES.items())}], lambda x: x IS NOT NULL), ',') AS issues FROM (SELECT *, {_W} AS w FROM documents LEFT JOIN {_REP} USING (doc_id))"
add("text_quality", lambda s, d: _docs(s, d, X.quality(F.col("text")).alias("q")).select("doc_id", F.round("q.score", 6).alias("score"), F.array_join("q.issues", ",").alias("issues")), _QUALITY_SQL)
add("text_char_ratios", lambda s, d: _docs(s, d, *(F.round(X.char_ratio(F.col("text"), k), 6).alias(k) for k in X.RANGES)), "SELECT doc_id, " + ", ".join(f"round(length(regexp_replace(text, '[^{p}]', '', 'g')) / greatest(length(text), 1), 6) AS {k}" for k, p in X.RANGES.items()) + " FROM documents")
add("text_tokens", lambda s, d: _docs(s, d, F.size(X.simple_tokens(F.col("text"))).cast("long").alias("tokens"), X.token_estimate(F.col("text")).alias("estimate")), r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_replace(x, '[^\p{L}\p{N}_-]', '', 'g')), lambda x: x <> '')) AS tokens, ceil(length(text) / 4.0::double)::bigint AS estimate FROM documents")
_GRAMS3 = "SELECT doc_id, CASE WHEN len(l) < 3 THEN [] ELSE list_distinct(list_transform(range(1, len(l) - 1), lambda i: concat(l[i], l[i + 1], l[i + 2]))) END AS g FROM (SELECT doc_id, string_split(text, '') AS l FROM documents)"
add(
    "text_jaccard_next",
    lambda s, d: _docs(s, d, F.array_distinct(X.char_ngrams(F.col("text"), 3)).alias("t")).join(_docs(s, d, F.array_distinct(X.char_ngrams(F.col("text"), 3)).alias("u")).select((F.col("doc_id") - 1).alias("doc_id"), "u"), "doc_id").select("doc_id", F.round(X.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard")),
    f"WITH n AS ({_GRAMS3}) SELECT doc_id, round(CASE WHEN z = 0 THEN 1.0 ELSE x / z END, 6) AS jaccard FROM (SELECT a.doc_id, len(list_intersect(a.g, b.g)) AS x, len(list_distinct(list_concat(a.g, b.g))) AS z FROM n a JOIN n b ON a.doc_id = b.doc_id - 1)",
)
_CURATED = "total passed with_pii toxic low_quality bad_length pass_rate"
add(
    "curation_report",
    lambda s, d: _rounded(quality.curation_report(quality.curate(table(s, d, "documents"), "text")), {"pass_rate": 6}),
    f"WITH q AS ({_QUALITY_SQL}), c AS (SELECT q.*, len({_PII_SQL}) > 0 AS pii, {_TOX_SQL} AS tox, length(text) BETWEEN 10 AND 1000000 AND len({_W}) BETWEEN 3 AND 100000 AS ok FROM q JOIN documents USING (doc_id)), r AS (SELECT *, issues = '' AND ok AND tox <= 0.7 AND NOT pii AS p FROM c) SELECT count(*) AS total, count_if(p)::bigint AS passed, count_if(pii)::bigint AS with_pii, count_if(tox > 0.7)::bigint AS toxic, count_if(issues <> '')::bigint AS low_quality, count_if(NOT ok)::bigint AS bad_length, round(count_if(p) / count(*), 6) AS pass_rate FROM r",
)
_BUCKETS = lambda x, bounds: ", ".join(f"count_if({' + '.join(f'({x} >= {b})::int' for b in bounds)} = {i})::bigint AS bucket_{i}" for i in range(len(bounds) + 1))
add("corpus_lengths", lambda s, d: _rounded(quality.length_stats(table(s, d, "documents"), "text"), {"avg_chars": 6, "avg_words": 6, "median_chars": 3, "median_words": 3}), f"SELECT min(c) AS min_chars, max(c) AS max_chars, round(avg(c), 6) AS avg_chars, round(list_sort(list(c))[count(*) // 2 + 1]::double, 3) AS median_chars, min(w)::int AS min_words, max(w)::int AS max_words, round(avg(w), 6) AS avg_words, round(list_sort(list(w))[count(*) // 2 + 1]::double, 3) AS median_words, {_BUCKETS('c', quality.LENGTHS)} FROM (SELECT length(text)::int AS c, len({_W}) AS w FROM documents)")
add("corpus_tokens", lambda s, d: _rounded(quality.token_stats(table(s, d, "documents"), "text"), {"mean_tokens": 6}), f"SELECT sum(len(w))::bigint AS tokens, round(avg(len(w)), 6) AS mean_tokens, {_BUCKETS('len(w)', quality.TOKENS)}, (SELECT count(DISTINCT t) FROM (SELECT unnest({_W}) AS t FROM documents)) AS distinct_tokens FROM (SELECT {_W} AS w FROM documents)")
add("corpus_vocabulary", lambda s, d: _rounded(quality.vocabulary(table(s, d, "documents"), "text"), {"type_token_ratio": 6}), rf"SELECT sum(n)::bigint AS words, count(*) AS vocabulary, count_if(n = 1)::bigint AS hapax, round(count(*) / sum(n), 6) AS type_token_ratio FROM (SELECT w, count(*) AS n FROM (SELECT regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS w FROM (SELECT unnest({_WORDS.format('lower(text)')}) AS w FROM documents)) WHERE w <> '' GROUP BY w)")
_GN = lambda n: f"SELECT g, count(*) AS n FROM {_grams(n, 'lower(text)')} GROUP BY g"
add("corpus_ngrams", lambda s, d: _rounded(quality.ngram_diversity(table(s, d, "documents"), "text"), {"distinct_2": 6, "distinct_3": 6, "repeated_2": 6, "repeated_3": 6}), f"SELECT * FROM (SELECT round(count(*) / sum(n), 6) AS distinct_2, round(sum(CASE WHEN n > 3 THEN n ELSE 0 END) / sum(n), 6) AS repeated_2 FROM ({_GN(2)})), (SELECT round(count(*) / sum(n), 6) AS distinct_3, round(sum(CASE WHEN n > 3 THEN n ELSE 0 END) / sum(n), 6) AS repeated_3 FROM ({_GN(3)}))")

# --- dedup -----------------------------------------------------------------------------------------------------------
add("dedup_row_report", lambda s, d: _rounded(dedup.exact_report(table(s, d, "lineitem"), ["l_partkey", "l_quantity", "l_returnflag"]), {"rate": 6}), "SELECT sum(n)::bigint AS rows, count_if(n > 1)::bigint AS groups, coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0)::bigint AS duplicates, coalesce(max(CASE WHEN n > 1 THEN n END), 0)::bigint AS largest, round(coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0) / sum(n), 6) AS rate FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_quantity, l_returnflag)")
add("dedup_exact_text", lambda s, d: dedup.exact_text(_docs(s, d, "text"), "doc_id", "text").drop("text"), "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS cluster, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate FROM documents")
add("dedup_by_dataset", lambda s, d: dedup.leaders(table(s, d, "documents"), "doc_id", "text", "source"), "SELECT source, count(*) AS rows, count_if(doc_id <> c)::bigint AS duplicates, count_if(doc_id <> c AND f <> source)::bigint AS cross_dataset FROM (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY text) AS c, arg_min(source, doc_id) OVER (PARTITION BY text) AS f FROM documents) GROUP BY source")
_HEX = "sha256(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey, 'c_mktsegment': c_mktsegment})::varchar)"
add("dedup_digest", lambda s, d: dedup.dataset_digest(table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")), f"SELECT sha256(concat_ws('|', count(*)::varchar, {', '.join(f'sum(h{i})::hugeint::varchar' for i in range(4))})) AS digest FROM (SELECT {', '.join(f"cast(concat('0x', substr(h, {1 + 15 * i}, 15)) as bigint)::hugeint AS h{i}" for i in range(4))} FROM (SELECT {_HEX} AS h FROM customer))")
_P = dedup.PRIME
_M31 = lambda x: f"cast(concat('0x', substr(md5({x}), 1, 8)) as bigint)"
_MIN = ", ".join(f"min((({_M31(f"'a|{p}'")} % {_P - 1} + 1) * h + {_M31(f"'b|{p}'")} % {_P}) % {_P}) AS x{p}" for p in range(128))
_SIG = f"SELECT doc_id, [{', '.join(f'x{p}' for p in range(128))}] AS s FROM (SELECT doc_id, {_MIN} FROM (SELECT doc_id, {_M31('g')} % {_P} AS h FROM (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, concat(c, lead(c, 1) OVER o, lead(c, 2) OVER o, lead(c, 3) OVER o, lead(c, 4) OVER o) AS g, lead(c, 4) OVER o AS z FROM (SELECT doc_id, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM (SELECT doc_id, string_split(trim(text), '') AS c FROM documents WHERE strlen(trim(text)) BETWEEN 50 AND 100000)) WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE z IS NOT NULL)) GROUP BY doc_id)"
add("dedup_minhash", lambda s, d: dedup.minhash(_docs(s, d, "text"), "doc_id", "text").select("doc_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature")), f"SELECT doc_id, array_to_string(s, ',') AS signature FROM ({_SIG})")
_BAND = f"SELECT doc_id, b - 1 AS band, md5(concat(b - 1, '|', array_to_string(s[8 * b - 7:8 * b], ','))) AS h FROM ({_SIG}), range(1, 17) t(b)"


def _banded(s: SparkSession, d: str) -> DataFrame:
    return dedup.bands(written(dedup.minhash(_docs(s, d, "text"), "doc_id", "text")), "doc_id", 16, 8)


add("dedup_lsh_stars", lambda s, d: dedup.candidate_pairs(_banded(s, d), "doc_id", star=True), f"WITH b AS ({_BAND}) SELECT DISTINCT m AS a, doc_id AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY band, h) AS m FROM b) WHERE m < doc_id")
add("dedup_lsh_stats", lambda s, d: _rounded(dedup.bucket_stats(_banded(s, d), "doc_id"), {"mean": 6}), f"WITH b AS ({_BAND}) SELECT count(*) AS buckets, sum(n)::bigint AS entries, round(avg(n), 6) AS mean, (SELECT count(DISTINCT doc_id) FROM b) AS documents FROM (SELECT count(*) AS n FROM b GROUP BY band, h)")


#: Distinct signatures by their smallest document, and their pairs that share a band and agree in 0.8 of the places.
_REPS = f"reps AS MATERIALIZED (SELECT s, min(doc_id) AS id FROM ({_SIG}) GROUP BY s), held AS MATERIALIZED (SELECT doc_id, id FROM ({_SIG}) JOIN reps USING (s))"
_LINKS = "banded AS (SELECT id, s, b - 1 AS band, md5(concat(b - 1, '|', array_to_string(s[8 * b - 7:8 * b], ','))) AS h FROM reps, range(1, 17) t(b)), links AS MATERIALIZED (SELECT DISTINCT x.id AS a, y.id AS b FROM banded x JOIN banded y ON x.band = y.band AND x.h = y.h AND x.id < y.id WHERE list_sum(list_transform(range(1, 129), lambda i: (x.s[i] = y.s[i])::int)) >= 0.8 * 128)"
add(
    "dedup_clusters",
    lambda s, d: dedup.similar_texts(dedup.minhash(_docs(s, d, "text"), "doc_id", "text"), "doc_id"),
    f"WITH RECURSIVE {_REPS}, {_LINKS}, g AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), r AS (SELECT id, id AS m FROM reps UNION SELECT g.b, r.m FROM r JOIN g ON r.id = g.a) SELECT doc_id, (SELECT min(m) FROM r WHERE r.id = held.id) AS cluster FROM held",
)
add(
    "dedup_keep_first",
    lambda s, d: dedup.similar_leaders(dedup.minhash(_docs(s, d, "text"), "doc_id", "text"), "doc_id"),
    f"WITH RECURSIVE {_REPS}, {_LINKS}, n AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS i, coalesce(near, []) AS near FROM reps LEFT JOIN (SELECT b AS id, list(a) AS near FROM links GROUP BY b) USING (id)), "
    "r AS (SELECT 0::bigint AS i, []::bigint[] AS kept UNION ALL SELECT n.i, CASE WHEN len(list_intersect(n.near, r.kept)) = 0 THEN list_append(r.kept, n.id) ELSE r.kept END FROM r JOIN n ON n.i = r.i + 1), "
    "k AS (SELECT kept FROM r ORDER BY i DESC LIMIT 1), o AS (SELECT id, CASE WHEN list_contains(kept, id) THEN id ELSE list_min(list_intersect(near, kept)) END AS keeper FROM n, k) SELECT doc_id, keeper FROM held JOIN o USING (id)",
)
add("dedup_near_rows", lambda s, d: _rounded(dedup.near_rows(table(s, d, "supplier").withColumn("s_acctbal", F.round("s_acctbal", -3)), "s_suppkey", ["s_nationkey", "s_acctbal"], 0.3), {"similarity": 6}), "WITH c AS (SELECT s_suppkey AS k, list_distinct([lower(trim(s_nationkey::varchar)), lower(trim((round(s_acctbal, -3) + 0.0::double)::varchar))]) AS s FROM supplier), h AS (SELECT *, list_min(list_transform(s, lambda x: md5(x))) AS h FROM c), z AS (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM h) SELECT x.k AS a, y.k AS b, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 6) AS similarity FROM z x JOIN z y ON x.h = y.h AND x.k < y.k WHERE x.n BETWEEN 2 AND 100 AND len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) >= 0.3")

# --- packing and batches ---------------------------------------------------------------------------------------------
_BIN = {"first_fit": "list_position(list_transform(room, lambda x: x >= n), true)", "best_fit": "list_position(room, list_min(list_filter(room, lambda x: x >= n)))"}
_BIN["greedy"] = _BIN["first_fit"]
for _s in ("first_fit", "best_fit", "greedy"):
    _shard = f"{sql_hash('pack', 'doc_id')} % greatest(1, (SELECT (count(*) + 1999) // 2000 FROM documents))" if _s == "first_fit" else "0"
    _order = "doc_id" if _s == "first_fit" else "n DESC, doc_id"
    add(
        f"packing_{_s}",
        lambda s, d, how=_s: _rounded(packing.report(packing.pack(table(s, d, "documents"), "doc_id", "n_chars", 8192, how), 8192).select("rows", "tokens", "bins", "efficiency"), {"efficiency": 6}),
        f"WITH RECURSIVE z AS (SELECT doc_id, least(n_chars, 8192) AS n, {_shard} AS shard FROM documents), o AS MATERIALIZED (SELECT shard, n, row_number() OVER (PARTITION BY shard ORDER BY {_order}) AS i FROM z), "
        f"r AS (SELECT DISTINCT shard, 0::bigint AS i, []::bigint[] AS room FROM o UNION ALL SELECT shard, i, CASE WHEN pos IS NULL THEN list_append(room, 8192 - n) ELSE list_concat(list_append(room[:pos - 1], room[pos] - n), room[pos + 1:]) END FROM (SELECT o.shard, o.i, o.n, r.room, nullif({_BIN[_s]}, 0) AS pos FROM r JOIN o ON o.shard = r.shard AND o.i = r.i + 1)), "
        "e AS (SELECT shard, arg_max(len(room), i) AS bins FROM r GROUP BY shard) SELECT count(*) AS rows, sum(n)::bigint AS tokens, (SELECT sum(bins)::bigint FROM e) AS bins, round(sum(n) / ((SELECT sum(bins) FROM e) * 8192), 6) AS efficiency FROM z",
    )
add("packing_none", lambda s, d: table(s, d, "orders").select("o_orderkey", packing.no_pack(F.sequence(F.lit(1), (F.col("o_orderkey") % 9 + 1).cast("int")), 6, 99, 7).alias("p")).select("o_orderkey", F.array_join(F.transform("p.ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join(F.transform("p.mask", lambda x: x.cast("string")), ",").alias("mask")), "SELECT o_orderkey, array_to_string(list_concat(list_append(range(1, k + 1), 99), [7, 7, 7, 7, 7, 7])[1:6], ',') AS ids, array_to_string(list_transform(range(1, 7), lambda i: (i <= k + 1)::int), ',') AS mask FROM (SELECT o_orderkey, o_orderkey % 9 + 1 AS k FROM orders)")
_MH = sql_hash(42, "concat_ws('|', o_orderkey, i)")
add(
    "mask_tokens",
    lambda s, d: table(s, d, "orders").select("o_orderkey", splits.mask_tokens(F.sequence(F.lit(10), (F.col("o_orderkey") % 23 + 10).cast("int")), F.col("o_orderkey"), 1000, 4, special=(10,)).alias("m")).select("o_orderkey", F.array_join(F.transform("m.labels", lambda x: x.cast("string")), ",").alias("labels")),
    f"WITH t AS (SELECT o_orderkey, o_orderkey % 23 + 1 AS n, unnest(range(0, o_orderkey % 23 + 1)) AS i FROM orders), h AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, i = 0 ORDER BY {_MH}, i) AS k FROM t) SELECT o_orderkey, string_agg(CASE WHEN i > 0 AND k <= ceil((n - 1) * 0.15::double) THEN i + 10 ELSE -100 END, ',' ORDER BY i) AS labels FROM h GROUP BY o_orderkey",
)

# --- quality ---------------------------------------------------------------------------------------------------------
_COLS = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]
_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) AS t, count(*) - count({c}) AS z, count(DISTINCT {c}) AS u, (SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY {c})) AS top FROM customer" for c in _COLS)


def _tops(s: SparkSession, d: str) -> DataFrame:
    from functools import reduce

    one = lambda c: table(s, d, "customer").groupBy(c).count().agg(F.max("count").alias("top")).select(F.lit(c).alias("column"), "top")
    return reduce(DataFrame.unionByName, map(one, _COLS))


add(
    "quality_score",
    lambda s, d: _rounded(quality.dataset_score(profile.column_profiles(table(s, d, "customer"), _COLS), _tops(s, d)), {"information": 6, "score": 6}),
    f"SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' WHEN score >= 40 THEN 'poor' ELSE 'critical' END AS grade FROM (SELECT completeness, consistency, round(information, 6) AS information, balance, round(completeness * 0.35::double + consistency * 0.25::double + information * 0.25::double + balance * 0.15::double, 6) AS score FROM (SELECT (1 - sum(z) / greatest(sum(t), 1)) * 100 AS completeness, 100 - 100 * count_if(u = 0) / count(*) AS consistency, avg(CASE WHEN u <= 1 THEN 20 WHEN u / t > 0.95 THEN 50 WHEN u / t > 0.5 THEN 95 ELSE 75 + 20 * (u / t) END) AS information, greatest(100 - sum(CASE WHEN top / t > 0.9 AND t > 50 THEN 20.0::double WHEN top / t > 0.7 THEN 10 ELSE 0 END), 0) AS balance FROM ({_PROFILE})))",
)
_E = quality.Expectation
_CHECKS = [_E("not_null", "c_custkey"), _E("unique", "c_nationkey", severity="warning"), _E("in_range", "c_acctbal", 0, 9000), _E("in_set", "c_mktsegment", values=("MACHINERY", "BUILDING"), severity="info"), _E("row_count", None, 1, 10_000_000)]
_CHECK_SQL = "SELECT e AS expectation, c AS \"column\", s AS severity, f::bigint AS failures, f = 0 AS passed FROM (SELECT 'not_null' AS e, 'c_custkey' AS c, 'error' AS s, 0 AS f UNION ALL SELECT 'unique', 'c_nationkey', 'warning', count(c_nationkey) - count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'in_range', 'c_acctbal', 'error', count_if(c_acctbal < 0 OR c_acctbal > 9000) FROM customer UNION ALL SELECT 'in_set', 'c_mktsegment', 'info', count_if(c_mktsegment NOT IN ('MACHINERY', 'BUILDING')) FROM customer UNION ALL SELECT 'row_count', '', 'error', 0)"
add("quality_expectations", lambda s, d: quality.check(table(s, d, "customer"), _CHECKS), _CHECK_SQL)
add("quality_expectation_report", lambda s, d: quality.expectation_report(quality.check(table(s, d, "customer"), _CHECKS)), f"SELECT count_if(passed)::bigint AS passed, count_if(NOT passed AND severity = 'error')::bigint AS failed_error, count_if(NOT passed AND severity = 'warning')::bigint AS failed_warning, count_if(NOT passed AND severity = 'info')::bigint AS failed_info, count_if(NOT passed AND severity = 'error') = 0 AS ok FROM ({_CHECK_SQL})")
add("quality_suggested", lambda s, d: (lambda t: quality.check(t, quality.suggested(profile.column_profiles(t, ["c_custkey", "c_acctbal"]))).select("expectation", "column", "passed"))(table(s, d, "customer")), "SELECT * FROM (VALUES ('row_count', '', true), ('not_null', 'c_acctbal', true), ('in_range', 'c_acctbal', true), ('not_null', 'c_custkey', true), ('in_range', 'c_custkey', true), ('unique', 'c_custkey', true)) AS v(expectation, \"column\", passed) UNION ALL SELECT 'unique', 'c_acctbal', true FROM customer HAVING count(DISTINCT c_acctbal) = count(*)")
add("quality_gate", lambda s, d: table(s, d, "customer").select("c_custkey", quality.gate(F.col("c_acctbal"), 0, 9000, "stop").alias("g")).select("c_custkey", "g.passed", "g.action"), "SELECT c_custkey, c_acctbal BETWEEN 0 AND 9000 AS passed, CASE WHEN c_acctbal BETWEEN 0 AND 9000 THEN 'continue' ELSE 'stop' END AS action FROM customer")
add("quality_dashboard", lambda s, d: _rounded(quality.dashboard(table(s, d, "documents").groupBy(F.col("source").alias("dataset"), F.col("lang").alias("at")).agg(F.round(F.avg("n_chars") / 5000, 6).alias("score"))), {"trend": 6}).select("dataset", "at", "score", "trend", "level", "rank"), "WITH s AS (SELECT source AS dataset, lang AS moment, round(avg(n_chars) / 5000, 6) AS score FROM documents GROUP BY ALL), l AS (SELECT *, score - lag(score) OVER (PARTITION BY dataset ORDER BY moment) AS trend, row_number() OVER (PARTITION BY dataset ORDER BY moment DESC) AS k FROM s) SELECT dataset, moment AS \"at\", score, round(trend, 6) AS trend, CASE WHEN score >= 0.9 THEN 'excellent' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.5 THEN 'fair' ELSE 'poor' END AS level, row_number() OVER (ORDER BY score DESC, dataset)::int AS rank FROM l WHERE k = 1")
add("quality_monitor", lambda s, d: _rounded(quality.monitor(table(s, d, "orders").select(F.sequence(F.lit(1), (F.col("o_orderkey") % 700 + 1).cast("int")).alias("input_ids"), F.col("o_orderstatus").alias("label"))), {c: 6 for c in ("mean_length", "median_length", "p95_length", "truncated", "label_entropy", "label_imbalance")}), "WITH o AS (SELECT o_orderkey % 700 + 1 AS k, o_orderstatus AS l FROM orders), c AS (SELECT count(*) AS n FROM o GROUP BY l), t AS (SELECT n, n / sum(n) OVER () AS p FROM c) SELECT count(*) AS samples, sum(k)::bigint AS tokens, round(avg(k), 6) AS mean_length, round(quantile_cont(k::double, 0.5), 6) AS median_length, round(quantile_cont(k::double, 0.95), 6) AS p95_length, max(k)::int AS max_length, round(count_if(k > 512) / count(*), 6) AS truncated, (SELECT round(-sum(p * log2(p)), 6) FROM t) AS label_entropy, (SELECT round(max(n) / min(n), 6) FROM t) AS label_imbalance FROM o")

# --- analysis --------------------------------------------------------------------------------------------------------


def _old_new(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(s, d, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    return o.filter("o_orderdate < '1998-01-01'").drop("o_orderdate"), o.filter("o_orderdate >= '1998-01-01'").withColumn("o_totalprice", F.col("o_totalprice") * 1.4).drop("o_orderdate")


add("drift_schema", lambda s, d: analysis.schema_drift(table(s, d, "orders"), table(s, d, "orders").withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("extra", F.lit(1)).drop("o_orderpriority")), "SELECT * FROM (VALUES ('o_custkey', 'retyped', 'bigint', 'string'), ('extra', 'added', NULL, 'int'), ('o_orderpriority', 'removed', 'string', NULL)) AS v(\"column\", change, from_type, to_type)")
_STAT = "SELECT '{c}' AS c, count(DISTINCT {c}) AS u, avg({c}) AS m, stddev_pop({c}) AS s FROM {t}"
_SIDES = "WITH o AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderdate < '1998-01-01'), n AS (SELECT o_custkey, o_totalprice * 1.4 AS o_totalprice FROM orders WHERE o_orderdate >= '1998-01-01'), a AS (" + " UNION ALL ".join(_STAT.format(c=c, t="o") for c in ("o_custkey", "o_totalprice")) + "), b AS (" + " UNION ALL ".join(_STAT.format(c=c, t="n") for c in ("o_custkey", "o_totalprice")) + "), j AS (SELECT a.c, abs(b.u - a.u) / greatest(a.u, 1) AS card, abs(b.m - a.m) / abs(a.m) AS dm, abs(b.s - a.s) / abs(a.s) AS ds, 0.5 * pow(least(abs(b.m - a.m) / a.s, 10), 2) + 0.5 * least(abs(ln(b.s / a.s)), 10) AS psi FROM a JOIN b ON a.c = b.c) "
add("drift_distribution", lambda s, d: (lambda o, n: _rounded(analysis.distribution_drift(profile.column_profiles(o), profile.column_profiles(n)), {"value": 6}))(*_old_new(s, d)), _SIDES + "SELECT c AS \"column\", 'cardinality' AS drift, round(card, 6) AS value, CASE WHEN card < 0.3 THEN 'low' WHEN card < 0.5 THEN 'medium' ELSE 'high' END AS severity FROM j WHERE card > 0.1 UNION ALL SELECT c, 'distribution', round(psi, 6), CASE WHEN psi < 0.25 THEN 'low' WHEN psi < 0.5 THEN 'medium' ELSE 'high' END FROM j WHERE (dm > 0.1 OR ds > 0.2 OR psi > 0.1) AND psi >= 0.1")
_HIST = "SELECT least(greatest(floor((o_totalprice - lo) / ((hi - lo) / 10)), 0), 9) AS b, count(*) / sum(count(*)) OVER () AS p FROM {}, e GROUP BY 1"
add("drift_psi", lambda s, d: (lambda o, n: _rounded(analysis.psi(o, n, "o_totalprice"), {"psi": 6}))(*_old_new(s, d)), "WITH o AS (SELECT o_totalprice FROM orders WHERE o_orderdate < '1998-01-01'), n AS (SELECT o_totalprice * 1.4 AS o_totalprice FROM orders WHERE o_orderdate >= '1998-01-01'), e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM o), x AS (" + _HIST.format("o") + "), y AS (" + _HIST.format("n") + ") SELECT round(sum((coalesce(y.p, 1e-4) - coalesce(x.p, 1e-4)) * ln(coalesce(y.p, 1e-4) / coalesce(x.p, 1e-4))), 6) AS psi FROM x FULL JOIN y ON x.b = y.b")
_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
add("correlations", lambda s, d: _rounded(analysis.correlations(table(s, d, "lineitem"), _LI), {"r": 6}), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_LI) for b in _LI[i + 1 :]))
add("correlations_high", lambda s, d: _rounded(analysis.high_correlations(analysis.correlations(table(s, d, "lineitem").withColumn("half", F.col("l_quantity") / 2 + F.col("l_tax")), ["l_quantity", "half", "l_discount"])), {"r": 6}), "SELECT 'l_quantity' AS a, 'half' AS b, round(corr(l_quantity, l_quantity / 2 + l_tax), 6) AS r, 'high' AS severity FROM lineitem")
add("correlation_ranking", lambda s, d: _rounded(analysis.target_ranking(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), {"r": 6}), "SELECT feature, round(r, 6) AS r, row_number() OVER (ORDER BY abs(r) DESC, feature)::int AS rank FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + ")")
add("imbalance", lambda s, d: _rounded(analysis.imbalance(table(s, d, "documents"), "lang"), {"ratio": 6, "effective": 4}), "SELECT classes, n, ratio, effective, CASE WHEN ratio <= 1.5 THEN 'balanced' WHEN ratio <= 3 THEN 'mild' WHEN ratio <= 10 THEN 'moderate' WHEN ratio <= 50 THEN 'severe' ELSE 'extreme' END AS level FROM (SELECT count(*) AS classes, max(t)::bigint AS n, round(max(c) / min(c), 6) AS ratio, round(count(*) / sum(t / c) * max(t), 4) AS effective FROM (SELECT count(*) AS c, sum(count(*)) OVER () AS t FROM documents GROUP BY lang))")
add("leakage_splits", lambda s, d: _rounded(analysis.split_leakage(splits.random_split(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"), "split", "o_custkey"), {"share": 6}), f"WITH r AS (SELECT o_custkey, CASE WHEN r < floor(n * 0.6::double) THEN 'train' WHEN r < floor(n * 0.6::double) + floor(n * 0.2::double) THEN 'val' ELSE 'test' END AS s FROM (SELECT o_custkey, row_number() OVER (ORDER BY {sql_hash(42, 'o_orderkey')}, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)), k AS (SELECT DISTINCT s, o_custkey AS k FROM r), z AS (SELECT s, count(*) AS n FROM k GROUP BY s), j AS (SELECT x.s AS a, y.s AS b, count(*) AS shared FROM k x JOIN k y ON x.k = y.k AND x.s < y.s GROUP BY ALL) SELECT a, b, shared, round(shared / least(p.n, q.n), 6) AS share, CASE WHEN shared / least(p.n, q.n) > 0.05 THEN 'critical' ELSE 'warning' END AS severity FROM j JOIN z p ON p.s = a JOIN z q ON q.s = b")
add("row_diff", lambda s, d: analysis.row_diff(table(s, d, "customer").filter("c_custkey % 10 <> 0"), table(s, d, "customer").filter("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 == 0, 0.5).otherwise(F.col("c_acctbal"))), ["c_custkey"]), "SELECT change, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'added' WHEN c_custkey % 7 = 0 THEN 'removed' WHEN c_custkey % 4 = 0 AND c_acctbal <> 0.5 THEN 'modified' ELSE 'unchanged' END AS change FROM customer WHERE c_custkey % 70 <> 0) GROUP BY change")
add("slices", lambda s, d: _rounded(analysis.slice_stats(table(s, d, "lineitem"), "l_returnflag", ["l_quantity", "l_tax"]), {"mean": 6, "std": 6}), " UNION ALL ".join(f"SELECT l_returnflag AS slice, '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM lineitem GROUP BY 1" for c in ("l_quantity", "l_tax")))
add("slice_label_shift", lambda s, d: _rounded(analysis.label_shift(table(s, d, "documents"), "source", "lang"), {"shift": 6}), "WITH k AS (SELECT source AS s, lang AS l, count(*) AS n FROM documents GROUP BY source, lang), c AS (SELECT s, l, n / sum(n) OVER (PARTITION BY s) AS p FROM k), f AS (SELECT s, l, coalesce(p, 0) AS p FROM (SELECT DISTINCT s FROM c) CROSS JOIN (SELECT DISTINCT l FROM c) LEFT JOIN c USING (s, l)) SELECT x.s AS a, y.s AS b, round(0.5 * sum(abs(x.p - y.p)), 6) AS shift FROM f x JOIN f y ON x.l = y.l AND x.s < y.s GROUP BY ALL")
_J = "documents JOIN labels USING (doc_id)"


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id")


_BIAS = "SELECT {0}, count(*) AS n, round(count(*) / (SELECT count(*) FROM " + _J + "), 6) AS share, round(avg((quality = 1)::int), 6) AS positive_rate, round(count(*) / (SELECT count(*) FROM " + _J + ") - 1 / count(*) OVER (), 6) AS representation_gap FROM " + _J + " GROUP BY {0}"
_R = {"share": 6, "positive_rate": 6, "representation_gap": 6}
add("bias_groups", lambda s, d: _rounded(analysis.group_bias(_labelled(s, d), ["lang"], F.col("quality") == 1), _R), _BIAS.format("lang"))
add("bias_intersections", lambda s, d: _rounded(analysis.group_bias(_labelled(s, d), ["lang", "source"], F.col("quality") == 1), _R), _BIAS.format("lang, source"))
add("bias_parity", lambda s, d: _rounded(analysis.parity(analysis.group_bias(_labelled(s, d), ["lang"], F.col("quality") == 1)), {"difference": 6, "ratio": 6}), f"SELECT round(x, 6) AS difference, round(r, 6) AS ratio, x < 0.1 AND coalesce(r BETWEEN 0.8 AND 1.25, false) AS fair, CASE WHEN x < 0.05 THEN 'none' WHEN x < 0.1 THEN 'low' WHEN x < 0.2 THEN 'medium' WHEN x < 0.3 THEN 'high' ELSE 'critical' END AS level FROM (SELECT max(p) - min(p) AS x, CASE WHEN min(p) > 0 THEN max(p) / min(p) END AS r FROM (SELECT avg((quality = 1)::int) AS p FROM {_J} GROUP BY lang))")

# --- labels: three annotators whose labels are flipped by a hash ------------------------------------------------------


def _annotations(s: SparkSession, d: str, n: int = 3) -> DataFrame:
    rows = table(s, d, "labels").select(F.col("doc_id").alias("sample_id"), "toxic", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("a"))
    h = hash_key("ann", F.concat_ws("|", "sample_id", "a"))
    return rows.select("sample_id", F.concat(F.lit("a"), "a").alias("annotator"), F.when(h % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("string").alias("label"), ((h % 100) / 100).alias("confidence"))


_AH = sql_hash("ann", "concat_ws('|', doc_id, a)")
_ANN = f"(SELECT doc_id AS sample_id, 'a' || a AS annotator, (CASE WHEN {_AH} % 5 = 0 THEN 1 - toxic ELSE toxic END)::varchar AS label, ({_AH} % 100) / 100 AS confidence FROM labels, range(1, 4) t(a))"
_CNT = f"(SELECT sample_id, label, count(*) AS c FROM {_ANN} GROUP BY ALL)"
add("labels_agreement", lambda s, d: _rounded(labels.pairwise_agreement(_annotations(s, d)), {"agreement": 6}), f"SELECT round(sum(x) / sum(y), 6) AS agreement FROM (SELECT sum(c * (c - 1) / 2) AS x, sum(c) * (sum(c) - 1) / 2 AS y FROM {_CNT} GROUP BY sample_id)")
add("labels_fleiss", lambda s, d: _rounded(labels.fleiss_kappa(_annotations(s, d), 3), {"kappa": 6}), f"WITH c AS {_CNT}, p AS (SELECT (sum(c * c) - 3) / 6.0 AS p FROM c GROUP BY sample_id), q AS (SELECT avg(p) AS po, count(*) AS n FROM p), e AS (SELECT sum(pow(t / (n * 3.0), 2)) AS pe FROM (SELECT sum(c) AS t FROM c GROUP BY label), q) SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM q, e")
add("labels_cohen", lambda s, d: _rounded(labels.cohen_kappa(_annotations(s, d), "a1", "a2"), {"kappa": 6}), f"WITH j AS (SELECT x.label AS x, y.label AS y FROM {_ANN} x JOIN {_ANN} y ON x.sample_id = y.sample_id AND x.annotator = 'a1' AND y.annotator = 'a2'), n AS (SELECT count(*) AS n, avg((x = y)::int) AS po FROM j), e AS (SELECT sum(a * b / (n * n)) AS pe FROM (SELECT x AS l, count(*) AS a FROM j GROUP BY x) JOIN (SELECT y AS l, count(*) AS b FROM j GROUP BY y) USING (l), n) SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM n, e")
add("labels_krippendorff", lambda s, d: _rounded(labels.krippendorff_alpha(_annotations(s, d)), {"alpha": 6}), f"WITH c AS (SELECT *, sum(c) OVER (PARTITION BY sample_id) AS m FROM {_CNT}), o AS (SELECT sum(c * (m - c) / (m - 1)) AS d, sum(c)::double AS n FROM c WHERE m > 1), e AS (SELECT sum(t * t) AS q FROM (SELECT sum(c)::double AS t FROM c WHERE m > 1 GROUP BY label)) SELECT round(1 - d * (n - 1) / (n * n - q), 6) AS alpha FROM o, e")
add("labels_consensus", lambda s, d: labels.consensus(_annotations(s, d)), f"SELECT sample_id, label FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY c DESC, label) AS k FROM {_CNT}) WHERE k = 1")
add("labels_annotators", lambda s, d: _rounded(labels.annotator_stats(_annotations(s, d)), {"agreement": 6, "confidence": 6}), f"WITH m AS (SELECT sample_id, label AS l FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY c DESC, label) AS k FROM {_CNT}) WHERE k = 1) SELECT annotator, count(*) AS n, round(avg((label = l)::int), 6) AS agreement, round(avg(confidence), 6) AS confidence, count_if(confidence < 0.5)::bigint AS low_confidence FROM {_ANN} JOIN m USING (sample_id) GROUP BY annotator")


def _probs(s: SparkSession, d: str) -> DataFrame:
    p = (hash_key("p", F.col("doc_id")) % 1000) / 1000
    return table(s, d, "labels").select("doc_id", F.col("toxic").alias("label"), F.array(1 - p, p).alias("probs"))


_PR = f"(SELECT doc_id, toxic::bigint AS given, ({sql_hash('p', 'doc_id')} % 1000) / 1000 AS p FROM labels)"
_PD = "(CASE WHEN 1 - p >= p THEN 0 ELSE 1 END)::bigint"
add("labels_confident_joint", lambda s, d: labels.confident_joint(_probs(s, d), threshold=0.7), f"SELECT given, {_PD} AS predicted, count(*) AS n FROM {_PR} WHERE greatest(p, 1 - p) >= 0.7 GROUP BY ALL")
add("labels_noise", lambda s, d: _rounded(labels.noise(labels.confident_joint(_probs(s, d), threshold=0.7)), {"noise_rate": 6}), f"SELECT round(avg((given <> {_PD})::int), 6) AS noise_rate FROM {_PR} WHERE greatest(p, 1 - p) >= 0.7")
add("labels_issues", lambda s, d: _rounded(labels.label_issues(_probs(s, d), "doc_id"), {"margin": 6}), f"SELECT doc_id, given, q AS predicted, round(m, 6) AS margin, CASE WHEN m > 0.3 THEN 'likely_wrong' WHEN m > 0.15 THEN 'ambiguous' ELSE 'borderline' END AS issue, m > 0.1 AS prune FROM (SELECT doc_id, given, {_PD} AS q, greatest(p, 1 - p) - CASE WHEN given = 1 THEN p ELSE 1 - p END AS m FROM {_PR}) WHERE given <> q")
_INF = "(SELECT vec_id, list_inner_product(embedding::double[], (SELECT list(m ORDER BY i) FROM (SELECT i, avg(embedding[i]::double) AS m FROM embeddings, range(1, 65) t(i) WHERE label = 0 GROUP BY i))) AS score FROM embeddings)"


def _influence(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return labels.influence(e, e.filter("label = 0"), "vec_id", "embedding")


add("influence", lambda s, d: _rounded(_influence(s, d), {"score": 6}), f"SELECT vec_id, round(score, 6) AS score FROM {_INF}")
add("influence_classes", lambda s, d: labels.influence_report(_influence(s, d), "vec_id").groupBy("class").agg(F.count("*").alias("n")), f"SELECT CASE WHEN z > 2 THEN 'highly_helpful' WHEN z > 1 THEN 'helpful' WHEN z < -2 THEN 'highly_harmful' WHEN z < -1 THEN 'harmful' ELSE 'neutral' END AS class, count(*) AS n FROM (SELECT (score - avg(score) OVER ()) / stddev_pop(score) OVER () AS z FROM {_INF}) GROUP BY 1")
add("influence_extremes", lambda s, d: labels.extremes(_influence(s, d), "vec_id", 5).select("vec_id", "side"), f"(SELECT vec_id, 'helpful' AS side FROM {_INF} ORDER BY score DESC, vec_id LIMIT 5) UNION ALL (SELECT vec_id, 'harmful' FROM {_INF} ORDER BY score, vec_id LIMIT 5)")

# --- evaluation and series -------------------------------------------------------------------------------------------
_EV = table


def _predictions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "labels").select("doc_id", F.col("toxic").alias("y"), F.when(hash_key("y", F.col("doc_id")) % 4 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("z"))


_PRED = f"(SELECT toxic AS y, CASE WHEN {sql_hash('y', 'doc_id')} % 4 = 0 THEN 1 - toxic ELSE toxic END AS z FROM labels)"
add("confusion_matrix", lambda s, d: labels.confusion(_predictions(s, d), "y", "z"), f"SELECT y AS label, z AS predicted, count(*) AS n FROM {_PRED} GROUP BY ALL")
add("class_report", lambda s, d: labels.class_report(_predictions(s, d), "y", "z"), f"WITH t AS (SELECT y, count(*) AS support, count_if(y = z) AS hit FROM {_PRED} GROUP BY y), p AS (SELECT z AS y, count(*) AS said FROM {_PRED} GROUP BY z) SELECT y AS label, support, round(hit / said, 4) AS precision, round(hit / support, 4) AS recall, round(2 * (hit / said) * (hit / support) / (hit / said + hit / support), 4) AS f1 FROM t JOIN p USING (y)")
add("regression_metrics", lambda s, d: labels.regression(table(s, d, "lineitem").withColumn("guess", F.col("l_quantity") * 1000), "l_extendedprice", "guess"), "SELECT round(m, 4) AS mse, round(sqrt(m), 4) AS rmse, round(a, 4) AS mae, round(1 - m / v, 4) AS r2 FROM (SELECT avg(pow(l_quantity * 1000 - l_extendedprice, 2)) AS m, avg(abs(l_quantity * 1000 - l_extendedprice)) AS a, var_pop(l_extendedprice) AS v FROM lineitem)")
add("series_ema", lambda s, d: _rounded(labels.ema(table(s, d, "events"), "event_type", "event_id", "value", 0.3), {"ema": 6}).select("series", "step", "ema"), "WITH RECURSIVE e AS (SELECT event_type AS series, event_id AS step, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events), r AS (SELECT series, step, k, value AS s FROM e WHERE k = 1 UNION ALL SELECT e.series, e.step, e.k, 0.3 * e.value + 0.7 * r.s FROM r JOIN e ON e.series = r.series AND e.k = r.k + 1) SELECT series, step, round(s, 6) AS ema FROM r")
add("series_last", lambda s, d: labels.last_points(table(s, d, "events").select("event_type", "event_id", "value"), "event_type", "event_id", 5), "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 5")
add("series_trim", lambda s, d: labels.trimmed(table(s, d, "events").select("event_type", "event_id"), "event_type", "event_id", 150, 100), "SELECT event_type, event_id FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS c, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE c <= 150 OR k <= 100")
add("series_best", lambda s, d: labels.best_metric(table(s, d, "events").select(F.when(F.col("event_type") == "click", "val_loss").otherwise(F.col("event_type")).alias("metric"), "value"), "metric", "value"), "SELECT metric, CASE WHEN metric IN ('val_loss', 'error') THEN min(value) ELSE max(value) END AS best FROM (SELECT CASE WHEN event_type = 'click' THEN 'val_loss' ELSE event_type END AS metric, value FROM events) GROUP BY metric")
add("series_lttb", lambda s, d: packing.lttb(table(s, d, "events"), "event_type", "event_id", "value", 50))
add("latest_per_key", lambda s, d: dedup.latest(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]), "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")

# --- chat ------------------------------------------------------------------------------------------------------------
for _n in ("llama3", "chatml", "mistral", "zephyr", "phi3", "gemma"):
    _t = chat.TEMPLATES[_n]

    def _sql_message(t: chat.Template, role: str, content: str) -> str:
        fill = lambda p, r: "concat(" + ", ".join(r if x == "R" else content if x == "C" else "'" + x.replace("'", "''") + "'" for x in p.replace("{role}", "\0R\0").replace("{content}", "\0C\0").split("\0")) + ")"
        named = f"CASE {role} {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in t.roles.items())} ELSE {role} END" if t.roles else role
        return (f"CASE {role} {' '.join(f"WHEN '{r}' THEN {fill(p, named)}" for r, p in t.by_role.items())} ELSE {fill(t.message, named)} END") if t.by_role else fill(t.message, named)

    _system = f"CASE WHEN NOT bool_or(role = 'system') THEN {_sql_message(_t, "'system'", "'" + (_t.system or '') + "'")} ELSE '' END" if _t.system else "''"
    add(f"chat_{_n}", lambda s, d, t=_t: chat.render(table(s, d, "conversations"), t, True), f"SELECT conv_id, concat('{_t.bos}', {_system}, string_agg({_sql_message(_t, 'role', 'text')}, '' ORDER BY turn), '{_t.prompt}') AS prompt FROM conversations GROUP BY conv_id")
add("chat_sharegpt", lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l")).select("conv_id", F.to_json(F.struct(F.transform("l", lambda m: F.struct(m["role"].alias("from"), m["text"].alias("value"))).alias("conversations"))).alias("j")).select("conv_id", F.size(F.from_json(chat.sharegpt_to_openai(F.col("j")), chat.OPENAI)["messages"]).alias("messages"), (chat.openai_to_sharegpt(chat.sharegpt_to_openai(F.col("j"))) == F.col("j")).alias("same")), "SELECT conv_id, count(*)::int AS messages, true AS same FROM conversations GROUP BY conv_id")

# --- catalogue, lineage, streams -------------------------------------------------------------------------------------


def _catalogue(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array(F.lower("p_brand")).alias("tags"), F.array(F.lower("p_type")).alias("tasks"), F.when(F.col("p_size") < 20, "csv").otherwise("parquet").alias("format"), (F.col("p_size") * 1000).cast("long").alias("rows"), F.lit("2024-05-01").alias("created_at"), (F.col("p_retailprice") % 100).alias("quality"))


_CAT = "(SELECT p_partkey AS id, p_name AS name, p_type AS description, lower(p_brand) AS tag, lower(p_type) AS task, CASE WHEN p_size < 20 THEN 'csv' ELSE 'parquet' END AS format, p_size * 1000 AS rows FROM part)"
add("catalog_search", lambda s, d: catalog.search(_catalogue(s, d), "brand#1", ["csv"], least_rows=3000, limit=1000).select("id", F.round("relevance", 6).alias("relevance")), f"SELECT id, round(CASE WHEN contains(lower(name), 'brand#1') THEN 0.4::double ELSE 0 END + CASE WHEN lower(name) = 'brand#1' THEN 0.3::double ELSE 0 END + CASE WHEN contains(lower(description), 'brand#1') THEN 0.2::double ELSE 0 END + CASE WHEN contains(tag, 'brand#1') THEN 0.1::double ELSE 0 END + CASE WHEN contains(task, 'brand#1') THEN 0.1::double ELSE 0 END, 6) AS relevance FROM {_CAT} WHERE format = 'csv' AND rows >= 3000 AND (contains(lower(name), 'brand#1') OR contains(lower(description), 'brand#1') OR contains(tag, 'brand#1') OR contains(task, 'brand#1')) ORDER BY relevance DESC, id LIMIT 1000")
add("catalog_facets", lambda s, d: catalog.facets(_catalogue(s, d)), f"SELECT 'format' AS facet, format AS value, count(*) AS n FROM {_CAT} GROUP BY ALL UNION ALL SELECT 'tag', tag, count(*) FROM {_CAT} GROUP BY ALL UNION ALL SELECT 'task', task, count(*) FROM {_CAT} GROUP BY ALL UNION ALL SELECT 'month', '2024-05', count(*) FROM {_CAT} UNION ALL SELECT 'rows', CASE WHEN rows < 1000 THEN 'tiny' WHEN rows < 10000 THEN 'small' WHEN rows < 100000 THEN 'medium' ELSE 'large' END, count(*) FROM {_CAT} GROUP BY ALL")
add("catalog_version_diff", lambda s, d: catalog.version_diff(table(s, d, "supplier").filter("s_suppkey % 5 <> 0").select(F.col("s_name").alias("file"), F.col("s_nationkey").cast("string").alias("hash")), table(s, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_name").alias("file"), F.when(F.col("s_suppkey") % 4 == 0, F.lit("x")).otherwise(F.col("s_nationkey").cast("string")).alias("hash"))), "SELECT s_name AS file, CASE WHEN s_suppkey % 5 = 0 THEN 'added' WHEN s_suppkey % 3 = 0 THEN 'removed' WHEN s_suppkey % 4 = 0 THEN 'modified' ELSE 'unchanged' END AS change FROM supplier WHERE s_suppkey % 15 <> 0")


def _edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("dst"), F.floor(F.col("p_partkey") / 3).alias("src")).filter("src > 0")


add("lineage_downstream", lambda s, d: catalog.reachable(_edges(s, d), s.createDataFrame([(2,)], "node long")).withColumn("depth", F.col("depth").cast("long")), "WITH RECURSIVE e AS (SELECT p_partkey // 3 AS src, p_partkey AS dst FROM part WHERE p_partkey // 3 > 0), r AS (SELECT 2::bigint AS node, 0::bigint AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY node")
add("lineage_upstream", lambda s, d: catalog.reachable(_edges(s, d), s.createDataFrame([(180,)], "node long"), upstream=True).withColumn("depth", F.col("depth").cast("long")), "WITH RECURSIVE e AS (SELECT p_partkey // 3 AS src, p_partkey AS dst FROM part WHERE p_partkey // 3 > 0), r AS (SELECT 180::bigint AS node, 0::bigint AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY node")
add("parameter_grid", lambda s, d: catalog.grid(s, {"lr": [0.001, 0.01], "batch": [16, 32], "layers": [1, 2, 3]}), "SELECT lr::double AS lr, batch::bigint AS batch, layers::bigint AS layers FROM (VALUES (0.001), (0.01)) a(lr), (VALUES (16), (32)) b(batch), (VALUES (1), (2), (3)) c(layers)")
add("events_windowed", lambda s, d: _rounded(streams.windowed(table(s, d, "events"), "ts", "event_type", "value", "1 day"), {"sum": 4, "mean": 6}), "SELECT date_trunc('day', ts)::timestamp AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
add("events_sessions", lambda s, d: streams.sessions(table(s, d, "events"), "ts", "user_id", "1 day").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events")), "SELECT user_id, sum(fresh)::bigint AS sessions, count(*) AS events FROM (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 DAY > ts THEN 0 ELSE 1 END AS fresh FROM events) GROUP BY user_id")
add("feature_matrix", lambda s, d: files.feature_matrix(table(s, d, "part").select(F.col("p_size").cast("string").alias("size"), F.col("p_brand").alias("brand"), F.col("p_partkey").cast("string").alias("k")), ["size", "brand"], "k").select(F.col("target").cast("double").alias("target"), F.col("features")[0].cast("double").alias("x"), F.col("features")[1].cast("double").alias("y")), "SELECT p_partkey::double AS target, p_size::double AS x, 0.0::double AS y FROM part")
add("clean_text", lambda s, d: _docs(s, d, F.md5(prep.clean_text(F.col("text"), True, False, True, False, False)).alias("clean")), r"SELECT doc_id, md5(trim(regexp_replace(text, 'https?://[^\s]+', '', 'g'))) AS clean FROM documents")

from . import extra_queries  # noqa: E402,F401  (registers)
