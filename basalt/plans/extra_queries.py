"""Registered queries: slices, safety, provenance, label quality, corpus issues, samplers, series, recipes that run out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import hash_key, sql_hash
from ..operators import catalog, dedup, labels, mixing, profile, provenance, quality, safety, slices, splits
from ..sources import files
from .queries import _rounded, add, table

# --- slices ----------------------------------------------------------------------------------------------------------
_NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def _sql_number(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, {_NUM}) THEN try_cast({x} AS double) END)"


def _sql_compared(x: str, op: str, target: str) -> str:
    number = f"try_cast('{target}' AS double)"
    return f"(CASE WHEN {_sql_number(x)} IS NOT NULL AND {number} IS NOT NULL THEN {_sql_number(x)} {op} {number} ELSE {x} {op} '{target}' END)"


_CELLS = {"bal": "coalesce(c_acctbal::varchar, '')", "seg": "coalesce(nullif(c_mktsegment, 'BUILDING'), '')", "name": "c_name", "nat": "c_nationkey::varchar"}
_MATCHES = [
    ("rich", "bal", "gt", "5000", _sql_compared("bal", ">", "5000")),
    ("indebted", "bal", "lt", "0", _sql_compared("bal", "<", "0")),
    ("named_late", "name", "ge", "Customer#000000500", _sql_compared("name", ">=", "Customer#000000500")),
    ("small_nation", "nat", "le", "x3", _sql_compared("nat", "<=", "x3")),
    ("middle", "bal", "between", "100, 2000.5", f"coalesce({_sql_number('bal')} BETWEEN 100 AND 2000.5, false)"),
    ("between_text", "seg", "between", "A, H", "seg BETWEEN 'A' AND 'H'"),
    ("listed", "seg", "in", "MACHINERY, FURNITURE", "seg IN ('MACHINERY', 'FURNITURE')"),
    ("holding", "name", "contains", "77", "contains(name, '77')"),
    ("no_segment", "seg", "is_null", "", "seg IN ('', 'null', 'NULL')"),
    ("segment", "seg", "is_not_null", "", "seg NOT IN ('', 'null', 'NULL')"),
    ("one_segment", "seg", "eq", "MACHINERY", "seg = 'MACHINERY'"),
    ("other_segment", "seg", "neq", "MACHINERY", "seg <> 'MACHINERY'"),
]
_CUSTOMER = f"(SELECT c_custkey, {', '.join(f'{x} AS {n}' for n, x in _CELLS.items())} FROM customer)"


def _cells(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nat"))


def _predicates() -> dict:
    return {n: slices.matches(F.col(c), op, t) for n, c, op, t, _ in _MATCHES}


add("slice_predicates", lambda s, d: _cells(s, d).select("c_custkey", *(p.alias(n) for n, p in _predicates().items())), f"SELECT c_custkey, {', '.join(f'{x} AS {n}' for n, _, _, _, x in _MATCHES)} FROM {_CUSTOMER}")
_TAGGED = " UNION ALL ".join(f"SELECT '{n}' AS slice, * FROM {_CUSTOMER} WHERE {x}" for n, _, _, _, x in _MATCHES)
add(
    "slice_quality",
    lambda s, d: _rounded(slices.quality(_cells(s, d), _predicates(), ["bal", "seg"], "nat"), {c: 6 for c in ("completeness", "balance", "representativeness", "score")}),
    f"WITH t AS ({_TAGGED}), n AS (SELECT slice, count(*) AS rows, 1.0::double - (count_if(bal IN ('', 'null', 'NULL')) + count_if(seg IN ('', 'null', 'NULL'))) / (count(*) * 2) AS c FROM t GROUP BY slice), k AS (SELECT slice, nat, count(*) AS n FROM t GROUP BY ALL), "
    "b AS (SELECT slice, 1 - (max(n) - min(n)) / sum(n) AS b FROM k GROUP BY slice), r AS (SELECT *, rows / (SELECT count(*) FROM customer) AS share FROM n JOIN b USING (slice)), z AS (SELECT *, CASE WHEN share < 0.01 THEN 0.3 WHEN share < 0.05 THEN 0.6 WHEN share < 0.1 THEN 0.8 ELSE 1.0 END::double AS p FROM r) "
    "SELECT slice, rows, round(c, 6) AS completeness, round(b, 6) AS balance, round(p, 6) AS representativeness, round(0.4::double * c + 0.3::double * b + 0.3::double * p, 6) AS score FROM z",
)
add("slice_extremes", lambda s, d: slices.extremes(table(s, d, "customer"), "c_mktsegment", ["c_name", "c_nationkey"]), " UNION ALL ".join(f"SELECT c_mktsegment AS slice, '{c}' AS \"column\", min({c}::varchar) AS lowest, max({c}::varchar) AS highest FROM customer GROUP BY c_mktsegment" for c in ("c_name", "c_nationkey")))

# --- safety ----------------------------------------------------------------------------------------------------------


def _sql_split(of: str, key: str, columns: str) -> str:
    return f"(SELECT {columns}, CASE WHEN r < floor(n * 0.6::double) THEN 'train' WHEN r < floor(n * 0.6::double) + floor(n * 0.2::double) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY {sql_hash(42, key)}, {key}) - 1 AS r, count(*) OVER () AS n FROM {of}))"


add(
    "leakage_report",
    lambda s, d: safety.leakage(splits.random_split(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"), "split", "o_custkey"),
    f"WITH k AS (SELECT o_custkey, max((split = 'train')::int) AS a, max((split = 'val')::int) AS b, max((split = 'test')::int) AS c FROM {_sql_split('orders', 'o_orderkey', 'o_custkey')} GROUP BY 1), "
    "n AS (SELECT sum(a)::bigint AS train_keys, sum(b)::bigint AS val_keys, sum(c)::bigint AS test_keys, count_if(a = 1 AND b = 1)::bigint AS train_val, count_if(a = 1 AND c = 1)::bigint AS train_test, count_if(b = 1 AND c = 1)::bigint AS val_test FROM k) "
    "SELECT *, CASE WHEN train_test > 0 THEN CASE WHEN train_test / greatest(least(train_keys, test_keys), 1) > 0.05 THEN 'critical' ELSE 'high' END WHEN train_val > 0 OR val_test > 0 THEN 'low' ELSE 'none' END AS severity FROM n",
)
_SHARES = f"(SELECT lang AS class, {', '.join(f'count_if(split = {chr(39)}{x}{chr(39)}) / sum(count_if(split = {chr(39)}{x}{chr(39)})) OVER () AS {x}' for x in safety.SPLITS)} FROM {_sql_split('documents', 'doc_id', 'lang')} GROUP BY lang)"


def _shares(s: SparkSession, d: str) -> DataFrame:
    return safety.class_shares(splits.random_split(table(s, d, "documents").select("doc_id", "lang"), "doc_id"), "split", "lang")


add("split_class_shares", lambda s, d: _rounded(_shares(s, d), {c: 6 for c in (*safety.SPLITS, "deviation")}), f"SELECT class, round(train, 6) AS train, round(val, 6) AS val, round(test, 6) AS test, round(greatest(abs(train - val), abs(train - test), abs(val - test)), 6) AS deviation FROM {_SHARES}")
_PSI = lambda a, b: f"round(sum((greatest({b}, 1e-4) - greatest({a}, 1e-4)) * ln(greatest({b}, 1e-4) / greatest({a}, 1e-4))), 6)"
add("split_consistency", lambda s, d: _rounded(safety.consistency(_shares(s, d)), {c: 6 for c in ("train_val", "train_test", "val_test")}), f"SELECT *, greatest(train_val, train_test, val_test) < 0.1 AS consistent FROM (SELECT {_PSI('train', 'val')} AS train_val, {_PSI('train', 'test')} AS train_test, {_PSI('val', 'test')} AS val_test FROM {_SHARES})")


def _leaky(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "user_id", "value", (F.col("value") * 1.02).alias("scaled"), (F.col("value") * 0.88).alias("shrunk"), (-F.col("value")).alias("value_next"))
    return profile.column_profiles(e).select("column", "total", "distinct", "mean", F.lit(None).cast("array<string>").alias("values"))


_NEAR = "1 - abs({0} - v) / abs(v)"
add(
    "feature_leakage",
    lambda s, d: safety.feature_leakage(_leaky(s, d), "value"),
    "WITH m AS (SELECT avg(value) AS v, avg(event_id) AS e, avg(user_id) AS u, count(DISTINCT event_id) = count(*) AS eu, count(DISTINCT user_id) = count(*) AS uu FROM events), "
    "r AS (SELECT 'event_id' AS \"column\", CASE WHEN eu THEN 1 ELSE 0 END AS base, e AS x, v FROM m UNION ALL SELECT 'user_id', CASE WHEN uu THEN 1 ELSE 0 END, u, v FROM m UNION ALL SELECT 'scaled', 0, v * 1.02, v FROM m UNION ALL SELECT 'shrunk', 0, v * 0.88, v FROM m UNION ALL SELECT 'value_next', 2, -v, v FROM m), "
    "k AS (SELECT \"column\", CASE WHEN 1 - abs(x - v) / abs(v) > 0.95 THEN 3 WHEN 1 - abs(x - v) / abs(v) > 0.85 THEN greatest(base, 2) ELSE base END AS risk FROM r) SELECT \"column\", (['low', 'medium', 'high', 'critical'])[risk + 1] AS risk FROM k WHERE risk > 0",
)
_COLS = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]
_HEALTH = " UNION ALL ".join(f"SELECT 60.0::double + 0.4::double * CASE WHEN count(DISTINCT {c}) > 0.9 * count(*) AND count(DISTINCT {c}) > 100 THEN 30 ELSE 100 END AS q FROM customer" for c in _COLS)
add("profile_health", lambda s, d: _rounded(safety.profile_health(profile.column_profiles(table(s, d, "customer"), _COLS)), {"data_quality": 6}), f"SELECT round(avg(q), 6) AS data_quality FROM ({_HEALTH})")
_RATIO = " UNION ALL ".join(f"SELECT max(n) / min(n) AS r FROM (SELECT count(*) AS n FROM documents GROUP BY {c})" for c in ("lang", "source"))
add("balance_health", lambda s, d: safety.balance_health(table(s, d, "documents"), ["lang", "source"]), f"SELECT avg(CASE WHEN r <= 1.5 THEN 100.0 WHEN r <= 3 THEN 80.0 WHEN r <= 10 THEN 50.0 WHEN r <= 50 THEN 20.0 ELSE 0.0 END::double) AS balance_health FROM ({_RATIO})")

# --- provenance: licences and restrictions by language and source ----------------------------------------------------


def _origins(s: SparkSession, d: str) -> DataFrame:
    lang, k = F.col("lang"), F.length("source")
    return table(s, d, "documents").select(
        F.col("doc_id").alias("row_index"), F.when(lang == "en", "web").when(lang == "de", "user_generated").when(lang == "fr", "licensed").alias("source_type"), F.col("source").alias("source_name"), F.when(lang == "en", "cc-by-4.0").when(lang == "de", "mit").alias("license"),
        (F.col("n_chars") > 1000).alias("consent"), F.when(lang != "fr", lang == "en").alias("commercial"), (lang == "en").alias("attribution"), F.array_compact(F.array(F.when(lang == "es", F.lit("no_commercial_use")), F.when(k % 2 == 0, F.lit("confidentiality")), F.when(lang == "de", F.lit("share_alike")))).alias("restrictions"),
    )


_ORIGIN = "(SELECT doc_id AS row_index, CASE lang WHEN 'en' THEN 'web' WHEN 'de' THEN 'user_generated' WHEN 'fr' THEN 'licensed' END AS source_type, source AS source_name, CASE lang WHEN 'en' THEN 'cc-by-4.0' WHEN 'de' THEN 'mit' END AS license, n_chars > 1000 AS consent, CASE WHEN lang <> 'fr' THEN lang = 'en' END AS commercial, lang = 'en' AS attribution, list_filter([CASE WHEN lang = 'es' THEN 'no_commercial_use' END, CASE WHEN length(source) % 2 = 0 THEN 'confidentiality' END, CASE WHEN lang = 'de' THEN 'share_alike' END], lambda x: x IS NOT NULL) AS restrictions FROM documents)"
add("provenance_distribution", lambda s, d: provenance.distribution(_origins(s, d)), " UNION ALL ".join(f"SELECT '{k}' AS kind, coalesce({c}, 'unknown') AS value, count(*) AS n FROM {_ORIGIN} GROUP BY ALL" for k, c in (("source", "source_type"), ("license", "license"))))
add("provenance_restrictions", lambda s, d: _rounded(provenance.restrictions(_origins(s, d)), {"share": 6}), f"SELECT restriction, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share, CASE restriction WHEN 'no_commercial_use' THEN 'high' WHEN 'confidentiality' THEN 'critical' ELSE 'medium' END AS severity FROM (SELECT unnest(restrictions) AS restriction FROM {_ORIGIN}) GROUP BY restriction")
add("provenance_issues", lambda s, d: _rounded(provenance.issues(_origins(s, d)), {"score": 6}), f"SELECT *, round(1.0::double - CASE WHEN unknown_license > 0 THEN 0.2 ELSE 0 END - CASE WHEN missing_consent > 0 THEN 0.3 ELSE 0 END, 6) AS score FROM (SELECT count(*) AS rows, count(source_type) AS with_source, count_if(license IS NULL)::bigint AS unknown_license, count_if(source_type = 'user_generated' AND NOT consent)::bigint AS missing_consent, count_if(list_contains(restrictions, 'no_commercial_use'))::bigint AS commercial_restriction FROM {_ORIGIN})")
add("provenance_violations", lambda s, d: provenance.commercial_violations(_origins(s, d)), f"SELECT row_index, 'license' AS issue FROM {_ORIGIN} WHERE NOT coalesce(commercial, false) UNION ALL SELECT row_index, 'restriction' FROM {_ORIGIN} WHERE list_contains(restrictions, 'no_commercial_use')")
add("provenance_allowed", lambda s, d: provenance.allowed(_origins(s, d), ["mit", "cc0-1.0"]).select("row_index"), f"SELECT row_index FROM {_ORIGIN} WHERE license IN ('mit', 'cc0-1.0')")
add("provenance_attribution", lambda s, d: provenance.attribution(_origins(s, d)), f"SELECT string_agg(t, '; ' ORDER BY t) AS text FROM (SELECT DISTINCT concat(source_name, ' (via ', source_type, ')') AS t FROM {_ORIGIN} WHERE attribution)")

# --- label quality and influence -------------------------------------------------------------------------------------


def _probs(s: SparkSession, d: str) -> DataFrame:
    p = (hash_key("p", F.col("doc_id")) % 1000) / 1000
    return table(s, d, "labels").select("doc_id", F.col("toxic").alias("label"), F.array(1 - p, p).alias("probs"))


_PR = f"(SELECT doc_id, toxic::bigint AS given, p, (CASE WHEN 1 - p >= p THEN 0 ELSE 1 END)::bigint AS said FROM (SELECT *, ({sql_hash('p', 'doc_id')} % 1000) / 1000 AS p FROM labels))"
_ERR = f"(SELECT given AS class, count(*) AS total, count_if(given <> said AND greatest(p, 1 - p) >= 0.7)::bigint AS errors FROM {_PR} GROUP BY given)"
add("label_class_errors", lambda s, d: _rounded(labels.class_errors(_probs(s, d), threshold=0.7), {"error_rate": 6}), f"SELECT class, total, errors, round(errors / total, 6) AS error_rate, CASE WHEN errors > 0 THEN concat(1 - class, ':', errors) ELSE '' END AS confused FROM {_ERR}")
add(
    "label_score",
    lambda s, d: _rounded(labels.label_score(labels.class_errors(_probs(s, d), threshold=0.7), F.lit(0.1), F.lit(0.3)), {"score": 6}),
    f"SELECT round(least(greatest(1 - (0.6::double * 0.2 + 0.2::double * CASE WHEN max(e) > 0 AND avg(e) > 0 THEN abs(max(e) - avg(e)) ELSE 0 END + 0.2::double * max(e)), 0), 1), 6) AS score FROM (SELECT errors / total AS e FROM {_ERR})",
)
add("label_summary", lambda s, d: _rounded(labels.label_summary(table(s, d, "labels"), "quality"), {"ratio": 6, "balance_ratio": 6}), "SELECT quality AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS ratio, round(min(count(*)) OVER () / max(count(*)) OVER (), 6) AS balance_ratio, min(count(*)) OVER () / max(count(*)) OVER () > 0.5 AS balanced FROM labels GROUP BY quality")
add("label_issues_by_noise", lambda s, d: labels.label_issues(_probs(s, d), "doc_id", method="by_noise_rate", least=0.6).select("doc_id", "issue", "prune"), f"SELECT doc_id, CASE WHEN m > 0.3 THEN 'likely_wrong' WHEN m > 0.15 THEN 'ambiguous' ELSE 'borderline' END AS issue, m > 0.05 AS prune FROM (SELECT doc_id, greatest(p, 1 - p) - CASE WHEN given = 1 THEN p ELSE 1 - p END AS m FROM {_PR} WHERE given <> said AND greatest(p, 1 - p) >= 0.6)")


def _losses(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "labels").select("doc_id", "toxic", ((hash_key("loss", F.col("doc_id")) % 2000) / 1000).alias("loss"))


_LOSS = f"(SELECT doc_id, toxic, ({sql_hash('loss', 'doc_id')} % 2000) / 1000 AS loss FROM labels)"
_INF = f"(SELECT doc_id, toxic, avg(loss) OVER () - loss AS score FROM {_LOSS})"
add("influence_loss", lambda s, d: _rounded(labels.loss_influence(_losses(s, d), "doc_id", "loss"), {"score": 6}), f"SELECT doc_id, round(score, 6) AS score FROM {_INF}")
add("influence_left_out", lambda s, d: _rounded(labels.loss_influence(_losses(s, d), "doc_id", "loss", 0.9), {"score": 6}), f"SELECT doc_id, round(0.9::double - loss, 6) AS score FROM {_LOSS}")


def _scored(s: SparkSession, d: str) -> DataFrame:
    return labels.loss_influence(_losses(s, d), "doc_id", "loss")


add("influence_by_class", lambda s, d: _rounded(labels.class_influence(_scored(s, d).join(table(s, d, "labels"), "doc_id"), "toxic"), {"mean": 6, "helpful": 6, "harmful": 6}), f"SELECT toxic AS class, round(avg(score), 6) AS mean, round(count_if(score > 0) / count(*), 6) AS helpful, round(count_if(score < 0) / count(*), 6) AS harmful FROM {_INF} GROUP BY toxic")
add(
    "influence_attribution",
    lambda s, d: _rounded(labels.attribution(labels.influence_report(_scored(s, d), "doc_id")), {"positive": 4, "negative": 4, "net": 4, "efficiency": 6, "pruning_benefit": 6}),
    f"WITH z AS (SELECT score, (score - avg(score) OVER ()) / stddev_pop(score) OVER () AS z FROM {_INF}) SELECT round(sum(CASE WHEN score > 0 THEN score END), 4) AS positive, round(sum(CASE WHEN score < 0 THEN score END), 4) AS negative, round(sum(score), 4) + 0.0 AS net, round(1 - count_if(z < -1) / count(*), 6) AS efficiency, round(count_if(z < -2) / count(*) * 0.05, 6) AS pruning_benefit FROM z",
)

# --- corpus and schema -----------------------------------------------------------------------------------------------
_SPECIAL = r"length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g'))"
_ISSUE = (
    r"WITH m AS (SELECT count(*) AS n, avg(length(text)) AS a, count_if(regexp_replace(text, '\s', '', 'g') = '') AS e, count_if(regexp_replace(text, '\s', '', 'g') <> '' AND length(text) < 5) AS s, "
    f"count_if(length(text) > 0 AND {_SPECIAL} / length(text) > 0.5) AS c, count_if(length(text) > 2000) AS l FROM documents), i AS (SELECT 'empty_texts' AS issue, e AS n, 'high' AS severity, e / n AS share FROM m WHERE e > 0 UNION ALL SELECT 'very_short_texts', s, 'medium', s / n FROM m WHERE s > 0 AND s / n > 0.05 "
    "UNION ALL SELECT 'special_char_heavy', c, 'low', c / n FROM m WHERE c > 0 UNION ALL SELECT 'very_long_texts', l, 'medium', l / n FROM m WHERE a > 2000 AND l > 0) "
)
add("corpus_issues", lambda s, d: _rounded(quality.text_issues(table(s, d, "documents"), "text"), {"share": 6}), _ISSUE + "SELECT issue, n::bigint AS n, severity, round(share, 6) AS share FROM i")
_VOC = r"(SELECT count(*) / sum(n) AS ttr FROM (SELECT w, count(*) AS n FROM (SELECT regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS w FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents)) WHERE w <> '' GROUP BY w))"
add("corpus_score", lambda s, d: _rounded(quality.corpus_score(quality.text_issues(table(s, d, "documents"), "text"), quality.vocabulary(table(s, d, "documents"), "text")), {"score": 6}), _ISSUE + f"SELECT round(least(greatest(1 - coalesce((SELECT sum(share * CASE severity WHEN 'high' THEN 0.15::double WHEN 'medium' THEN 0.08::double ELSE 0.03::double END) FROM i), 0) + CASE WHEN ttr > 0.1 THEN 0.05 WHEN ttr > 0.05 THEN 0.02 ELSE 0 END, 0), 1), 6) AS score FROM {_VOC}")
_E = quality.Expectation
_SCHEMA = [_E("type_match", "n_name", values=("string",)), _E("type_match", "n_nationkey", values=("string",)), _E("no_duplicate_columns"), _E("schema_match", values=("n_nationkey", "n_name", "n_comment"))]
add("quality_schema", lambda s, d: quality.check(table(s, d, "nation"), _SCHEMA).select("expectation", "column", "failures", "passed"), "SELECT * FROM (VALUES ('type_match', 'n_name', 0::bigint, true), ('type_match', 'n_nationkey', 1, false), ('no_duplicate_columns', '', 0, true), ('schema_match', '', 2, false)) t(expectation, \"column\", failures, passed)")
add("quality_dashboard_summary", lambda s, d: _rounded(quality.dashboard_summary(quality.dashboard(table(s, d, "documents").groupBy(F.col("source").alias("dataset"), F.col("lang").alias("at")).agg((F.avg("n_chars") / 5000).alias("score"))), table(s, d, "labels").select(F.col("doc_id").alias("dataset"), (F.col("quality") == 1).alias("resolved"))), {"mean_score": 6, "resolution_rate": 6}), "WITH s AS (SELECT source, lang, avg(n_chars) / 5000 AS score FROM documents GROUP BY ALL), l AS (SELECT source, arg_max(score, lang) AS score FROM s GROUP BY source) SELECT count(*) AS datasets, round(avg(score), 6) AS mean_score, count_if(score >= 0.9)::bigint AS excellent, count_if(score >= 0.7 AND score < 0.9)::bigint AS good, count_if(score >= 0.5 AND score < 0.7)::bigint AS fair, count_if(score < 0.5)::bigint AS poor, (SELECT round(avg(quality), 6) FROM labels) AS resolution_rate FROM l")


def _sequences(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(s, d, "orders").select("o_orderkey", F.floor(k / 100).alias("batch"), F.transform(F.sequence(F.lit(1), (k % 37).cast("int") + 1), lambda i: (i * k % 11).cast("int")).alias("input_ids"))


_SEQ = "(SELECT o_orderkey, o_orderkey // 100 AS batch, list_transform(range(1, o_orderkey % 37 + 2), lambda i: i * o_orderkey % 11) AS ids FROM orders)"
add("batch_stats", lambda s, d: _rounded(splits.batch_stats(_sequences(s, d)), {"padding_ratio": 6}), f"SELECT batch, count(*) AS samples, sum(len(ids))::bigint AS tokens, max(len(ids))::int AS max_length, round(1 - sum(len(ids)) / (count(*) * max(len(ids))), 6) AS padding_ratio FROM {_SEQ} GROUP BY batch")
add("collation_report", lambda s, d: _rounded(splits.collation_report(splits.collate(_sequences(s, d), "batch", "input_ids")), {"padding_ratio": 6, "efficiency": 6}), f"SELECT count(*) AS samples, sum(m)::bigint AS cells, sum(n)::bigint AS tokens, round(1 - sum(n) / sum(m), 6) AS padding_ratio, round(sum(n) / sum(m), 6) AS efficiency FROM (SELECT len(ids) AS n, ceil(max(len(ids)) OVER (PARTITION BY batch) / 8) * 8 AS m FROM {_SEQ})")
add("token_monitor", lambda s, d: _rounded(quality.token_monitor(_sequences(s, d)), {"padding": 6, "oov": 6, "empty": 6}), f"SELECT round(sum(len(list_filter(ids, lambda x: x = 0))) / sum(len(ids)), 6) AS padding, round(sum(len(list_filter(ids, lambda x: x = 1))) / sum(len(ids)), 6) AS oov, round(count_if(len(ids) = 0) / count(*), 6) AS empty FROM {_SEQ}")

# --- samplers and series ---------------------------------------------------------------------------------------------
_IDX = "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)"
add("sampler_subset", lambda s, d: splits.subset_sample(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], table(s, d, "customer").select((F.col("c_custkey") * 3).alias("index"))), f"SELECT o_orderkey, row_number() OVER (ORDER BY {sql_hash(42, 'i')}, i) - 1 AS place FROM {_IDX} WHERE i IN (SELECT c_custkey * 3 FROM customer)")
add("accessor_random", lambda s, d: splits.accessor_sample(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 100, "random"), f"SELECT o_orderkey FROM orders ORDER BY -ln(greatest({sql_hash(42, 'o_orderkey')} / 1152921504606846976.0::double, 1e-18)), o_orderkey LIMIT 100")
add("accessor_first", lambda s, d: splits.accessor_sample(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 100), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
add(
    "shards_streamed",
    lambda s, d: splits.streamed_shuffle(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], "o_orderkey", 7, 50),
    f"WITH n AS (SELECT count(*) // 7 AS z, count(*) % 7 AS m FROM orders), r AS (SELECT o_orderkey, (CASE WHEN i < m * (z + 1) THEN i // (z + 1) ELSE m + (i - m * (z + 1)) // z END)::int AS shard, i, z, m FROM {_IDX}, n), p AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY i) - 1 AS j FROM r) "
    f"SELECT o_orderkey, shard, row_number() OVER (PARTITION BY shard ORDER BY j // 50, {sql_hash(42, 'o_orderkey')}, o_orderkey) - 1 AS place FROM p",
)
_SER = lambda k: f"(SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, value FROM events WHERE event_type = '{k}')"


def _series(s: SparkSession, d: str, kind: str) -> DataFrame:
    return table(s, d, "events").filter(F.col("event_type") == kind)


add("series_aligned", lambda s, d: labels.aligned(_series(s, d, "click"), _series(s, d, "view"), "event_id", "value"), f"SELECT x.place, x.value AS a, y.value AS b FROM {_SER('click')} x JOIN {_SER('view')} y USING (place)")
add("series_rolling", lambda s, d: _rounded(labels.rolling(table(s, d, "events").select("event_id", "value"), ["event_id"], "value", 100), {"rolling_mean": 6}).select("event_id", "rolling_mean", "rolling_max"), "SELECT event_id, round(avg(value) OVER w, 6) AS rolling_mean, max(value) OVER w AS rolling_max FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")

# --- recipes that run out --------------------------------------------------------------------------------------------
_W, _N = {"en": 0.5, "de": 0.3, "fr": 0.2}, {"en": 150, "de": 70, "fr": 90}
_U = f"({sql_hash(42, 'step')} / 1152921504606846976.0::double)"
_LIVE = {k: f"(CASE WHEN {k} < {n} THEN {_W[k]}::double ELSE 0 END)" for k, n in _N.items()}
_SUM = "(" + " + ".join(_LIVE.values()) + ")"


def _recursive(pick: str, total: int) -> str:
    """Steps one by one, with the rows that each dataset has given. pick: a step's dataset from step, en, de and fr."""
    return (
        f"WITH RECURSIVE r AS (SELECT -1::bigint AS step, 0 AS en, 0 AS de, 0 AS fr, NULL::varchar AS dataset UNION ALL SELECT step, en + (d = 'en')::int, de + (d = 'de')::int, fr + (d = 'fr')::int, d FROM (SELECT *, {pick} AS d FROM (SELECT step + 1 AS step, en, de, fr FROM r WHERE step + 1 < {total})) WHERE d IS NOT NULL) "
        "SELECT step, step AS position, dataset, CASE dataset WHEN 'en' THEN en WHEN 'de' THEN de ELSE fr END::bigint - 1 AS row_index, 0::bigint AS epoch FROM r WHERE step >= 0"
    )


add("recipe_executed", lambda s, d: mixing.executed(s, mixing.Recipe(_W), _N, 400), _recursive(f"CASE WHEN {_SUM} = 0 THEN NULL WHEN en < 150 AND ({_U} < {_LIVE['en']} / {_SUM} OR (de >= 70 AND fr >= 90)) THEN 'en' WHEN de < 70 AND ({_U} < ({_LIVE['en']} + {_LIVE['de']}) / {_SUM} OR fr >= 90) THEN 'de' ELSE 'fr' END", 400))
_COUNT = "((en < 150)::int + (de < 70)::int + (fr < 90)::int)"
add("recipe_turns", lambda s, d: mixing.executed(s, mixing.Recipe(_W, "interleaved", run=5), _N, 400), _recursive(f"CASE WHEN {_COUNT} = 0 THEN NULL ELSE list_filter([CASE WHEN en < 150 THEN 'en' END, CASE WHEN de < 70 THEN 'de' END, CASE WHEN fr < 90 THEN 'fr' END], lambda x: x IS NOT NULL)[(step // 5) % {_COUNT} + 1] END", 400))

# --- texts, catalogue, cells -----------------------------------------------------------------------------------------
_G5 = "SELECT doc_id, CASE WHEN len(l) < 5 THEN [] ELSE list_distinct(list_transform(range(1, len(l) - 3), lambda i: concat(l[i], l[i + 1], l[i + 2], l[i + 3], l[i + 4]))) END AS g FROM (SELECT doc_id, string_split(text, '') AS l FROM documents)"
add("text_shingles_next", lambda s, d: table(s, d, "documents").select("doc_id", "text").join(table(s, d, "documents").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next")), "doc_id").select("doc_id", F.round(X.shingle_similarity(F.col("text"), F.col("next")), 6).alias("similarity")), f"WITH n AS ({_G5}) SELECT doc_id, round(CASE WHEN z = 0 THEN 1.0 ELSE x / z END, 6) AS similarity FROM (SELECT a.doc_id, len(list_intersect(a.g, b.g)) AS x, len(list_distinct(list_concat(a.g, b.g))) AS z FROM n a JOIN n b ON a.doc_id = b.doc_id - 1)")
add("text_hamming", lambda s, d: table(s, d, "orders").select("o_orderkey", X.hamming(F.col("o_orderkey"), F.col("o_custkey")).alias("bits")), "SELECT o_orderkey, bit_count(xor(o_orderkey, o_custkey))::int AS bits FROM orders")


def _catalogue(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("status"), F.when(F.col("p_size") < 20, "csv").otherwise("parquet").alias("format"), F.col("p_retailprice").alias("updated_at"), (F.col("p_size") * 30).alias("mb"))


add("catalog_listed", lambda s, d: catalog.listed(_catalogue(s, d), form="csv", name="1", offset=5, limit=40).select("id"), "SELECT p_partkey AS id FROM part WHERE p_size < 20 AND p_name LIKE '%1%' ORDER BY p_retailprice DESC, p_partkey LIMIT 40 OFFSET 5")
add("catalog_sizes", lambda s, d: _catalogue(s, d).groupBy(catalog.size_bucket(F.col("mb")).alias("bucket")).agg(F.count("*").alias("n")), "SELECT CASE WHEN p_size * 30 < 10 THEN 'small' WHEN p_size * 30 < 100 THEN 'medium' WHEN p_size * 30 < 1000 THEN 'large' ELSE 'huge' END AS bucket, count(*) AS n FROM part GROUP BY 1")
add("experiments_listed", lambda s, d: catalog.experiments(table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_custkey") > 50, '"a"').otherwise("a").alias("task_type"), F.lit("g").alias("group_name")), status="O", name="URGENT", task="a", group="g").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '%URGENT%'")
_TRIAL = f"(SELECT trial, {', '.join(f"{lo} + {hi - lo} * ({sql_hash(f'42|{k}', 'trial')} / 1152921504606846976.0::double) AS {k}" for k, lo, hi in (('lr', 0.001, 0.1), ('dropout', 0.0, 0.5)))} FROM range(200) t(trial))"


def _trials(s: SparkSession) -> DataFrame:
    return catalog.random_trials(s, {"lr": (0.001, 0.1), "dropout": (0.0, 0.5)}, 200)


add("random_trials", lambda s, d: _rounded(_trials(s), {"lr": 9, "dropout": 9}), f"SELECT trial, round(lr, 9) AS lr, round(dropout, 9) AS dropout FROM {_TRIAL}")
add("best_trial", lambda s, d: catalog.best_trial(_trials(s).withColumn("loss", F.abs(F.col("lr") - 0.02) + F.col("dropout")), "loss").select("trial"), f"SELECT trial FROM {_TRIAL} ORDER BY abs(lr - 0.02) + dropout, trial LIMIT 1")
add("cells_json", lambda s, d: files.json_rows(table(s, d, "nation").withColumn("n_name", F.nullif("n_name", F.lit("BRAZIL")))), "SELECT to_json({'n_nationkey': n_nationkey, 'n_name': nullif(n_name, 'BRAZIL'), 'n_regionkey': n_regionkey})::varchar AS json FROM nation")
add("cells_text", lambda s, d: files.string_cells(table(s, d, "nation").withColumn("n_name", F.nullif("n_name", F.lit("BRAZIL")))), "SELECT n_nationkey::varchar AS n_nationkey, coalesce(nullif(n_name, 'BRAZIL'), '') AS n_name, n_regionkey::varchar AS n_regionkey FROM nation")
add("missing_flags", lambda s, d: files.missing_flags(_cells(s, d)), "SELECT * FROM (VALUES ('c_custkey', false), ('bal', false), ('seg', true), ('name', false), ('nat', false)) t(\"column\", missing)")
add(
    "dedup_overall",
    lambda s, d: _rounded(dedup.overall(dedup.exact_report(table(s, d, "lineitem"), ["l_partkey", "l_quantity", "l_returnflag"]), table(s, d, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))), {"rate": 6}),
    "WITH e AS (SELECT sum(n)::bigint AS rows, coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0)::bigint AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_quantity, l_returnflag)), a AS (SELECT count(DISTINCT k) AS affected FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT c_custkey + 1 FROM customer)), "
    "r AS (SELECT rows, duplicates, affected, least((duplicates + affected) / rows, 1.0) AS rate FROM e, a) SELECT rows, duplicates, affected, round(rate, 6) AS rate, CASE WHEN rate > 0.3 THEN 'remove_duplicates' WHEN rate > 0.1 THEN 'review_duplicates' WHEN rate > 0 THEN 'minor_duplicates' ELSE 'none' END AS advice FROM r",
)


# --- shards in the hands of workers ----------------------------------------------------------------------------------
_NOW, _EVENTS = 1000.0, ("claimed", "processing", "completed", "failed")


def _states(s: SparkSession, d: str) -> DataFrame:
    """Customers as shards, orders as what 25 workers (nations) report of them; nations below 5 have been silent."""
    told = table(s, d, "orders").select(F.col("o_custkey").alias("shard_id"), (F.col("o_orderkey") % 25).alias("worker"), F.element_at(F.array(*map(F.lit, _EVENTS)), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("event"), F.col("o_orderkey").alias("at"))
    beats = table(s, d, "nation").select(F.col("n_nationkey").alias("worker"), F.when(F.col("n_nationkey") < 5, 10.0).otherwise(_NOW - F.col("n_nationkey")).alias("at"))
    return splits.shard_states(table(s, d, "customer").select(F.col("c_custkey").alias("shard_id")), told, beats, _NOW)


_STATES = """(SELECT shard_id, CASE WHEN event IS NULL OR event IN ('claimed', 'processing') AND worker < 5 THEN 'available' ELSE event END AS state, CASE WHEN event IS NULL OR event IN ('claimed', 'processing') AND worker < 5 THEN NULL ELSE worker END AS worker
FROM (SELECT c_custkey AS shard_id, o_orderkey % 25 AS worker, ['claimed', 'processing', 'completed', 'failed'][o_orderkey % 4 + 1] AS event, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) AS r FROM customer LEFT JOIN orders ON o_custkey = c_custkey) WHERE r = 1)"""
add("shard_states", _states, f"SELECT shard_id, state, worker FROM {_STATES}")
add("shard_progress", lambda s, d: _rounded(splits.shard_progress(_states(s, d)), {"completion_pct": 6}), f"SELECT count(*) AS total, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state IN ('claimed', 'processing')) AS in_progress, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'available') AS available, round(100.0::double * count(*) FILTER (state = 'completed') / count(*), 6) AS completion_pct FROM {_STATES}")
