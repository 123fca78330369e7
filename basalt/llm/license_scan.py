"""Operator 2: licence scan by ordered signature rules, in DataFrame functions only.

A text with none of the rules' keywords is only counted. For the others the words are joined by one space, each rule
whose keyword is among them runs its regular expression, and overlapping detections are resolved: a detection counts with
the earliest rule among its own and those of the detections inside it, so that a whole is never behind its parts. In that
order, the longer first of equal ones, each is kept that overlaps none kept before. So a detection inside a kept one
goes, of two that only overlap the one of the earlier rule stays, and one that goes pushes out nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import rules

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Letters A-Z in either case, digits and all characters beyond ASCII make words.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIT = "struct<at:int,ends:int,priority:int,label:string,score:double>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _gate() -> str:
    """A pattern that finds a keyword of any rule, or a base phrase, in whole words of either case."""
    gap = WORD[0] + WORD[2:]  # what stands between words
    words = {w.replace(" ", gap) for w in {w for r in rules() for w in r.keywords} | set(PHRASES)}
    edge, starts = WORD[:-1], sorted({w[0] for w in words})
    # one branch a first letter, so that most words are left at their first character
    tree = "|".join(f"{c}(?:{'|'.join(sorted(w[1:] for w in words if w[0] == c))})" for c in starts)
    return f"(?i)(?<!{edge})(?:{tree})(?!{edge})"


def _rule_table() -> Column:
    return F.array(*(F.struct(F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"), F.array(*(F.lit(f" {w} ") for w in r.keywords)).alias("keywords"), F.lit(r.score).alias("score")) for r in rules()))


def _found(text: Column, rule: Column) -> Column:
    """All matches of a rule as (-)spans: each starts after the gap and the matches before it."""
    gaps = F.regexp_extract_all(text, F.concat(F.lit(r"(?s)\G(.*?)"), rule["pattern"]), F.lit(1))
    hits = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    ends = F.aggregate(
        F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h"))),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_HIT}>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + x["h"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("at"), (-(a["at"] + x["g"] + x["h"])).alias("ends"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["score"].alias("score")).cast(_HIT))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return ends


def _resolved(hits: Column) -> Column:
    """The kept detections by their places. `ends` is negative."""

    def ranked(h: Column) -> Column:
        inside = lambda x: F.filter(h, lambda y: (y["at"] >= x["at"]) & (y["ends"] >= x["ends"]))
        return F.array_sort(F.transform(h, lambda x: F.struct(F.array_min(F.transform(inside(x), lambda y: y["priority"])).alias("rank"), (x["ends"] + x["at"]).alias("size"), x["at"].alias("at"), x["priority"].alias("own"), x.alias("hit"))))

    empty = F.array().cast(f"array<{_HIT}>")
    free = lambda kept, x: ~F.exists(kept, lambda y: (x["at"] < -y["ends"]) & (y["at"] < -x["ends"]))
    kept = F.aggregate(_let(hits, ranked), empty, lambda kept, x: F.when(free(kept, x["hit"]), F.concat(kept, F.array(x["hit"]))).otherwise(kept))
    return F.array_sort(kept)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    n_base counts the places of base phrases; first_word and last_word are the first words of the first and last one.
    labels: the base labels and those of the kept detections, distinct and sorted. score: the best detection's, at
    least 0.9 for a base phrase, 0 without any. detections: (start, end, label, score) in characters of the words
    joined by one space. Null and empty texts have no word, no label and score 0; repeated rows give repeated results; an
    empty table gives no row; other columns are not looked at, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = f"(?<= )(?:{'|'.join(PHRASES)})(?= )"
    words = F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))
    counted = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.when(F.col("_t").rlike(_gate()), F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.translate("_t", UPPER, LOWER), F.lit(WORD), F.lit(0)), " "), F.lit(" "))).alias("_n"),
    )
    n = F.col("_n")
    hits = F.flatten(F.transform(F.filter(_rule_table(), lambda r: F.exists(r["keywords"], lambda w: F.contains(n, w))), lambda r: _found(n, r)))
    found = counted.select("*", F.when(n.isNotNull(), _resolved(hits)).otherwise(F.array().cast(f"array<{_HIT}>")).alias("_d"))
    before = lambda prefix: F.length(prefix) - F.length(F.replace(prefix, F.lit(" "), F.lit(""))) - 1  # noqa: E731  words before it
    labels = F.filter(F.array(*(F.when(F.contains(n, F.lit(f" {p} ")), F.lit(x)) for p, x in PHRASES.items())), lambda x: x.isNotNull())
    places = F.coalesce(F.regexp_count(n, F.lit(base)), F.lit(0)).cast("long")
    got = found.select(
        "doc_id",
        "n_words",
        places.alias("n_base"),
        F.when(places > 0, before(F.regexp_extract(n, f"(?s)^(.*?){base}", 1))).cast("long").alias("first_word"),
        F.when(places > 0, before(F.regexp_extract(n, f"(?s)^(.*){base}", 1))).cast("long").alias("last_word"),
        labels.alias("_b"),
        "_d",
    )
    return got.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("_b"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_b", F.transform("_d", lambda x: x["label"])))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("_d", lambda x: x["score"])), F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.9)).otherwise(F.lit(0.0))).alias("score"),
        F.transform("_d", lambda x: F.struct(x["at"].alias("start"), (-x["ends"]).alias("end"), x["label"].alias("label"), x["score"].alias("score"))).alias("detections"),
    )
