"""Operator 1: a threshold table of quality rules, compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of words are kept in this many low bits of a hash; texts with more words take the exact way alone.
PLACE_BITS = 24

# Frequent function words of the languages that the rules know.
STOP_WORDS = {
    "en": "the of and to in is it for on with as by that this are was be at from or an a not have has he she they we you",
    "de": "der die das und ist in den von zu mit auf für im ein eine nicht des dem sich als auch es an",
    "es": "el la de que y en los del las un una por con no se su para es al lo como más",
    "fr": "le la les de des et en un une du que qui est pour dans par au sur ne pas il elle ce ou",
}


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule if the measure is outside [least, most] and it has at least `words` words."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    words: int = 0


#: The production threshold table.
RULES = (
    Rule("too_many_words", "n_words", most=2_000_000),
    Rule("mean_word_length", "mean_word", least=1.5, most=18.0),
    Rule("symbols_to_characters", "symbol_ratio", most=0.1),
    Rule("stop_words", "stop_ratio", least=0.005, words=100),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5, words=1),
    Rule("line_ends_with_ellipsis", "ellipsis_ratio", most=0.5, words=1),
    Rule("bullet_lines", "bullet_ratio", most=0.9, words=1),
    Rule("words_with_a_letter", "letter_ratio", least=0.5),
)


def _let(value: Column, body) -> Column:
    """body of value, with value computed once: a lambda variable stands for it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the list. words must not be null.

    Windows are hashed, hash and place packed into one long and sorted; only places whose hash has an equal neighbour
    are compared by their words, so that a collision changes nothing.
    """
    mask = (1 << PLACE_BITS) - 1
    last = F.size(words) - 3

    def hashed(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    packed = _let(
        F.array_sort(_let(hashed(words), lambda h: F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))),
        lambda s: F.transform(
            F.filter(s, lambda x, i: (F.shiftright(x.bitwiseXOR(F.get(s, i + 1)), PLACE_BITS) == 0) | (F.coalesce(F.shiftright(x.bitwiseXOR(F.get(s, i - 1)), PLACE_BITS), F.lit(1)) == 0)),
            lambda x: x.bitwiseAND(F.lit(mask)).cast("int"),
        ),
    )
    places = F.when(F.size(words) < (1 << PLACE_BITS), packed).otherwise(F.sequence(F.lit(0), last))
    exact = _let(
        F.array_sort(F.transform(places, lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i")))),
        lambda s: F.array_sort(
            F.transform(
                F.filter(s, lambda x, k: _same(x, F.get(s, k + 1)) | _same(x, F.get(s, k - 1))),
                lambda x: x["i"],
            )
        ),
    )
    covered = _let(exact, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))
    return F.when(last < 0, F.lit(0).cast("long")).otherwise(covered)


def _same(x: Column, y: Column) -> Column:
    return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and ratios of every whole text. A null text has no words; ratios without a divisor are null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stop = sorted({w for s in STOP_WORDS.values() for w in s.split()})
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("_w"))
    base = base.select("*", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    counted = base.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop"),
        F.size(F.filter("_l", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis"),
        F.size(F.filter("_l", lambda x: x.rlike(r"^\s*[-*•‣▪·]"))).cast("long").alias("n_bullets"),
        F.size(F.filter("_w", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_with_letter"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return counted.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word"),
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_stop", "n_words").alias("stop_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_ellipsis", "n_lines").alias("ellipsis_ratio"),
        ratio("n_bullets", "n_lines").alias("bullet_ratio"),
        ratio("n_with_letter", "n_words").alias("letter_ratio"),
    )


def broken(rule: Rule) -> Column:
    """Whether a rule is broken; a null measure breaks none."""
    value = F.col(rule.measure)
    bounds = [value < rule.least] * (rule.least is not None) + [value > rule.most] * (rule.most is not None)
    return F.coalesce((F.col("n_words") >= rule.words) & reduce(lambda a, b: a | b, bounds), F.lit(False))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the base counts, base_failed, kept, and the names of the broken rules.

    base_failed: under 50 words, or over half of the words repeat. kept: neither that nor a broken rule. Null and empty
    texts have no words and fail the base; repeated rows give repeated results.
    """
    got = measures(docs, id_col, text_col)
    names = F.filter(F.array(*(F.when(broken(r), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), names.alias("broken_rules")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("broken_rules") == 0)).alias("kept"), F.array_join("broken_rules", ",").alias("broken_rules")
    )
