"""Text signals as column expressions: personal data, toxicity, language, quality, repetition, n-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Personal-data patterns by kind, in order of detection, and the masks of those that are masked.
PII = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"\b(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
}
MASKS = {"email": "*****@*****.***", "phone": "***-***-****", "ip_address": "***.***.***.***", "credit_card": "****-****-****-****"}
URL = r"https?://[^\s]+"

# Phrases that count as toxic.
TOXIC = ["kill yourself", "die in a fire", "i hate you", "stupid idiot", "shut up", "go away", "worthless", "pathetic", "disgusting", "moron", "imbecile", "degenerate"]

# Frequent words of each language, in the order that breaks ties.
LANGUAGES = {
    "en": "the and that have for with this from they will",
    "zh": "的 是 在 了 不 和 有 我 他 这",
    "ja": "の に を は が と で た し て",
    "ko": "이 가 는 을 를 에 의 로 고 다",
    "fr": "le la les des est que pas une dans pour",
    "de": "der die das und ist nicht ein eine von mit",
    "es": "que los las una por del con para como más",
    "ru": "и в не на что с это а по как",
    "ar": "في من على أن هذا الذي مع كان هذه ما",
}
RANGES = {"cjk": r"\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}", "latin": "A-Za-z", "cyrillic": r"\x{0400}-\x{04FF}", "arabic": r"\x{0600}-\x{06FF}"}


def words(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def count_of(text: Column, kept: str) -> Column:
    """Characters of a class."""
    return F.length(F.regexp_replace(text, f"[^{kept}]", ""))


def _share(part: Column, text: Column) -> Column:
    return part / F.greatest(F.length(text), F.lit(1))


def detect_pii(text: Column) -> Column:
    """The kinds of personal data found, in a fixed order."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in PII.items())))


def mask_pii(text: Column, ssn: bool = False) -> Column:
    """E-mail addresses, phone numbers, IP addresses and cards replaced; social security numbers on request."""
    for kind, mask in MASKS.items():
        text = F.regexp_replace(text, PII[kind], mask)
    return F.regexp_replace(text, PII["ssn"], "***-**-****") if ssn else text


def toxicity_score(text: Column) -> Column:
    """Share of the phrases found, plus 0.2 for shouting in more than 5 words and 0.1 for many exclamation marks; at most 1."""
    base = let(F.lower(text), lambda lower: reduce(lambda a, b: a + b, (F.contains(lower, F.lit(p)).cast("int") for p in TOXIC)) / F.lit(float(len(TOXIC))))
    n = F.greatest(F.size(words(text)), F.lit(1))
    shout = F.when((_share(count_of(text, r"\p{Lu}"), text) > 0.5) & (n > 5), 0.2).otherwise(0.0)
    marks = F.when(_share(count_of(text, "!"), text) > 0.05, 0.1).otherwise(0.0)
    return F.least(F.least(base + shout, F.lit(1.0)) + marks, F.lit(1.0))


def char_ratio(text: Column, name: str) -> Column:
    return _share(count_of(text, RANGES[name]), text)


def let(value: Column, body) -> Column:
    """body of value, computed once: a lambda would compute a captured expression again for every element."""
    return F.transform(F.array(value), body)[0]


def language_scores(lower: Column, size: Column) -> dict[str, Column]:
    """Frequent words found in a lower-case text, over a size; at most 1."""
    return {k: F.least(reduce(lambda a, b: a + b, (F.contains(lower, F.lit(w)).cast("int") for w in v.split())) / size, F.lit(1.0)) for k, v in LANGUAGES.items()}


def detect_language(text: Column) -> Column:
    """struct<lang, confidence>; ties go to the first language; mostly CJK characters make it Chinese.

    Scores are over a tenth of the text's bytes (1 at least).
    """

    def named(m: Column, scores: Column, best: Column) -> Column:
        name = F.when(best > 0, F.element_at(F.array(*map(F.lit, LANGUAGES)), F.array_position(scores, best).cast("int"))).otherwise("unknown")
        turned = (m["cjk"] > 0.3) & (name != "zh")
        return F.struct(F.when(turned, F.lit("zh")).otherwise(name).alias("lang"), F.when(turned, F.least(best + m["cjk"], F.lit(1.0))).otherwise(best).alias("confidence"))

    size = F.greatest(F.greatest(F.octet_length(text), F.lit(1)) / 10.0, F.lit(1.0))
    measured = F.struct(F.lower(text).alias("lower"), size.alias("size"), char_ratio(text, "cjk").alias("cjk"))
    return let(measured, lambda m: let(F.array(*language_scores(m["lower"], m["size"]).values()), lambda s: let(F.array_max(s), lambda best: named(m, s, best))))


def _windows(parts: Column, n: int, glue: str) -> Column:
    """n consecutive elements joined, by position."""
    none = F.array().cast("array<string>")
    return let(parts, lambda v: F.when(F.size(v) >= n, F.transform(F.sequence(F.lit(0), F.size(v) - n), lambda i: F.concat_ws(glue, *(F.get(v, i + k) for k in range(n))))).otherwise(none))


def word_ngrams(w: Column, n: int) -> Column:
    """n consecutive words joined by a space, by position."""
    return _windows(w, n, " ")


def repetition_ratio(text: Column) -> Column:
    """Windows of 4 words seen before, over all windows; 0 under 4 words."""
    return let(word_ngrams(words(text), 4), lambda g: F.when(F.size(g) > 0, (F.size(g) - F.size(F.array_distinct(g))) / F.size(g)).otherwise(0.0))


def char_ngrams(text: Column, n: int) -> Column:
    """n consecutive characters, by position."""
    return _windows(F.filter(F.split(text, ""), lambda x: x != ""), n, "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays, repeats counted once; 1 if both are empty, null if one is null."""

    def ratio(s: Column) -> Column:
        total = F.size(s["a"]) + F.size(s["b"]) - s["n"]
        return F.when(total == 0, 1.0).otherwise(s["n"] / total)

    pair = lambda s: let(F.struct(s["a"], s["b"], F.size(F.array_intersect(s["a"], s["b"])).alias("n")), ratio)
    return let(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), lambda s: F.when(s["a"].isNotNull() & s["b"].isNotNull(), pair(s)))


#: Bounds of the quality assessment.
QUALITY = {"min_chars": 50, "max_chars": 100_000, "min_words": 10, "max_repetition": 0.3, "max_special": 0.3, "min_alnum": 0.5, "max_url": 0.2}


def quality_measures(text: Column) -> Column:
    """struct of what the quality assessment looks at, each measured once."""
    w = words(text)
    return let(
        F.struct(F.length(text).alias("chars"), F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", "")).alias("plain"), count_of(text, r"\p{L}\p{N}").alias("alnum"), w.alias("w"), F.regexp_count(text, F.lit(URL)).alias("urls"), count_of(text, ".!?。").alias("ends")),
        lambda m: F.struct(m["chars"], F.greatest(m["chars"], F.lit(1)).alias("size"), m["plain"], m["alnum"], F.size(m["w"]).alias("n"), m["urls"], m["ends"], let(word_ngrams(m["w"], 4), lambda g: F.when(F.size(g) > 0, (F.size(g) - F.size(F.array_distinct(g))) / F.size(g)).otherwise(0.0)).alias("repetition")),
    )


def quality_issues(m: Column, bounds: dict[str, float] | None = None) -> list[tuple[str, float, Column]]:
    """(issue, penalty, whether measures m have it)."""
    b = QUALITY | (bounds or {})
    return [
        ("text_too_short", 0.3, m["chars"] < b["min_chars"]),
        ("text_too_long", 0.2, m["chars"] > b["max_chars"]),
        ("too_few_words", 0.3, m["n"] < b["min_words"]),
        ("high_repetition", 0.3, m["repetition"] > b["max_repetition"]),
        ("high_special_chars", 0.2, (m["chars"] - m["plain"]) / m["size"] > b["max_special"]),
        ("low_alphanumeric", 0.2, m["alnum"] / m["size"] < b["min_alnum"]),
        ("too_many_urls", 0.2, m["urls"] / F.greatest(m["n"], F.lit(1)) > b["max_url"]),
        ("no_sentence_endings", 0.1, (m["ends"] == 0) & (m["n"] > 20)),
    ]


def quality(text: Column, bounds: dict[str, float] | None = None) -> Column:
    """struct<score, passed, issues>: 1 less the penalties, at least 0; passed without issues."""

    def judged(m: Column) -> Column:
        found = quality_issues(m, bounds)
        score = F.greatest(reduce(lambda a, x: a - F.when(x[2], x[1]).otherwise(0.0), found, F.lit(1.0)), F.lit(0.0))
        issues = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, _, c in found)))
        return F.struct(score.alias("score"), (F.size(issues) == 0).alias("passed"), issues.alias("issues"))

    return let(quality_measures(text), judged)


def shingle_similarity(a: Column, b: Column, k: int = 5) -> Column:
    """Jaccard of the hashed character shingles; 1 if both texts have none, 0 if one has none."""
    hashes = lambda x: F.transform(char_ngrams(x, k), lambda g: F.xxhash64(g))
    return jaccard(hashes(a), hashes(b))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two longs differ."""
    return F.bit_count(a.bitwiseXOR(b))


def simhash(text: Column, n: int = 3) -> Column:
    """A long: each bit is set if more of the character n-grams' hashes have it set than not; 0 without n-grams."""
    h = F.transform(char_ngrams(text, n), lambda g: F.xxhash64(g))

    def bits(v: Column) -> Column:
        one = lambda b: F.aggregate(v, F.lit(0), lambda s, x: s + F.when(F.getbit(x, F.lit(b)) == 1, 1).otherwise(-1))
        return reduce(lambda s, b: s.bitwiseOR(F.when(one(b) > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")), range(64), F.lit(0).cast("long"))

    return let(h, bits)


def simple_tokens(text: Column) -> Column:
    """Lower-case words with only letters, digits, - and _ kept."""
    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_-]", "")), lambda w: w != "")


def token_estimate(text: Column, chars_per_token: float = 4.0) -> Column:
    return F.ceil(F.length(text) / F.lit(chars_per_token))
