"""Operator 9: language identification, word first.

A known word scores its log frequency in every language, less their mean. An unseen word falls back to its longest
character n-grams that are known, then to shorter ones; one without any scores nothing. A text's language is the one with
the largest sum over its words. Its score is the mean over all words of the share that each word alone gives that
language (the softmax of its scores, 0 for a word that scores nothing): it says how much of the text speaks for the
answer, whatever its length, and is 0 for a text in letters never learned.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bound_batches

#: Labelled documents that the model is fitted on, at most about. All their words and n-grams make the model.
FIT_DOCS = 20_000
#: n-gram sizes, the first tried first.
SIZES = (5, 4, 3, 2, 1)
#: Distinct words whose scores a worker remembers.
REMEMBER = 300_000
UNKNOWN = "und"


#: Runs of word characters that are no digits.
RUN = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def letters() -> re.Pattern:
    """Runs of letters. Numerals that are no digits (fractions, Roman and circled numbers) count as word characters for
    the regular expression engine, and are left out here."""
    numerals = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
    return re.compile(f"[^\\W\\d_{re.escape(numerals)}]+")


def words(text: str | None) -> list[str]:
    """The runs of letters, in lower case. The pattern of letters alone is slow, and only meets runs that hold another character."""
    found = RUN.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ((run,) if run.isalpha() else letters().findall(run))]


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3, is 1. A null id is not held out, but nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def cut(word: str, size: int) -> list[str]:
    """n-grams of the word with a blank at both ends, single ones without the blanks; size 0: the word itself."""
    if not size:
        return [word]
    padded = f" {word} " if size > 1 else word
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


def hashed(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys (64-bit hashes) of all words' n-grams, and the word of each."""
    grams = [cut(w, size) for w in words]
    sizes = list(map(len, grams))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(grams)), np.uint64, sum(sizes)), np.repeat(np.arange(len(words)), sizes)


class LanguageModel:
    """Log frequencies of words (size 0) and n-grams by language. rows: arrays of size, key, language and count.

    Words and n-grams are known by their keys, sorted, so that a model of a million of them takes some tens of MB.
    """

    def __init__(self, languages: list[str], size: np.ndarray, key: np.ndarray, language: np.ndarray, n: np.ndarray):
        self.languages, self.keys, self.logs = languages, {}, {}
        for s in (0, *SIZES):
            own = size == s
            self.keys[s], at = np.unique(key[own], return_inverse=True)
            counts = np.zeros((len(self.keys[s]), len(languages)))
            np.add.at(counts, (at, language[own]), n[own])
            self.logs[s] = self._logs(counts)

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        """Smoothed log frequencies, less their mean over the languages: what all languages share says nothing."""
        if not counts.size:
            return np.zeros(counts.shape, np.float32)
        logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts)))
        return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's score in every language, and whether there is any evidence for it: the mean over its known n-grams of
        the longest size that has any, the word itself first."""
        out, left = np.zeros((len(words), len(self.languages))), np.arange(len(words))
        for size in (0, *SIZES):
            keys, owner = hashed([words[i] for i in left], size)
            if len(keys) and len(self.keys[size]):
                at = np.minimum(np.searchsorted(self.keys[size], keys), len(self.keys[size]) - 1)
                found = self.keys[size][at] == keys
                n = np.bincount(owner[found], minlength=len(left))
                np.add.at(out, left[owner[found]], self.logs[size][at[found]])
                out[left] /= np.maximum(n, 1)[:, None]
                left = left[n == 0]
        known = np.ones(len(words), bool)
        known[left] = False
        return out, known


class Scorer:
    """Remembers the scores of words met before, and each word's shares of the languages."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.code: defaultdict[str, int] = defaultdict(count().__next__)
        self.table = np.zeros((1024, 2 * len(self.model.languages)), np.float32)
        self.known = 0

    def _learn(self) -> None:
        fresh = list(islice(reversed(self.code), len(self.code) - self.known))[::-1]
        while self.known + len(fresh) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        if fresh:
            own, evidence = self.model.scores(fresh)
            share = np.exp(own - own.max(axis=1, keepdims=True, initial=-np.inf)) * evidence[:, None]
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            self.table[self.known : self.known + len(fresh)] = np.concatenate((own, share), axis=1)
            self.known += len(fresh)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; a text is looked up in bounded pieces."""
        if len(self.code) > REMEMBER:
            self._forget()
        n, found = len(self.model.languages), [words(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        self._learn()
        out, ends = [], np.cumsum(sizes)
        for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            if a == b or not n:
                out.append((UNKNOWN, 0.0))
                continue
            total = sum(self.table[codes[i : min(b, i + (1 << 16))]].sum(axis=0, dtype=np.float64) for i in range(a, b, 1 << 16))
            best = int(total[:n].argmax())
            out.append((self.model.languages[best], float(total[n + best] / (b - a))))
        return out


def sampled(rows: DataFrame, most: int, id_col: str) -> DataFrame:
    """All rows if they are `most` at most, else about that many, chosen by a hash of the id."""
    n = rows.select(id_col).count()
    share = 1 << 30
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(share)) < F.lit(share * most // n))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> LanguageModel:
    """Fit on labelled documents that are not held out, at most about fit_docs. All their words and n-grams are counted on the
    executors; the keys and counts, a few numbers each, come to the driver."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = sampled(rows, fit_docs, id_col).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys, n = list(seen), list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for batch in it:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((language, w) for w in words(text))
                if len(seen) > 100_000:
                    yield out()
        yield out()

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of keys, added up for some ten thousand words at a time."""

        def out(held: list) -> Iterator[pa.RecordBatch]:
            names, own, n = (list(x) for x in zip(*held, strict=True))
            languages, at = np.unique(names, return_inverse=True)
            n = np.array(n, np.int64)
            for size in (0, *SIZES):
                keys, owner = hashed(own, size)
                pair, where = np.unique(np.stack([keys, at[owner].astype(np.uint64)]), axis=1, return_inverse=True)
                total = np.bincount(where.reshape(-1), n[owner], minlength=pair.shape[1]).astype(np.int64)
                table = pa.table({"size": np.full(len(total), size, np.int32), "key": pair[0].view(np.int64), "lang": pa.array(languages[pair[1].astype(np.int64)].tolist(), pa.string()), "n": total})
                yield from table.to_batches(max_chunksize=10_000)

        held: list = []
        for batch in it:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(held) >= 30_000:
                yield from out(held)
                held = []
        if held:
            yield from out(held)

    counts = arrow_map(rows, counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    keys = arrow_map(counts, keyed, "size int, key long, lang string, n long").groupBy("size", "key", "lang").agg(F.sum("n").alias("n"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    code = F.coalesce(F.array_position(F.array(*map(F.lit, languages)).cast("array<string>"), F.col("lang")) - 1, F.lit(0)).cast("int")
    table = keys.select("size", "key", code.alias("lang"), "n").toArrow()
    size, key, lang, n = (table.column(c).to_numpy() for c in ("size", "key", "lang", "n"))
    return LanguageModel(languages, size, key.view(np.uint64), lang, n)


def language(text: Column, docs: DataFrame, model: LanguageModel) -> Column:
    """struct<lang_pred, score> of a text. No letter, or a null text: und with score 0. Ties: the language first in the alphabet."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorers: list[Scorer] = []

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(column: pa.Array) -> pa.Array:
        if not scorers:
            scorers.append(Scorer(shared.value))
        texts = column.to_pylist()
        rows = [r for at in range(0, len(texts), 256) for r in scorers[0].predict(texts[at : at + 256])]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.float64())], ["lang_pred", "score"])

    return predict.asNondeterministic()(text)


def identify(docs: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Without a model, one is fitted on docs.

    A text without letters, a null text, or a model that saw no label gives `und` with score 0. Repeated rows give
    repeated results; ties go to the language first in the alphabet.
    """
    bound_batches(docs.sparkSession)
    model = model or fit(docs, id_col, text_col, lang_col, fit_docs)
    got = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), language(F.col(text_col), docs, model).alias("r"))
    return got.select("doc_id", "held_out", "r.lang_pred", "r.score")
