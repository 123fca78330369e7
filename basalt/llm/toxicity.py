"""Operator 8: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words' weights, and a document's the
noisy-or of its sentences' scores: it is toxic if any sentence is. Only document labels are needed to fit the weights;
the sentence scores then say where the toxic passage is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bound_batches, dropped, shared_dir, written
from .language import held_out, sampled

#: Words, and the marks that end a sentence.
TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
ENDS = ".!?\n"
#: Labelled documents that the model is fitted on, at most about.
FIT_DOCS = 6_000
#: A word or stem counts if it is in that many documents, and that share of them at least, and its documents are toxic so many
#: standard errors more often than all are.
LEAST_DOCS, LEAST_SHARE, SIGNIFICANT = 3, 0.002, 4.5
#: Steps of the fit, their length, and the pull of all weights to zero.
STEPS, RATE, PULL = 300, 0.1, 1e-5
TOXIC = 0.7
#: A word's first characters count as features of their own, so that inflections share what their stem tells.
STEMS = (4, 5, 6)
#: Words whose weights a model remembers.
REMEMBER = 300_000


def features(word: str) -> list[str]:
    """A word, and its stems marked by a star."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


class _Weights(dict):
    """Summed weights of words, infinite for the ends of sentences."""

    def __init__(self, model: ToxicityModel):
        super().__init__(dict.fromkeys(ENDS, np.inf))
        self.model = model

    def __missing__(self, word: str) -> float:
        self[word] = w = float(sum(self.model.weights[self.model.code[f]] for f in features(word) if f in self.model.code))
        return w


Bag = Counter  # of tuples of feature codes, one for each sentence that holds any


def bag(text: str, code: dict[str, int]) -> Bag:
    """A document's sentences by the features that they hold, and how often each such sentence comes."""
    out, held = Counter(), []
    for word in TOKEN.findall(text.lower()):
        if word in ENDS:
            if held:
                out[tuple(sorted(held))] += 1
            held = []
        else:
            held += [code[f] for f in features(word) if f in code]
    if held:
        out[tuple(sorted(held))] += 1
    return out


class ToxicityModel:
    """Weights of the words that count, a sentence bias, and a leak: the chance that a text is toxic without any of them.

    A sentence counts if it holds such a word, so that length alone makes no text toxic. Without labels of both kinds the
    model scores every text by the labels' mean.
    """

    def __init__(self, kept: list[str], bags: list[Bag], labels: list[int], steps: int = STEPS):
        y = np.array(labels, float)
        mean = float(y.mean()) if len(y) else 0.0
        self.leak = min(max(mean, 1e-3), 1 - 1e-3)
        self.bias, self.weights = -1.0, np.zeros(len(kept))
        self.code = {w: i for i, w in enumerate(kept)}
        if 0 < mean < 1:
            self._fit(bags, y, steps)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_remembered"}

    def _fit(self, bags: list[Bag], y: np.ndarray, steps: int) -> None:
        rows = [(d, own, n) for d, b in enumerate(bags) for own, n in b.items()]
        # the leak is one more sentence of every document, without words; those come first
        owner = np.concatenate((np.arange(len(y)), np.array([d for d, _, _ in rows], np.int64)))
        times = np.concatenate((np.ones(len(y)), np.array([n for _, _, n in rows], float)))
        words = np.array([c for _, own, _ in rows for c in own], np.int64)
        sentence = np.repeat(np.arange(len(y), len(owner)), [len(own) for _, own, _ in rows])
        leak = np.arange(len(owner)) < len(y)
        x = np.concatenate((self.weights, [self.bias, np.log(self.leak / (1 - self.leak))]))
        m1, m2 = np.zeros_like(x), np.zeros_like(x)
        for step in range(1, steps + 1):
            p = _logistic(np.where(leak, x[-1], x[-2]) + np.bincount(sentence, x[words], minlength=len(owner)))
            clean = np.exp(np.bincount(owner, times * np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)))  # no sentence is toxic
            g = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-6), 1.0)[owner] * times * p / len(y)
            grad = np.concatenate((np.bincount(words, g[sentence], minlength=len(x) - 2) + PULL * x[:-2], [g[~leak].sum(), g[leak].sum()]))
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            x -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        self.weights, self.bias, self.leak = x[:-2], float(x[-2]), float(_logistic(x[-1]))

    def sentences(self, text: str | None) -> np.ndarray:
        """The scores of the sentences that hold a word that counts."""
        memo = self.__dict__.get("_remembered")
        if memo is None or len(memo) > REMEMBER:
            memo = self._remembered = _Weights(self)
        tokens = TOKEN.findall((text or "").lower())
        weights = np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens))
        ends = np.isinf(weights)
        own = (weights != 0) & ~ends
        ids, at = np.unique(np.cumsum(ends)[own], return_inverse=True)
        return _logistic(self.bias + np.bincount(at, weights[own], minlength=len(ids))[: len(ids)])

    def score(self, text: str | None) -> float:
        return float(1 - (1 - self.leak) * np.prod(1 - self.sentences(text)))

    def locate(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, score) in characters of the sentences that score `least` or more."""
        out, spans, begin, last = [], [], None, None
        for m in TOKEN.finditer(text or ""):
            if m[0] in ENDS:
                if begin is not None:
                    spans.append((begin, last))
                begin = None
            else:
                begin, last = (m.start() if begin is None else begin), m.end()
        if begin is not None:
            spans.append((begin, last))
        for a, b in spans:
            p = self.sentences(text[a:b])
            if len(p) and p[0] >= least:
                out.append((a, b, float(p[0])))
        return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS) -> ToxicityModel:
    """Fit on labelled documents that are not held out, at most about fit_docs of them, chosen by a hash of the id.

    Equal texts are learned once, by the label of the smallest id; a document with any label 1 is toxic. Texts stay on
    the executors: the features are chosen by distributed counts, and only the chosen ones' codes, by sentence, come to
    the driver.
    """
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) == 1).cast("int").alias("toxic"))
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(sampled(marks, fit_docs, "id"), "id")
    once = held.withColumn("key", F.sha2("text", 256)).groupBy("key").agg(F.min_by(F.struct("text", "toxic"), F.struct("id", "toxic")).alias("r")).select("key", "r.*")
    path = shared_dir(docs.sparkSession)
    rows = written(once, path)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, toxic = Counter(), Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64()), pa.array([toxic[w] for w in docs], pa.int64())], ["word", "docs", "toxic"])
            docs.clear()
            toxic.clear()
            return got

        for batch in it:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {f for w in set(TOKEN.findall(text.lower())) if w not in ENDS for f in features(w)}
                docs.update(own)
                toxic.update(own if label else ())
                if len(docs) > 200_000:
                    yield out()
        yield out()

    n, mean = rows.agg(F.count("*"), F.coalesce(F.avg("toxic"), F.lit(0.0))).first()
    least, spread = max(LEAST_DOCS, LEAST_SHARE * n), mean * (1 - mean)
    found = arrow_map(rows.select("text", "toxic"), counted, "word string, docs long, toxic long").groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    bar = SIGNIFICANT * F.sqrt(F.col("docs") * spread)
    kept = sorted(r["word"] for r in found.filter((F.col("docs") >= least) & (bar > 0) & (F.col("toxic") - F.col("docs") * mean >= bar)).select("word").collect())
    code = {w: i for i, w in enumerate(kept)}

    def bagged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            bags = [bag(t, code) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([list(b) for b in bags], pa.list_(pa.list_(pa.int32()))), pa.array([list(b.values()) for b in bags], pa.list_(pa.int64()))], ["key", "toxic", "sentences", "times"])

    got = arrow_map(rows.select("key", "text", "toxic"), bagged, "key string, toxic int, sentences array<array<int>>, times array<long>").toArrow().sort_by("key").to_pydict()
    dropped(docs.sparkSession, path)
    bags = [Counter(dict(zip(map(tuple, s), t, strict=True))) for s, t in zip(got["sentences"], got["times"], strict=True)]
    return ToxicityModel(kept, bags, got["toxic"])


def toxicity(text: Column, docs: DataFrame, model: ToxicityModel) -> Column:
    """The score of a text, double."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(column: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t) for t in column.to_pylist()], pa.float64())

    return scores.asNondeterministic()(text)


def toxic_sentences(text: Column, docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> Column:
    """array<struct<start, end, score>>: where the sentences that score `least` or more stand. Null: empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<start:int,end:int,score:double>>")
    def located(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.array([[{"start": a, "end": b, "score": p} for a, b, p in shared.value.locate(t, least)] for t in column.to_pylist()], kind)

    return located(text)


def score_documents(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (score >= 0.7). Without a model, one is fitted.

    Texts without a word that counts, empty and null ones too, score the leak; with labels of one kind or none, every
    text scores the labels' mean, between 0.001 and 0.999.
    Repeated rows give repeated results; a document labelled more than once counts as toxic if any label says so.
    """
    bound_batches(docs.sparkSession)
    model = model or fit(docs, labels, id_col, text_col, label_col, fit_docs)
    got = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), toxicity(F.col(text_col), docs, model).alias("score"))
    return got.select("*", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
