"""Corpus pipeline over the documents table: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import language, packing, simhash, substring_dedup, toxicity
from basalt.llm.common import bound_batches, dropped, free_name, shared_dir, written

#: A document stays if its language has at least this score. Labelled documents score 0.28 (mixes of three languages) and more,
#: held-out ones of the 10,000-document table 0.45 and more; texts in letters never learned 0, and those with mostly such
#: words their share of other words at most.
SURE = 0.25
#: Similarity of near copies.
SIMILAR = 0.8
#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 4096, 1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified with a score of at least SURE; the model is fitted on the input.

    Null and empty texts and those without letters are rejected, and so are all without any labelled document. Repeated
    rows stay or go together, rows with a null id are judged by their texts; other columns pass, whatever their names.
    An empty table stays empty.
    """
    bound_batches(spark)
    name = free_name(docs.columns, "language")
    found = docs.withColumn(name, language.language(F.col("text"), docs, language.fit(docs)))
    return found.filter((F.col(name).getField("lang_pred") != language.UNKNOWN) & (F.col(name).getField("score") >= SURE)).select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic; the model is fitted on the labelled documents of the input.

    Null and empty texts score the model's leak and stay unless most labelled documents are toxic. Repeated rows stay or go
    together, rows with a null id are judged by their texts; other columns pass, whatever their names. An empty table
    stays empty.
    """
    bound_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs.columns, "toxicity")
    return docs.withColumn(name, toxicity.toxicity(F.col("text"), docs, model)).filter(F.col(name) < toxicity.TOXIC).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: 0.8 or more of their five-word shingles agree.

    Pairs come from the Gray-order index over SimHash fingerprints, within 2 bits as in operator 3, and those farther apart
    from MinHash keys besides; each is then checked exactly. Rows that repeat an id stay or go together; rows with a null
    id and null, empty and blank texts stay. Other columns pass, whatever their names. An empty table stays empty.
    """
    found = simhash.similar_groups(docs, similarity=SIMILAR, shingle=5)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words of 13-word windows that an earlier document holds; documents left without words go, and n_chars, if there
    is such a column, follows the text.

    Null, empty and short texts and rows with a null id stay as they are; rows that repeat an id lose nothing to each
    other. Other columns pass, whatever their names. An empty table stays empty.
    """
    got = substring_dedup.deduplicated(docs)
    return got.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else got


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences; one row a piece.

    Null and empty texts are their end id alone; repeated rows are packed once each, and rows with a null id too. An empty
    table gives no row.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=CAPACITY, end_id=END)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_cut),
    ("best_fit_packing", best_fit_pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. A stage's rows are deleted once the next one's are written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = shared_dir(spark)
        docs = written(stage(spark, docs, sf_dir), path)
        if last:
            dropped(spark, last)
        last = path
    return docs


#: SQL can't express the models, the fingerprints' hash or the packing.
ORACLE_SQL = None
