"""Corpus pipeline: quality filter, exact dedup, near dedup, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run``
writes every stage's result as Parquet into the shared checkpoint folder and reads it again. All
stages but the last return the columns of ``documents``; the last returns one row for each document
that the mix takes, with its number of copies and words.

Rows with a null id stay in every filtering stage unless their text is a copy, low in quality or
contaminated; an empty table passes through, and without trusted positives every document passes the
classifier. ``ORACLE_SQL`` is None, as the classifier and the mix
have no SQL form; the tests compare the stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import decontaminate, exact_dedup, mixing, ngram_join, quality
from veilwork.llm._common import materialise, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, threshold=0.3)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)
    kept = exact_dedup.new_rows(docs, index, keep="last")
    index.drop()  # a run starts with an empty index; what is kept has been found
    return kept


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id stays.

    Documents are linked when the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
    Null ids come last, and texts of equal or null ids are rows of their own.
    """
    return ngram_join.drop_near_duplicates(docs, size=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(docs).filter("copies > 0")
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
