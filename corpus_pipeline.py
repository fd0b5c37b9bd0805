"""A training-data pipeline over documents: each stage works on all that the one before it kept.

Every stage takes null ids and texts, empty and very long texts, repeated rows, an empty table and extra columns of any name. All
stages but the last return the columns that they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import ngram_join, packing, quality_classifier, substring_dedup, toxicity
from tablewright.llm.common import documents, table
from tablewright.llm.queries import labelled


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3 stay; null texts are scored as empty, equal rows alike, a score of 0.3 stays."""
    return quality_classifier.keep_good(docs, labelled(spark, sf_dir, "quality"), threshold=0.3)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under 0.5 stay; null texts are scored as empty, equal rows alike, a score of 0.5 goes."""
    return toxicity.keep_clean(docs, labelled(spark, sf_dir, "toxic"), threshold=0.5)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 0.8 of five-word shingles tie together the one of the smallest id stays (null is the largest), of equal rows one; texts without words all stay."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that start in a document of a smaller id too go; null texts become empty, documents stay even when nothing is left."""
    return substring_dedup.without_repeats(docs, span=50)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in sequences; null texts are a piece of one token, equal rows are pieces of their own, extra columns end here."""
    return packing.pack(packing.pieces(docs, packing.vocabulary()))


STAGES = [
    ("quality_classifier", keep_good),
    ("toxicity", keep_clean),
    ("ngram_join", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: SQL expresses neither the trained models nor the packing; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, f"stage-{name}")
    return docs
