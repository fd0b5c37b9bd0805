"""The queries of this subpackage: opN_<name> for each operator, over the whole documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, licenses, lm_scoring, ngram_join, oracles, packing, pieces, quality_classifier, quality_rules, substring_dedup, toxicity
from .common import crc_fold, documents


def labelled(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Training labels: those of documents outside the held-out fold."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_fold() != 0).select("doc_id", F.col(label).alias("label"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_classifier.classify(documents(spark, sf_dir), labelled(spark, sf_dir, "quality"), threshold=0.3)
    return found.select("doc_id", (crc_fold() == 0).alias("held_out"), "score", "predicted")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(documents(spark, sf_dir), pieces.model_path())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(documents(spark, sf_dir), labelled(spark, sf_dir, "toxic"), threshold=0.5)
    return found.select("doc_id", (crc_fold() == 0).alias("held_out"), "score", "predicted")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir), n=4, percent=85).select("doc_id", "n_shingles", "class_id", "component_id", "n_links")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), packing.vocabulary()))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(documents(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"), span=50)
    return found.select("_rest.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply(documents(spark, sf_dir))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir), crc_fold(mod=10) != 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_pieces, op3_toxicity, op4_ngram_join, op5_packing, op6_fingerprints, op7_licenses, op8_suffix_dedup, op9_quality_rules, op10_lm_scoring)}


def oracle_sql() -> dict[str, str]:
    """The others have trained models, own hashes or a packing in their columns: tests/llm holds them against brute force."""
    return {"op4_ngram_join": oracles.NGRAM_JOIN, "op8_suffix_dedup": oracles.SUFFIX_DEDUP}
