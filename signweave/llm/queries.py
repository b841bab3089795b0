"""One query per operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, lines, mixing, packing, passages, quality, search, simhash, tokens, vectors
from .oracles import ORACLES


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, room=4096)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("detections")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeats(_read(spark, sf_dir, "documents"), length=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_read(spark, sf_dir, "embeddings"), cosine=0.98)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_read(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.3)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), most=4, words=4)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_recurring_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Domains of the labelled table and their target weights.
DOMAIN = "case when toxic = 1 then 'toxic' when quality = 1 then 'clean' when quality = 0 then 'poor' end"
TARGETS = {"clean": 0.96, "poor": 0.01, "toxic": 0.03}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _read(spark, sf_dir, "labels").select("doc_id", F.expr(DOMAIN).alias("domain"))
    return mixing.mix(_read(spark, sf_dir, "documents"), labelled, TARGETS, prefix="", columns=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_counts, op2_packing, op3_license_scan, op4_substring_dedup, op5_embedding_near_dedup, op6_exact_top_k, op7_quality_classifier, op8_simhash_near_dedup, op9_line_dedup, op10_mixing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
