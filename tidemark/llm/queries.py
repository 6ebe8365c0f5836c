"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.hamming_topk import top_k
from tidemark.llm.license_scan import license_detections
from tidemark.llm.line_dedup import drop_repeated_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.ordinal import classify, graded, train
from tidemark.llm.packing import best_fit_pack
from tidemark.llm.parity_join import near_duplicate_groups
from tidemark.llm.quality_rules import quality_verdicts
from tidemark.llm.repeated_windows import drop_repeated_words
from tidemark.llm.suffix_dedup import drop_repeated_bytes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(_table(spark, sf_dir, "documents"))


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op9_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_words(_table(spark, sf_dir, "documents")).drop("kept")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_detections(_table(spark, sf_dir, "documents")).drop("detections")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(_table(spark, sf_dir, "documents")).drop("kept")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "longest_run", F.sha2("text", 256).alias("kept_sha256"))


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_multi_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return classify(documents, train(documents, graded(_table(spark, sf_dir, "labels"))))


def op8_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(_table(spark, sf_dir, "documents")).drop("node")
