"""The corpus pipeline: documents -> quality rules -> line dedup -> near-duplicate join -> mixing -> packing.

Every stage is one operator of ``tidemark.llm`` at production parameters. A stage gets all that its
predecessor kept, written as Parquet and read again, and returns the columns of ``documents``; the last
returns the packed pieces. Stages share no state but those tables.

- ``quality_rules`` keeps the documents that pass the counts and the divergence rules, unchanged.
- ``line_dedup`` deletes later copies of runs of lines and of single long lines; a document left without a word goes.
- ``near_duplicates`` keeps, of every group of linked documents, the one with the smallest id, of
  rows that share that id all; documents without an id are in no group and stay.
- ``mix_sources`` keeps every document and writes them in the order of the schedule: the rows of its
  files, in the order of the files' numbers.
- ``best_fit_packing`` packs all that is left into sequences of 2048 tokens, in contiguous ranges of that
  order, and numbers the sequences in it, so sequence_id runs through the sources in their target shares.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import store
from tidemark.llm.line_dedup import drop_repeated_lines
from tidemark.llm.mixing import in_mixed_order, mix_sources
from tidemark.llm.packing import best_fit_pack
from tidemark.llm.parity_join import near_duplicate_groups
from tidemark.llm.quality_rules import quality_verdicts

#: The stages are not all expressible in SQL; tests hold their operators against brute force and each stage against the one before.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_verdicts(docs, carry=tuple(docs.columns)).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    emptied = (F.col("n_removed_lines") > 0) & (F.col("n_removed_lines") == F.col("n_lines"))
    out = drop_repeated_lines(docs).where(~emptied)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(docs.select("doc_id", "text"))
    drop = groups.where("doc_id > component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(drop, F.col("doc_id") == F.col("_gone"), "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_mixed_order(mix_sources(docs)).select(*docs.columns)


def in_file_order(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of a Parquet table with position, their number in the order of its files and of the rows in each."""
    sizes = docs.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("n")).collect()
    # part-00012-<id>-c000: the partition's number, then the file's among those of the partition
    number = lambda path: [int(k) for k in re.findall(r"(?:part-|-c)(\d+)(?=[-.])", path.rsplit("/", 1)[-1])]
    before, rows = 0, []
    for r in sorted(sizes, key=lambda r: (number(r["_file"]), r["_file"])):
        rows.append((r["_file"], before))
        before += r["n"]
    table = F.broadcast(spark.createDataFrame(rows, "_file string, _before long"))
    read = docs.select(*docs.columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    return read.join(table, F.col("_path") == F.col("_file")).select(*docs.columns, (F.col("_before") + F.col("_row")).alias("position"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_pack(in_file_order(spark, docs), position="position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mixing),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
