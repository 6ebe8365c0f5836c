"""Readers of the driver's tables under the names that the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, close: the mean unit price a supplier shipped at that day."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    return lines.groupBy("symbol", "date").agg(F.round(F.avg("p") + 1e-9, 6).alias("close"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of reported values: entity, period, part, form, filed, value and the order of ties."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("period"), F.col("l_returnflag").alias("form"), F.to_date("l_shipdate").alias("filed"), F.col("l_extendedprice").alias("value"), F.col("l_partkey").alias("tie1"), F.col("l_suppkey").alias("tie2"), F.col("l_discount").alias("tie3"))


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, sector, qtr (its last day), total: what a customer ordered in a qtr."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)).alias("qtr"), F.col("o_totalprice").alias("p"))
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("sector"))
    return o.groupBy("entity", "qtr").agg(F.round(F.sum("p"), 2).alias("total")).join(c, "entity")
