"""Knowledge-dated version choice, ladders and composites over long fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def choose_versions(facts: DataFrame, keys: list[str], form_rank: Column, filed: str, ties: list[Column], as_of: str | None = None) -> DataFrame:
    """One version a key: known by the date, best form first, then the latest filed, then the given order.

    The date is applied before the choice, so a period falls back to an older version instead of
    vanishing. The row is picked by an aggregate of one struct, which is pre-aggregated in every task.
    """
    known = facts if as_of is None else facts.where(F.col(filed) <= F.lit(as_of).cast("date"))
    rest = [c for c in facts.columns if c not in keys]
    order = F.struct(form_rank.alias("_r"), (-F.unix_date(filed)).alias("_f"), *[t.alias(f"_t{i}") for i, t in enumerate(ties)])
    best = known.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def first_usable(facts: DataFrame, keys: list[str], tag: str, ladder: list[str], date: str, value: str, as_of: str, tolerance_days: int) -> DataFrame:
    """For each key the ladder's first tag with a value near the date; zeros count only if nothing else does.

    Keys without any tag stay, with a null value and a reason.
    """
    day = F.lit(as_of).cast("date")
    near = F.col(tag).isin(*ladder) & (F.col(date) <= day) & (F.datediff(day, date) <= tolerance_days)
    latest = facts.groupBy(*keys, tag).agg(F.max(F.when(near, F.struct(date, value))).alias("_x"))
    rank = F.array_position(F.array(*map(F.lit, ladder)), F.col(tag))
    order = F.struct((F.col(f"_x.{value}") == 0).alias("zero"), rank.alias("rank"))
    usable = F.col("_x").isNotNull()
    picked = latest.groupBy(*keys).agg(F.min_by(F.when(usable, F.struct(F.col(tag).alias("t"), F.col(f"_x.{value}").alias("v"))), F.when(usable, order)).alias("_p"))
    return picked.select(*keys, F.col("_p.t").alias("tag"), F.col("_p.v").alias("value"), F.when(F.col("_p").isNull(), "no tag within tolerance").alias("reason"))


def composite(facts: DataFrame, keys: list[str], tag: str, parts: list[str], value: str, filed: str) -> DataFrame:
    """Sum over component tags, only where all are there; it is known when the last of them is."""
    one = facts.where(F.col(tag).isin(*parts)).groupBy(*keys, tag).agg(F.sum(value).alias("_v"), F.max(filed).alias("_f"))
    return one.groupBy(*keys).agg(F.sum("_v").alias(value), F.max("_f").alias(filed), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(parts)).drop("_n")
