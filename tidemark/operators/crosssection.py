"""Per-date statistics: mid-ranks, correlations, buckets, winsorising, leave-one-out baselines, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def midrank(value: str, by: list[str]) -> Column:
    """Rank from 1 in the group, ties sharing the mean of the ranks they span."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, by: list[str], out: str = "ic") -> DataFrame:
    """n and rank correlation a group over rows that have both; null under three rows or for a constant side."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.withColumns({"_rx": midrank(x, by), "_ry": midrank(y, by)})
    # corr itself divides by zero on a constant side under ANSI rules, so its parts are divided behind a guard
    agg = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("_rx", "_ry").alias("_c"), (F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("_s"))
    return agg.select(*by, "n", F.when((F.col("n") >= 3) & (F.col("_s") > 0), F.col("_c") / F.col("_s")).alias(out))


def buckets(df: DataFrame, value: str, by: list[str], k: int, tie: str, out: str = "bucket") -> DataFrame:
    """Split each group into k runs of sorted values, the first n % k one longer."""
    return df.withColumn(out, F.ntile(k).over(Window.partitionBy(*by).orderBy(value, tie)))


def winsorised(df: DataFrame, value: str, by: list[str], low: float = 0.01, high: float = 0.99, least: int = 20) -> DataFrame:
    """value clipped at the group's percentiles when it has enough rows; ``moved`` tells which were."""
    w = Window.partitionBy(*by)
    lo, hi = (F.percentile(value, F.lit(p)).over(w) for p in (low, high))
    enough = F.count(value).over(w) >= least
    clipped = F.when(enough, F.least(F.greatest(F.col(value), lo), hi)).otherwise(F.col(value))
    return df.withColumn("_c", clipped).withColumn("moved", F.col("_c") != F.col(value)).withColumn(value, F.col("_c")).drop("_c")


def leave_one_out_mean(df: DataFrame, value: str, by: list[str], out: str = "loo_mean") -> DataFrame:
    w = Window.partitionBy(*by)
    n = F.count(value).over(w)
    return df.withColumn(out, F.when(n > 1, (F.sum(value).over(w) - F.col(value)) / (n - 1)))


def leave_one_out_median(df: DataFrame, value: str, by: list[str], tie: str, least: int = 4, out: str = "loo_median") -> DataFrame:
    """Median of the others in the group, from the group's order statistics: no list is gathered.

    Taking out the row of rank r moves every later rank down by one; the two middle ranks of what is left are
    the k-th and (k + 1)-th of the whole, one further on where they lie at or beyond r.
    """
    w = Window.partitionBy(*by)
    o = w.orderBy(value, tie)
    df = df.withColumns({"_r": F.row_number().over(o), "_n": F.count(F.lit(1)).over(w)})
    rows = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = F.col("_n") - 1
    lo, hi = F.floor((m + 1) / 2), F.floor((m + 2) / 2)
    base = {f"_v{i}": F.max(F.when(F.col("_r") == F.floor((F.col("_n") + i) / 2), F.col(value))).over(rows) for i in (0, 1, 2, 3)}
    df = df.withColumns(base)
    # ranks floor((n + i) / 2) for i = 0..3 cover every place that lo and hi can shift to
    at = lambda k: F.when(F.col("_r") <= k, k + 1).otherwise(k)
    pick = lambda k: F.when(at(k) == F.floor(F.col("_n") / 2), F.col("_v0")).when(at(k) == F.floor((F.col("_n") + 1) / 2), F.col("_v1")).when(at(k) == F.floor((F.col("_n") + 2) / 2), F.col("_v2")).otherwise(F.col("_v3"))
    return df.withColumn(out, F.when(m >= least, (pick(lo) + pick(hi)) / 2)).drop("_r", "_n", "_v0", "_v1", "_v2", "_v3")


def auc(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Mann-Whitney area under the curve with mid-ranks; null without both classes."""
    r = df.withColumn("_r", midrank(score, by))
    p, n = F.sum(F.col(label).cast("double")), F.count(F.lit(1))
    rank_sum = F.sum(F.when(F.col(label) == 1, F.col("_r")))
    return r.groupBy(*by).agg(n.alias("n"), p.cast("long").alias("positives"), F.when((p > 0) & (p < n), (rank_sum - p * (p + 1) / 2) / (p * (n - p))).alias("auc"))


def calibration(df: DataFrame, label: str, probability: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the right edge in the last one; empty bins stay."""
    binned = df.withColumn("bin", F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int"))
    got = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_probability"), F.avg(F.col(label).cast("double")).alias("observed"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(F.broadcast(got), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def ndcg(df: DataFrame, query: str, score: str, grade: str, tie: str, k: int) -> DataFrame:
    """Normalised discounted gain at k of each query's ranking; null when nothing is relevant."""
    shown = F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), tie))
    ideal = F.row_number().over(Window.partitionBy(query).orderBy(F.col(grade).desc(), tie))
    gain = lambda place: F.sum(F.when(F.col(place) <= k, F.col(grade) / F.log2(F.col(place) + 1)).otherwise(0.0))
    agg = df.withColumns({"_s": shown, "_i": ideal}).groupBy(query).agg(gain("_s").alias("_d"), gain("_i").alias("_m"))
    return agg.select(query, F.when(F.col("_m") > 0, F.col("_d") / F.col("_m")).alias("ndcg"))
