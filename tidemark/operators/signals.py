"""Tests of a score against what followed: buckets, turnover, standard errors, null distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.crosssection import spearman

#: Ranges that a global order is cut into, each ranked by a task of its own.
RANGES = 64


def global_rank(df: DataFrame, value: str, out: str = "rank0") -> DataFrame:
    """df with the place from 0 of a row's first equal, ``ties`` and the number of all rows, without one task sorting all of them.

    Rows are cut at approximate percentiles of the value, ranked inside their range, and moved on by the counts of the
    ranges before; equal values share a range. The cuts and counts are at most ``RANGES`` rows.
    """
    cuts = sorted(set(df.agg(F.percentile_approx(value, F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])).alias("c")).first()["c"] or []))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value))) if cuts else F.lit(0)
    cut = df.withColumn("_range", place)
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("n_all"))
    inside = cut.withColumns({"_r": F.rank().over(Window.partitionBy("_range").orderBy(value)) - 1, "ties": F.count(F.lit(1)).over(Window.partitionBy("_range", value))})
    return inside.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_before") + F.col("_r")).drop("_range", "_before", "_r")


def split_bucket(place: Column, n: Column, k: int) -> Column:
    """The bucket from 0 of a place from 0 when n rows are split as evenly as they go, longer ones first."""
    size, longer = F.floor(n / k), n % k
    head = (size + 1) * longer
    return F.when(place < head, F.floor(place / (size + 1))).otherwise(longer + F.floor((place - head) / F.greatest(size, F.lit(1)))).cast("int")


def quantile_returns(df: DataFrame, value: str, ret: str, k: int = 5) -> DataFrame:
    """Returns by pooled bucket of the value; a run of equal values goes whole to the bucket of its middle."""
    r = global_rank(df.where(F.col(value).isNotNull() & F.col(ret).isNotNull()), value)
    middle = F.floor((2 * F.col("rank0") + F.col("ties") - 1) / 2)
    b = r.withColumn("bucket", split_bucket(middle, F.col("n_all"), k) + 1)
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("value_from"), F.max(value).alias("value_to"), F.avg(value).alias("mean_value"), F.avg(ret).alias("mean_return"), F.percentile(ret, F.lit(0.5)).alias("median_return"))


def bucket_members(df: DataFrame, value: str, date: str, k: int, tie: str) -> DataFrame:
    """df with the bucket of every row in its date; dates with fewer than two names a bucket are left out."""
    w = Window.partitionBy(date)
    placed = df.withColumns({"bucket": F.ntile(k).over(w.orderBy(value, tie)), "_n": F.count(F.lit(1)).over(w)})
    return placed.where(F.col("_n") >= 2 * k).drop("_n")


def bucket_table(members: DataFrame, value: str, ret: str, date: str) -> DataFrame:
    """Per bucket the means over dates of its per-date means, names a date, and the share of dates above zero."""
    by = members.groupBy(date, "bucket").agg(F.avg(ret).alias("r"), F.avg(value).alias("v"), F.count(F.lit(1)).alias("m"))
    return by.groupBy("bucket").agg(F.avg("m").alias("names"), F.avg("v").alias("mean_value"), F.avg("r").alias("mean_ret"), F.percentile("r", F.lit(0.5)).alias("median_ret"), F.avg((F.col("r") > 0).cast("double")).alias("positive"), F.count(F.lit(1)).alias("dates"))


def bucket_spread(members: DataFrame, value: str, ret: str, date: str, k: int) -> DataFrame:
    """One row: mean of top less bottom over dates, rank correlation of bucket and mean return, and the share of steps up."""
    by = members.groupBy(date, "bucket").agg(F.avg(ret).alias("r"))
    ends = by.groupBy(date).agg((F.max(F.when(F.col("bucket") == k, F.col("r"))) - F.max(F.when(F.col("bucket") == 1, F.col("r")))).alias("s"))
    spread = ends.agg(F.avg("s").alias("spread"), F.count(F.lit(1)).alias("dates"))
    means = bucket_table(members, value, ret, date).select("bucket", "mean_ret", F.lit(1).alias("g"))
    mono = spearman(means, "bucket", "mean_ret", ["g"], "monotonicity").select("monotonicity")
    up = means.withColumn("_s", (F.col("mean_ret") > F.lag("mean_ret").over(Window.partitionBy("g").orderBy("bucket"))).cast("double")).agg(F.avg("_s").alias("steps_up"))
    return spread.crossJoin(mono).crossJoin(up)


def turnover(members: DataFrame, name: str, date: str, k: int) -> DataFrame:
    """For every date but the first the shares of the top and bottom bucket and of all names that are new since the one before."""
    dates = members.select(date).distinct()
    before = dates.withColumn("_p", F.lag(date).over(Window.orderBy(date))).where("_p is not null")
    was = members.select(F.col(date).alias("_p"), name, F.col("bucket").alias("_was"))
    now = members.select(date, name, "bucket").join(F.broadcast(before), date).join(was, ["_p", name], "left")
    share = lambda b: F.avg(F.when(F.col("bucket") == b, F.when(F.col("_was") == b, 0.0).otherwise(1.0)))
    return now.groupBy(date).agg(share(k).alias("top"), share(1).alias("bottom"), F.avg(F.when(F.col("_was").isNull(), 1.0).otherwise(0.0)).alias("churn"))


def turnover_report(turned: DataFrame, spread: Column, spacing_days: Column) -> DataFrame:
    """Means over dates, rebalances a year, and the one-way cost in basis points that eats the spread; null where it isn't earned."""
    out = turned.agg(F.avg("top").alias("top"), F.avg("bottom").alias("bottom"), F.avg("churn").alias("churn"), F.count(F.lit(1)).alias("pairs"))
    out = out.withColumns({"rebalances": 365.25 / spacing_days, "_t": (F.col("top") + F.col("bottom")) / 2})
    return out.withColumn("breakeven_bps", F.when((F.col("_t") > 0) & (spread > 0), spread / (2 * F.col("_t") * F.col("rebalances")) * 10_000)).drop("_t")


def overlap_lag(dates: DataFrame, date: str, horizon_months: int) -> DataFrame:
    """One row: the median gap of the distinct dates in days and the last lag whose windows still overlap."""
    gaps = dates.select(date).distinct().withColumn("_g", F.datediff(date, F.lag(date).over(Window.orderBy(date))))
    out = gaps.agg(F.percentile("_g", F.lit(0.5)).alias("spacing_days"))
    months = F.greatest(F.lit(1), F.bround(F.col("spacing_days") / (365.25 / 12)))
    return out.withColumn("lag", F.coalesce(F.greatest(F.lit(0), F.ceil(F.lit(horizon_months) / months) - 1), F.lit(0)).cast("int"))


def two_sided_p(t: Column) -> Column:
    """Two-sided normal p-value by the rational approximation 7.1.26 of Abramowitz and Stegun, good to 1.5e-7."""
    x = F.abs(t) / F.sqrt(F.lit(2.0))
    k = 1 / (1 + 0.3275911 * x)
    poly = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429))))
    return F.when(t.isNotNull() & ~F.isnan(t), poly * F.exp(-x * x))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that is a function of the key alone, whatever the partition: 32 bits of its md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("double") / 4294967296.0


def block_bootstrap(series: DataFrame, value: str, order: str, block: int, draws: int) -> DataFrame:
    """One row: the spread of the mean over draws of whole blocks, put together to the length of the series; null where a block is longer."""
    x = series.where(F.col(value).isNotNull()).select((F.row_number().over(Window.orderBy(order)) - 1).alias("i"), F.col(value).alias("x"))
    n = x.agg(F.count(F.lit(1)).alias("n"))
    starts = x.sparkSession.range(draws).select(F.col("id").alias("draw")).crossJoin(F.broadcast(n)).where((F.col("n") >= 2) & (F.col("n") >= block))
    starts = starts.withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    first = F.floor(uniform(F.col("draw"), F.col("b")) * (F.col("n") - block + 1))
    places = starts.withColumn("s", first).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("b") * block + F.col("k") < F.col("n"))
    means = places.select("draw", (F.col("s") + F.col("k")).cast("int").alias("i")).join(F.broadcast(x), "i").groupBy("draw").agg(F.avg("x").alias("m"))
    return means.agg(F.count(F.lit(1)).alias("draws"), F.stddev_samp("m").alias("se"))


def permutation_null(df: DataFrame, score: str, ret: str, date: str, name: str, draws: int) -> DataFrame:
    """draw, ic: the mean over dates of the rank correlation when the returns of every date are dealt anew."""
    both = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull()).select(date, name, score, ret)
    w = Window.partitionBy(date)
    ranked = both.withColumns({"_i": F.row_number().over(w.orderBy(name)), "_r": F.col(ret)})
    dealt = ranked.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    dealt = dealt.withColumn("_j", F.row_number().over(Window.partitionBy("draw", date).orderBy(uniform(F.col("draw"), F.col(name), F.col(date).cast("string")), name)))
    other = ranked.select(date, F.col("_i").alias("_j"), F.col("_r").alias("_dealt"))
    pairs = dealt.select("draw", date, "_j", score).join(other, [date, "_j"])
    ics = spearman(pairs, score, "_dealt", ["draw", date])
    return ics.groupBy("draw").agg(F.avg("ic").alias("ic"))


def windows_in_sequence(df: DataFrame, name: str, date: str, horizon_days: int) -> DataFrame:
    """How many holding periods of each name could be held one after another, the earliest taken first.

    A fold over the sorted dates of a name, which are as many as its rebalances.
    """
    days = F.array_sort(F.collect_set(F.unix_date(date)))
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("n"))
    step = lambda s, d: F.when(s["last"].isNull() | (d - s["last"] >= horizon_days), F.struct(d.alias("last"), (s["n"] + 1).alias("n"))).otherwise(s)
    return df.groupBy(name).agg(days.alias("_d")).select(name, F.aggregate("_d", start, step, lambda s: s["n"]).alias("windows"))


def grouped_spearman(df: DataFrame, x: str, y: str, by: list[str], least: int) -> DataFrame:
    """One row: the mean of the groups' rank correlations, over groups of enough rows where it is defined."""
    ics = spearman(df, x, y, by).where((F.col("n") >= least) & F.col("ic").isNotNull())
    return ics.agg(F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("groups"))


def change_spearman(df: DataFrame, name: str, date: str, x: str, y: str) -> DataFrame:
    """Per date the rank correlation of both sides' changes since the name's row before."""
    w = Window.partitionBy(name).orderBy(date)
    moved = df.withColumns({"_dx": F.col(x) - F.lag(x).over(w), "_dy": F.col(y) - F.lag(y).over(w)})
    return spearman(moved, "_dx", "_dy", [date])
