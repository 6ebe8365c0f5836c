"""As-of joins, returns and ranges over long price tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, at: str, date: str, value: str, *, forward: bool = False, tolerance_days: int | None = None, out: str = "close") -> DataFrame:
    """left with the value of right last seen on or before ``at`` (forward: first on or after), and its date.

    Both sides meet in one sort by key and date and the value is carried along, so the cost is a shuffle
    and a sort, not the pairs an inequality join makes. Rows without a match stay, with nulls.
    """
    columns = left.columns
    l_side = left.select(F.col(key).alias("_k"), F.col(at).alias("_d"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*columns).alias("_row"))
    r_side = right.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(date).alias("_d"), F.col(value).alias("_v"), F.lit(None).cast(l_side.schema["_row"].dataType).alias("_row"))
    day = F.when(F.col("_row").isNull(), F.col("_d"))
    both = l_side.unionByName(r_side).withColumn("_seen", day)
    order = [F.col("_d").desc() if forward else F.col("_d").asc(), F.col("_row").isNotNull().asc()]
    w = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pair = F.last(F.when(F.col("_row").isNull(), F.struct("_seen", "_v")), ignorenulls=True).over(w)
    found = both.withColumn("_m", pair).where(F.col("_row").isNotNull())
    if tolerance_days is not None:
        found = found.withColumn("_m", F.when(F.abs(F.datediff("_d", F.col("_m._seen"))) <= tolerance_days, F.col("_m")))
    return found.select("_row.*", F.col("_m._v").alias(out), F.col("_m._seen").alias(f"{out}_date"))


def weekly_returns(prices: DataFrame) -> DataFrame:
    """symbol, from_date, to_date, ret between the last closes of consecutive ISO weeks that have any."""
    week = prices.groupBy("symbol", F.date_trunc("week", "date").alias("_w")).agg(F.max("date").alias("to_date"), F.max_by("close", "date").alias("close"))
    w = Window.partitionBy("symbol").orderBy("_w")
    moved = week.withColumns({"from_date": F.lag("to_date").over(w), "_before": F.lag("close").over(w)})
    return moved.where("_before is not null").select("symbol", "from_date", "to_date", (F.col("close") / F.col("_before") - 1).alias("ret"))


def realised_volatility(prices: DataFrame, days: int = 365, least: int = 40) -> DataFrame:
    """symbol, date, n, vol: at every week's last close the yearly spread of the weekly returns that lie wholly in the days before it.

    Of the returns that end in the days only the first can begin before them; it is taken out of the frame's sums.
    """
    w = Window.partitionBy("symbol").orderBy(F.unix_date("to_date")).rangeBetween(-days, 0)
    framed = weekly_returns(prices).withColumns({"_n": F.count("ret").over(w), "_s": F.sum("ret").over(w), "_q": F.sum(F.col("ret") * F.col("ret")).over(w), "_f": F.first(F.struct("from_date", "ret")).over(w)})
    early = F.col("_f.from_date") < F.date_sub("to_date", days)
    less = lambda c, x: F.col(c) - F.when(early, x).otherwise(0)
    sums = framed.select("symbol", F.col("to_date").alias("date"), less("_n", F.lit(1)).cast("long").alias("n"), less("_s", F.col("_f.ret")).alias("_s"), less("_q", F.col("_f.ret") * F.col("_f.ret")).alias("_q"))
    var = (F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")) / (F.col("n") - 1)
    return sums.select("symbol", "date", "n", F.when(F.col("n") >= least, F.sqrt(F.greatest(var, F.lit(0.0)) * 52)).alias("vol"))


def price_return(prices: DataFrame, months: int, slack_days: int = 15) -> DataFrame:
    """prices with the return against the last close so many months (of 365.25 / 12 days) before, if one is within the slack."""
    due = prices.select("symbol", "date", F.col("close").alias("now")).withColumn("_due", F.date_sub("date", round(365.25 * months / 12)))
    met = asof(due, prices, "symbol", "_due", "date", "close", tolerance_days=slack_days, out="then")
    return met.select("symbol", "date", "now", F.when(F.col("then") > 0, F.col("now") / F.col("then") - 1).alias("ret"))


def range_position(low: Column, high: Column, last: Column) -> Column:
    """Where the last close stands between a range's ends; null for a range of nothing."""
    return F.when(high > low, (last - low) / (high - low))


def trailing(prices: DataFrame, days: int, **aggregates: Column) -> DataFrame:
    """prices with aggregates over the trailing days up to and with each row's date."""
    w = Window.partitionBy("symbol").orderBy(F.unix_date("date")).rangeBetween(-days, 0)
    return prices.withColumns({name: a.over(w) for name, a in aggregates.items()})


def forward_returns(scores: DataFrame, prices: DataFrame, horizon_days: int) -> DataFrame:
    """scores with entry and exit closes, ret and the reason where there is none.

    Entry is the last close on or before the date; exit the first one a horizon or more after the date.
    """
    entered = asof(scores, prices, "symbol", "as_of", "date", "close", out="entry")
    due = entered.withColumn("_due", F.date_add("as_of", horizon_days))
    left = asof(due, prices, "symbol", "_due", "date", "close", forward=True, out="exit").drop("_due")
    reason = F.when(F.col("entry").isNull(), "no price on or before the date").when(F.col("exit").isNull(), "no price at the horizon").when(F.col("entry") <= 0, "entry price is not positive")
    return left.withColumn("reason", reason).withColumn("ret", F.when(F.col("reason").isNull(), F.col("exit") / F.col("entry") - 1))


def newey_west(series: DataFrame, value: str, order: str, lag: int) -> DataFrame:
    """n, mean, naive and Bartlett-weighted standard errors of a mean of overlapping observations, one a date."""
    x = series.where(F.col(value).isNotNull() & ~F.isnan(value)).select(order, F.col(value).cast("double").alias("_x"))
    stats = x.agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"))
    dev = x.crossJoin(F.broadcast(stats)).withColumn("_d", F.col("_x") - F.col("mean"))
    w = Window.orderBy(order)
    lagged = dev.select("_d", *[F.lag("_d", j).over(w).alias(f"_l{j}") for j in range(1, lag + 1)])
    sums = lagged.agg(F.sum(F.col("_d") * F.col("_d")).alias("_g0"), *[F.sum(F.col("_d") * F.col(f"_l{j}")).alias(f"_g{j}") for j in range(1, lag + 1)])
    both = stats.crossJoin(F.broadcast(sums))
    gamma = lambda j: F.coalesce(F.col(f"_g{j}"), F.lit(0.0)) / F.col("n")
    total = gamma(0)
    for j in range(1, lag + 1):
        total = total + 2.0 * (1.0 - j / (lag + 1)) * gamma(j)
    ok = F.col("n") > lag
    return both.select("n", "mean", F.when(ok, F.sqrt(gamma(0) / F.col("n"))).alias("se_naive"), F.when(ok, F.sqrt(F.greatest(total, F.lit(0.0)) / F.col("n"))).alias("se"), F.when(~ok, "lag is not below n").alias("reason"))
