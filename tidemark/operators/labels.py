"""Outcomes, labels and dated lookups: what followed a date, and what a date may know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.periods import nearest
from tidemark.operators.series import asof

#: Days without a price that make a delisting, and days that a member stays after its last filing.
DELISTING_GAP, STALE = 30, 460


def listed_on(when: Column, admitted: Column, departed: Column, last_filing: Column | None = None) -> Column:
    """Membership on a date: admitted inclusive, departed exclusive, an unknown admission admits, stale filers are out."""
    inside = (admitted.isNull() | (admitted <= when)) & (departed.isNull() | (when < departed))
    return inside if last_filing is None else inside & (last_filing.isNull() | (F.datediff(when, last_filing) <= STALE))


def members_on(dates: DataFrame, members: DataFrame, date: str = "as_of") -> DataFrame:
    """Every date with its members; dates are a small table, so the interval join is a broadcast of them."""
    return members.join(F.broadcast(dates), listed_on(F.col(date), F.col("admitted"), F.col("departed"), F.col("last_filing") if "last_filing" in members.columns else None))


def dated_lookup(left: DataFrame, intervals: DataFrame, key: str, at: str, since: str, through: str, value: str, out: str) -> DataFrame:
    """left with the value whose interval (both ends inside, open ones null) holds its date; of several the one that began last."""
    r = intervals.select(F.col(key).alias("_k"), F.col(since).alias("_s"), F.col(through).alias("_t"), F.col(value).alias("_v"))
    inside = (F.col("_s").isNull() | (F.col("_s") <= F.col(at))) & (F.col("_t").isNull() | (F.col(at) <= F.col("_t")))
    met = left.join(r, (F.col(key) == F.col("_k")) & inside, "left")
    best = met.groupBy(*left.columns).agg(F.max_by("_v", F.struct("_s", "_v")).alias(out))
    return best


def deal_in_window(left: DataFrame, deals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """left with the earliest deal strictly after the start and not after the end: announced and offer."""
    r = deals.select(F.col(key).alias("_k"), F.col("announced").alias("_a"), F.col("offer").alias("_o"))
    met = left.join(r, (F.col(key) == F.col("_k")) & (F.col("_a") > F.col(start)) & (F.col("_a") <= F.col(end)), "left")
    best = met.groupBy(*left.columns).agg(F.min_by(F.struct("_a", "_o"), F.struct("_a", "_o")).alias("_d"))
    return best.select(*left.columns, F.col("_d._a").alias("announced"), F.col("_d._o").alias("offer"))


def outcomes(scores: DataFrame, prices: DataFrame, deals: DataFrame, benchmark: DataFrame, horizon_days: int, delisting_return: float | None) -> DataFrame:
    """scores (symbol, as_of, score) with exit_kind and the return over the horizon, or none with the kind that says why.

    Held where a close exists at the horizon; else acquired where a deal falls inside it: out at the offer, or at the last close, and
    the rest of the horizon at the benchmark; else censored where the prices run to the end of the panel; else delisted.
    """
    last = prices.groupBy("symbol").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"))
    panel_last = prices.agg(F.max("date").alias("panel_last"))
    df = asof(scores, prices, "symbol", "as_of", "date", "close", out="entry")
    df = df.withColumn("horizon_end", F.date_add("as_of", horizon_days))
    df = asof(df, prices, "symbol", "horizon_end", "date", "close", forward=True, out="exit")
    df = df.join(last, "symbol", "left").crossJoin(F.broadcast(panel_last))
    df = deal_in_window(df, deals, "symbol", "as_of", "horizon_end")
    offered = F.col("offer") > 0
    df = df.withColumns({"_out": F.when(offered, F.col("announced")).otherwise(F.col("last_date")), "_price": F.when(offered, F.col("offer")).otherwise(F.col("last_close")), "_one": F.lit(1)})
    market = benchmark.withColumn("_one", F.lit(1))
    df = asof(df, market, "_one", "_out", "date", "close", forward=True, out="_b0")
    df = asof(df, market, "_one", "horizon_end", "date", "close", forward=True, out="_b1")
    carry = F.when((F.col("_out") < F.col("horizon_end")) & (F.col("_b0") > 0) & F.col("_b1").isNotNull(), F.col("_b1") / F.col("_b0") - 1).otherwise(0.0)
    usable = F.col("entry") > 0
    kind = F.when(F.col("last_date").isNull() | ~F.coalesce(usable, F.lit(False)), "no price").when(F.col("exit").isNotNull(), "held").when(F.col("announced").isNotNull(), "acquired").when(F.datediff("panel_last", "last_date") <= DELISTING_GAP, "censored").otherwise("delisted")
    df = df.withColumn("exit_kind", kind)
    deal = F.col("_price") / F.col("entry") * (1 + carry) - 1
    ret = F.when(F.col("exit_kind") == "held", F.col("exit") / F.col("entry") - 1).when(F.col("exit_kind") == "acquired", deal).when(F.col("exit_kind") == "delisted", F.lit(delisting_return).cast("double"))
    return df.select(*scores.columns, "entry", "exit_kind", ret.alias("ret"))


def next_labels(panel: DataFrame, key: str, date: str, value: str, horizons: int, tolerance_days: int = 45) -> DataFrame:
    """key, date, h, label: for every horizon of h years the value of the entity's row nearest to it, within the tolerance."""
    ahead = panel.select(key, date).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    ahead = ahead.withColumn("_due", F.date_add(date, F.round(F.col("h") * 365.25).cast("int")))
    return nearest(ahead, panel, key, F.col("_due"), tolerance_days, date, value, out="label").select(key, date, "h", "label", "label_date")


def latest_before(left: DataFrame, right: DataFrame, key: str, at: str, date: str, value: str, out: str) -> DataFrame:
    """left with the value of the right row dated last on or before it (the as-of join that attaches a panel to labels)."""
    return asof(left, right, key, at, date, value, out=out)


def matched(labels: DataFrame, features: DataFrame, on: list[str], flag: str = "matched") -> DataFrame:
    """Labels with their features and whether there are any; none is dropped, so what is unmatched can be counted."""
    return labels.join(features.withColumn(flag, F.lit(True)), on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def survivorship(named: DataFrame, universe: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Named entities beside the universe: known or not, how often named, and the event that took them away."""
    counts = named.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    known = universe.select(key).distinct().withColumn("in_universe", F.lit(True))
    event = events.groupBy(key).agg(F.min("announced").alias("event"))
    return counts.join(known, key, "left").join(event, key, "left").withColumn("in_universe", F.coalesce("in_universe", F.lit(False)))


def quarter_ends(spark, first: str, last: str) -> DataFrame:
    months = F.sequence(F.trunc(F.lit(first).cast("date"), "quarter"), F.lit(last).cast("date"), F.expr("interval 3 months"))
    ends = spark.range(1).select(F.explode(months).alias("m")).select(F.last_day(F.add_months("m", 2)).alias("as_of"))
    return ends.where(F.col("as_of").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def rebalance_dates(spark, first: str, last: str, months: int) -> DataFrame:
    """Every so many months on the first date's day; a month too short for it takes the 28th, not its end."""
    start = F.lit(first).cast("date")
    n = F.floor(F.months_between(F.last_day(F.lit(last).cast("date")), F.trunc(start, "month")) / months).cast("int")
    k = spark.range(1).select(F.explode(F.sequence(F.lit(0), n)).alias("k"))
    month = F.add_months(F.trunc(start, "month"), (F.col("k") * months).cast("int"))
    day = F.when(F.dayofmonth(start) > F.dayofmonth(F.last_day(month)), 28).otherwise(F.dayofmonth(start))
    return k.select(F.make_date(F.year(month), F.month(month), day).alias("as_of")).where(F.col("as_of") <= F.lit(last).cast("date"))


def event_labels(members: DataFrame, dates: DataFrame, events: DataFrame, key: str, last_known: str, horizon_months: int = 12, gap_days: int = 90) -> DataFrame:
    """key, as_of, label for members on each date: after the event, in the gap, unresolved, positive or negative, in this order."""
    event = events.groupBy(key).agg(F.min("announced").alias("event"))
    df = members_on(dates, members).join(event, key, "left")
    gap = F.date_add("as_of", gap_days)
    end = F.add_months(gap, horizon_months)
    label = F.when(F.col("event") <= F.col("as_of"), "after").when(F.col("event") <= gap, "in gap").when(end > F.lit(last_known).cast("date"), "unresolved").when(F.col("event") <= end, "positive").otherwise("negative")
    return df.select(key, "as_of", label.alias("label"))


def unaffected_price(deals: DataFrame, prices: DataFrame, key: str, days: int = 30) -> DataFrame:
    """deals (key, announced) with the last close before the announcement and the mean of the closes in the days before it."""
    r = prices.select(F.col(key).alias("_k"), F.col("date").alias("_d"), F.col("close").alias("_c"))
    met = deals.join(r, (F.col(key) == F.col("_k")) & (F.col("_d") < F.col("announced")) & (F.col("_d") >= F.date_sub("announced", 365)), "left")
    recent = F.when(F.col("_d") >= F.date_sub("announced", days), F.col("_c"))
    return met.groupBy(*deals.columns).agg(F.max_by("_c", "_d").alias("unaffected"), F.avg(recent).alias("mean_before"))


def announcement_date(deals: DataFrame, filings: DataFrame, key: str, days: int = 30) -> DataFrame:
    """The earliest related filing from the agreement on (its floor) within the days after, and never before the floor."""
    r = filings.select(F.col(key).alias("_k"), F.col("filed").alias("_f"))
    met = deals.join(r, (F.col(key) == F.col("_k")) & F.col("_f").between(F.col("floor"), F.date_add("floor", days)), "left")
    return met.groupBy(*deals.columns).agg(F.greatest(F.min("_f"), F.first("floor")).alias("announced"))


def completion(deals: DataFrame, filings: DataFrame, key: str, as_of: str, pending_days: int = 540) -> DataFrame:
    """completed with its date where a completion form follows the announcement, else pending for a while, then unresolved."""
    r = filings.select(F.col(key).alias("_k"), F.col("filed").alias("_f"))
    day = F.lit(as_of).cast("date")
    met = deals.join(r, (F.col(key) == F.col("_k")) & (F.col("_f") >= F.col("announced")) & (F.col("_f") <= day), "left")
    best = met.groupBy(*deals.columns).agg(F.min("_f").alias("completed"))
    status = F.when(F.col("completed").isNotNull(), "completed").when(F.datediff(day, "announced") <= pending_days, "pending").otherwise("unresolved")
    return best.withColumn("status", status)


def peer_percentile(df: DataFrame, value: str, by: list[str], least: int = 3, out: str = "percentile") -> DataFrame:
    """Share of a group's values below a row's, equal ones counting half; null in groups of fewer values."""
    w = Window.partitionBy(*by)
    n = F.count(value).over(w)
    below = F.rank().over(w.orderBy(F.col(value).asc_nulls_last())) - 1
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return df.withColumn(out, F.when((n >= least) & F.col(value).isNotNull(), (below + 0.5 * same) / n))


def relative_to_peers(df: DataFrame, value: str, date: str, vertical: str, least: int = 5, out: str = "relative") -> DataFrame:
    """A value less the median of its vertical that day, or of the whole day where the vertical has too few."""
    day = df.groupBy(date).agg(F.percentile(value, F.lit(0.5)).alias("_day"))
    near = df.groupBy(date, vertical).agg(F.percentile(value, F.lit(0.5)).alias("_near"), F.count(value).alias("_n"))
    met = df.join(near, [date, vertical], "left").join(F.broadcast(day), date)
    return met.withColumn(out, F.col(value) - F.when(F.col("_n") >= least, F.col("_near")).otherwise(F.col("_day"))).drop("_near", "_n", "_day")
