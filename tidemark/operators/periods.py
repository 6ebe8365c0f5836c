"""Period algebra over long tables of duration facts: subtraction, tiling, trailing twelve months, anniversaries.

Facts are rows of the key columns, ``start``, ``end``, ``val``, ``form``, ``filed`` and ``ord`` (the order in
which they were reported, which settles ties). Lengths count both ends. A key is one entity's one tag, so
the few hundred periods of a key meet in one row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import periodcore as core
from tidemark.operators.saved import saved

#: Days of a year, of a quarter, the look-back of a trailing year, and the slack of tiles.
ANNUAL, QUARTER, LOOK_BACK, FIRST_SLACK, SLACK, MOST_TILES = (350, 380), (80, 100), 364, 8, 1, 9
_COVER = "array<struct<tiles:int,value:double,days:int,derived:boolean,filed:date>>"


def days(start: str = "start", end: str = "end") -> Column:
    return F.datediff(end, start) + 1


def to_integral(facts: DataFrame) -> DataFrame:
    """Period averages as value times days, which adds up where averages don't."""
    return facts.where("start is not null").withColumn("val", F.col("val") * days())


def _listed(facts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and _p: the filed periods of a key in the order they were reported."""
    first = facts.where("start is not null").groupBy(*keys, "start", "end").agg(F.min_by(F.struct("val", "form", "filed", "ord"), "ord").alias("_f"))
    item = F.struct("_f.ord", "start", "end", F.col("_f.val").cast("double").alias("val"), F.col("_f.form").cast("string").alias("form"), F.col("_f.filed").cast("date").alias("filed"))
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_p")).withColumn("_p", F.transform("_p", lambda x: x.dropFields("ord")))


def _whole_keys(keys: list[str]) -> Column:
    """Facts whose key has a null meet no others."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def _closure(passes: int):
    kind = "array<struct<start:date,end:date,val:double,form:string,filed:date,n:int,b_start:date,b_end:date,s_start:date,s_end:date>>"

    def close(lists: pa.Array, ok: pa.Array) -> pa.Array:
        return core.to_lists(core.closed(lists, ok, passes))

    return F.arrow_udf(close, kind)


def derived_periods(facts: DataFrame, keys: list[str], passes: int = 3) -> DataFrame:
    """All periods, filed or left over when one that shares its start or end is taken from a longer one.

    A pass works on what the passes before it knew; known periods are never replaced, and of several
    differences for one period the first in the order of the longer, then the shorter period counts. What is derived
    is known when the later of its two periods is, and says so in ``derived``. A key's facts meet in one row (see
    ``periodcore``), so facts that are partitioned by a part of the key are not dealt again; values are doubles.
    """
    rows = _listed(facts, keys).select(*keys, F.inline(_closure(passes)("_p", _whole_keys(keys))))
    told = F.when(F.col("b_start").isNotNull(), F.concat_ws("", F.col("b_start"), F.lit(".."), F.col("b_end"), F.lit(" less "), F.col("s_start"), F.lit(".."), F.col("s_end")))
    return rows.select(*keys, "start", "end", "val", "form", "filed", "n", told.alias("derived"))


def cover_window(periods: DataFrame, windows: DataFrame, keys: list[str], *, slack_days: int = FIRST_SLACK) -> DataFrame:
    """For every window (keys, from, to) the tiles that cover it: their number, value, days and whether any is derived.

    Tiles follow each other; the first may begin some days off, the earliest start and then the longest tile is tried
    first, and the first cover in that order is taken. Windows that can't be tiled stay, with nulls.
    """
    tile = F.struct("start", "end", F.col("val").cast("double").alias("val"), "filed", "n", F.col("derived").isNotNull().alias("derived"))
    tiles = periods.groupBy(*keys).agg(F.collect_list(tile).alias("_p"))

    def cover(lists: pa.Array, ends: pa.Array) -> pa.Array:
        return core.covers(core.periods_of(lists), ends, slack_days, SLACK, MOST_TILES)

    return _covers(_by_key(windows, keys, F.struct("from", "to")).join(tiles.hint("merge"), keys, "left").withColumn("_r", F.arrow_udf(cover, _COVER)("_p", "_w")), windows.columns)


def cover_derived(facts: DataFrame, windows: DataFrame, keys: list[str], passes: int = 3) -> DataFrame:
    """``cover_window`` by the ``derived_periods`` of facts; they are derived beside the windows, so only filed facts are dealt."""

    def cover(lists: pa.Array, ends: pa.Array, ok: pa.Array) -> pa.Array:
        return core.covers(core.closed(lists, ok, passes), ends, FIRST_SLACK, SLACK, MOST_TILES)

    met = _by_key(windows, keys, F.struct("from", "to")).join(_listed(facts, keys).hint("merge"), keys, "left")
    return _covers(met.withColumn("_r", F.arrow_udf(cover, _COVER)("_p", "_w", _whole_keys(keys))), windows.columns)


def _covers(met: DataFrame, columns: list[str]) -> DataFrame:
    each = met.select(F.explode(F.arrays_zip("_a", "_r")).alias("_x"))
    return each.select(*[F.col(f"_x._a.{c}").alias(c) for c in columns], *[F.col(f"_x._r.{c}").alias(c) for c in ("tiles", "value", "days", "derived", "filed")])


def _by_key(rows: DataFrame, keys: list[str], window: Column) -> DataFrame:
    """keys, all rows of the key in _a and their windows in _w, in one order."""
    listed = rows.withColumn("_w", window).groupBy(*keys).agg(F.collect_list(F.struct(F.struct(*[F.col(c) for c in rows.columns]).alias("a"), "_w")).alias("_l"))
    return listed.select(*keys, F.col("_l.a").alias("_a"), F.col("_l._w").alias("_w"))


def trailing_twelve_months(facts: DataFrame, as_of: DataFrame, keys: list[str], *, kind: str = "flow") -> DataFrame:
    """keys, as_of, value, filed and method of the twelve months up to each date; null with method null where it can't be formed.

    One filed period of a year that ends on the date is taken as it is; else a year back is tiled. ``kind``
    ``average`` is weighted by days. Periods are derived and tiled beside the dates, so only filed facts are dealt.
    """
    filed = _listed(to_integral(facts) if kind == "average" else facts, keys)

    def trail(lists: pa.Array, ends: pa.Array, ok: pa.Array) -> pa.Array:
        return core.trailing(core.closed(lists, ok, 3), ends, ANNUAL, FIRST_SLACK, SLACK, MOST_TILES)

    windows = _by_key(as_of, keys, F.struct(F.date_sub("as_of", LOOK_BACK).alias("from"), F.col("as_of").alias("to")))
    met = windows.join(filed.hint("merge"), keys, "left").withColumn("_r", F.arrow_udf(trail, _COVER)("_p", "_w", _whole_keys(keys)))
    each = met.select(F.explode(F.arrays_zip("_a", "_r")).alias("_x")).select("_x._a", "_x._r")
    value = F.col("_r.value") / F.col("_r.days") if kind == "average" else F.col("_r.value")
    tiled = F.concat(F.col("_r.tiles").cast("string"), F.lit(" periods tiled"), F.when(F.col("_r.derived"), ", some by subtraction").otherwise(""))
    method = F.when(F.col("_r.tiles") < 0, "single filed annual period").when(F.col("_r.tiles") > 0, tiled)
    return each.select(*[F.col(f"_a.{c}").alias(c) for c in as_of.columns], F.when(F.col("_r.tiles") != 0, value).alias("value"), F.col("_r.filed").alias("filed"), method.alias("method"))


def latest_annual(facts: DataFrame, as_of: DataFrame, keys: list[str]) -> DataFrame:
    """The value of the last filed year that ends on or before each date, beside the date."""
    year = facts.where(F.col("start").isNotNull() & days().between(*ANNUAL)).select(*keys, F.col("end").alias("_e"), "val", "ord")
    met = as_of.join(year, keys, "left").where(F.col("_e").isNull() | (F.col("_e") <= F.col("as_of")))
    best = met.groupBy(*as_of.columns).agg(F.max_by(F.struct("_e", "val"), F.struct("_e", (-F.col("ord")).alias("o"))).alias("_b"))
    return as_of.join(best, as_of.columns, "left").select(*as_of.columns, F.col("_b._e").alias("end"), F.col("_b.val").alias("value"))


def resolve_ttm(facts: DataFrame, as_of: DataFrame, entity: str, tag: str, ladder: list[str], *, guard: float | None = None, annual_fallback: bool = False, default: float | None = None) -> DataFrame:
    """entity, as_of, tag, value, method: the first tag of the ladder whose facts give twelve months.

    With a guard, the largest lower tag of more than guard times a positive winner takes its place: the winner was a part, not the total. Then
    the last filed year, then the default, then a null with the reason.
    """
    dates = as_of.crossJoin(F.broadcast(facts.sparkSession.createDataFrame([(t, k) for k, t in enumerate(ladder)], f"{tag} string, _rank int")))
    got = saved(trailing_twelve_months(facts.where(F.col(tag).isin(*ladder)), dates, [entity, tag]).where("method is not null"))
    by = [entity, "as_of"]
    first = got.groupBy(*by).agg(F.min_by(F.struct("_rank", tag, "value", "method"), "_rank").alias("_w"))
    if guard is not None:
        rest = got.join(first, by).where((F.col("_rank") > F.col("_w._rank")) & (F.col("_w.value") > 0) & (F.col("value") > guard * F.col("_w.value")))
        swap = rest.groupBy(*by).agg(F.max_by(F.struct("_rank", tag, "value", "method"), F.struct("value", (-F.col("_rank")).alias("r"))).alias("_g"))
        first = first.join(swap, by, "left").withColumn("_w", F.coalesce("_g", "_w")).drop("_g")
    out = as_of.join(first, by, "left").select(*by, F.col(f"_w.{tag}").alias(tag), F.col("_w.value").alias("value"), F.col("_w.method").alias("method"))
    if annual_fallback:
        year = latest_annual(facts.where(F.col(tag).isin(*ladder)), dates, [entity, tag]).where("value is not null")
        one = year.groupBy(*by).agg(F.min_by(F.struct(tag, "value"), "_rank").alias("_y"))
        out = out.join(one, by, "left").select(*by, F.coalesce(tag, F.col(f"_y.{tag}")).alias(tag), F.coalesce("value", "_y.value").alias("value"), F.coalesce("method", F.when(F.col("_y").isNotNull(), "latest filed fiscal year")).alias("method"))
    if default is not None:
        out = out.withColumns({"method": F.coalesce("method", F.lit("absent, defaulted")), "value": F.coalesce("value", F.lit(default))})
    return out.withColumn("reason", F.when(F.col("method").isNull(), "no tag tiles twelve months"))


def latest_running_tag(facts: DataFrame, entity: str, tag: str, ladder: list[str]) -> DataFrame:
    """The tag of the ladder whose duration facts run latest, the earlier on the ladder for equal ends: entity, tag, last_end, n."""
    rank = F.array_position(F.array(*map(F.lit, ladder)), F.col(tag))
    runs = facts.where(F.col(tag).isin(*ladder) & F.col("start").isNotNull()).groupBy(entity, tag).agg(F.max("end").alias("e"), F.count(F.lit(1)).alias("n"))
    best = runs.groupBy(entity).agg(F.max_by(F.struct(tag, "e", "n"), F.struct("e", (-rank).alias("r"))).alias("_b"))
    return best.select(entity, F.col(f"_b.{tag}").alias(tag), F.col("_b.e").alias("last_end"), F.col("_b.n").alias("n"))


def quarterly_series(periods: DataFrame, keys: list[str]) -> DataFrame:
    """One quarter for every end, a filed one before a derived one, then the one nearest to 91 days: keys, end, value."""
    q = periods.where(days().between(*QUARTER))
    order = F.struct(F.col("derived").isNotNull().alias("d"), F.abs(days() - 91).alias("off"), F.col("n"))
    return q.groupBy(*keys, "end").agg(F.min_by("val", order).alias("value"))


def annual_series(facts: DataFrame, entity: str, tag: str, ladder: list[str]) -> DataFrame:
    """One fiscal year for every end: the ladder's first tag that has it, its value and when it was filed."""
    rank = F.array_position(F.array(*map(F.lit, ladder)), F.col(tag))
    year = facts.where(F.col(tag).isin(*ladder) & F.col("start").isNotNull() & days().between(*ANNUAL))
    best = year.groupBy(entity, "end").agg(F.min_by(F.struct(tag, "val", "filed"), F.struct(rank.alias("r"), "ord")).alias("_b"))
    return best.select(entity, "end", F.col(f"_b.{tag}").alias(tag), F.col("_b.val").alias("value"), F.col("_b.filed").alias("filed"))


def nearest(left: DataFrame, right: DataFrame, key: str, target: Column, tolerance_days: int, date: str, value: str, *, order: str | None = None, out: str = "match") -> DataFrame:
    """left with the row of right whose date lies nearest to the target day within the tolerance; of two as near, the earlier (or the first by ``order``).

    Both sides are cut into buckets of the tolerance's width and meet in the bucket of the target and its neighbours, so a
    long history is not compared as a whole.
    """
    width = max(1, tolerance_days)
    l_side = left.withColumn("_t", target)
    l_side = l_side.withColumn("_b", F.explode_outer(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.unix_date("_t") / width) + k)))
    r_side = right.select(F.col(key).alias("_k"), F.floor(F.unix_date(date) / width).alias("_rb"), F.col(date).alias("_rd"), F.col(value).alias("_rv"), (F.col(order) if order else F.unix_date(date)).alias("_o"))
    near = F.abs(F.datediff("_rd", "_t"))
    met = l_side.join(r_side, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_rb")) & (near <= tolerance_days), "left")
    best = met.groupBy(*left.columns).agg(F.min_by(F.struct("_rd", "_rv"), F.when(F.col("_rd").isNotNull(), F.struct(near.alias("n"), "_o"))).alias("_m"))
    return best.select(*left.columns, F.col("_m._rd").alias(f"{out}_date"), F.col("_m._rv").alias(out))


def anniversary(left: DataFrame, right: DataFrame, key: str, at: str, years: int, tolerance_days: int, date: str, value: str, out: str = "match") -> DataFrame:
    """The row nearest to so many years of 365.25 days before ``at``; negative years look ahead."""
    return nearest(left, right, key, F.date_sub(at, round(365.25 * years)), tolerance_days, date, value, out=out)


def prior_year_end(left: DataFrame, ends: DataFrame, key: str, at: str, date: str, tolerance_days: int = 10) -> DataFrame:
    """left with the reported period end nearest to a year before, else that day itself."""
    target = F.date_sub(at, 365)
    found = nearest(left, ends, key, target, tolerance_days, date, date, out="prior")
    return found.select(*left.columns, F.coalesce("prior_date", target).alias("prior_end"))


def year_on_year(series: DataFrame, key: str, tolerance_days: int = 25) -> DataFrame:
    """Every end of a quarterly series (key, end, value) beside the one a year before: growth where the base is positive."""
    out = anniversary(series, series, key, "end", 1, tolerance_days, "end", "value", out="before")
    return out.where("before is not null")
