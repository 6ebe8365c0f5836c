"""The fact store: units, validity, dimensions, guards, and the statement lines built from ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.valuation import known

#: Units in the order they are preferred, and forms of periodic reports with their ranks.
UNITS = ("USD", "shares", "USD/shares", "pure")
FORMS = {"10-K": 0, "10-K/A": 0, "10-KT": 0, "20-F": 0, "40-F": 0, "10-Q": 1, "10-Q/A": 1, "6-K": 1}
OTHER_FORM = 2


def form_rank(form: Column) -> Column:
    out = F.lit(OTHER_FORM)
    for rank in sorted(set(FORMS.values()), reverse=True):
        out = F.when(form.isin(*[f for f, r in FORMS.items() if r == rank]), rank).otherwise(out)
    return out


def preferred_unit(facts: DataFrame, keys: list[str], unit: str = "unit", order: str = "ord") -> DataFrame:
    """Only the rows of each key's preferred unit; of unlisted ones, that which was reported first."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, UNITS)), F.col(unit)), F.lit(0))
    first = facts.groupBy(*keys, unit).agg(F.min(order).alias("_o"), F.first(F.when(rank > 0, rank).otherwise(99)).alias("_r"))
    best = first.groupBy(*keys).agg(F.min_by(unit, F.struct("_r", "_o")).alias("_u"))
    return facts.join(best, keys).where(F.col(unit) == F.col("_u")).drop("_u")


def usable_rows(facts: DataFrame) -> DataFrame:
    """Rows with an end and a value that is a number."""
    return facts.where(F.col("end").isNotNull() & known(F.col("val")).isNotNull())


def lookahead(rows: DataFrame, at: str, *dates: str) -> DataFrame:
    """Rows that hold a date after the one they stand for: there must be none."""
    return rows.where(F.greatest(*[F.coalesce(F.col(d), F.col(at)) for d in dates]) > F.col(at))


def dimension_kind(dims: Column, segment_axis: str, geography_axis: str) -> Column:
    """consolidated, segment, geography or excluded, by the axes that a fact's dimensions name."""
    n = F.size(F.map_keys(dims))
    only = lambda axis: (n == 1) & F.map_contains_key(dims, axis)
    return F.when(dims.isNull() | (n == 0), "consolidated").when(only(segment_axis), "segment").when(only(geography_axis), "geography").otherwise("excluded")


def axis_member(dims: Column, local_name: str) -> Column:
    """The member under an axis whose name ends in the local name, whatever its prefix."""
    hit = F.map_filter(dims, lambda k, _: F.element_at(F.split(k, ":"), -1) == local_name)
    return F.get(F.map_values(hit), F.lit(0))


def undimensioned(facts: DataFrame, as_of: str, instant: bool) -> DataFrame:
    """Facts without dimensions, of one kind, that end by the date."""
    plain = F.col("dims").isNull() | (F.size("dims") == 0)
    return facts.where(plain & (F.col("end") <= F.lit(as_of).cast("date")) & (F.col("start").isNull() if instant else F.col("start").isNotNull()))


def first_values(facts: DataFrame, keys: list[str], order: str = "ord", slack: float = 0.5) -> DataFrame:
    """One value a key, the first reported, and whether the key's values differ by more than the slack."""
    return facts.groupBy(*keys).agg(F.min_by("val", order).alias("val"), (F.max("val") - F.min("val") > slack).alias("conflict"))


def explicitly_zero(facts: DataFrame, entity: str, date: str) -> DataFrame:
    """entity, date, zero: is there a fact of exactly nothing on the date."""
    return facts.groupBy(entity, date).agg(F.max((F.col("val") == 0).cast("int")).cast("boolean").alias("zero"))


def dwarfed(value: Column, other: Column, times: float) -> Column:
    """Is a positive value less than so small a part of another that it can't be the total."""
    return (known(value) > 0) & (known(other) > times * value)


def far_apart(a: Column, b: Column, times: float) -> Column:
    """Are two positive amounts more than so many times apart, either way."""
    return F.when((known(a) > 0) & (known(b) > 0), F.abs(F.ln(a / b)) > F.ln(F.lit(float(times))))


def latest_by_class(facts: DataFrame, entity: str, as_of: str) -> DataFrame:
    """Shares of all classes on the latest day that has any, by the date: entity, end, shares, classes."""
    rows = facts.where(F.col("end") <= F.lit(as_of).cast("date")).groupBy(entity, "end").agg(F.sum("val").alias("shares"), F.count(F.lit(1)).alias("classes"))
    return rows.groupBy(entity).agg(F.max_by(F.struct("end", "shares", "classes"), "end").alias("b")).select(entity, "b.*")


def latest_documents(documents: DataFrame, entity: str, as_of: Column, date: str, text: str) -> DataFrame:
    """The document last filed by the date, one an entity."""
    return documents.where(F.col(date) <= as_of).groupBy(entity).agg(F.max_by(F.struct(date, text), F.struct(date, text)).alias("b")).select(entity, "b.*")


def basis_factor(pinned: Column, current: Column, ratios: tuple[float, ...], tolerance: float = 0.01) -> Column:
    """Which ratio two vintages of one figure are apart, 1 included; null where it is none."""
    r = F.when(known(pinned) > 0, known(current) / pinned)
    return F.get(F.filter(F.array(F.lit(1.0), *map(F.lit, ratios)), lambda x: F.abs(r - x) <= tolerance * x), F.lit(0))


def straight_debt(noncurrent: Column, current: Column, combined: Column) -> Column:
    """Both legs where there is a long one, else the combined tag, else the short leg alone; nothing reported is nothing owed."""
    return F.coalesce(noncurrent + F.coalesce(current, F.lit(0.0)), combined, current, F.lit(0.0))


def lease(noncurrent: Column, current: Column, whole: Column) -> Column:
    """struct of the long and short part of a lease, from its legs or, without any, from a total taken as long."""
    split = noncurrent.isNotNull() | current.isNotNull()
    zero = F.lit(0.0)
    return F.struct(F.when(split, F.coalesce(noncurrent, zero)).otherwise(F.coalesce(whole, zero)).alias("noncurrent"), F.when(split, F.coalesce(current, zero)).otherwise(zero).alias("current"))


def operating_profit(ebit: Column, pretax: Column, interest: Column) -> Column:
    """struct of the profit and where it comes from: the line itself, or profit before tax with the interest put back."""
    return F.struct(F.coalesce(ebit, pretax + F.coalesce(interest, F.lit(0.0))).alias("value"), F.when(ebit.isNotNull(), "reported").when(pretax.isNotNull(), "pretax plus interest").otherwise("missing").alias("source"))


def diluted_shares(diluted: Column, basic: Column, income: Column) -> Column:
    """Diluted shares; for a loss, where dilution is left out, basic ones do."""
    return F.coalesce(diluted, F.when(income <= 0, basic))


def derived_lines(revenue: Column, ebit: Column, da: Column, rent: Column, tax: Column, pretax: Column, current_assets: Column, current_liabilities: Column, cash: Column, short_debt: Column) -> Column:
    """struct of lines that follow from others, null where a part is."""
    ebitda = ebit + da
    return F.struct(ebitda.alias("ebitda"), (ebitda + rent).alias("ebitdar"), F.when(revenue > 0, ebit / revenue).alias("ebit_margin"), F.when(pretax > 0, tax / pretax).alias("tax_rate"), ((current_assets - cash) - (current_liabilities - short_debt)).alias("working_capital"))


def debt_control(resolved: Column, reported: Column, warn: float = 0.05, refuse: float = 0.5) -> Column:
    """ok, warning or refused, by how far resolved debt is from the balance sheet's own total; without one there is nothing to control."""
    gap = F.abs(resolved - reported) / F.when(reported > 0, reported)
    return F.when(gap.isNull(), "no control").when(gap > refuse, "refused").when(gap > warn, "warning").otherwise("ok")


def controls(**checks: Column) -> Column:
    """The names of checks that don't hold, in the order given; one that can't be made counts as held."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))


def provenance(concept: Column, tag: Column, method: Column, filed: Column, periods: Column) -> Column:
    return F.struct(concept.alias("concept"), tag.alias("tag"), method.alias("method"), filed.alias("filed"), periods.alias("periods"))


def share_count(outstanding: Column, blocks: Column, weighted: Column, price: Column) -> Column:
    """struct of the count and its basis: outstanding shares with the award blocks' net shares, else the weighted average."""
    extra = F.aggregate(F.coalesce(blocks, F.array().cast("array<struct<count:double,strike:double>>")), F.lit(0.0), lambda s, a: s + F.when(a["strike"].isNull(), a["count"]).when(price > a["strike"], a["count"] * (1 - a["strike"] / price)).otherwise(0.0))
    own = F.when(known(price) > 0, outstanding + extra)
    return F.struct(F.coalesce(own, weighted).alias("shares"), F.when(own.isNotNull(), "outstanding and awards").when(weighted.isNotNull(), "weighted average").otherwise("none").alias("basis"))
