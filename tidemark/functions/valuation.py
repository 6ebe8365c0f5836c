"""Row-level valuation arithmetic: guarded ratios, projections, terminal values and solvers as expressions.

Every function takes and gives columns; what can't be formed is null. Multi-year work is a fold over a sequence of years, so
a valuation costs its row and no shuffle. NaN counts as missing, since it would rank above every number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """x with NaN as null."""
    return F.when(~F.isnan(x.cast("double")), x)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once: inside a fold, a column that is named twice is worked out twice."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null unless the denominator is positive: a negative base is as meaningless as a zero one."""
    d = known(denominator)
    return F.when(d > 0, known(numerator) / d)


def growth(new: Column, old: Column) -> Column:
    o = known(old)
    return F.when(o > 0, known(new) / o - 1)


def cagr(new: Column, old: Column, years: float) -> Column:
    n, o = known(new), known(old)
    return F.when((n > 0) & (o > 0), F.pow(n / o, F.lit(1.0 / years)) - 1)


def log_size(x: Column) -> Column:
    return F.when(known(x) > 0, F.ln(x))


def total(*parts: Column) -> Column:
    """The sum, null where any part is."""
    out = known(parts[0])
    for p in parts[1:]:
        out = out + known(p)
    return out


def clipped(x: Column, floor: float, ceiling: float) -> Column:
    return F.when(known(x).isNotNull(), F.least(F.greatest(x, F.lit(floor)), F.lit(ceiling)))


def _max0(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def shelter(ebit: Column, free: Column, capped: Column, unused: Column, limit: float, cap: float) -> dict[str, Column]:
    """One year's use of carried losses: what is sheltered, and the free, capped and unused balances it leaves.

    Capped losses go first, as far as the cap of this year and what earlier years left of it reach; together
    they shelter at most ``limit`` of the year's profit, and a loss joins the free ones.
    """
    room = _max0(limit * ebit)
    allowed = unused + cap
    old = F.least(capped, allowed, room)
    new = F.least(free, room - old)
    return {"used": old + new, "free": free + _max0(-ebit) - new, "capped": capped - old, "unused": allowed - old}


_YEAR = "struct<year:int,revenue:double,growth:double,ebit:double,taxes:double,cash_taxes:double,nopat:double,da:double,capex:double,delta_nwc:double,sbc:double,fcff:double,ebitda:double,nol:double,shares:double>"


def line(first: Column, last: Column, year: Column, years: int) -> Column:
    """The value in a year of a straight line from the first to the last."""
    return first + (last - first) * ((year - 1) / F.lit(float(max(years - 1, 1))))


def project(revenue: Column, g1: Column, gn: Column, m1: Column, mn: Column, tax: Column, *, years: int = 10, da: float = 0.04, capex: float = 0.05, nwc: float = 0.02, sbc: Column | None = None, price: Column | None = None, shares: Column | None = None, nol: Column | None = None, nol_capped: Column | None = None, limit: float = 0.8, cap: float = 0.0, path: Column | None = None) -> Column:
    """The years of a projection, as an array of structs; null where trailing revenue isn't positive.

    Growth (or an explicit ``path`` of it) and margin run in straight lines. Losses give no refund; with ``nol`` they are carried forward. With
    ``sbc`` (a share of revenue) the charge is added back, and with ``price`` it issues shares.
    """
    zero = F.lit(0.0)
    count = zero if shares is None else shares.cast("double")
    state = F.struct(revenue.cast("double").alias("rev"), (nwc * revenue).cast("double").alias("nwc"), (zero if nol is None else nol.cast("double")).alias("free"), (zero if nol_capped is None else nol_capped.cast("double")).alias("capped"), zero.alias("unused"), count.alias("shares"), F.array().cast(f"array<{_YEAR}>").alias("out"))

    def year(s: Column, t: Column) -> Column:
        g = line(g1, gn, t, years) if path is None else F.element_at(path, t)
        rev = s["rev"] * (1 + g)
        ebit = rev * line(m1, mn, t, years)
        sheltered = shelter(ebit, s["free"], s["capped"], s["unused"], limit, cap) if nol is not None else {"used": zero, "free": s["free"], "capped": s["capped"], "unused": s["unused"]}
        cash = tax * _max0(ebit - sheltered["used"])
        charge = zero if sbc is None else sbc * rev
        held = nwc * rev
        nopat = ebit - cash
        fcff = nopat + da * rev - capex * rev - (held - s["nwc"]) + charge
        issued = charge / price if price is not None else zero
        row = F.struct(
            t.cast("int").alias("year"), rev.alias("revenue"), g.cast("double").alias("growth"), ebit.alias("ebit"), (tax * _max0(ebit)).alias("taxes"), cash.alias("cash_taxes"), nopat.alias("nopat"),
            (da * rev).alias("da"), (capex * rev).alias("capex"), (held - s["nwc"]).alias("delta_nwc"), charge.cast("double").alias("sbc"), fcff.alias("fcff"), (ebit + da * rev).alias("ebitda"),
            (sheltered["free"] + sheltered["capped"]).alias("nol"), (s["shares"] + issued).alias("shares"),
        )
        return F.struct(rev.alias("rev"), held.alias("nwc"), sheltered["free"].alias("free"), sheltered["capped"].alias("capped"), sheltered["unused"].alias("unused"), (s["shares"] + issued).alias("shares"), F.concat(s["out"], F.array(row.cast(_YEAR))).alias("out"))

    return F.when(known(revenue) > 0, F.aggregate(F.sequence(F.lit(1), F.lit(years)), state, year, lambda s: s["out"]))


def discount_factors(rate: Column, years: int, mid_year: bool = True) -> Column:
    """Factors of the years 1 to n, from the middle of each year by default; null at a rate of -1 or less."""
    return F.when(known(rate) > -1, F.transform(F.sequence(F.lit(1), F.lit(years)), lambda t: F.pow(1 + rate, -(t - (0.5 if mid_year else 0.0)))))


def present_value(flows: Column, factors: Column) -> Column:
    return F.aggregate(F.zip_with(flows, factors, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def gordon(fcff: Column, rate: Column, g: Column) -> Column:
    return F.when(g < rate, fcff * (1 + g) / (rate - g))


def exit_value(ebitda: Column, multiple: Column) -> Column:
    return F.when(ebitda > 0, ebitda * multiple)


def value_driver(nopat_next: Column, rate: Column, g: Column, roic: Column) -> Column:
    return F.when((roic > 0) & (g < rate) & (nopat_next > 0), nopat_next * (1 - g / roic) / (rate - g))


def carryforward_value(balance: Column, ebit_next: Column, g: Column, rate: Column, tax: Column, years: int, *, limit: float = 0.8, horizon: int = 200) -> Column:
    """What the losses left after the projection save in tax, used at up to ``limit`` of a profit that grows, over at most ``horizon`` years."""
    state = F.struct(balance.cast("double").alias("left"), ebit_next.cast("double").alias("ebit"), F.lit(0.0).alias("pv"))

    def year(s: Column, k: Column) -> Column:
        used = F.least(s["left"], _max0(limit * s["ebit"]))
        return F.struct((s["left"] - used).alias("left"), (s["ebit"] * (1 + g)).alias("ebit"), (s["pv"] + tax * used * F.pow(1 + rate, -(k + F.lit(years + 0.5)))).alias("pv"))

    return F.when((balance > 0) & (ebit_next > 0), F.aggregate(F.sequence(F.lit(0), F.lit(horizon - 1)), state, year, lambda s: s["pv"])).otherwise(0.0)


def run_dcf(years_: Column, rate: Column, g: Column, tax: Column, margin_n: Column, *, years: int = 10, nwc: float = 0.02, multiple: Column | None = None, roic: Column | None = None, carried: bool = False) -> Column:
    """struct of pv_explicit, the three enterprise values, the carried losses' value, terminal EBITDA and the multiple that Gordon implies.

    The Gordon flow is taxed in full, and discounted with the mid-year flows (N - 1/2); a multiple is a price at the end of year N.
    """
    def valued(rows: Column) -> Column:
        last = F.element_at(rows, -1)
        explicit = present_value(F.transform(rows, lambda y: y["fcff"]), discount_factors(rate, years))
        taxed = last["fcff"] - (last["taxes"] - last["cash_taxes"])
        next_ebit = margin_n * last["revenue"] * (1 + g)
        carry = carryforward_value(last["nol"], next_ebit, g, rate, tax, years) if carried else F.lit(0.0)
        tail = F.lit(None).cast("double") if multiple is None else exit_value(last["ebitda"], multiple)
        driver = value_driver(next_ebit - tax * _max0(next_ebit), rate, g, rate if roic is None else roic)
        return F.struct(explicit.alias("explicit"), gordon(taxed, rate, g).alias("tv"), tail.alias("tail"), driver.alias("driver"), carry.alias("carried"), last["ebitda"].alias("ebitda_n"), last["shares"].alias("shares"))

    def summed(x: Column) -> Column:
        late, mid = F.pow(1 + rate, F.lit(-float(years))), F.pow(1 + rate, F.lit(-(years - 0.5)))
        base = x["explicit"] + x["carried"]
        implied = F.when(x["ebitda_n"] > 0, x["tv"] * F.sqrt(1 + rate) / x["ebitda_n"])
        return F.struct(x["explicit"].alias("explicit"), (base + x["tv"] * mid).alias("gordon"), (base + x["tail"] * late).alias("exit"), (base + x["driver"] * mid).alias("driver"), x["carried"].alias("carried"), x["ebitda_n"].alias("ebitda_n"), implied.alias("implied_multiple"), x["shares"].alias("shares"))

    return let(let(years_, valued), summed)


def dcf_value(revenue: Column, g1: Column, gn: Column, m1: Column, mn: Column, tax: Column, rate: Column, terminal: Column, years: int, capex: float = 0.05, da: float = 0.04, nwc: float = 0.02) -> Column:
    """Enterprise value of a fading projection with a growing perpetuity at its end; null where growth reaches the rate or revenue isn't positive."""
    start = F.struct(revenue.cast("double").alias("rev"), F.lit(0.0).alias("pv"), F.lit(0.0).alias("fcff"))

    def year(s: Column, t: Column) -> Column:
        def flow(rev: Column) -> Column:
            ebit = rev * line(m1, mn, t, years)
            return F.struct(rev.alias("rev"), (ebit - tax * _max0(ebit) + rev * (da - capex) - nwc * (rev - s["rev"])).alias("fcff"))

        return let(let(s["rev"] * (1 + line(g1, gn, t, years)), flow), lambda x: F.struct(x["rev"].alias("rev"), (s["pv"] + x["fcff"] / F.pow(1 + rate, t - 0.5)).alias("pv"), x["fcff"].alias("fcff")))

    def close(s: Column) -> Column:
        return s["pv"] + s["fcff"] * (1 + terminal) / (rate - terminal) / F.pow(1 + rate, F.lit(years - 0.5))

    return F.when((terminal < rate) & (known(revenue) > 0), F.aggregate(F.sequence(F.lit(1), F.lit(years)), start, year, close))


def solve_monotone(value_at: Callable[[Column], Column], target: Column, low: float | Column, high: float | Column, steps: int = 60) -> Column:
    """struct(root, reached, edge): where a function that rises or falls throughout meets a target, by halving.

    Out of reach there is no root, and ``edge`` is the end whose value lies nearer.
    """
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))

    def solved(b: Column) -> Column:
        def half(s: Column, _: Column) -> Column:
            return let((s["lo"] + s["hi"]) / 2, lambda mid: let((value_at(mid) < b["target"]) == (b["f_hi"] > b["f_lo"]), lambda right: F.struct(F.when(right, mid).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi"))))

        reached = F.coalesce((b["target"] >= F.least(b["f_lo"], b["f_hi"])) & (b["target"] <= F.greatest(b["f_lo"], b["f_hi"])), F.lit(False))
        root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(b["lo"].alias("lo"), b["hi"].alias("hi")), half, lambda s: (s["lo"] + s["hi"]) / 2)
        edge = F.when(reached, None).when(F.abs(b["f_lo"] - b["target"]) <= F.abs(b["f_hi"] - b["target"]), b["lo"]).otherwise(b["hi"])
        return F.struct(F.when(reached, root).alias("root"), reached.alias("reached"), edge.alias("edge"))

    return let(F.struct(lo.alias("lo"), hi.alias("hi"), value_at(lo).alias("f_lo"), value_at(hi).alias("f_hi"), target.alias("target")), solved)


def bisected(value_at: Callable[[Column], Column], target: Column, low: float, high: float, steps: int = 60) -> Column:
    """The root alone; null where the target is out of reach."""
    return solve_monotone(value_at, target, low, high, steps)["root"]


def treasury_shares(basic: Column, price: Column, awards: Column, units: Column | None = None) -> Column:
    """Basic shares, for each (count, strike) in the money count * (1 - strike / price), and units; null at a price of 0 or less or with a strike unknown."""
    extra = F.aggregate(awards, F.lit(0.0), lambda s, a: s + F.when(price > a["strike"], a["count"] * (1 - a["strike"] / price)).otherwise(0.0))
    unknown = F.exists(awards, lambda a: a["strike"].isNull())
    return F.when((known(price) > 0) & ~unknown, basic + extra + (F.lit(0.0) if units is None else units))


def unlever(beta: Column, debt_to_equity: Column, tax: Column) -> Column:
    return beta / (1 + (1 - tax) * debt_to_equity)


def relever(beta: Column, debt_to_equity: Column, tax: Column) -> Column:
    return beta * (1 + (1 - tax) * debt_to_equity)


def ev_bridge(price: Column, shares: Column, debt: Column, convertible: Column, conversion_price: Column, finance_lease: Column, operating_lease: Column, preferred: Column, minority: Column, cash: Column, securities: Column, *, capitalise: bool = False) -> Column:
    """struct of the bridge from a share price to enterprise value: treatment of the convertible, net claims and the value.

    A convertible is equity where the price is above a known conversion price, and debt else.
    """
    treatment = F.when(convertible <= 0, "none").when(conversion_price.isNotNull() & (price > conversion_price), "if_converted").otherwise("debt")
    as_debt = F.when(treatment == "debt", convertible).otherwise(0.0)
    claims = debt + as_debt + finance_lease + preferred + minority - cash - securities
    leases = operating_lease if capitalise else F.lit(0.0)
    equity = price * shares
    return F.struct(treatment.alias("treatment"), equity.alias("equity"), claims.alias("claims"), leases.alias("leases"), (equity + claims + leases).alias("ev"))


def equity_from_dcf(ev: Column, bridge: Column) -> Column:
    """Operating leases are never taken off a value whose flows already paid the rent."""
    return ev - bridge["claims"]


def equity_from_ev(ev: Column, bridge: Column) -> Column:
    return ev - bridge["claims"] - bridge["leases"]


def wacc(risk_free: Column, beta: Column, premium: Column, size: Column, pre_tax_debt: Column, tax: Column, equity: Column, debt: Column) -> Column:
    """struct of the costs of equity and debt and their market-weighted mean; null without any capital."""
    ke = risk_free + beta * premium + size
    kd = pre_tax_debt * (1 - tax)
    capital = equity + debt
    return F.struct(ke.alias("cost_of_equity"), kd.alias("cost_of_debt"), F.when(capital > 0, equity / capital * ke + debt / capital * kd).alias("wacc"))


def apv(flows: Column, fcff_n: Column, unlevered: Column, g: Column, debt: Column, cost_of_debt: Column, tax: Column, years: int) -> Column:
    """struct of the unlevered value and the value of the interest's tax shield, constant for the years and growing after; null where g reaches a rate."""
    factors = discount_factors(unlevered, years)
    base = present_value(flows, factors) + gordon(fcff_n, unlevered, g) * F.pow(1 + unlevered, F.lit(-(years - 0.5)))
    saved = tax * cost_of_debt * debt
    shield = present_value(F.transform(F.sequence(F.lit(1), F.lit(years)), lambda t: saved), discount_factors(cost_of_debt, years, False))
    tail = F.when(g < cost_of_debt, saved * (1 + g) / (cost_of_debt - g)) * F.pow(1 + cost_of_debt, F.lit(-float(years)))
    return F.struct(base.alias("unlevered"), (shield + tail).alias("shield"), (base + shield + tail).alias("value"))


def path_cagr(path: Column, horizon: int) -> Column:
    """Yearly growth that a path's first years come to; null where a year is missing."""
    part = F.slice(path, 1, horizon)
    whole = F.aggregate(part, F.lit(1.0), lambda p, g: p * (1 + g))
    return F.when((F.size(path) >= horizon) & ~F.exists(part, lambda g: g.isNull()) & (whole > 0), F.pow(whole, F.lit(1.0 / horizon)) - 1)


#: Interest coverage floors with their rating and spread, best first; below all, the worst.
COVERAGE_STEPS = (
    (8.50, "Aaa/AAA", 0.0069),
    (6.50, "Aa2/AA", 0.0085),
    (5.50, "A1/A+", 0.0107),
    (4.25, "A2/A", 0.0118),
    (3.00, "A3/A-", 0.0133),
    (2.50, "Baa2/BBB", 0.0183),
    (2.25, "Ba1/BB+", 0.0250),
    (2.00, "Ba2/BB", 0.0315),
    (1.75, "B1/B+", 0.0403),
    (1.50, "B2/B", 0.0489),
    (1.25, "B3/B-", 0.0644),
    (0.80, "Caa/CCC", 0.0946),
    (0.65, "Ca2/CC", 0.1083),
    (0.20, "C2/C", 0.1390),
)
WORST, UNKNOWN = ("D2/D", 0.1860), ("Baa2/BBB", 0.0183)


def rating_step(coverage: Column) -> Column:
    """(rating, spread) of the highest floor a coverage reaches; an unknown coverage gets the lowest investment grade."""
    step = lambda r: F.struct(F.lit(r[0]).alias("rating"), F.lit(r[1]).alias("spread"))
    out = F.when(known(coverage).isNull(), step(UNKNOWN))
    for floor, rating, spread in COVERAGE_STEPS:
        out = out.when(coverage >= floor, step((rating, spread)))
    return out.otherwise(step(WORST))
