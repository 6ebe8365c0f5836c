"""Operating metrics by line of business, peer multiples, sums of parts: expressions over a company's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.valuation import growth, ratio

#: Multiples above these say nothing.
CAPS = {"ev_revenue": 100.0, "ev_ebitda": 100.0, "ev_ebit": 150.0, "pe": 150.0, "fcf_yield": 1.0}


def peer_metrics(ev: Column, equity: Column, revenue: Column, ebitda: Column, ebit: Column, income: Column, fcf: Column) -> Column:
    """struct of multiples: null with a flag where the base isn't positive or the multiple is beyond its cap."""
    raw = {"ev_revenue": ratio(ev, revenue), "ev_ebitda": ratio(ev, ebitda), "ev_ebit": ratio(ev, ebit), "pe": ratio(equity, income), "fcf_yield": ratio(fcf, equity)}
    kept = [F.when(x <= CAPS[k], x).alias(k) for k, x in raw.items()]
    flags = [F.when(x.isNull(), F.lit(f"{k}: no positive base")).when(x > CAPS[k], F.lit(f"{k}: beyond its cap")) for k, x in raw.items()]
    return F.struct(*kept, F.array_join(F.array_compact(F.array(*flags)), "; ").alias("flags"))


def software(revenue: Column, revenue_before: Column, ebitda: Column, fcf: Column, ebit: Column, sales_cost: Column, gross_margin: Column, arr: Column, ev: Column, rpo: Column, billings: Column) -> Column:
    """struct of a subscription business's figures: three rules of 40 and their spread, magic number, payback, multiples of what recurs."""
    g = growth(revenue, revenue_before)
    rules = {k: 100 * (g + ratio(x, revenue)) for k, x in (("rule_ebitda", ebitda), ("rule_fcf", fcf), ("rule_ebit", ebit))}
    magic = ratio(revenue - revenue_before, sales_cost)
    many = list(rules.values())
    return F.struct(*[x.alias(k) for k, x in rules.items()], (F.greatest(*many) - F.least(*many)).alias("rule_spread"), magic.alias("magic"), F.when((magic > 0) & (gross_margin > 0), 12 / (magic * gross_margin)).alias("payback_months"), ratio(ev, arr).alias("ev_arr"), ratio(rpo, revenue).alias("rpo_cover"), ratio(billings, revenue).alias("billings_cover"))


def media(content_spend: Column, amortisation: Column, ebitda: Column, ev: Column) -> Column:
    """struct of what content costs beyond its amortisation, and earnings and the multiple after it."""
    gap = content_spend - amortisation
    return F.struct(gap.alias("content_gap"), ratio(content_spend, amortisation).alias("spend_to_amortisation"), (ebitda - gap).alias("ebitda_after_gap"), ratio(ev, ebitda - gap).alias("ev_after_gap"))


def telecom(revenue: Column, ebitda: Column, capex: Column, net_debt: Column, interest: Column, maintenance: Column, equity: Column, towers: Column) -> Column:
    """struct of capital intensity, leverage and, for towers only, a proxy of funds from operations and its multiple."""
    affo = F.when(towers, ebitda - interest - maintenance)
    return F.struct(ratio(capex, revenue).alias("capex_intensity"), (ebitda - capex).alias("ebitda_less_capex"), ratio(net_debt, ebitda).alias("leverage"), affo.alias("affo"), ratio(equity, affo).alias("price_affo"))


def subscriber_check(revenue: Column, subscribers: Column, subscribers_before: Column, arpu: Column, months: int = 12, tolerance: float = 0.10) -> Column:
    """struct of revenue a mean subscriber and month, and whether it departs from the stated figure by more than the tolerance."""
    mean = (subscribers + subscribers_before) / 2
    own = ratio(revenue, mean * months)
    return F.struct(own.alias("implied_arpu"), (F.abs(own / F.when(arpu > 0, arpu) - 1) > tolerance).alias("inconsistent"))


def value_segments(df: DataFrame, key: str, metric: str, multiple: str) -> DataFrame:
    """Segments (rows of a key) with their value, its share of all the key's, and a reason where a metric has no value."""
    value = F.when(F.col(metric) > 0, F.col(metric) * F.col(multiple))
    out = df.withColumn("value", value)
    whole = F.sum("value").over(Window.partitionBy(key))
    return out.withColumns({"share": F.when(whole > 0, F.col("value") / whole), "reason": F.when(F.col("value").isNull(), "metric is not positive")})


def sum_of_parts(segments: DataFrame, key: str, cost: Column, multiple: Column, discount: float, claims: Column) -> DataFrame:
    """One row a key: gross value, corporate drag, what is left after the discount, equity; null where nothing is left."""
    gross = segments.groupBy(key).agg(F.sum("value").alias("gross"), F.first(cost).alias("_cost"), F.first(multiple).alias("_multiple"), F.first(claims).alias("_claims"))
    drag = F.when(F.col("_cost") >= 0, F.col("_cost") * F.col("_multiple"))
    sub = F.col("gross") - drag
    net = F.when(sub > 0, sub * (1 - discount))
    return gross.select(key, "gross", drag.alias("drag"), net.alias("ev"), (net - F.col("_claims")).alias("equity"), F.when(net.isNull(), "nothing is left after corporate costs").alias("reason"))


def billings(revenue: Column, deferred: Column, deferred_before: Column) -> Column:
    """Revenue and the rise of what was billed ahead of it."""
    return revenue + deferred - deferred_before


def feature_set(f: dict[str, Column]) -> dict[str, Column]:
    """Point-in-time features of a company and date from its figures, null wherever a part is missing.

    f holds rev, rev_1y, rev_3y, ebit, ebit_1y, ebitda, fcf, income, capex, rd, sga, debt, cash, equity_book, assets, ev, equity, price figures.
    """
    from tidemark.functions.valuation import cagr, log_size, total

    g1, g3 = growth(f["rev"], f["rev_1y"]), cagr(f["rev"], f["rev_3y"], 3)
    margin = lambda x: ratio(f[x], f["rev"])
    before = ratio(f["ebit_1y"], f["rev_1y"])
    invested = total(f["debt"], f["equity_book"], -f["cash"])
    return {
        "growth_1y": g1, "cagr_3y": g3, "acceleration": g1 - g3, "ebit_margin": margin("ebit"), "ebitda_margin": margin("ebitda"), "fcf_margin": margin("fcf"), "net_margin": margin("income"),
        "ebit_margin_change": margin("ebit") - before, "capex_intensity": margin("capex"), "rd_intensity": margin("rd"), "sga_intensity": margin("sga"), "rule_of_40": g1 + margin("fcf"),
        "roic": ratio(f["ebit"] * (1 - F.lit(0.25)), invested), "leverage": ratio(f["debt"] - f["cash"], f["ebitda"]), "cash_to_assets": ratio(f["cash"], f["assets"]), "asset_turnover": ratio(f["rev"], f["assets"]),
        "ev_revenue": ratio(f["ev"], f["rev"]), "ev_ebitda": ratio(f["ev"], f["ebitda"]), "earnings_yield": ratio(f["income"], f["equity"]), "fcf_yield": ratio(f["fcf"], f["equity"]), "book_to_market": ratio(f["equity_book"], f["equity"]),
        "log_revenue": log_size(f["rev"]), "log_equity": log_size(f["equity"]), "log_assets": log_size(f["assets"]),
    }
