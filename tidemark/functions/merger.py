"""Merger arithmetic on a row that holds both companies' figures: offer, funding, earnings walk, purchase accounting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: standalone earnings a share below which a percentage says more of its base than of the deal.
LEAST_EPS = 0.10


def consideration(acquirer_price: Column, target_price: Column, target_shares: Column, net_debt: Column, premium: Column | float, pct_cash: Column | float, *, fees: float = 0.0, financing_fees: float = 0.0, repaid: Column | None = None, repay_premium: float = 0.0, cash_available: Column | None = None, extra_shares: Column | None = None) -> Column:
    """struct of the offer and how it is paid: cash on hand first, new debt for the rest; null at prices of 0 or less."""
    c = F.lit(pct_cash) if not isinstance(pct_cash, Column) else pct_cash
    p = F.lit(premium) if not isinstance(premium, Column) else premium
    zero = F.lit(0.0)
    paid_back = zero if repaid is None else repaid
    offer = target_price * (1 + p)
    equity = offer * (target_shares + (zero if extra_shares is None else extra_shares))
    cash = c * equity
    stock = (1 - c) * equity
    cost = paid_back * repay_premium
    need = cash + fees + financing_fees + paid_back + cost
    used = F.least(zero if cash_available is None else cash_available, need)
    out = F.struct(offer.alias("offer"), equity.alias("equity"), (equity + net_debt).alias("enterprise"), cash.alias("cash"), stock.alias("stock"), (stock / acquirer_price).alias("new_shares"), (offer / acquirer_price).alias("exchange_ratio"), used.alias("cash_used"), (need - used).alias("new_debt"), paid_back.alias("repaid"), cost.alias("repay_cost"))
    return F.when((acquirer_price > 0) & (target_price > 0) & (target_shares > 0), out)


def funding_gap(offer: Column, fees: float, financing_fees: float) -> Column:
    """Uses less sources of funds; zero, but for rounding, for every offer that ``consideration`` forms."""
    uses = offer["equity"] + fees + financing_fees + offer["repaid"] + offer["repay_cost"]
    return uses - (offer["new_debt"] + offer["cash_used"] + offer["stock"])


def breakeven_synergies(eps: Column, shares: Column, income_before: Column, tax: Column, phase_in: Column | float) -> Column:
    """Run-rate synergies before tax at which the deal leaves earnings a share as they were; null without any phase-in."""
    phase = F.lit(phase_in) if not isinstance(phase_in, Column) else phase_in
    return F.when(phase > 0, (eps * shares - income_before) / (1 - tax) / phase)


def accretion(offer: Column, income_a: Column, income_t: Column, shares_a: Column, tax: Column, *, synergies: Column | float = 0.0, phase_in: float = 1.0, debt_cost: float = 0.06, cash_yield: float = 0.03, financing_fees: float = 0.0, fee_years: int = 5, step_up: Column | float = 0.0, life_years: int = 8, interest_stopped: Column | None = None) -> Column:
    """struct of the earnings walk: pro-forma income, shares and earnings a share, accretion, and its share of a base large enough."""
    after = 1 - tax
    synergy = synergies * F.lit(phase_in) * after
    before = income_a + income_t + after * ((F.lit(0.0) if interest_stopped is None else interest_stopped) - offer["new_debt"] * debt_cost - offer["cash_used"] * cash_yield - F.lit(financing_fees / fee_years) - step_up / F.lit(float(life_years)))
    income = before + synergy
    shares = shares_a + offer["new_shares"]
    alone = income_a / F.when(shares_a > 0, shares_a)
    eps = income / F.when(shares > 0, shares)
    gain = eps - alone
    return F.struct(income.alias("income"), shares.alias("shares"), alone.alias("eps_alone"), eps.alias("eps"), gain.alias("gain"), F.when(alone >= LEAST_EPS, gain / alone).alias("gain_pct"), breakeven_synergies(alone, shares, before, tax, phase_in).alias("breakeven"))


def opening_balance_sheet(price: Column, book: Column, tax: Column, *, intangible_pct: float = 0.3, deferred_tax_assets: Column | None = None) -> Column:
    """struct of the excess over book and what it becomes; a price below book leaves no intangibles."""
    dta = F.lit(0.0) if deferred_tax_assets is None else deferred_tax_assets
    excess = price - book
    intangible = F.when(excess > 0, intangible_pct * excess).otherwise(0.0)
    liability = tax * intangible
    return F.struct(excess.alias("excess"), intangible.alias("intangibles"), liability.alias("dtl"), (excess - intangible + liability - dta).alias("goodwill"))


def roll_forward(base: Column, margin: Column, tax: Column, debt: Column, amortisation: Column, *, years: int = 5, growth: float = 0.05, haircut: Column | None = None, debt_cost: float = 0.06, da: float = 0.04, capex: float = 0.05, nwc: float = 0.02, fee: Column | None = None, sweep: float = 0.5) -> Column:
    """The combined company's years after closing: interest on opening debt, amortisation, and debt paid from what cash is left."""
    zero = F.lit(0.0)
    cut = zero if haircut is None else haircut
    charge = zero if fee is None else fee
    kind = "struct<year:int,revenue:double,pretax:double,income:double,fcf:double,debt:double>"
    start = F.struct(base.cast("double").alias("rev"), debt.cast("double").alias("debt"), F.array().cast(f"array<{kind}>").alias("out"))

    def year(s: Column, t: Column) -> Column:
        rev = base * F.pow(F.lit(1 + growth), t - 1) - F.when(t == 1, cut).otherwise(0.0)
        pretax = rev * margin - s["debt"] * debt_cost - amortisation - charge
        taxes = tax * F.greatest(pretax, zero)
        fcf = pretax - taxes + amortisation + charge + (da - capex) * rev - nwc * (rev - s["rev"])
        left = s["debt"] - F.least(F.greatest(fcf, zero) * sweep, s["debt"])
        row = F.struct(t.cast("int").alias("year"), rev.alias("revenue"), pretax.alias("pretax"), (pretax - taxes).alias("income"), fcf.alias("fcf"), left.alias("debt"))
        return F.struct(rev.alias("rev"), left.alias("debt"), F.concat(s["out"], F.array(row.cast(kind))).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(years)), start, year, lambda s: s["out"])


def contribution(a: Column, t: Column) -> Column:
    """The first company's share of a figure of both; null where a part is missing, negative or all is nothing."""
    return F.when((a >= 0) & (t >= 0) & (a + t > 0), a / (a + t))
