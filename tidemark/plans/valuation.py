"""Queries over a valuation of every customer as a company with made-up but fixed figures."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import folds
from tidemark.functions import valuation as v
from tidemark.operators import signals as sg
from tidemark.sources.tables import load

N = 10


def doubles(sql: str) -> str:
    """The SQL with its decimal literals as doubles, as Spark's Python literals are."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.:])", r"\1::double", sql)


def company(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("e"), F.abs("c_acctbal").alias("bal"))
    e = F.col("e")
    out = c.withColumns({"rev": F.col("bal") + 100.0 + F.sqrt(e + 0.5), "g1": (e % 20) / 100.0, "gn": F.lit(0.03), "m1": F.when(e % 9 == 0, F.lit(-0.1)).otherwise(0.05 + (e % 7) / 50.0), "mn": F.lit(0.2), "tax": F.lit(0.25), "rate": 0.08 + (e % 5) / 100.0, "tg": F.lit(0.025)})
    out = out.withColumns({"price": (10 + e % 50).cast("double"), "shares": (50 + e % 100).cast("double"), "debt": F.col("rev") * ((e % 4) / 4.0), "conv": F.when(e % 6 == 0, F.col("rev") * 0.2).otherwise(0.0), "conv_price": F.when(e % 12 != 0, F.lit(30.0)), "fin_lease": F.col("rev") * 0.02, "op_lease": F.col("rev") * 0.05})
    out = out.withColumns({"pref": F.when(e % 10 == 0, 25.0).otherwise(0.0), "nci": F.when(e % 8 == 0, 15.0).otherwise(0.0), "cash": F.col("rev") * 0.3, "sti": F.col("rev") * 0.1, "sbc": 0.03 + (e % 3) / 100.0, "nol": F.when(e % 9 == 0, F.col("rev") * 0.5).otherwise(0.0), "beta": 0.7 + (e % 13) / 10.0})
    return out.withColumn("ebitda", F.col("rev") * (F.col("m1") + 0.04))


#: The figures that a value per share takes.
FIGURES = ("rev", "g1", "gn", "m1", "mn", "tax", "rate", "tg", "debt", "cash", "shares", "price")


def spread(spark, df):
    """df by company over several tasks a core: a table of companies is one small file, and it is the valuation that takes time."""
    return df.repartition(8 * spark.sparkContext.defaultParallelism, "e")


def plain(columns, tail: int = 0):
    """The figures by name, nulls as NaN, as columns of so many further dimensions."""
    out = (c.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in columns)
    return {k: x.reshape(-1, *[1] * tail) for k, x in zip(FIGURES, out, strict=True)}


def share_value(x, growth=None, **changed):
    """The per-share value of companies' figures, some of them replaced."""
    y = {**x, **changed}
    ev = folds.dcf_value(y["rev"], y["g1"], y["gn"], y["m1"], y["mn"], y["tax"], y["rate"], y["tg"], N, growth)
    return (ev - (x["debt"] - x["cash"])) / x["shares"]


def nulls(x, kind=None):
    """An array whose NaN are nulls."""
    x = np.ascontiguousarray(x).ravel()
    return pa.array(x, kind, mask=np.isnan(x))


def in_lists(flat: pa.Array, width: int):
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat)


COMPANY = doubles(
    "c0 as (select c_custkey e, abs(c_acctbal) bal from customer), c1 as (select *, bal+100.0+sqrt(e+0.5) rev, (e%20)/100.0 g1, 0.03 gn, case when e%9=0 then -0.1 else 0.05+(e%7)/50.0 end m1, 0.2 mn, 0.25 tax, 0.08+(e%5)/100.0 rate, 0.025 tg from c0),"
    " c2 as (select *, (10+e%50)::double price, (50+e%100)::double shares, rev*((e%4)/4.0) debt, case when e%6=0 then rev*0.2 else 0.0 end conv, case when e%12<>0 then 30.0 end conv_price, rev*0.02 fin_lease, rev*0.05 op_lease from c1),"
    " c as (select *, case when e%10=0 then 25.0 else 0.0 end pref, case when e%8=0 then 15.0 else 0.0 end nci, rev*0.3 cash, rev*0.1 sti, 0.03+(e%3)/100.0 sbc, case when e%9=0 then rev*0.5 else 0.0 end nol, 0.7+(e%13)/10.0 beta, rev*(m1+0.04) ebitda from c2)"
)


def projection(df, **how):
    c = {k: F.col(k) for k in ("rev", "g1", "gn", "m1", "mn", "tax")}
    return v.project(c["rev"], c["g1"], c["gn"], c["m1"], c["mn"], c["tax"], years=N, **how)


def full(df):
    return projection(df, sbc=F.col("sbc"), price=F.col("price"), shares=F.col("shares"), nol=F.col("nol"))


#: A year of the projection as a step of a recursion; losses, stock charges and issued shares as in the fold.
def years_sql(source: str = "c", sbc: str = "sbc", issue: bool = True, nol: str = "nol", g1: str = "g1", mn: str = "mn") -> str:
    used = "least(lf, greatest(0.8*ek,0.0))" if nol != "0.0" else "0.0"
    return doubles(
        f"y0 as (select {source}.*, 0 t, rev rv, 0.02*rev nw, {nol} lf, shares sh, 0.0 gr, 0.0 eb, 0.0 txs, 0.0 ctx, 0.0 dn, 0.0 fc from {source}), "
        f"y as (select * from y0 union all select * exclude (gk, ek, us) replace (t+1 as t, rv*(1+gk) as rv, 0.02*(rv*(1+gk)) as nw, lf-us+greatest(-ek,0.0) as lf, sh+{'sbc*(rv*(1+gk))/price' if issue else '0.0'} as sh, gk as gr, ek as eb, tax*greatest(ek,0.0) as txs, tax*greatest(ek-us,0.0) as ctx, 0.02*(rv*(1+gk))-nw as dn, ek-tax*greatest(ek-us,0.0)+0.04*(rv*(1+gk))-0.05*(rv*(1+gk))-(0.02*(rv*(1+gk))-nw)+{sbc}*(rv*(1+gk)) as fc) "
        f"from (select *, {used} us from (select *, rv*(1+gk)*(m1+({mn}-m1)*(t/9.0)) ek from (select *, {g1}+(gn-{g1})*(t/9.0) gk from y where t<10))))"
    )


def project_years(spark, d):
    rows = company(spark, d).withColumn("y", F.explode(full(None)))
    return rows.select(F.col("e").alias("entity"), F.col("y.year").alias("year"), *[F.round(f"y.{c}", 6).alias(c) for c in ("revenue", "ebit", "taxes", "cash_taxes", "delta_nwc", "fcff", "nol", "shares")])


YEARS_SQL = f"with recursive {COMPANY}, {years_sql()} select e entity, t::int as year, round(rv,6) revenue, round(eb,6) ebit, round(txs,6) taxes, round(ctx,6) cash_taxes, round(dn,6) delta_nwc, round(fc,6) fcff, round(lf,6) nol, round(sh,6) shares from y where t>0"


def factors(spark, d):
    c = company(spark, d)
    both = [c.select(F.col("e").alias("entity"), F.lit(mid).alias("mid_year"), F.posexplode(v.discount_factors(F.col("rate"), N, mid)).alias("k", "f")) for mid in (True, False)]
    return both[0].unionByName(both[1]).select("entity", "mid_year", (F.col("k") + 1).cast("int").alias("year"), F.round("f", 8).alias("factor"))


FACTORS_SQL = doubles(f"with {COMPANY} select e entity, m.m mid_year, t::int as year, round(power(1+rate, -(t-case when m.m then 0.5 else 0.0 end)),8) factor from c, range(1,11) r(t), (values (true),(false)) m(m)")


def dcf(spark, d):
    out = v.run_dcf(full(None), F.col("rate"), F.col("tg"), F.col("tax"), F.col("mn"), years=N, multiple=F.lit(11.0), roic=F.col("rate") + 0.03, carried=True)
    df = company(spark, d).withColumn("x", out)
    bridge = v.ev_bridge(*[F.col(c) for c in ("price", "shares", "debt", "conv", "conv_price", "fin_lease", "op_lease", "pref", "nci", "cash", "sti")])
    per = v.equity_from_dcf(F.col("x.gordon"), bridge) / F.col("x.shares")
    return df.select(F.col("e").alias("entity"), *[F.round(f"x.{c}", 3).alias(c) for c in ("explicit", "gordon", "exit", "driver", "carried", "ebitda_n")], F.round("x.implied_multiple", 5).alias("implied_multiple"), F.round(per, 5).alias("per_share"))


DCF_CTE = doubles(
    "ex as (select e, sum(fc/power(1+rate,t-0.5)) explicit from y where t>0 group by e), la as (select * from y where t=10),"
    " cf as (select e, 0 k, lf bal, mn*rv*(1+tg) eb, 0.0 pv, tg, rate, tax from la union all select e, k+1, bal-least(bal,greatest(0.8*eb,0.0)), eb*(1+tg), pv+tax*least(bal,greatest(0.8*eb,0.0))*power(1+rate,-(k+10.5)), tg, rate, tax from cf where k<200 and bal>0 and eb>0),"
    " cv as (select e, max(pv) carried from cf group by e),"
    " dv as (select la.*, ex.explicit, cv.carried, (fc-(txs-ctx))*(1+tg)/(rate-tg) tv, eb+0.04*rv ebn, mn*rv*(1+tg)*(1-tax) npn from la join ex using (e) join cv using (e)),"
    " dx as (select *, explicit+tv*power(1+rate,-9.5)+carried gordon, explicit+case when ebn>0 then ebn*11.0 end*power(1+rate,-10.0)+carried xt, explicit+npn*(1-tg/(rate+0.03))/(rate-tg)*power(1+rate,-9.5)+carried driver, case when ebn>0 then tv*sqrt(1+rate)/ebn end im from dv)"
)
BRIDGE_CTE = doubles("br as (select *, case when conv<=0 then 'none' when conv_price is not null and price>conv_price then 'if_converted' else 'debt' end tr, price*shares eq from c), bx as (select *, debt+case when tr='debt' then conv else 0.0 end+fin_lease+pref+nci-cash-sti claims from br)")
DCF_SQL = f"with recursive {COMPANY}, {years_sql()}, {DCF_CTE}, {BRIDGE_CTE} select e entity, round(explicit,3) explicit, round(gordon,3) gordon, round(xt,3) as exit, round(driver,3) driver, round(carried,3) carried, round(ebn,3) ebitda_n, round(im,5) implied_multiple, round((gordon-claims)/sh,5) per_share from dx join (select e, claims from bx) using (e)"


def bridges(spark, d):
    names = [F.col(c) for c in ("price", "shares", "debt", "conv", "conv_price", "fin_lease", "op_lease", "pref", "nci", "cash", "sti")]
    df = company(spark, d).withColumns({"a": v.ev_bridge(*names), "b": v.ev_bridge(*names, capitalise=True)})
    return df.select(F.col("e").alias("entity"), "a.treatment", F.round("a.claims", 4).alias("claims"), F.round("a.ev", 4).alias("ev"), F.round("b.ev", 4).alias("ev_with_leases"), F.round(v.equity_from_dcf(F.lit(5000.0), F.col("b")), 4).alias("equity_dcf"), F.round(v.equity_from_ev(F.lit(5000.0), F.col("b")), 4).alias("equity_ev"))


BRIDGES_SQL = doubles(f"with {COMPANY}, {BRIDGE_CTE} select e entity, tr treatment, round(claims,4) claims, round(eq+claims,4) ev, round(eq+claims+op_lease,4) ev_with_leases, round(5000.0-claims,4) equity_dcf, round(5000.0-claims-op_lease,4) equity_ev from bx")


def capital_costs(spark, d):
    coverage = F.col("ebitda") / F.when(F.col("debt") > 0, F.col("debt") * 0.06)
    df = company(spark, d).withColumns({"s": v.rating_step(coverage), "de": F.col("debt") / (F.col("price") * F.col("shares"))})
    df = df.withColumns({"bu": v.unlever(F.col("beta"), F.col("de"), F.col("tax"))})
    df = df.withColumn("bl", v.relever(F.col("bu"), F.lit(0.25), F.col("tax")))
    df = df.withColumn("w", v.wacc(F.lit(0.04), F.col("bl"), F.lit(0.05), F.lit(0.01), 0.04 + F.col("s.spread"), F.col("tax"), F.col("price") * F.col("shares"), F.col("debt")))
    return df.select(F.col("e").alias("entity"), "s.rating", *[F.round(c, 6).alias(n) for c, n in (("bu", "unlevered"), ("bl", "relevered"), ("w.cost_of_equity", "cost_of_equity"), ("w.cost_of_debt", "cost_of_debt"), ("w.wacc", "wacc"))])


def _step(column):
    return "case when cov is null then " + f"{v.UNKNOWN[column]!r}" + "".join(f" when cov>={f} then {(r, s)[column]!r}" for f, r, s in v.COVERAGE_STEPS) + f" else {v.WORST[column]!r} end"


CAPITAL_SQL = doubles(f"with {COMPANY}, k as (select *, ebitda/case when debt>0 then debt*0.06 end cov, debt/(price*shares) de, price*shares eq from c), s as (select *, {_step(0)} rating, {_step(1)} spread, beta/(1+(1-tax)*de) bu from k), w as (select *, bu*(1+(1-tax)*0.25) bl, (0.04+spread)*(1-tax) kd from s), z as (select *, 0.04+bl*0.05+0.01 ke from w) select e entity, rating, round(bu,6) unlevered, round(bl,6) relevered, round(ke,6) cost_of_equity, round(kd,6) cost_of_debt, round(eq/(eq+debt)*ke+debt/(eq+debt)*kd,6) wacc from z")


def apv_of(spark, d):
    y = projection(None)
    df = company(spark, d).withColumn("y", y).withColumn("ku", 0.04 + v.unlever(F.col("beta"), F.col("debt") / (F.col("price") * F.col("shares")), F.col("tax")) * 0.05 + 0.02)
    df = df.withColumn("a", v.apv(F.transform("y", lambda r: r["fcff"]), F.element_at("y", -1)["fcff"], F.col("ku"), F.lit(0.02), F.col("debt"), F.lit(0.06), F.col("tax"), N))
    return df.select(F.col("e").alias("entity"), F.round("ku", 6).alias("unlevered_cost"), *[F.round(f"a.{c}", 3).alias(c) for c in ("unlevered", "shield", "value")])


APV_SQL = doubles(f"with recursive {COMPANY}, {years_sql(sbc='0.0', issue=False, nol='0.0')}, k as (select e, 0.04+beta/(1+(1-tax)*(debt/(price*shares)))*0.05+0.02 ku, tax*0.06*debt sv from c), b as (select y.e, any_value(ku) ku, any_value(sv) sv, sum(fc/power(1+ku,t-0.5)) pv, max(fc) filter (where t=10) fl from y join k using (e) where t>0 group by y.e), z as (select *, pv+fl*1.02/(ku-0.02)*power(1+ku,-9.5) un, sv*(1-power(1.06,-10))/0.06 + sv*1.02/(0.06-0.02)*power(1.06,-10) sh from b) select e entity, round(ku,6) unlevered_cost, round(case when 0.02<ku then un end,3) unlevered, round(sh,3) shield, round(case when 0.02<ku then un+sh end,3) as value from z")


def grid(axis: str, values: tuple):
    """A 5 by 5 grid of the projection's value: the rate against perpetual growth, or against the exit multiple."""

    def run(spark, d):
        def values_of(*columns: pa.Array) -> pa.Array:
            x = plain(columns, 2)
            with np.errstate(all="ignore"):
                f, rev, ebit = folds.flows(np.where(x["rev"] > 0, x["rev"], np.nan), lambda t: folds._line(x["g1"], x["gn"], t, N), x["m1"], x["mn"], x["tax"], N)
                w, tried = x["rate"] + np.array(STEPS).reshape(1, -1, 1), np.array(values).reshape(1, 1, -1)
                ebitda = ebit + 0.04 * rev
                late = folds.perpetuity(f[-1], w, tried) * np.power(1 + w, -(N - 0.5)) if axis == "growth" else np.where(ebitda > 0, ebitda * tried, np.nan) * np.power(1 + w, -float(N))
                return in_lists(nulls(folds.present(f, w) + late), len(STEPS) * len(values))

        value = F.arrow_udf(values_of, "array<double>")(*FIGURES)
        c = spread(spark, company(spark, d)).select("e", "rate", value.alias("v"))
        each = c.select("e", "rate", F.posexplode("v").alias("k", "value"))
        at = lambda xs, k: F.get(F.array(*map(F.lit, xs)), k.cast("int"))
        w = F.col("rate") + at(STEPS, F.floor(F.col("k") / len(values)))
        return each.select(F.col("e").alias("entity"), F.round(w, 4).alias("rate"), at(values, F.col("k") % len(values)).alias(axis), F.round("value", 3).alias("value"))

    return run


def grid_sql(axis: str, values: tuple) -> str:
    tail = "case when x<w then fl*(1+x)/(w-x) end*power(1+w,-9.5)" if axis == "growth" else "case when ebn>0 then ebn*x end*power(1+w,-10.0)"
    return doubles(f"with recursive {COMPANY}, {years_sql(sbc='0.0', issue=False, nol='0.0')}, k as (select e, rate, list(fc order by t) f, max(fc) filter (where t=10) fl, max(eb+0.04*rv) filter (where t=10) ebn from y where t>0 group by e, rate), g as (select *, rate+dw w from k, (values (-0.02),(-0.01),(0.0),(0.01),(0.02)) a(dw), (values {','.join(f'({x})' for x in values)}) b(x)) select e entity, round(w,4) rate, x::double {axis}, round(list_sum(list_transform(range(1,11), lambda t: f[t]/power(1+w,t-0.5))) + {tail},3) as value from g")


STEPS = (-0.02, -0.01, 0.0, 0.01, 0.02)
RATES, MULTIPLES = (0.01, 0.015, 0.02, 0.025, 0.03), (7.0, 9.0, 11.0, 13.0, 15.0)


def value_with(df, **changed):
    """The per-share value with some of the company's figures replaced by columns."""
    get = lambda k: changed.get(k, F.col(k))
    ev = v.dcf_value(get("rev"), get("g1"), get("gn"), get("m1"), get("mn"), get("tax"), get("rate"), get("tg"), N)
    return (ev - (F.col("debt") - F.col("cash"))) / F.col("shares")


def implied(name: str, low: float, high: float):
    """The figure at which a company's value meets its price; where none does, the nearer end."""

    def run(spark, d):
        c = company(spark, d).withColumn("s", v.solve_monotone(lambda x: value_with(None, **{name: x}), F.col("price"), low, high, 50))
        checked = value_with(None, **{name: F.col("s.root")})
        return c.select(F.col("e").alias("entity"), "s.reached", "s.edge", F.round(F.abs(checked - F.col("price")), 3).alias("miss"))

    return run


def implied_sql(name: str, low: float, high: float) -> str:
    ends = f"select c.* replace ({low} as {name}), 0 side from c union all select c.* replace ({high} as {name}), 1 side from c".replace("c.*", "*")
    return doubles(f"with recursive {COMPANY}, cc as ({ends}), {years_sql('cc', sbc='0.0', issue=False, nol='0.0')}, k as (select e, side, price, debt, cash, shares, (sum(fc/power(1+rate,t-0.5)) + max(fc) filter (where t=10)*(1+any_value(tg))/(any_value(rate)-any_value(tg))*power(1+any_value(rate),-9.5) - (debt-cash))/shares val from y where t>0 group by e, side, price, debt, cash, shares), p as (select e, any_value(price) price, max(val) filter (where side=0) a, max(val) filter (where side=1) b from k group by e) select e entity, coalesce(price between least(a,b) and greatest(a,b), false) reached, case when price between least(a,b) and greatest(a,b) then null when abs(a-price)<=abs(b-price) then {low} else {high} end edge, case when price between least(a,b) and greatest(a,b) then 0.0 end miss from p")


def duration(spark, d):
    """Years for which the first year's growth must hold to be worth the price: the first of 0 to 10 whose value reaches it."""

    def first_year(*columns: pa.Array) -> pa.Array:
        x = plain(columns, 1)
        k = np.arange(N + 1).reshape(1, -1)
        value = share_value(x, lambda t: np.where(t <= k, x["g1"], x["gn"]))
        enough = value >= x["price"]
        return pa.array(enough.argmax(axis=1).astype(np.int32), mask=~enough.any(axis=1))

    c = spread(spark, company(spark, d)).select("e", F.arrow_udf(first_year, "int")(*FIGURES).alias("years"))
    got = c.groupBy("e").agg(F.min("years").alias("years"))
    return got.select(F.col("e").alias("entity"), F.col("years").cast("int").alias("years"), F.when(F.col("years").isNull(), "not within ten years").alias("reason"))


DURATION_SQL = doubles(f"with recursive {COMPANY}, cc as (select c.*, k from c, range(0,11) r(k)), {years_sql('cc', sbc='0.0', issue=False, nol='0.0').replace('g1+(gn-g1)*(t/9.0::double) gk', 'case when t+1<=k then g1 else gn end gk')}, q as (select e, k, any_value(price) price, (sum(fc/power(1+rate,t-0.5)) + max(fc) filter (where t=10)*(1+any_value(tg))/(any_value(rate)-any_value(tg))*power(1+any_value(rate),-9.5) - any_value(debt-cash))/any_value(shares) val from y where t>0 group by e, k) select e entity, min(k) filter (where val>=price)::int as \"years\", case when min(k) filter (where val>=price) is null then 'not within ten years' end reason from q group by e")


def frontier(spark, d):
    """For six margins the growth that meets the price."""
    margins = (0.1, 0.15, 0.2, 0.25, 0.3, 0.35)

    def solved(*columns: pa.Array) -> pa.Array:
        x = {k: np.repeat(y, len(margins)) for k, y in plain(columns).items()}
        x["mn"] = np.tile(np.array(margins), len(columns[0]))
        root, reached, _ = folds.solve_monotone(lambda g: share_value(x, g1=g), x["price"], -0.2, 0.6, 50)
        miss = np.abs(share_value(x, g1=root) - x["price"])
        return in_lists(pa.StructArray.from_arrays([pa.array(x["mn"]), pa.array(reached), nulls(miss)], ["margin", "reached", "miss"]), len(margins))

    c = spread(spark, company(spark, d)).select("e", F.explode(F.arrow_udf(solved, "array<struct<margin:double,reached:boolean,miss:double>>")(*FIGURES)).alias("s"))
    return c.select(F.col("e").alias("entity"), "s.margin", "s.reached", F.round("s.miss", 3).alias("miss"))


FRONTIER_SQL = doubles(f"with recursive {COMPANY}, cc as (select c.* replace (gg as g1, mm as mn), side from c, (values (-0.2,0),(0.6,1)) a(gg,side), (values (0.1),(0.15),(0.2),(0.25),(0.3),(0.35)) b(mm)), {years_sql('cc', sbc='0.0', issue=False, nol='0.0')}, k as (select e, mn, side, any_value(price) price, (sum(fc/power(1+rate,t-0.5)) + max(fc) filter (where t=10)*(1+any_value(tg))/(any_value(rate)-any_value(tg))*power(1+any_value(rate),-9.5) - any_value(debt-cash))/any_value(shares) val from y where t>0 group by e, mn, side), p as (select e, mn, any_value(price) price, max(val) filter (where side=0) a, max(val) filter (where side=1) b from k group by e, mn) select e entity, mn::double margin, coalesce(price between least(a,b) and greatest(a,b), false) reached, case when price between least(a,b) and greatest(a,b) then 0.0 end miss from p")


def screen(spark, d):
    """Companies by how much growth their price asks for beyond what they show, the most demanding first within each rate."""
    from pyspark.sql import Window

    c = company(spark, d).withColumn("gap", F.round(F.col("price") - value_with(None), 4))
    order = Window.partitionBy("rate").orderBy(F.col("gap").desc(), "e")
    return c.select(F.col("e").alias("entity"), F.round("rate", 2).alias("rate"), "gap", F.row_number().over(order).alias("place"))


SCREEN_SQL = doubles(f"with recursive {COMPANY}, {years_sql(sbc='0.0', issue=False, nol='0.0')}, k as (select e, rate, round(any_value(price) - (sum(fc/power(1+rate,t-0.5)) + max(fc) filter (where t=10)*(1+any_value(tg))/(rate-any_value(tg))*power(1+rate,-9.5) - any_value(debt-cash))/any_value(shares),4) gap from y where t>0 group by e, rate) select e entity, round(rate,2) rate, gap, row_number() over (partition by rate order by gap desc, e)::int place from k")

SHOCKS = (("g1", 0.03), ("mn", 0.02), ("rate", 0.01), ("tg", 0.004))
#: Rows of a factor of the shocks' correlations; each row's squares sum to one.
FACTOR = ((1.0, 0.0, 0.0, 0.0), (0.3, 0.953939201416946, 0.0, 0.0), (-0.2, 0.0, 0.979795897113271, 0.0), (0.1, 0.0, 0.2, 0.974679434480896))
DRAWS = 200


def draws(spark):
    """draw and four correlated standard normal shocks, a function of the draw's number alone."""
    u = lambda k: (sg.uniform(F.col("draw"), F.lit(k)) * 4294967296.0 + 0.5) / 4294967296.0
    z = [F.sqrt(-2 * F.ln(u(2 * k))) * F.cos(2 * 3.141592653589793 * u(2 * k + 1)) for k in range(4)]
    base = spark.range(DRAWS).select(F.col("id").alias("draw")).select("draw", *[x.alias(f"z{k}") for k, x in enumerate(z)])
    mixed = [sum((F.col(f"z{j}") * w for j, w in enumerate(row) if w), F.lit(0.0)).alias(f"s{k}") for k, row in enumerate(FACTOR)]
    return base.select("draw", *mixed)


def simulated(spark, d):
    """draws by company (every one whose key ends a hundred's cycle would do; here all): its value under the draw's shocks, none where growth reaches the rate."""
    c = company(spark, d).crossJoin(F.broadcast(draws(spark)))
    moved = {k: F.col(k) + F.col(f"s{i}") * sd for i, (k, sd) in enumerate(SHOCKS)}
    return c.withColumn("value", F.when((moved["tg"] < moved["rate"]) & (moved["rate"] > 0), value_with(None, **moved)))


def simulation(spark, d):
    """The draws' values of a company in one row, summed up beside it: nothing but companies is dealt."""
    shocks = np.array([[r[f"s{i}"] for i in range(len(SHOCKS))] for r in draws(spark).collect()])
    points = (0.05, 0.25, 0.5, 0.75, 0.95)
    names = ["n", "rejected", *[f"p{int(p * 100):02d}" for p in points], "mean", "sd", "above_price", "price_percentile"]

    def summed(values: np.ndarray, price: np.ndarray, heads: np.ndarray) -> list[np.ndarray]:
        """Of the rows of every company (one, unless its key is repeated) all draws together."""
        total = np.diff(np.append(heads, len(values)))
        above, below = (np.add.reduceat(x.sum(axis=1), heads) for x in (values > price, values <= price))
        every = np.full((len(heads), total.max(), values.shape[1]), np.nan)
        owner = np.repeat(np.arange(len(heads)), total)
        every[owner, np.arange(len(values)) - heads[owner]] = values
        every = np.sort(every.reshape(len(heads), -1), axis=1)
        n = (~np.isnan(every)).sum(axis=1)
        some = np.where(n == 0, np.nan, n)
        mean = np.nansum(every, axis=1) / some
        sd = np.sqrt(np.nansum((every - mean[:, None]) ** 2, axis=1) / some)
        return [n, total * values.shape[1] - n, *[folds.quantile(every, n, p) for p in points], mean, sd, above / some, below / some]

    def simulate(lists: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(lists), 500):
            part = lists[at : at + 500]
            x = plain(part.flatten().flatten(), 1)
            moved = {k: x[k] + shocks[:, i].reshape(1, -1) * sd for i, (k, sd) in enumerate(SHOCKS)}
            with np.errstate(all="ignore"):
                ok = (moved["tg"] < moved["rate"]) & (moved["rate"] > 0)
                values = np.where(ok, share_value(x, **{**moved, "rate": np.where(ok, moved["rate"], np.nan)}), np.nan)
            sizes = part.value_lengths().to_numpy(zero_copy_only=False)
            parts.append(summed(values, x["price"], np.cumsum(sizes) - sizes))
        out = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * len(names)
        return pa.StructArray.from_arrays([*[pa.array(c.astype(np.int64)) for c in out[:2]], *[nulls(c) for c in out[2:]]], names)

    kind = "struct<" + ",".join(f"{k}:{'long' if i < 2 else 'double'}" for i, k in enumerate(names)) + ">"
    listed = spread(spark, company(spark, d)).groupBy("e").agg(F.collect_list(F.struct(*FIGURES)).alias("c"))
    c = listed.select("e", F.arrow_udf(simulate, kind)("c").alias("s"))
    places = lambda k: 6 if k in ("above_price", "price_percentile") else 3
    return c.select(F.col("e").alias("entity"), "s.n", "s.rejected", *[F.round(f"s.{k}", places(k)).alias(k) for k in names[2:]])


def _u(k):
    return f"((('0x'||substr(md5(draw::varchar||chr(124)||'{k}'),1,8))::bigint+0.5::double)/4294967296.0::double)"


DRAWS_CTE = doubles("zz as (select draw, " + ", ".join(f"sqrt(-2*ln({_u(2 * k)}))*cos(2*3.141592653589793*{_u(2 * k + 1)}) z{k}" for k in range(4)) + f" from range({DRAWS}) r(draw)), ss as (select draw, " + ", ".join("+".join(f"z{j}*({w})" for j, w in enumerate(row) if w) + f" s{k}" for k, row in enumerate(FACTOR)) + " from zz)")
#: The value under shocks in closed list form: revenue is a running product of the years' growth.
SIM_VALUE = doubles(
    "sm as (select c.e, draw, price, debt, cash, shares, rev, gn, m1, tax, g1+s0*0.03 g1, mn+s1*0.02 mn, rate+s2*0.01 w, tg+s3*0.004 x from c, ss),"
    " sg as (select *, list_transform(range(0,11), lambda k: case when k=0 then rev else rev*list_product(list_transform(range(0,k), lambda t: 1+g1+(gn-g1)*(t/9.0))) end) rv from sm),"
    " sf as (select *, list_transform(range(1,11), lambda k: rv[k+1]*(m1+(mn-m1)*((k-1)/9.0))-tax*greatest(rv[k+1]*(m1+(mn-m1)*((k-1)/9.0)),0.0)+0.04*rv[k+1]-0.05*rv[k+1]-(0.02*rv[k+1]-0.02*rv[k])) fc from sg),"
    " sv as (select *, case when x<w and w>0 then (list_sum(list_transform(range(1,11), lambda k: fc[k]/power(1+w,k-0.5)))+fc[10]*(1+x)/(w-x)*power(1+w,-9.5)-(debt-cash))/shares end val from sf)"
)
SIM_SQL = f"with {COMPANY}, {DRAWS_CTE}, {SIM_VALUE} select e entity, count(val)::bigint n, sum((val is null)::int)::bigint rejected, " + ", ".join(f"round(quantile_cont(val,{p}),3) p{int(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", round(avg(val),3) mean, round(stddev_pop(val),3) sd, round(avg((val>price)::int::double) filter (where val is not null),6) above_price, round(avg((val<=price)::int::double) filter (where val is not null),6) price_percentile from sv group by e"


def tornado(spark, d):
    """For every company and shock the value at its 5th and 95th percentile, the others at their base, by the swing."""
    c = company(spark, d)
    parts = []
    for k, sd in SHOCKS:
        low, high = ({k: F.col(k) + q * sd} for q in (-1.6448536269514722, 1.6448536269514722))
        parts.append(c.select(F.col("e").alias("entity"), F.lit(k).alias("driver"), F.round(value_with(None, **low), 3).alias("low"), F.round(value_with(None, **high), 3).alias("high")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.withColumn("swing", F.round(F.abs(F.col("high") - F.col("low")), 3))


TORNADO_SQL = doubles(f"with {COMPANY}, ss as (select * from (values " + ", ".join(f"('{k}', {q}, {', '.join(str(float(i == j)) for j in range(4))})" for i, (k, _) in enumerate(SHOCKS) for q in ("-1.6448536269514722", "1.6448536269514722")) + ") t(driver, draw, a0, a1, a2, a3)), sx as (select driver, draw, a0*draw s0, a1*draw s1, a2*draw s2, a3*draw s3 from ss), " + SIM_VALUE.replace("from c, ss)", "from c, sx)").replace("select c.e, draw,", "select c.e, driver, draw,") + ", tw as (select e, driver, round(max(val) filter (where draw<0),3) low, round(max(val) filter (where draw>0),3) high from sv group by e, driver) select e entity, driver, low, high, round(abs(high-low),3) swing from tw")


def solver_cases(spark, d):
    """A falling perpetuity and a rising line, with targets within and out of reach."""
    c = company(spark, d).where("rev > 0")
    flow = F.col("rev") * 0.1
    fall = v.solve_monotone(lambda r: flow * 1.02 / (r - 0.02), flow * F.when(F.col("e") % 5 == 0, 200.0).otherwise(12.0), 0.03, 1.0)
    rise = v.solve_monotone(lambda x: flow * x, flow * F.when(F.col("e") % 4 == 0, 3.0).otherwise(0.25), 0.0, 1.0)
    both = c.select(F.col("e").alias("entity"), F.explode(F.array(F.struct(F.lit("falling").alias("kind"), fall.alias("s")), F.struct(F.lit("rising").alias("kind"), rise.alias("s")))).alias("x"))
    return both.select("entity", "x.kind", F.round("x.s.root", 6).alias("root"), "x.s.reached", "x.s.edge")


SOLVER_SQL = doubles(f"with {COMPANY} select e entity, 'falling' kind, case when e%5<>0 then round(0.02+1.02/12.0,6) end root, e%5<>0 reached, case when e%5=0 then 0.03 end edge from c union all select e, 'rising', case when e%4<>0 then 0.25 end, e%4<>0, case when e%4=0 then 1.0 end from c")

QUERIES = {
    "project_years": (project_years, YEARS_SQL),
    "discount_factors": (factors, FACTORS_SQL),
    "run_dcf": (dcf, DCF_SQL),
    "ev_bridge": (bridges, BRIDGES_SQL),
    "capital_costs": (capital_costs, CAPITAL_SQL),
    "apv": (apv_of, APV_SQL),
    "sensitivity_growth": (grid("growth", RATES), grid_sql("growth", RATES)),
    "sensitivity_exit": (grid("multiple", MULTIPLES), grid_sql("multiple", MULTIPLES)),
    "implied_discount_rate": (implied("rate", 0.03, 0.6), implied_sql("rate", 0.03, 0.6)),
    "implied_growth": (implied("g1", -0.3, 0.8), implied_sql("g1", -0.3, 0.8)),
    "implied_margin": (implied("mn", -0.2, 0.7), implied_sql("mn", -0.2, 0.7)),
    "implied_duration": (duration, DURATION_SQL),
    "growth_margin_frontier": (frontier, FRONTIER_SQL),
    "demand_screen": (screen, SCREEN_SQL),
    "simulation_percentiles": (simulation, SIM_SQL),
    "tornado": (tornado, TORNADO_SQL),
    "solver_cases": (solver_cases, SOLVER_SQL),
}
