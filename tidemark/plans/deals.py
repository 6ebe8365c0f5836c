"""Queries over mergers of each company with the next one, metric packs, sums of parts and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import merger as mg
from tidemark.functions import metrics as mt
from tidemark.functions import valuation as v
from tidemark.plans.valuation import COMPANY, company, doubles

FEES, FIN = 20.0, 10.0


def pairs(spark, d):
    """Each company as the acquirer of the one with the next key."""
    a = company(spark, d).withColumns({"ni": (F.col("rev") * F.col("m1") - F.col("debt") * 0.06) * 0.75, "book": F.col("rev") * 0.6})
    t = a.select(*[F.col(c).alias(f"t_{c}") for c in a.columns])
    return a.join(t, F.col("e") + 1 == F.col("t_e"))


PAIRS = doubles(f"{COMPANY}, ni as (select *, (rev*m1-debt*0.06)*0.75 ni, rev*0.6 book from c), pr as (select a.*, t.e t_e, t.rev t_rev, t.m1 t_m1, t.price t_price, t.shares t_shares, t.debt t_debt, t.cash t_cash, t.ni t_ni, t.book t_book, t.ebitda t_ebitda from ni a join ni t on t.e=a.e+1)")


def offer(premium=0.3, pct_cash=0.5):
    return mg.consideration(F.col("price"), F.col("t_price"), F.col("t_shares"), F.col("t_debt") - F.col("t_cash"), premium, pct_cash, fees=FEES, financing_fees=FIN, repaid=F.col("t_debt"), repay_premium=0.01, cash_available=F.col("cash"))


OFFER = "of as (select *, t_price*(1+{p}) offer, t_price*(1+{p})*t_shares eq, t_debt rp, t_debt*0.01 rc from {src}), fu as (select *, {c}*eq ca, (1-{c})*eq st, {c}*eq+20.0+10.0+rp+rc need from of), cn as (select *, least(cash, need) cu, need-least(cash, need) nd, st/price ns, offer/price xr from fu)"


def offer_sql(src="pr", p="0.3", c="0.5"):
    return doubles(OFFER.format(src=src, p=p, c=c))


def considered(spark, d):
    df = pairs(spark, d).withColumn("o", offer())
    return df.select(F.col("e").alias("entity"), *[F.round(f"o.{c}", 4).alias(c) for c in ("offer", "equity", "enterprise", "cash", "stock", "new_shares", "exchange_ratio", "cash_used", "new_debt")], F.round(F.abs(mg.funding_gap(F.col("o"), FEES, FIN)), 3).alias("gap"))


CONSIDERED_SQL = doubles(f"with {PAIRS}, {offer_sql()} select e entity, round(offer,4) offer, round(eq,4) equity, round(eq+t_debt-t_cash,4) enterprise, round(ca,4) cash, round(st,4) stock, round(ns,4) new_shares, round(xr,4) exchange_ratio, round(cu,4) cash_used, round(nd,4) new_debt, 0.0 gap from cn")


def walk(o):
    return mg.accretion(o, F.col("ni"), F.col("t_ni"), F.col("shares"), F.col("tax"), synergies=40.0, phase_in=0.5, financing_fees=FIN, interest_stopped=F.col("t_debt") * 0.06)


WALK = doubles("wk as (select *, ni+t_ni+0.75*(t_debt*0.06-nd*0.06-cu*0.03-10.0/5-0.0) bf, shares+ns sh from cn), ac as (select *, bf+40.0*0.5*0.75 inc, ni/shares ea, (bf+40.0*0.5*0.75)/sh ep from wk)")


def accretive(spark, d):
    df = pairs(spark, d).withColumn("o", offer()).withColumn("w", walk(F.col("o")))
    return df.select(F.col("e").alias("entity"), *[F.round(f"w.{c}", 5).alias(c) for c in ("income", "shares", "eps_alone", "eps", "gain", "gain_pct")], F.round("w.breakeven", 3).alias("breakeven"))


ACCRETION_SQL = doubles(f"with {PAIRS}, {offer_sql()}, {WALK} select e entity, round(inc,5) income, round(sh,5) shares, round(ea,5) eps_alone, round(ep,5) eps, round(ep-ea,5) gain, case when ea>=0.1 then round((ep-ea)/ea,5) end gain_pct, round((ea*sh-bf)/0.75/0.5,3) breakeven from ac")


def accretion_grid(spark, d):
    """Accretion for five premiums against five shares of cash."""
    df = pairs(spark, d).withColumn("premium", F.explode(F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4, 0.5))))).withColumn("pct_cash", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))))
    df = df.withColumn("o", offer(F.col("premium"), F.col("pct_cash"))).withColumn("w", walk(F.col("o")))
    return df.select(F.col("e").alias("entity"), "premium", "pct_cash", F.round("w.gain", 5).alias("gain"), F.round("w.gain_pct", 5).alias("gain_pct"))


GRID_SQL = doubles(f"with {PAIRS}, ax as (select pr.*, pp, cc from pr, (values (0.1),(0.2),(0.3),(0.4),(0.5)) a(pp), (values (0.0),(0.25),(0.5),(0.75),(1.0)) b(cc)), {offer_sql('ax', 'pp', 'cc')}, {WALK} select e entity, pp::double premium, cc::double pct_cash, round(ep-ea,5) gain, case when ea>=0.1 then round((ep-ea)/ea,5) end gain_pct from ac")


def opening(spark, d):
    df = pairs(spark, d).withColumn("o", offer())
    x = mg.opening_balance_sheet(F.col("o.equity"), F.col("t_book"), F.col("tax"), deferred_tax_assets=F.col("t_rev") * 0.01)
    return df.withColumn("x", x).select(F.col("e").alias("entity"), *[F.round(f"x.{c}", 4).alias(c) for c in ("excess", "intangibles", "dtl", "goodwill")])


OPENING_SQL = doubles(f"with {PAIRS}, {offer_sql()}, x as (select *, eq-t_book ex, case when eq-t_book>0 then 0.3*(eq-t_book) else 0.0 end it from cn) select e entity, round(ex,4) excess, round(it,4) intangibles, round(tax*it,4) dtl, round(ex-it+tax*it-t_rev*0.01,4) goodwill from x")


def rolled(spark, d):
    df = pairs(spark, d).withColumn("o", offer())
    df = df.withColumn("x", mg.opening_balance_sheet(F.col("o.equity"), F.col("t_book"), F.col("tax")))
    base = F.col("rev") + F.col("t_rev")
    margin = (F.col("rev") * F.col("m1") + F.col("t_rev") * F.col("t_m1")) / base
    rows = mg.roll_forward(base, margin, F.col("tax"), F.col("debt") + F.col("o.new_debt"), F.col("x.intangibles") / 8.0, haircut=F.col("t_rev") * 0.02, fee=F.lit(FIN / 5))
    return df.withColumn("y", F.explode(rows)).select(F.col("e").alias("entity"), F.col("y.year").alias("year"), *[F.round(f"y.{c}", 4).alias(c) for c in ("revenue", "pretax", "income", "fcf", "debt")])


ROLLED_SQL = doubles(f"""with recursive {PAIRS}, {offer_sql()}, b as (select *, rev+t_rev bs, (rev*m1+t_rev*t_m1)/(rev+t_rev) mg, case when eq-t_book>0 then 0.3*(eq-t_book) else 0.0 end/8.0 am from cn),
y as (select e, 0 t, bs rv, debt+nd db, 0.0 pt, 0.0 inc, 0.0 fcf, bs, mg, am, tax, t_rev*0.02 hc from b
 union all select e, t+1, r2, db-least(greatest(f2,0.0)*0.5, db), p2, p2-tax*greatest(p2,0.0), f2, bs, mg, am, tax, hc from (select *, p2-tax*greatest(p2,0.0)+am+2.0+(0.04-0.05)*r2-0.02*(r2-rv) f2 from (select *, r2*mg-db*0.06-am-2.0 p2 from (select *, bs*power(1.05,t)-case when t=0 then hc else 0.0 end r2 from y where t<5))))
select e entity, t::int as year, round(rv,4) revenue, round(pt,4) pretax, round(inc,4) income, round(fcf,4) fcf, round(db,4) debt from y where t>0""")


def contributed(spark, d):
    p = pairs(spark, d)
    return p.select(F.col("e").alias("entity"), *[F.round(mg.contribution(F.col(a), F.col(f"t_{a}")), 6).alias(f"{n}_share") for a, n in (("rev", "revenue"), ("ebitda", "ebitda"), ("ni", "income"))])


CONTRIBUTED_SQL = doubles(f"with {PAIRS} select e entity, " + ", ".join(f"case when {a}>=0 and t_{a}>=0 and {a}+t_{a}>0 then round({a}/({a}+t_{a}),6) end {n}_share" for a, n in (("rev", "revenue"), ("ebitda", "ebitda"), ("ni", "income"))) + " from pr")


def merged(spark, d):
    """The whole deal in one row: offer, funding, accretion, goodwill and debt after five years."""
    df = pairs(spark, d).withColumn("o", offer()).withColumn("w", walk(F.col("o"))).withColumn("x", mg.opening_balance_sheet(F.col("o.equity"), F.col("t_book"), F.col("tax")))
    return df.select(F.col("e").alias("entity"), F.round("o.equity", 4).alias("equity"), F.round("o.new_debt", 4).alias("new_debt"), F.round("w.gain", 5).alias("gain"), F.round("x.goodwill", 4).alias("goodwill"))


MERGED_SQL = doubles(f"with {PAIRS}, {offer_sql()}, {WALK} select e entity, round(eq,4) equity, round(nd,4) new_debt, round(ep-ea,5) gain, round((eq-t_book)-case when eq-t_book>0 then 0.3*(eq-t_book) else 0.0 end*(1-tax),4) goodwill from ac")

LINES = "case e%4 when 0 then 'software' when 1 then 'media' when 2 then 'towers' else 'telecom' end"


def packs(spark, d):
    """One metric pack a company, by its line of business."""
    c = company(spark, d)
    ev = F.col("price") * F.col("shares") + F.col("debt") - F.col("cash")
    before = F.col("rev") / (1 + F.col("g1") - 0.05)
    ebit, fcf = F.col("rev") * F.col("m1"), F.col("rev") * (F.col("m1") - 0.01)
    c = c.withColumns({"ev": ev, "line": F.expr(LINES)})
    c = c.withColumn("s", mt.software(F.col("rev"), before, F.col("ebitda"), fcf, ebit, F.col("rev") * 0.3, F.lit(0.7), F.col("rev") * 0.9, F.col("ev"), F.col("rev") * 1.2, mt.billings(F.col("rev"), F.col("rev") * 0.2, before * 0.2)))
    c = c.withColumn("m", mt.media(F.col("rev") * 0.4, F.col("rev") * 0.35, F.col("ebitda"), F.col("ev")))
    c = c.withColumn("t", mt.telecom(F.col("rev"), F.col("ebitda"), F.col("rev") * 0.15, F.col("debt") - F.col("cash"), F.col("debt") * 0.06, F.col("rev") * 0.05, F.col("price") * F.col("shares"), F.col("line") == "towers"))
    c = c.withColumn("u", mt.subscriber_check(F.col("rev"), F.col("shares") * 2, F.col("shares"), F.col("rev") / (F.col("shares") * 18) * F.when(F.col("e") % 3 == 0, 1.3).otherwise(1.02)))
    soft, tele = F.col("line") == "software", F.col("line").isin("towers", "telecom")
    one = lambda on, name: F.round(F.when(on, F.col(name)), 5)
    return c.select(F.col("e").alias("entity"), "line", *[one(soft, f"s.{n}").alias(n) for n in ("rule_ebitda", "rule_fcf", "rule_spread", "magic", "payback_months", "ev_arr", "billings_cover")], *[one(F.col("line") == "media", f"m.{n}").alias(n) for n in ("content_gap", "ev_after_gap")], *[one(tele, f"t.{n}").alias(n) for n in ("capex_intensity", "leverage", "affo", "price_affo")], F.when(tele, F.col("u.inconsistent")).alias("inconsistent"))


PACKS_SQL = doubles(f"""with {COMPANY}, b as (select *, {LINES} line, price*shares+debt-cash ev, rev/(1+g1-0.05) bf, rev*m1 eb, rev*(m1-0.01) fc, price*shares eq from c),
k as (select *, rev/bf-1 g, (rev-bf)/(rev*0.3) mgc, rev*0.4-rev*0.35 gap, ebitda-(debt*0.06)-(rev*0.05) af from b)
select e entity, line, {", ".join(f"case when line='software' then round({x},5) end {n}" for n, x in (("rule_ebitda", "100*(g+ebitda/rev)"), ("rule_fcf", "100*(g+fc/rev)"), ("rule_spread", "greatest(100*(g+ebitda/rev),100*(g+fc/rev),100*(g+eb/rev))-least(100*(g+ebitda/rev),100*(g+fc/rev),100*(g+eb/rev))"), ("magic", "mgc"), ("payback_months", "case when mgc>0 then 12/(mgc*0.7) end"), ("ev_arr", "ev/(rev*0.9)"), ("billings_cover", "(rev+rev*0.2-bf*0.2)/rev")))},
{", ".join(f"case when line='media' then round({x},5) end {n}" for n, x in (("content_gap", "gap"), ("ev_after_gap", "case when ebitda-gap>0 then ev/(ebitda-gap) end")))},
{", ".join(f"case when line in ('towers','telecom') then round({x},5) end {n}" for n, x in (("capex_intensity", "0.15*rev/rev"), ("leverage", "case when ebitda>0 then (debt-cash)/ebitda end"), ("affo", "case when line='towers' then af end"), ("price_affo", "case when line='towers' and af>0 then eq/af end")))},
case when line in ('towers','telecom') then e%3=0 end inconsistent from k""")


def multiples(spark, d):
    ev = F.col("price") * F.col("shares") + F.col("debt") - F.col("cash")
    x = mt.peer_metrics(ev, F.col("price") * F.col("shares"), F.col("rev"), F.col("ebitda"), F.col("rev") * F.col("m1"), (F.col("rev") * F.col("m1") - F.col("debt") * 0.06) * 0.75, F.col("rev") * (F.col("m1") - 0.01))
    return company(spark, d).withColumn("x", x).select(F.col("e").alias("entity"), *[F.round(f"x.{c}", 6).alias(c) for c in mt.CAPS], "x.flags")


def _multiple_sql():
    raw = {"ev_revenue": ("ev", "rev"), "ev_ebitda": ("ev", "ebitda"), "ev_ebit": ("ev", "eb"), "pe": ("eq", "ni"), "fcf_yield": ("fc", "eq")}
    kept = ", ".join(f"case when {b}>0 and {a}/{b}<={mt.CAPS[k]} then round({a}/{b},6) end {k}" for k, (a, b) in raw.items())
    flags = ", ".join(f"case when {b}<=0 then '{k}: no positive base' when {a}/{b}>{mt.CAPS[k]} then '{k}: beyond its cap' end" for k, (a, b) in raw.items())
    return doubles(f"with {COMPANY}, b as (select *, price*shares+debt-cash ev, price*shares eq, rev*m1 eb, (rev*m1-debt*0.06)*0.75 ni, rev*(m1-0.01) fc from c) select e entity, {kept}, concat_ws('; ', {flags}) flags from b")


def implied_values(spark, d):
    """Each company's equity a share at the quartiles of its sector's revenue multiple (the companies of its line)."""
    ev = F.col("price") * F.col("shares") + F.col("debt") - F.col("cash")
    c = company(spark, d).withColumns({"line": F.expr(LINES), "x": v.ratio(ev, F.col("rev"))})
    band = c.groupBy("line").agg(*[F.percentile("x", F.lit(p)).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)], F.count("x").alias("n"))
    met = c.join(F.broadcast(band), "line")
    return met.select(F.col("e").alias("entity"), "line", "n", *[F.round((F.col(q) * F.col("rev") - F.col("debt") + F.col("cash")) / F.col("shares"), 4).alias(f"per_share_{q}") for q in ("q25", "q50", "q75")])


IMPLIED_SQL = doubles(f"with {COMPANY}, b as (select *, {LINES} line, case when rev>0 then (price*shares+debt-cash)/rev end x from c), q as (select line, quantile_cont(x,0.25) q25, quantile_cont(x,0.5) q50, quantile_cont(x,0.75) q75, count(x)::bigint n from b group by line) select e entity, line, n, " + ", ".join(f"round(({q}*rev-debt+cash)/shares,4) per_share_{q}" for q in ("q25", "q50", "q75")) + " from b join q using (line)")


def parts(spark, d):
    seg = F.array(*[F.struct(F.lit(n).alias("segment"), (F.col("rev") * w).alias("metric"), F.lit(m).alias("multiple")) for n, w, m in (("core", 0.6, 2.0), ("cloud", 0.3, 6.0), ("ventures", -0.05, 3.0))])
    rows = company(spark, d).select(F.col("e").alias("entity"), F.explode(seg).alias("s"), (F.col("rev") * 0.02 * (F.col("e") % 40 + 1)).alias("cost"), (F.col("debt") - F.col("cash")).alias("claims")).select("entity", "s.*", "cost", "claims")
    return mt.value_segments(rows, "entity", "metric", "multiple")


def segments(spark, d):
    return parts(spark, d).select("entity", "segment", F.round("value", 4).alias("value"), F.round("share", 6).alias("share"), "reason")


def sotp(spark, d):
    out = mt.sum_of_parts(parts(spark, d), "entity", F.col("cost"), F.lit(8.0), 0.15, F.col("claims"))
    return out.select("entity", *[F.round(c, 4).alias(c) for c in ("gross", "drag", "ev", "equity")], "reason")


SEGMENTS_SQL = doubles(f"with {COMPANY}, s as (select e entity, unnest(['core','cloud','ventures']) segment, unnest([rev*0.6*2.0, rev*0.3*6.0, null]) vl from c) select entity, segment, round(vl,4) as value, round(vl/sum(vl) over (partition by entity),6) share, case when vl is null then 'metric is not positive' end reason from s")
SOTP_SQL = doubles(f"with {COMPANY}, s as (select e entity, rev*0.6*2.0+rev*0.3*6.0 gross, rev*0.02*(e%40+1)*8.0 drag, debt-cash cl from c) select entity, round(gross,4) gross, round(drag,4) drag, case when gross-drag>0 then round((gross-drag)*(1-0.15),4) end ev, case when gross-drag>0 then round((gross-drag)*(1-0.15)-cl,4) end equity, case when gross-drag<=0 then 'nothing is left after corporate costs' end reason from s")

FIGURES = {
    "rev": "rev", "rev_1y": "rev/(1+g1-0.05)", "rev_3y": "rev/1.3", "ebit": "rev*m1", "ebit_1y": "rev*m1*0.8", "ebitda": "ebitda", "fcf": "rev*(m1-0.01)", "income": "(rev*m1-debt*0.06)*0.75", "capex": "rev*0.05", "rd": "case when e%5<>0 then rev*0.1 end", "sga": "rev*0.2",
    "debt": "debt", "cash": "cash", "equity_book": "rev*0.6-debt", "assets": "rev*1.4", "ev": "price*shares+debt-cash", "equity": "price*shares",
}


def features(spark, d):
    c = company(spark, d)
    f = {k: F.expr(x).cast("double") for k, x in ((k, doubles(x).replace("::double", "D")) for k, x in FIGURES.items())}
    got = mt.feature_set(f)
    return c.select(F.col("e").alias("entity"), *[F.round(x, 6).alias(k) for k, x in got.items()])


def _feature_sql():
    base = ", ".join(f"({x})::double f_{k}" for k, x in FIGURES.items())
    r = lambda a, b: f"case when {b}>0 then ({a})/({b}) end"
    g1, g3 = "case when f_rev_1y>0 then f_rev/f_rev_1y-1 end", "case when f_rev>0 and f_rev_3y>0 then power(f_rev/f_rev_3y,1.0/3)-1 end"
    inv = "f_debt+f_equity_book-f_cash"
    q = {
        "growth_1y": g1, "cagr_3y": g3, "acceleration": f"({g1})-({g3})", "ebit_margin": r("f_ebit", "f_rev"), "ebitda_margin": r("f_ebitda", "f_rev"), "fcf_margin": r("f_fcf", "f_rev"), "net_margin": r("f_income", "f_rev"), "ebit_margin_change": f"({r('f_ebit', 'f_rev')})-({r('f_ebit_1y', 'f_rev_1y')})",
        "capex_intensity": r("f_capex", "f_rev"), "rd_intensity": r("f_rd", "f_rev"), "sga_intensity": r("f_sga", "f_rev"), "rule_of_40": f"({g1})+({r('f_fcf', 'f_rev')})", "roic": r("f_ebit*(1-0.25)", inv), "leverage": r("f_debt-f_cash", "f_ebitda"), "cash_to_assets": r("f_cash", "f_assets"), "asset_turnover": r("f_rev", "f_assets"),
        "ev_revenue": r("f_ev", "f_rev"), "ev_ebitda": r("f_ev", "f_ebitda"), "earnings_yield": r("f_income", "f_equity"), "fcf_yield": r("f_fcf", "f_equity"), "book_to_market": r("f_equity_book", "f_equity"), "log_revenue": "ln(f_rev)", "log_equity": "ln(f_equity)", "log_assets": "ln(f_assets)",
    }
    return doubles(f"with {COMPANY}, f as (select e, {base} from c) select e entity, " + ", ".join(f"round({x},6) {k}" for k, x in q.items()) + " from f")


QUERIES = {
    "consideration": (considered, CONSIDERED_SQL),
    "accretion": (accretive, ACCRETION_SQL),
    "accretion_grid": (accretion_grid, GRID_SQL),
    "opening_balance_sheet": (opening, OPENING_SQL),
    "purchase_accounting": (rolled, ROLLED_SQL),
    "contribution": (contributed, CONTRIBUTED_SQL),
    "merger_summary": (merged, MERGED_SQL),
    "metric_packs": (packs, PACKS_SQL),
    "peer_multiples": (multiples, _multiple_sql()),
    "implied_by_peers": (implied_values, IMPLIED_SQL),
    "value_segments": (segments, SEGMENTS_SQL),
    "sum_of_parts": (sotp, SOTP_SQL),
    "feature_rows": (features, _feature_sql()),
}
