"""Queries that test the cheapness score against the return that followed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import crosssection as cs
from tidemark.operators import signals as sg
from tidemark.plans.panel import IC, MID, PANEL, ic, panel
from tidemark.sources.tables import load

K = 5


def scored(spark, d):
    return panel(spark, d).where("ret is not null")


def rounded(df, *names, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


def quintiles(spark, d):
    out = sg.quantile_returns(scored(spark, d), "score", "ret", K)
    return rounded(out, "value_from", "value_to", "mean_value", "mean_return", "median_return")


QUINTILE_SQL = f"""{PANEL}, u as (select *, rank() over (order by score)-1 r0, count(*) over (partition by score) ties, count(*) over () n from t where ret is not null),
m as (select *, (2*r0+ties-1)//2 p, n//{K} sz, n%{K} lg from u),
b as (select *, (case when p < (sz+1)*lg then p//(sz+1) else lg + (p-(sz+1)*lg)//sz end)+1 bucket from m)
select bucket::int bucket, count(*)::bigint n, round(min(score),6) value_from, round(max(score),6) value_to, round(avg(score),6) mean_value, round(avg(ret),6) mean_return, round(median(ret),6) median_return from b group by bucket"""

MEMBERS = f"{PANEL}, mb as (select * from (select *, ntile({K}) over (partition by as_of order by score, symbol) bucket, count(*) over (partition by as_of) n from t where ret is not null) where n >= {2 * K})"
BY = "bd as (select as_of, bucket, avg(ret) r, avg(score) v, count(*) m from mb group by all)"


def members(spark, d):
    return sg.bucket_members(scored(spark, d), "score", "as_of", K, "symbol")


def table(spark, d):
    return rounded(sg.bucket_table(members(spark, d), "score", "ret", "as_of"), "names", "mean_value", "mean_ret", "median_ret", "positive")


def spread(spark, d):
    return rounded(sg.bucket_spread(members(spark, d), "score", "ret", "as_of", K), "spread", "monotonicity", "steps_up")


SPREAD_CTE = f"sp as (select avg(s) spread, count(*)::bigint dates from (select as_of, max(r) filter (bucket={K}) - max(r) filter (bucket=1) s from bd group by as_of)), mm as (select bucket, avg(r) mr from bd group by bucket)"
SPREAD_SQL = f"{MEMBERS}, {BY}, {SPREAD_CTE} select round(spread,6) spread, dates, (select round(corr(a,b),6) from (select rank() over (order by bucket) a, rank() over (order by mr) b from mm)) monotonicity, (select round(avg(up),6) from (select (mr > lag(mr) over (order by bucket))::int::double up from mm)) steps_up from sp"


def turned(spark, d):
    return rounded(sg.turnover(members(spark, d), "symbol", "as_of", K), "top", "bottom", "churn")


TURN_CTE = f"""dt as (select as_of, lag(as_of) over (order by as_of) p from (select distinct as_of from mb)),
tn as (select x.as_of, avg(case when x.bucket={K} then case when y.bucket={K} then 0.0 else 1.0 end end) top, avg(case when x.bucket=1 then case when y.bucket=1 then 0.0 else 1.0 end end) bottom, avg(case when y.symbol is null then 1.0 else 0.0 end) churn
 from mb x join dt on x.as_of=dt.as_of and p is not null left join mb y on y.symbol=x.symbol and y.as_of=dt.p group by x.as_of)"""


def cost(spark, d):
    m = members(spark, d)
    facts = sg.bucket_spread(m, "score", "ret", "as_of", K).select(F.abs("spread").alias("_s")).crossJoin(sg.overlap_lag(m, "as_of", 12).select("spacing_days"))
    one = sg.turnover(m, "symbol", "as_of", K).crossJoin(F.broadcast(facts))
    total = sg.turnover_report(one.select("top", "bottom", "churn"), F.lit(1.0), F.lit(1.0)).select("top", "bottom", "churn", "pairs").crossJoin(facts)
    half = (F.col("top") + F.col("bottom")) / 2
    out = total.withColumns({"rebalances": 365.25 / F.col("spacing_days"), "breakeven_bps": F.when((half > 0) & (F.col("_s") > 0), F.col("_s") / (2 * half * (365.25 / F.col("spacing_days"))) * 10_000)})
    return out.select(*[F.round(c, 6).alias(c) for c in ("top", "bottom", "churn", "rebalances")], "pairs", F.round("breakeven_bps", 4).alias("breakeven_bps"))


COST_SQL = f"{MEMBERS}, {BY}, {SPREAD_CTE}, {TURN_CTE}, gp as (select median(as_of-p) sd from dt), z as (select avg(top) top, avg(bottom) bottom, avg(churn) churn, count(*)::bigint pairs from tn) select round(top,6) top, round(bottom,6) bottom, round(churn,6) churn, round(365.25/sd,6) rebalances, pairs, case when top+bottom>0 and abs(spread)>0 then round(abs(spread)/(top+bottom)/(365.25/sd)*10000,4) end breakeven_bps from z, gp, sp"


def lags(spark, d):
    parts = [sg.overlap_lag(scored(spark, d), "as_of", h).withColumn("horizon", F.lit(h)) for h in (3, 12, 24)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LAG_SQL = f"{PANEL}, g as (select as_of - lag(as_of) over (order by as_of) gap from (select distinct as_of from t where ret is not null)), m as (select median(gap)::double spacing_days from g) select spacing_days, greatest(0, ceil(h/greatest(1, round_even(spacing_days/(365.25/12),0)))-1)::int lag, h::int horizon from m, (values (3),(12),(24)) v(h)"


def p_values(spark, d):
    i = ic(spark, d).where("ic is not null")
    stat = i.select("as_of", (F.col("ic") * F.sqrt(F.col("n") - 1)).alias("t"))
    return stat.select("as_of", F.round("t", 6).alias("t"), F.round(sg.two_sided_p(F.col("t")), 6).alias("p"))


P_SQL = f"{IC}, pv as (select as_of, ic*sqrt(n-1) t, abs(ic*sqrt(n-1))/sqrt(2.0) x from ic where ic is not null), pk as (select *, 1/(1+0.3275911::double*x) k from pv) select as_of, round(t,6) t, round(k*(0.254829592::double+k*(-0.284496736::double+k*(1.421413741::double+k*(-1.453152027::double+k*1.061405429::double))))*exp(-x*x),6) p from pk"


def bootstrap(spark, d):
    return rounded(sg.block_bootstrap(ic(spark, d), "ic", "as_of", 4, 400), "se")


U = "(('0x'||substr(md5({k}),1,8))::bigint/4294967296.0::double)"
BOOT_SQL = f"{IC}, x as (select row_number() over (order by as_of)-1 i, ic x from ic where ic is not null), n as (select count(*) n from x), st as (select d draw, b, floor({U.format(k='d::varchar||chr(124)||b::varchar')}*(n-4+1))::bigint s, n from n, range(400) r(d), range(1000) q(b) where n>=4 and b<ceil(n/4.0)), pl as (select draw, s+k i from st, range(4) w(k) where b*4+k<n), m as (select draw, avg(x) m from pl join x using (i) group by draw) select count(*)::bigint draws, round(stddev_samp(m),6) se from m"


def permuted(spark, d):
    df = panel(spark, d).where("ret is not null")
    null = sg.permutation_null(df, "score", "ret", "as_of", "symbol", 40)
    own = ic(spark, d).agg(F.avg("ic").alias("own"))
    return null.crossJoin(F.broadcast(own)).agg(F.count(F.lit(1)).alias("draws"), F.round(F.avg("ic"), 5).alias("null_mean"), F.round(F.first("own"), 6).alias("ic"), F.round((F.sum((F.abs("ic") >= F.abs("own")).cast("int")) + 1) / (F.count(F.lit(1)) + 1), 6).alias("p"))


PERM_SQL = f"""{IC}, w as (select as_of, symbol, score, ret, row_number() over (partition by as_of order by symbol) i from t where ret is not null),
dl as (select r.d draw, w.as_of, w.score, row_number() over (partition by r.d, w.as_of order by {U.format(k="r.d::varchar||chr(124)||w.symbol::varchar||chr(124)||strftime(w.as_of,'%Y-%m-%d')")}, w.symbol) j from w, range(40) r(d)),
pr as (select dl.draw, dl.as_of, {MID.format(by='dl.draw, dl.as_of', v='dl.score')} a, {MID.format(by='dl.draw, dl.as_of', v='w.ret')} b from dl join w on w.as_of=dl.as_of and w.i=dl.j),
nl as (select draw, avg(c) c from (select draw, as_of, case when count(*)>=3 and min(a)<>max(a) and min(b)<>max(b) then corr(a,b) end c from pr group by all) group by draw)
select count(*)::bigint draws, round(avg(c),5) null_mean, (select round(avg(ic),6) from ic) ic, round((sum((abs(c)>=(select abs(avg(ic)) from ic))::int)+1)/(count(*)+1),6) p from nl"""


def sequential(spark, d):
    return sg.windows_in_sequence(scored(spark, d), "symbol", "as_of", 200)


SEQ_SQL = f"with recursive {PANEL[5:]}, u as (select distinct symbol, as_of from t where ret is not null), g as (select symbol, min(as_of) last, 1 n from u group by symbol union all select symbol, nx, n+1 from (select g.symbol, g.n, (select min(as_of) from u where u.symbol=g.symbol and u.as_of>=g.last+200) nx from g) where nx is not null) select symbol, max(n)::int windows from g group by symbol"


def regioned(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_nationkey") % 4).alias("vertical"))
    return scored(spark, d).join(F.broadcast(s), "symbol")


def grouped(spark, d):
    return rounded(sg.grouped_spearman(regioned(spark, d), "score", "ret", ["as_of", "vertical"], 5), "mean_ic")


GROUPED_SQL = f"{PANEL}, z as (select t.*, s_nationkey%4 vertical from t join supplier on s_suppkey=symbol where ret is not null), k as (select as_of, vertical, {MID.format(by='as_of, vertical', v='score')} a, {MID.format(by='as_of, vertical', v='ret')} b from z), c as (select as_of, vertical, case when min(a)<>max(a) and min(b)<>max(b) then corr(a,b) end ic from k group by all having count(*)>=5) select round(avg(ic),6) mean_ic, count(ic)::bigint groups from c"


def changes(spark, d):
    return rounded(sg.change_spearman(scored(spark, d), "symbol", "as_of", "score", "ret"), "ic")


CHANGE_SQL = f"{PANEL}, v as (select as_of, score-lag(score) over w dx, ret-lag(ret) over w dy from t where ret is not null window w as (partition by symbol order by as_of)), k as (select as_of, {MID.format(by='as_of', v='dx')} a, {MID.format(by='as_of', v='dy')} b from v where dx is not null and dy is not null) select as_of, count(*)::bigint n, case when count(*)>=3 and min(a)<>max(a) and min(b)<>max(b) then round(corr(a,b),6) end ic from k group by as_of"


def harness(spark, d):
    """One row: the score's mean correlation, its errors under overlap, the bucket spread and the turnover, as one report."""
    from tidemark.operators import series

    one = series.newey_west(ic(spark, d), "ic", "as_of", 3).select("n", "mean", "se_naive", "se")
    out = one.crossJoin(sg.bucket_spread(members(spark, d), "score", "ret", "as_of", K).select("spread", "monotonicity"))
    out = out.withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))
    return rounded(out.withColumn("p", sg.two_sided_p(F.col("t"))), "mean", "se_naive", "se", "spread", "monotonicity", "t", "p", places=5)


def _harness_sql():
    from tidemark.plans.panel import NEWEY_SQL

    newey = NEWEY_SQL.replace("round(max(mu),6)", "max(mu)").replace("round(sqrt((select g from g where j=0)/max(n)),6)", "sqrt((select g from g where j=0)/max(n))").replace("round(sqrt(greatest((select sum(case when j=0 then g else 2*(1-j/4.0)*g end) from g),0)/max(n)),6)", "sqrt(greatest((select sum(case when j=0 then g else 2*(1-j/4.0)*g end) from g),0)/max(n))")
    return f"with nw as ({newey}), bs as ({SPREAD_SQL.replace('round(spread,6)', 'spread').replace('round(corr(a,b),6)', 'corr(a,b)')}), q as (select n, mean, se_naive, se, spread, monotonicity, mean/se t, abs(mean/se)/sqrt(2.0) x from nw, bs), k as (select *, 1/(1+0.3275911::double*x) k from q) select n, round(mean,5) mean, round(se_naive,5) se_naive, round(se,5) se, round(spread,5) spread, round(monotonicity,5) monotonicity, round(t,5) t, round(k*(0.254829592::double+k*(-0.284496736::double+k*(1.421413741::double+k*(-1.453152027::double+k*1.061405429::double))))*exp(-x*x),5) p from k"


QUERIES = {
    "quintile_returns": (quintiles, QUINTILE_SQL),
    "bucket_report": (table, f"{MEMBERS}, {BY} select bucket::int bucket, round(avg(m),6) names, round(avg(v),6) mean_value, round(avg(r),6) mean_ret, round(median(r),6) median_ret, round(avg((r>0)::int::double),6) positive, count(*)::bigint dates from bd group by bucket"),
    "bucket_spread": (spread, SPREAD_SQL),
    "turnover": (turned, f"{MEMBERS}, {TURN_CTE} select as_of, round(top,6) top, round(bottom,6) bottom, round(churn,6) churn from tn"),
    "turnover_cost": (cost, COST_SQL),
    "overlap_lag": (lags, LAG_SQL),
    "two_sided_p": (p_values, P_SQL),
    "bootstrap_se": (bootstrap, BOOT_SQL),
    "permutation_null": (permuted, PERM_SQL),
    "sequential_windows": (sequential, SEQ_SQL),
    "grouped_spearman": (grouped, GROUPED_SQL),
    "change_spearman": (changes, CHANGE_SQL),
    "signal_report": (harness, _harness_sql()),
}
