"""Queries over facts, prices and cross-sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import crosssection as cs
from tidemark.operators import pointintime as pit
from tidemark.operators import series
from tidemark.sources.tables import facts, load, prices, quarterly

AS_OF = "1998-06-30"
P = "p as (select l_suppkey symbol, l_shipdate::date date, round(avg(l_extendedprice/l_quantity)+1e-9,6) as close from lineitem group by all)"
D = "d as (select last_day((date '1996-03-01' + to_months((3*i)::int))::date) as_of from range(0,20) r(i))"
S = "s as (select symbol, as_of from (select distinct l_suppkey symbol from lineitem), d)"
A = "a as (select s.symbol, s.as_of, p.close entry, p.date entry_date from s asof left join p on s.symbol=p.symbol and s.as_of>=p.date)"
R = "r as (select a.*, p.close as exit, p.date exit_date from a asof left join p on a.symbol=p.symbol and a.as_of + 90 <= p.date)"
T = "t as (select *, -entry score, case when entry is null then 'no price on or before the date' when exit is null then 'no price at the horizon' when entry<=0 then 'entry price is not positive' end reason, case when entry>0 then exit/entry-1 end ret from r)"
PANEL = f"with {P},{D},{S},{A},{R},{T}"
MID = "rank() over (partition by {by} order by {v}) + (count(*) over (partition by {by},{v}) - 1)/2.0"
IC = f"{PANEL}, k as (select as_of, {MID.format(by='as_of', v='score')} rx, {MID.format(by='as_of', v='ret')} ry from t where ret is not null), ic as (select as_of, count(*)::bigint n, case when count(*)>=3 and min(rx)<>max(rx) and min(ry)<>max(ry) then corr(rx,ry) end ic from k group by as_of)"
Q = "q as (select o_custkey entity, last_day((date_trunc('quarter', o_orderdate) + interval 2 month)::date) qtr, round(sum(o_totalprice),2) total from orders group by all), c as (select q.*, c_mktsegment sector from q join customer on c_custkey=entity)"


def dates(spark):
    return spark.range(20).select(F.last_day(F.add_months(F.lit("1996-03-01").cast("date"), (F.col("id") * 3).cast("int"))).alias("as_of"))


def grid(spark, d):
    symbols = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol")).distinct()
    return symbols.withColumn("as_of", F.explode(F.array(*[F.lit(r["as_of"]) for r in dates(spark).collect()])))


def panel(spark, d):
    out = series.forward_returns(grid(spark, d), prices(spark, d), 90)
    return out.withColumn("score", -F.col("entry"))


def fact_choice(as_of=None):
    def run(spark, d):
        rank = F.when(F.col("form") == "A", 0).when(F.col("form") == "R", 1).otherwise(2)
        out = pit.choose_versions(facts(spark, d), ["entity", "period"], rank, "filed", [F.col(c) for c in ("value", "tie1", "tie2", "tie3")], as_of)
        return out.select("entity", "period", "form", "filed", "value")

    return run


def fact_sql(where=""):
    return f"select entity, period, form, filed, value from (select l_orderkey entity, l_linenumber period, l_returnflag form, l_shipdate::date filed, l_extendedprice as value, row_number() over (partition by l_orderkey, l_linenumber order by case l_returnflag when 'A' then 0 when 'R' then 1 else 2 end, l_shipdate desc, l_extendedprice, l_partkey, l_suppkey, l_discount) rn from lineitem {where}) where rn=1"


def ladder(spark, d):
    f = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("tag"), F.to_date("l_shipdate").alias("date"), F.round(F.col("l_extendedprice") * F.col("l_discount"), 4).alias("value"))
    return pit.first_usable(f, ["entity"], "tag", ["R", "A", "N"], "date", "value", AS_OF, 20)


LADDER_SQL = f"with f as (select l_suppkey entity, l_returnflag tag, l_shipdate::date date, round(l_extendedprice*l_discount,4) as value from lineitem), n as (select entity, tag, max(struct_pack(d:=date, v:=value)) x from f where date<=date '{AS_OF}' and date '{AS_OF}'-date<=20 group by all), w as (select *, row_number() over (partition by entity order by (x.v=0)::int, case tag when 'R' then 1 when 'A' then 2 else 3 end) rn from n) select e.entity, w.tag, w.x.v as value, case when w.tag is null then 'no tag within tolerance' end reason from (select distinct entity from f) e left join w on w.entity=e.entity and rn=1"


def composite(spark, d):
    f = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.trunc("l_shipdate", "month").alias("period"), F.col("l_returnflag").alias("tag"), F.col("l_quantity").alias("value"), F.to_date("l_shipdate").alias("filed"))
    return pit.composite(f, ["entity", "period"], "tag", ["A", "N", "R"], "value", "filed").select("entity", "period", F.round("value", 2).alias("value"), "filed")


COMPOSITE_SQL = "select l_suppkey entity, date_trunc('month', l_shipdate)::date period, round(sum(l_quantity),2) as value, max(l_shipdate)::date filed from lineitem where l_returnflag in ('A','N','R') group by all having count(distinct l_returnflag)=3"


def weekly(spark, d):
    return series.weekly_returns(prices(spark, d)).withColumn("ret", F.round("ret", 6))


WEEKLY_SQL = f"with {P}, w as (select symbol, date_trunc('week', date) wk, max(date) to_date, arg_max(close, date) as close from p group by all), m as (select *, lag(to_date) over (partition by symbol order by wk) from_date, lag(close) over (partition by symbol order by wk) b from w) select symbol, from_date, to_date, round(close/b-1,6) ret from m where b is not null"


def range_52w(spark, d):
    return series.trailing(prices(spark, d), 365, low=F.min("close"), high=F.max("close")).select("symbol", "date", "close", "low", "high")


RANGE_SQL = f"with {P} select symbol, date, close, min(close) over w low, max(close) over w high from p window w as (partition by symbol order by date range between interval 365 days preceding and current row)"


def realised_vol(spark, d):
    return series.realised_volatility(prices(spark, d)).select("symbol", "date", "n", F.round("vol", 6).alias("vol"))


WEEKS = WEEKLY_SQL.replace("round(close/b-1,6) ret", "close/b-1 ret").replace("with p as", "with z as (with p as", 1) + ")"
VOL_SQL = WEEKS + " select x.symbol, x.to_date date, count(y.ret)::bigint n, case when count(y.ret)>=40 then round(stddev_samp(y.ret)*sqrt(52.0),6) end vol from z x left join z y on y.symbol=x.symbol and y.to_date<=x.to_date and y.from_date>=x.to_date-365 group by 1, 2"


def asof_close(cap=None):
    def run(spark, d):
        return series.asof(grid(spark, d), prices(spark, d), "symbol", "as_of", "date", "close", tolerance_days=cap)

    return run


def forward_close(spark, d):
    return series.asof(grid(spark, d), prices(spark, d), "symbol", "as_of", "date", "close", forward=True)


def forward_returns(spark, d):
    return panel(spark, d).select("symbol", "as_of", "entry", "entry_date", "exit", "exit_date", F.round("ret", 6).alias("ret"), "reason")


def ic(spark, d):
    return cs.spearman(panel(spark, d), "score", "ret", ["as_of"])


def ic_by_date(spark, d):
    return ic(spark, d).select("as_of", "n", F.round("ic", 6).alias("ic"))


def newey(spark, d):
    out = series.newey_west(ic(spark, d), "ic", "as_of", 3)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "se_naive", "se")], "reason")


NEWEY_SQL = f"{IC}, x as (select ic, row_number() over (order by as_of) i, ic-avg(ic) over () dv, avg(ic) over () mu, count(*) over () n from ic where ic is not null), g as (select j, sum(a.dv*b.dv)/max(a.n) g from range(0,4) r(j) join x a on true join x b on b.i=a.i-j group by j) select max(n)::bigint n, round(max(mu),6) mean, round(sqrt((select g from g where j=0)/max(n)),6) se_naive, round(sqrt(greatest((select sum(case when j=0 then g else 2*(1-j/4.0)*g end) from g),0)/max(n)),6) se, null::varchar reason from x"


def bucket_table(spark, d):
    """Means over dates of each bucket's mean return; dates with fewer than two names a bucket are left out."""
    from pyspark.sql import Window

    enough = F.count(F.lit(1)).over(Window.partitionBy("as_of")) >= 10
    b = cs.buckets(panel(spark, d).where("ret is not null").withColumn("_e", enough).where("_e"), "score", ["as_of"], 5, "symbol")
    by_date = b.groupBy("as_of", "bucket").agg(F.avg("ret").alias("m"), F.count(F.lit(1)).alias("n"))
    return by_date.groupBy("bucket").agg(F.round(F.avg("m"), 6).alias("mean_ret"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("dates"))


BUCKET_SQL = f"{PANEL}, b as (select * from (select *, ntile(5) over (partition by as_of order by score, symbol) bucket, count(*) over (partition by as_of) nm from t where ret is not null) where nm>=10), m as (select as_of, bucket, avg(ret) m, count(*) n from b group by all) select bucket::int bucket, round(avg(m),6) mean_ret, sum(n)::bigint n, count(*)::bigint dates from m group by bucket"


def hit_rate(spark, d):
    w = panel(spark, d).where("ret is not null")
    mean = cs.leave_one_out_mean(w, "entry", ["as_of"], "others").withColumn("up", F.col("others") / F.col("entry") - 1)
    use = mean.where("up <> 0 and ret <> 0")
    return use.groupBy("as_of").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.signum("up") == F.signum("ret")).cast("double")), 6).alias("hit_rate"))


HIT_SQL = f"{PANEL}, m as (select *, ((sum(entry) over (partition by as_of) - entry)/(count(*) over (partition by as_of)-1))/entry-1 up from t where ret is not null) select as_of, count(*)::bigint n, round(avg((sign(up)=sign(ret))::int::double),6) hit_rate from m where up<>0 and ret<>0 group by as_of"


def winsor(spark, d):
    out = cs.winsorised(quarterly(spark, d), "total", ["qtr"])
    return out.select("entity", "qtr", F.round("total", 4).alias("total"), "moved")


WINSOR_SQL = f"with {Q}, w as (select *, quantile_cont(total,0.01) over z lo, quantile_cont(total,0.99) over z hi, count(*) over z n from c window z as (partition by qtr)), x as (select entity, qtr, total t0, case when n>=20 then least(greatest(total,lo),hi) else total end total from w) select entity, qtr, round(total,4) total, total<>t0 moved from x"


def standard(spark, d):
    q = quarterly(spark, d)
    stats = q.where(F.col("qtr") <= F.lit(AS_OF).cast("date")).groupBy("sector").agg(F.avg("total").alias("m"), F.stddev_samp("total").alias("s"))
    return q.join(F.broadcast(stats), "sector").select("entity", "qtr", F.round((F.col("total") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0), 6).alias("z"))


STANDARD_SQL = f"with {Q}, st as (select sector, avg(total) m, stddev_samp(total) s from c where qtr<=date '{AS_OF}' group by sector) select entity, qtr, round((total-m)/case when s>0 then s else 1.0 end,6) z from c join st using (sector)"


def loo_mean(spark, d):
    return cs.leave_one_out_mean(quarterly(spark, d), "total", ["qtr"]).select("entity", "qtr", F.round(F.col("loo_mean") + 1e-7, 4).alias("loo_mean"))


LOO_SQL = f"with {Q} select entity, qtr, case when count(*) over z>1 then round((sum(total) over z-total)/(count(*) over z-1)+1e-7,4) end loo_mean from c window z as (partition by qtr)"


def loo_median(spark, d):
    q = quarterly(spark, d)
    return cs.leave_one_out_median(q, "total", ["qtr", "sector"], "entity").select("entity", "qtr", F.round("loo_median", 4).alias("loo_median"))


LOO_MEDIAN_SQL = f"with {Q} select x.entity, x.qtr, case when count(y.entity)>=4 then round(median(y.total),4) end loo_median from c x left join c y on x.qtr=y.qtr and x.sector=y.sector and x.entity<>y.entity group by x.entity, x.qtr, x.sector"


def persistence(spark, d):
    from pyspark.sql import Window

    return quarterly(spark, d).select("entity", "qtr", F.lag("total").over(Window.partitionBy("entity").orderBy("qtr")).alias("previous"))


def peer_stats(spark, d):
    return quarterly(spark, d).groupBy("qtr").agg(F.count("total").alias("n"), F.min("total").alias("low"), *[F.round(F.percentile("total", F.lit(p)), 4).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))], F.max("total").alias("high"))


PEER_SQL = f"with {Q} select qtr, count(total)::bigint n, min(total) low, round(quantile_cont(total,0.25),4) p25, round(quantile_cont(total,0.5),4) p50, round(quantile_cont(total,0.75),4) p75, max(total) high from c group by qtr"


def overall_and_sector(spark, d):
    q = quarterly(spark, d)
    return q.groupingSets([["sector"], []], "sector").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 5, F.round(F.percentile("total", F.lit(0.5)), 4)).alias("median")).select(F.coalesce("sector", F.lit("(all)")).alias("sector"), "n", "median")


OVERALL_SQL = f"with {Q} select coalesce(sector,'(all)') sector, count(*)::bigint n, case when count(*)>=5 then round(quantile_cont(total,0.5),4) end median from c group by grouping sets ((sector),())"


def rerating(spark, d):
    q = quarterly(spark, d).withColumn("y", F.log("total"))
    means = q.groupBy("qtr").agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n"), F.var_pop("y").alias("v"))
    total = means.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) / F.sum("n")).alias("s"))
    between = F.col("s") - F.col("g") * F.col("g")
    return total.select("n", F.round("within", 6).alias("within"), F.round(between, 6).alias("between"), F.round(between / (between + F.col("within")), 6).alias("calendar_r2"))


RERATING_SQL = f"with {Q}, m as (select qtr, avg(ln(total)) m, count(*) n, var_pop(ln(total)) v from c group by qtr), z as (select sum(n)::bigint n, sum(n*v)/sum(n) w, sum(n*m*m)/sum(n)-power(sum(n*m)/sum(n),2) b from m) select n, round(w,6) \"within\", round(b,6) \"between\", round(b/(b+w),6) calendar_r2 from z"


def quarter_deciles(q):
    b = F.expr("cast((row_number() over (partition by qtr order by total, entity) * 10 - 1) div count(*) over (partition by qtr) as int)")
    return q.withColumn("bucket", b).groupBy("qtr", "bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total"), 4).alias("mean"))


def deciles(spark, d):
    return quarter_deciles(quarterly(spark, d))


DECILES_SQL = f"with {Q}, b as (select *, (row_number() over (partition by qtr order by total, entity)*10-1)//count(*) over (partition by qtr) bucket from c) select qtr, bucket::int bucket, count(*)::bigint n, round(avg(total),4) mean from b group by all"

def returns_12m(spark, d):
    return series.price_return(prices(spark, d), 12).select("symbol", "date", F.round("ret", 6).alias("ret"))


RETURN_SQL = f"with {P}, q as (select symbol, date, close, (date-365)::date due from p) select q.symbol, q.date, case when p.close>0 and q.due-p.date<=15 then round(q.close/p.close-1,6) end ret from q asof left join p on q.symbol=p.symbol and q.due>=p.date"


def position(spark, d):
    r = series.trailing(prices(spark, d), 365, low=F.min("close"), high=F.max("close"))
    return r.select("symbol", "date", F.round(series.range_position(F.col("low"), F.col("high"), F.col("close")), 6).alias("position"))


POSITION_SQL = f"select symbol, date, case when high>low then round((close-low)/(high-low),6) end position from ({RANGE_SQL})"

QUERIES = {
    "price_return_12m": (returns_12m, RETURN_SQL),
    "range_position": (position, POSITION_SQL),
    "fact_versions": (fact_choice(), fact_sql()),
    "fact_asof_choice": (fact_choice(AS_OF), fact_sql(f"where l_shipdate::date <= date '{AS_OF}'")),
    "ladder_first_usable": (ladder, LADDER_SQL),
    "composite_all_or_nothing": (composite, COMPOSITE_SQL),
    "weekly_returns": (weekly, WEEKLY_SQL),
    "range_52w": (range_52w, RANGE_SQL),
    "realised_vol": (realised_vol, VOL_SQL),
    "asof_close": (asof_close(), f"with {P},{D},{S},{A} select symbol, as_of, entry as close, entry_date close_date from a"),
    "asof_close_capped": (asof_close(15), f"with {P},{D},{S},{A} select symbol, as_of, case when as_of-entry_date<=15 then entry end as close, case when as_of-entry_date<=15 then entry_date end close_date from a"),
    "forward_close": (forward_close, f"with {P},{D},{S} select s.symbol, s.as_of, p.close, p.date close_date from s asof left join p on s.symbol=p.symbol and s.as_of<=p.date"),
    "forward_returns": (forward_returns, f"{PANEL} select symbol, as_of, entry, entry_date, exit, exit_date, round(ret,6) ret, reason from t"),
    "ic_by_date": (ic_by_date, f"{IC} select as_of, n, round(ic,6) ic from ic"),
    "newey_west": (newey, NEWEY_SQL),
    "bucket_table": (bucket_table, BUCKET_SQL),
    "hit_rate": (hit_rate, HIT_SQL),
    "winsorised_panel": (winsor, WINSOR_SQL),
    "standardised_panel": (standard, STANDARD_SQL),
    "loo_mean": (loo_mean, LOO_SQL),
    "loo_median": (loo_median, LOO_MEDIAN_SQL),
    "persistence_lag": (persistence, f"with {Q} select entity, qtr, lag(total) over (partition by entity order by qtr) previous from c"),
    "peer_stats": (peer_stats, PEER_SQL),
    "overall_and_sector": (overall_and_sector, OVERALL_SQL),
    "rerating_variance": (rerating, RERATING_SQL),
    "reversion_deciles": (deciles, DECILES_SQL),
}
