"""Queries over outcomes, labels, dated lookups and deal dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import labels as lb
from tidemark.plans.panel import D, P, Q, S, dates, grid
from tidemark.sources.tables import load, prices, quarterly

CUT = "1998-06-30"


def cut_prices(spark, d):
    """Prices in which every ninth symbol's series stops early."""
    return prices(spark, d).where(~((F.col("symbol") % 9 == 0) & (F.col("date") > F.lit(CUT).cast("date"))))


def deals(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"))
    s = s.where("symbol % 3 = 0")
    return s.select("symbol", F.date_add(F.lit("1997-01-15").cast("date"), (F.col("symbol") * 11 % 900).cast("int")).alias("announced"), F.when(F.col("symbol") % 2 == 0, F.lit(1500.0)).alias("offer"))


def outcomes(spark, d):
    p = cut_prices(spark, d)
    scores = grid(spark, d).withColumn("score", (F.col("symbol") % 7).cast("double"))
    out = lb.outcomes(scores, p, deals(spark, d), p.where("symbol = 1").select("date", "close"), 365, -0.55)
    return out.select("symbol", "as_of", "score", "exit_kind", F.round("ret", 6).alias("ret"))


DEALS = "dl as (select s_suppkey symbol, (date '1997-01-15' + (s_suppkey*11%900)::int)::date announced, case when s_suppkey%2=0 then 1500.0::double end offer from supplier where s_suppkey%3=0)"
PC = f"pc as (select * from p where not (symbol%9=0 and date > date '{CUT}'))"
OUT_SQL = f"""with {P}, {PC}, {D}, {S}, {DEALS}, bm as (select date, close from pc where symbol=1),
e as (select s.symbol, s.as_of, p.close entry, (s.as_of+365)::date he from s asof left join pc p on s.symbol=p.symbol and s.as_of>=p.date),
x as (select e.*, p.close as exit from e asof left join pc p on e.symbol=p.symbol and e.he<=p.date),
l as (select symbol, max(date) ld, arg_max(close, date) lc from pc group by symbol),
y as (select x.*, l.ld, l.lc, (select max(date) from pc) pl, (select min(struct_pack(a:=announced, o:=offer)) from dl where dl.symbol=x.symbol and announced>x.as_of and announced<=x.he) dd from x left join l using (symbol)),
z as (select *, case when dd.o>0 then dd.a else ld end od, case when dd.o>0 then dd.o else lc end op from y),
b0 as (select z.*, bm.close c0 from z asof left join bm on z.od<=bm.date), b1 as (select b0.*, bm.close c1 from b0 asof left join bm on b0.he<=bm.date),
k as (select *, case when ld is null or not coalesce(entry>0,false) then 'no price' when exit is not null then 'held' when dd.a is not null then 'acquired' when pl-ld<=30 then 'censored' else 'delisted' end exit_kind from b1)
select symbol, as_of, (symbol%7)::double score, exit_kind, round(case exit_kind when 'held' then exit/entry-1 when 'acquired' then op/entry*(1+case when od<he and c0>0 and c1 is not null then c1/c0-1 else 0.0 end)-1 when 'delisted' then -0.55 end,6) ret from k"""


def customer_members(spark, d):
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("z"))
    return o.select("entity", F.when(F.col("entity") % 5 != 0, F.col("a")).alias("admitted"), F.when(F.col("entity") % 4 == 0, F.col("z")).alias("departed"), F.col("z").alias("last_filing"))


MEMBERS = "mb as (select entity, case when entity%5<>0 then a end admitted, case when entity%4=0 then z end departed, z last_filing from (select o_custkey entity, min(o_orderdate)::date a, max(o_orderdate)::date z from orders group by 1))"
LISTED = "(admitted is null or admitted<=as_of) and (departed is null or as_of<departed) and (last_filing is null or as_of-last_filing<=460)"
HALF = "hd as (select unnest(generate_series(date '1995-06-30', date '2003-06-30', interval 6 month))::date as_of)"


def half_years(spark):
    return spark.sql("select explode(sequence(date '1995-06-30', date '2003-06-30', interval 6 months)) as_of")


def listed(spark, d):
    return lb.members_on(half_years(spark), customer_members(spark, d)).select("entity", "as_of")


def coverage(spark, d):
    m = lb.members_on(half_years(spark), customer_members(spark, d))
    return m.groupBy("as_of").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("departed").isNull().cast("long")).alias("survived"), F.sum(F.col("departed").isNotNull().cast("long")).alias("departed"))


def events(spark, d):
    o = load(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.groupBy(F.col("o_custkey").alias("entity")).agg(F.to_date(F.min("o_orderdate")).alias("announced"))


def event_labels(spark, d):
    return lb.event_labels(customer_members(spark, d), half_years(spark), events(spark, d), "entity", "2001-06-30").groupBy("as_of", "label").agg(F.count(F.lit(1)).alias("n"))


EVENTS = "ev as (select o_custkey entity, min(o_orderdate)::date as \"event\" from orders where o_orderstatus='F' group by 1)"
LABELS_SQL = f"""with {MEMBERS}, {HALF}, {EVENTS}, m as (select entity, as_of, "event" e, (as_of+90)::date gp, (as_of+90+interval 12 month)::date en from hd join mb on {LISTED} left join ev using (entity))
select as_of, case when e<=as_of then 'after' when e<=gp then 'in gap' when en>date '2001-06-30' then 'unresolved' when e<=en then 'positive' else 'negative' end as label, count(*)::bigint n from m group by 1, 2"""


def names(spark, d):
    """Names that customers went by in turn, each with the days it held; the last one is open."""
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("y")).agg(F.to_date(F.min("o_orderdate")).alias("since"))
    from pyspark.sql import Window

    until = F.date_sub(F.lead("since").over(Window.partitionBy("entity").orderBy("since")), 1)
    return o.select("entity", F.concat(F.lit("name "), F.col("y").cast("string")).alias("name"), "since", until.alias("through"))


def former(spark, d):
    left = customer_members(spark, d).select("entity").withColumn("as_of", F.explode(F.array(*[F.lit(x).cast("date") for x in ("1995-01-10", "1997-07-01", "1999-12-31")])))
    return lb.dated_lookup(left, names(spark, d), "entity", "as_of", "since", "through", "name", "name")


FORMER_SQL = "with o as (select o_custkey entity, year(o_orderdate) y, min(o_orderdate)::date since from orders group by all), n as (select entity, 'name '||y as name, since, (lead(since) over (partition by entity order by since)-1)::date through from o), l as (select distinct o_custkey entity, unnest([date '1995-01-10', date '1997-07-01', date '1999-12-31']) as_of from orders) select l.entity, l.as_of, arg_max(n.name, n.since) as name from l left join n on l.entity=n.entity and since<=as_of and (through is null or as_of<=through) group by all"


def horizon_labels(spark, d):
    y = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    panel = y.select("entity", F.make_date("y", F.lit(12), F.lit(31)).alias("year_end"), "total")
    return lb.next_labels(panel, "entity", "year_end", "total", 3)


HORIZON_SQL = "with y as (select o_custkey entity, make_date(year(o_orderdate),12,31) year_end, round(sum(o_totalprice),2) total from orders group by all), h as (select y.*, unnest([1,2,3]) h from y), w as (select *, (year_end+round(h*365.25)::int)::date due from h) select w.entity, w.year_end, w.h::int h, arg_min(y.total, struct_pack(n:=abs(y.year_end-due), d:=y.year_end)) as label, arg_min(y.year_end, struct_pack(n:=abs(y.year_end-due), d:=y.year_end)) label_date from w left join y on y.entity=w.entity and abs(y.year_end-due)<=45 group by w.entity, w.year_end, w.h"


def unaffected(spark, d):
    out = lb.unaffected_price(deals(spark, d).select("symbol", "announced"), prices(spark, d), "symbol")
    return out.select("symbol", "announced", "unaffected", F.round("mean_before", 4).alias("mean_before"))


UNAFFECTED_SQL = f"with {P}, {DEALS} select dl.symbol, announced, arg_max(close, date) unaffected, round(avg(close) filter (where date>=announced-30),4) mean_before from dl left join p on p.symbol=dl.symbol and date<announced and date>=announced-365 group by all"


def filings(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("filed"), "l_returnflag").distinct()


def announced(spark, d):
    floors = deals(spark, d).select("symbol", F.col("announced").alias("floor"))
    return lb.announcement_date(floors, filings(spark, d).where("l_returnflag = 'R'"), "symbol")


def completed(spark, d):
    rare = filings(spark, d).where("l_returnflag = 'A' and day(filed) = 15 and month(filed) = 11")
    return lb.completion(deals(spark, d).select("symbol", "announced"), rare, "symbol", "1999-01-31")


COMPLETED_SQL = f"with {DEALS}, fl as (select distinct l_suppkey symbol, l_shipdate::date filed from lineitem where l_returnflag='A' and day(l_shipdate)=15 and month(l_shipdate)=11), m as (select dl.symbol, announced, min(filed) completed from dl left join fl on fl.symbol=dl.symbol and filed>=announced and filed<=date '1999-01-31' group by all) select *, case when completed is not null then 'completed' when date '1999-01-31'-announced<=540 then 'pending' else 'unresolved' end status from m"


def grids(spark, d):
    q = lb.quarter_ends(spark, "1996-02-10", "1999-11-30").withColumn("kind", F.lit("quarter ends"))
    r = [lb.rebalance_dates(spark, first, "1999-02-28", m).withColumn("kind", F.lit(f"every {m} from {first}")) for first, m in (("1997-01-31", 1), ("1997-08-30", 3), ("1996-02-29", 6))]
    return q.unionByName(r[0]).unionByName(r[1]).unionByName(r[2])


def _rebalance_sql(first, m):
    return f"select make_date(year(x), month(x), case when day(date '{first}')>day(last_day(x)) then 28 else day(date '{first}') end) as_of, 'every {m} from {first}' kind from (select unnest(generate_series(date_trunc('month', date '{first}'), date '1999-02-28', interval {m} month))::date x) where make_date(year(x), month(x), case when day(date '{first}')>day(last_day(x)) then 28 else day(date '{first}') end) <= date '1999-02-28'"


GRIDS_SQL = "select last_day((x + interval 2 month)::date) as_of, 'quarter ends' kind from (select unnest(generate_series(date '1996-01-01', date '1999-11-30', interval 3 month))::date x) where last_day((x + interval 2 month)::date) between date '1996-02-10' and date '1999-11-30' union all " + " union all ".join(_rebalance_sql(*x) for x in (("1997-01-31", 1), ("1997-08-30", 3), ("1996-02-29", 6)))


def percentiles(spark, d):
    out = lb.peer_percentile(quarterly(spark, d), "total", ["qtr", "sector"])
    return out.select("entity", "qtr", F.round("percentile", 6).alias("percentile"))


def relative(spark, d):
    out = lb.relative_to_peers(quarterly(spark, d).where("entity % 11 < 3"), "total", "qtr", "sector")
    return out.select("entity", "qtr", F.round("relative", 3).alias("relative"))


RELATIVE_SQL = f"with {Q}, w as (select * from c where entity%11<3), z as (select *, median(total) over (partition by qtr) md, median(total) over (partition by qtr, sector) mn, count(*) over (partition by qtr, sector) n from w) select entity, qtr, round(total-case when n>=5 then mn else md end,3) relative from z"


def survivors(spark, d):
    named = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"))
    known = load(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("symbol"))
    return lb.survivorship(named, known, deals(spark, d), "symbol").select("symbol", "times", "in_universe", "event")


SURVIVORS_SQL = f"with {DEALS}, n as (select l_suppkey symbol, count(*)::bigint times from lineitem group by 1) select n.symbol, times, (s_suppkey is not null) in_universe, announced as \"event\" from n left join supplier on s_suppkey=n.symbol and s_acctbal>0 left join dl on dl.symbol=n.symbol"


def matched(spark, d):
    labels = lb.event_labels(customer_members(spark, d), half_years(spark), events(spark, d), "entity", "2001-06-30").withColumnRenamed("as_of", "qtr")
    features = quarterly(spark, d).select("entity", "qtr", "total")
    out = lb.matched(labels.where("label in ('positive', 'negative')"), features, ["entity", "qtr"])
    return out.groupBy("qtr", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("matched").cast("long")).alias("with_features"), F.round(F.avg("total"), 6).alias("mean_total"))


MATCHED_SQL = f"with {MEMBERS}, {HALF}, {EVENTS}, {Q}, m as (select entity, as_of, \"event\" e, (as_of+90)::date gp, (as_of+90+interval 12 month)::date en from hd join mb on {LISTED} left join ev using (entity)), lb as (select entity, as_of qtr, case when e<=as_of then 'after' when e<=gp then 'in gap' when en>date '2001-06-30' then 'unresolved' when e<=en then 'positive' else 'negative' end as label from m) select qtr, label, count(*)::bigint n, count(total)::bigint with_features, round(avg(total),6) mean_total from lb left join c using (entity, qtr) where label in ('positive','negative') group by all"


def attached(spark, d):
    """The last quarter's total that was known on each label date."""
    left = customer_members(spark, d).select("entity").crossJoin(F.broadcast(half_years(spark)))
    return lb.latest_before(left, quarterly(spark, d), "entity", "as_of", "qtr", "total", "total")


QUERIES = {
    "outcome_kinds": (outcomes, OUT_SQL),
    "members_on_date": (listed, f"with {MEMBERS}, {HALF} select entity, as_of from hd join mb on {LISTED}"),
    "universe_coverage": (coverage, f"with {MEMBERS}, {HALF} select as_of, count(*)::bigint members, sum((departed is null)::int)::bigint survived, sum((departed is not null)::int)::bigint departed from hd join mb on {LISTED} group by as_of"),
    "event_labels": (event_labels, LABELS_SQL),
    "former_names": (former, FORMER_SQL),
    "horizon_labels": (horizon_labels, HORIZON_SQL),
    "unaffected_price": (unaffected, UNAFFECTED_SQL),
    "announcement_date": (announced, f"with {DEALS}, fl as (select distinct l_suppkey symbol, l_shipdate::date filed from lineitem where l_returnflag='R') select dl.symbol, dl.announced floor, greatest(min(filed), any_value(dl.announced)) announced from dl left join fl on fl.symbol=dl.symbol and filed between dl.announced and dl.announced+30 group by dl.symbol, dl.announced"),
    "completion_status": (completed, COMPLETED_SQL),
    "date_grids": (grids, GRIDS_SQL),
    "peer_percentile": (percentiles, f"with {Q} select entity, qtr, case when count(*) over (partition by qtr, sector)>=3 then round((rank() over (partition by qtr, sector order by total)-1+0.5*count(*) over (partition by qtr, sector, total))/count(*) over (partition by qtr, sector),6) end percentile from c"),
    "relative_to_peers": (relative, RELATIVE_SQL),
    "survivor_anti": (survivors, SURVIVORS_SQL),
    "matched_labels": (matched, MATCHED_SQL),
    "latest_before": (attached, f"with {Q}, {HALF}, l as (select distinct o_custkey entity, as_of from orders, hd) select l.entity, l.as_of, c.total, c.qtr total_date from l asof left join c on l.entity=c.entity and l.as_of>=c.qtr"),
}
