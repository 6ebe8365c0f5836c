"""Queries over year-to-date facts: subtraction, tiles, trailing years, series and anniversaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import periods as p
from tidemark.sources.tables import load

KEY = ["entity"]
DATES = ("1997-12-31", "1998-06-30", "1998-10-02", "1999-03-31", "2003-12-31")


def ytd(spark, d):
    """What each customer ordered from January on, as filed after three, six, nine and twelve months of every year with orders."""
    orders = load(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice").repartition("o_custkey")
    o = orders.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.sum("o_totalprice").alias("v"))
    each = o.groupBy("entity", "y").agg(*[F.round(F.coalesce(F.sum(F.when(F.col("q") <= k, F.col("v"))), F.lit(0.0)), 2).alias(f"v{k}") for k in range(1, 5)])
    rows = each.select("entity", "y", F.posexplode(F.array("v1", "v2", "v3", "v4")).alias("k", "val"))
    end = F.last_day(F.make_date("y", 3 * F.col("k") + 3, F.lit(1)))
    out = rows.select("entity", F.make_date("y", F.lit(1), F.lit(1)).alias("start"), end.alias("end"), "val", (F.col("y") * 4 + F.col("k")).alias("ord"))
    return out.withColumns({"filed": F.date_add("end", 45), "form": F.when(F.month("end") == 12, "10-K").otherwise("10-Q")})


def tagged(spark, d):
    """Year-to-date facts under tag y; a twentieth of them under a part's tag that ranks ahead, for every third customer, and whole years only under tag z."""
    f = ytd(spark, d)
    tag = lambda name, when, val: F.when(when, F.struct(F.lit(name).alias("tag"), val.alias("val")))
    e, val = F.col("entity"), F.col("val")
    tags = F.array(tag("part", e % 3 == 0, val / 20), tag("y", e % 7 != 0, val), tag("z", (e % 2 == 0) & (F.month("end") == 12), val))
    return f.withColumn("_t", F.explode(F.filter(tags, lambda t: t.isNotNull()))).select("entity", "start", "end", F.col("_t.val").alias("val"), "ord", "filed", "form", F.col("_t.tag").alias("tag"))


def as_of(spark, d):
    dates = F.array(*[F.lit(x).cast("date") for x in DATES])
    return load(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.explode(dates).alias("as_of"))


YTD = "o as (select o_custkey entity, year(o_orderdate) y, quarter(o_orderdate) q, sum(o_totalprice) v from orders group by all), f as (select entity, make_date(y,1,1) s, last_day(make_date(y,3*k::int,1)) e, round(coalesce(sum(v) filter (where q<=k),0.0),2) val, last_day(make_date(y,3*k::int,1))+45 filed, y*4+k ord, case when k=4 then '10-K' else '10-Q' end form from o, range(1,5) r(k) group by entity, y, k)"
AS_OF = "a as (select c_custkey entity, unnest([" + ",".join(f"date '{x}'" for x in DATES) + "]) as_of from customer)"


def closure(facts: str, by: str = "entity", passes: int = 3) -> str:
    """CTEs k0 to k3: the known periods after every pass."""
    keys = by.split(", ")
    same = " and ".join(f"b.{k}=s.{k}" for k in keys)
    out = [f"k0 as (select {by}, s, e, val, filed, row_number() over (partition by {by} order by ord) n, null::varchar derived from {facts})"]
    for i in range(passes):
        told = "strftime(b.s,'%Y-%m-%d')||'..'||strftime(b.e,'%Y-%m-%d')||' less '||strftime(s.s,'%Y-%m-%d')||'..'||strftime(s.e,'%Y-%m-%d')"
        pair = lambda s, e, on: f"select {', '.join('b.' + k for k in keys)}, {s} s, {e} e, b.val-s.val val, greatest(b.filed,s.filed) filed, b.n bn, s.n sn, {told} derived from k{i} b join k{i} s on {same} and {on}"  # noqa: B023, E731
        out.append(f"c{i} as materialized ({pair('(s.e+1)::date', 'b.e', 'b.s=s.s and s.e<b.e')} union all {pair('b.s', '(s.s-1)::date', 'b.e=s.e and s.s>b.s')})")
        out.append(f"x{i} as (select * from (select *, row_number() over (partition by {by}, s, e order by bn, sn) rn from c{i}) where rn=1 and ({by}, s, e) not in (select ({by}, s, e) from k{i}))".replace(f"({by}, s, e) not in (select ({by}, s, e) from k{i})", f"not exists (select 1 from k{i} h where {' and '.join(f'h.{k}=_.{k}' for k in keys)} and h.s=_.s and h.e=_.e)").replace(f"from c{i})", f"from c{i}) _"))
        out.append(f"k{i + 1} as materialized (select * from k{i} union all select {by}, s, e, val, filed, (select max(n) from k{i} m where {' and '.join(f'm.{k}=x.{k}' for k in keys)})+row_number() over (partition by {by} order by bn, sn), derived from x{i} x)")
    return ", ".join(out)


def tiling(by: str = "entity", value: str = "val") -> str:
    """CTEs r and t: the tiles' ranks and, for every window of w, the first cover."""
    keys = by.split(", ")
    same = " and ".join(f"r.{k}=g.{k}" for k in keys)
    return f"""r as (select *, row_number() over (partition by {by} order by s, e-s desc, n) rk from k3),
g as (select {by}, wf, wt, wf cursor, []::bigint[] path, 0.0::double sm, 0 len, false der, null::date fd, 0 depth from w
 union all select {', '.join('g.' + k for k in keys)}, wf, wt, (r.e+1)::date, list_append(path, r.rk), sm+r.{value}, len+(r.e-r.s)::int+1, der or derived is not null, greatest(coalesce(fd, filed), filed), depth+1
 from g join r on {same} and abs(r.s-cursor)<=case when depth=0 then 8 else 1 end and r.e<=wt+8 where abs(cursor-wt)>1 and cursor<=wt and depth<9),
t as (select {by}, wf, wt, arg_min(struct_pack(tiles:=len(path), val:=sm, days:=len, der:=der, fd:=fd), path) b from g where abs(cursor-wt)<=1 group by all)"""


def derived(spark, d):
    return p.derived_periods(ytd(spark, d), KEY).select("entity", "start", "end", F.round("val", 2).alias("val"), "filed", "derived")


def covered(spark, d):
    w = as_of(spark, d).select("entity", F.date_sub("as_of", 364).alias("from"), F.col("as_of").alias("to"))
    out = p.cover_derived(ytd(spark, d), w, KEY)
    return out.select("entity", F.col("from").alias("window_from"), F.col("to").alias("window_to"), "tiles", F.round("value", 2).alias("value"), "days", "derived")


COVER_SQL = f"with recursive {YTD}, {closure('f')}, {AS_OF}, w as (select entity, (as_of-364)::date wf, as_of wt from a), {tiling()} select w.entity, w.wf window_from, w.wt window_to, b.tiles::int tiles, round(b.val,2) as value, b.days::int as \"days\", b.der derived from w left join t on w.entity=t.entity and w.wf=t.wf and w.wt=t.wt"


def ttm(kind):
    def run(spark, d):
        out = p.trailing_twelve_months(ytd(spark, d), as_of(spark, d), KEY, kind=kind)
        return out.select("entity", "as_of", F.round("value", 2).alias("value"), "method")

    return run


def ttm_sql(average: bool) -> str:
    f = "fi as (select * replace (val*((e-s)+1) as val) from f)" if average else "fi as (select * from f)"
    per = (lambda v, n: f"{v}/({n})") if average else (lambda v, n: v)
    return f"""with recursive {YTD}, {f}, {closure('fi')}, {AS_OF},
y as (select a.entity, as_of, min_by({per('val', 'e-s+1')}, s) v from a join k0 k on a.entity=k.entity and k.e=as_of and e-s+1 between 350 and 380 group by all),
w as (select entity, (as_of-364)::date wf, as_of wt from a where not exists (select 1 from y where y.entity=a.entity and y.as_of=a.as_of)), {tiling()}
select entity, as_of, round(v,2) as value, 'single filed annual period' as "method" from y
union all select w.entity, w.wt, round({per('b.val', 'b.days')},2), b.tiles||' periods tiled'||case when b.der then ', some by subtraction' else '' end from w left join t on w.entity=t.entity and w.wt=t.wt"""


TAGGED = f"{YTD}, ft as (select entity, 'part' tag, s, e, val/20 val, filed, ord from f where entity%3=0 union all select entity, 'y', s, e, val, filed, ord from f where entity%7<>0 union all select entity, 'z', s, e, val, filed, ord from f where entity%2=0 and month(e)=12)"


def resolved(spark, d):
    out = p.resolve_ttm(tagged(spark, d), as_of(spark, d), "entity", "tag", ["part", "y", "z"], guard=10.0, annual_fallback=True, default=0.0)
    return out.select("entity", "as_of", "tag", F.round("value", 4).alias("value"), "method")


RESOLVED_SQL = f"""with recursive {TAGGED}, {closure('ft', 'entity, tag')}, {AS_OF}, lad as (select entity, as_of, unnest(['part','y','z']) tag, unnest([0,1,2]) rk from a),
y1 as (select lad.entity, as_of, lad.tag, min_by(val, s) v from lad join k0 k on lad.entity=k.entity and lad.tag=k.tag and k.e=as_of and e-s+1 between 350 and 380 group by all),
w as (select entity, tag, (as_of-364)::date wf, as_of wt from lad where not exists (select 1 from y1 where y1.entity=lad.entity and y1.as_of=lad.as_of and y1.tag=lad.tag)), {tiling('entity, tag')},
got as (select entity, as_of, tag, v, 'single filed annual period' m from y1 union all select entity, wt, tag, b.val, b.tiles||' periods tiled'||case when b.der then ', some by subtraction' else '' end from t),
gr as (select got.*, rk from got join lad using (entity, as_of, tag)),
fst as (select entity, as_of, arg_min(struct_pack(rk:=rk, tag:=tag, v:=v, m:=m), rk) w from gr group by all),
sw as (select gr.entity, gr.as_of, arg_max(struct_pack(rk:=gr.rk, tag:=gr.tag, v:=gr.v, m:=gr.m), struct_pack(v:=gr.v, r:=-gr.rk)) w from gr join fst on gr.entity=fst.entity and gr.as_of=fst.as_of and gr.rk>fst.w.rk and fst.w.v>0 and gr.v>10*fst.w.v group by all),
la as (select lad.entity, as_of, lad.tag, lad.rk, arg_max(val, e) v from lad join ft on lad.entity=ft.entity and lad.tag=ft.tag and e<=as_of and e-s+1 between 350 and 380 group by all),
ly as (select entity, as_of, arg_min(struct_pack(tag:=tag, v:=v), rk) w from la group by all)
select a.entity, a.as_of, coalesce(sw.w.tag, fst.w.tag, ly.w.tag) tag, round(coalesce(sw.w.v, fst.w.v, ly.w.v, 0.0),4) as value, coalesce(sw.w.m, fst.w.m, case when ly.w is not null then 'latest filed fiscal year' end, 'absent, defaulted') as "method"
from a left join fst using (entity, as_of) left join sw using (entity, as_of) left join ly using (entity, as_of)"""


def latest_year(spark, d):
    out = p.latest_annual(ytd(spark, d), as_of(spark, d), KEY)
    return out.select("entity", "as_of", F.col("end").alias("year_end"), "value")


LATEST_SQL = f"with {YTD}, {AS_OF} select a.entity, as_of, max(e) year_end, arg_max(val, e) as value from a left join f on a.entity=f.entity and e<=as_of and e-s+1 between 350 and 380 group by all"


def running(spark, d):
    return p.latest_running_tag(tagged(spark, d), "entity", "tag", ["part", "y", "z"])


RUNNING_SQL = f"with {TAGGED}, g as (select entity, tag, max(e) e, count(*)::bigint n from ft group by all) select entity, b.tag tag, b.e last_end, b.n n from (select entity, arg_max(struct_pack(tag:=tag, e:=e, n:=n), struct_pack(e:=e, r:=-case tag when 'part' then 0 when 'y' then 1 else 2 end)) b from g group by all)"


def quarters(spark, d):
    return p.quarterly_series(p.derived_periods(ytd(spark, d), KEY), KEY).select("entity", "end", F.round("value", 2).alias("value"))


QUARTERS_SQL = f"with {YTD}, {closure('f')}, q as (select *, row_number() over (partition by entity, e order by derived is not null, abs(e-s+1-91), n) rn from k3 where e-s+1 between 80 and 100) select entity, e as \"end\", round(val,2) as value from q where rn=1"


def years(spark, d):
    return p.annual_series(tagged(spark, d), "entity", "tag", ["part", "y", "z"])


YEARS_SQL = f"with {TAGGED}, g as (select *, row_number() over (partition by entity, e order by case tag when 'part' then 0 when 'y' then 1 else 2 end, ord) rn from ft where e-s+1 between 350 and 380) select entity, e as \"end\", tag, val as value, filed from g where rn=1"


def customer_days(spark, d):
    """The total of every customer's days with orders."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return o.groupBy("entity", "day").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


DAYS = "n as (select o_custkey entity, o_orderdate::date as day, round(sum(o_totalprice),2) total from orders group by all)"


def near_sql(offset: int, tolerance: int) -> str:
    return f"with {DAYS}, m as (select x.entity, x.day, arg_min(struct_pack(d:=y.day, v:=y.total), struct_pack(n:=abs(y.day-(x.day-({offset}))), d:=y.day)) m from n x join n y on x.entity=y.entity and abs(y.day-(x.day-({offset})))<={tolerance} group by all) select n.entity, n.day as \"end\", m.m.d match_date, m.m.v as match from n left join m using (entity, day)"


def anniversary(years_back, tolerance):
    def run(spark, d):
        days = customer_days(spark, d)
        left = days.select("entity", F.col("day").alias("end"))
        return p.anniversary(left, days, "entity", "end", years_back, tolerance, "day", "total")

    return run


def prior(spark, d):
    days = customer_days(spark, d)
    return p.prior_year_end(days.select("entity", F.col("day").alias("end")), days, "entity", "end", "day")


PRIOR_SQL = f"select entity, \"end\", coalesce(match_date, (\"end\"-365)::date) prior_end from ({near_sql(365, 10)})"


def yoy(spark, d):
    q = p.quarterly_series(p.derived_periods(ytd(spark, d), KEY), KEY)
    out = p.year_on_year(q, "entity")
    return out.select("entity", "end", F.round("value", 2).alias("value"), F.round("before", 2).alias("before"), "before_date", F.when(F.col("before") > 0, F.round(F.col("value") / F.col("before") - 1, 5)).alias("growth"))


YOY_SQL = f"with z as ({QUARTERS_SQL}), m as (select x.entity, x.\"end\" e, any_value(x.value) v, arg_min(struct_pack(d:=y.\"end\", v:=y.value), struct_pack(n:=abs(y.\"end\"-(x.\"end\"-365)), d:=y.\"end\")) b from z x join z y on x.entity=y.entity and abs(y.\"end\"-(x.\"end\"-365))<=25 group by all) select entity, e as \"end\", v as value, b.v as before, b.d before_date, case when b.v>0 then round(v/b.v-1,5) end growth from m"

QUERIES = {
    "derived_periods": (derived, f"with {YTD}, {closure('f')} select entity, s as \"start\", e as \"end\", round(val,2) val, filed::date filed, derived from k3"),
    "cover_window": (covered, COVER_SQL),
    "ttm_flow": (ttm("flow"), ttm_sql(False)),
    "ttm_average": (ttm("average"), ttm_sql(True)),
    "resolve_ttm": (resolved, RESOLVED_SQL),
    "latest_annual": (latest_year, LATEST_SQL),
    "latest_running_tag": (running, RUNNING_SQL),
    "quarterly_series": (quarters, QUARTERS_SQL),
    "annual_series": (years, YEARS_SQL),
    "nearest_anniversary": (anniversary(1, 25), near_sql(365, 25)),
    "anniversary_ahead": (anniversary(-1, 45), near_sql(-365, 45)),
    "prior_year_end": (prior, PRIOR_SQL),
    "year_on_year": (yoy, YOY_SQL),
}
