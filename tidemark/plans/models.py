"""Queries over scores, labels, peers, valuation and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import valuation as v
from tidemark.operators import crosssection as cs
from tidemark.operators import series
from tidemark.operators.pairs import co_members, nearest_by_cosine
from tidemark.plans.panel import MID, WEEKLY_SQL
from tidemark.sources.tables import load, prices

SCORED = "s as (select d.doc_id, d.lang, l.quality, l.toxic, least(d.n_chars,5000)/5000.0 p from labels l join documents d using (doc_id))"


def scored(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return load(spark, d, "labels").join(docs, "doc_id").withColumn("p", F.least("n_chars", F.lit(5000)) / 5000.0)


def auc(spark, d):
    return cs.auc(scored(spark, d), "quality", "p", ["lang"]).select("lang", "n", "positives", F.round("auc", 6).alias("auc"))


AUC_SQL = f"with {SCORED}, k as (select lang, quality, {MID.format(by='lang', v='p')} r from s) select lang, count(*)::bigint n, sum(quality)::bigint positives, case when sum(quality)>0 and sum(quality)<count(*) then round((sum(case when quality=1 then r end)-sum(quality)*(sum(quality)+1)/2.0)/(sum(quality)*(count(*)-sum(quality))),6) end auc from k group by lang"


def calibration(spark, d):
    return cs.calibration(scored(spark, d), "quality", "p").select("bin", "n", F.round("mean_probability", 6).alias("mean_probability"), F.round("observed", 6).alias("observed"))


CALIBRATION_SQL = f"with {SCORED}, b as (select least(floor(p*10),9)::int bin, count(*) n, avg(p) mp, avg(quality::double) o from s group by 1) select r.i::int bin, coalesce(n,0)::bigint n, round(mp,6) mean_probability, round(o,6) observed from range(10) r(i) left join b on b.bin=r.i"


def ndcg(spark, d):
    df = scored(spark, d).withColumn("grade", (F.col("quality") * 2 + 1 - F.col("toxic")).cast("double"))
    return cs.ndcg(df, "lang", "p", "grade", "doc_id", 10).select("lang", F.round("ndcg", 6).alias("ndcg"))


NDCG_SQL = f"with {SCORED}, g as (select lang, (quality*2+1-toxic)::double grade, row_number() over (partition by lang order by p desc, doc_id) a, row_number() over (partition by lang order by quality*2+1-toxic desc, doc_id) b from s) select lang, round(sum(case when a<=10 then grade/log2(a+1) else 0 end)/sum(case when b<=10 then grade/log2(b+1) else 0 end),6) ndcg from g group by lang"


def precision_recall(spark, d):
    w = Window.partitionBy("lang").orderBy(F.col("p").desc(), "doc_id")
    df = scored(spark, d).withColumn("place", F.row_number().over(w))
    hit = F.sum(F.when(F.col("place") <= 20, F.col("quality")))
    return df.groupBy("lang").agg(F.round(hit / F.sum((F.col("place") <= 20).cast("int")), 6).alias("precision"), F.round(hit / F.when(F.sum("quality") > 0, F.sum("quality")), 6).alias("recall"))


PR_SQL = f"with {SCORED}, g as (select *, row_number() over (partition by lang order by p desc, doc_id) a from s) select lang, round(sum(case when a<=20 then quality end)/sum((a<=20)::int),6) \"precision\", round(sum(case when a<=20 then quality end)/case when sum(quality)>0 then sum(quality) end,6) recall from g group by lang"


def base_rate(spark, d):
    o = load(spark, d, "orders")
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("positives"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("rate"))


def named(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_partkey").alias("grp"), F.col("l_suppkey").alias("peer")).distinct()


def popularity(spark, d):
    n = named(spark, d).groupBy("peer").agg(F.countDistinct("grp").alias("groups"))
    place = F.row_number().over(Window.orderBy(F.col("groups").desc(), "peer"))
    return n.withColumn("place", place)


def most_named(spark, d):
    out = load(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("peer"))
    return named(spark, d).groupBy("peer").agg(F.count(F.lit(1)).alias("n")).where("n >= 500").join(out, "peer", "left_anti")


def co_pairs(spark, d, hot=1000):
    """Symmetric pairs of suppliers that ship any part together; a long list of a part's suppliers is cut into lots of ``hot``."""
    return co_members(load(spark, d, "lineitem"), "l_partkey", "l_suppkey", hot)


CO_SQL = "with g as (select distinct l_partkey grp, l_suppkey peer from lineitem) select distinct x.peer a, y.peer b from g x join g y on x.grp=y.grp and x.peer<>y.peer"


def census(spark, d):
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.to_date(F.min("o_orderdate")).alias("admitted"), F.to_date(F.max("o_orderdate")).alias("departed"))
    days = spark.sql("select explode(sequence(date '1995-06-30', date '2001-06-30', interval 6 months)) as_of")
    listed = F.broadcast(days).join(o, (F.col("admitted") <= F.col("as_of")) & (F.col("as_of") < F.col("departed")))
    return listed.groupBy("as_of").agg(F.count(F.lit(1)).alias("members"), F.sum((F.col("departed") < F.lit("2001-01-01").cast("date")).cast("long")).alias("left_later"))


CENSUS_SQL = "with o as (select o_custkey entity, min(o_orderdate)::date admitted, max(o_orderdate)::date departed from orders group by 1), d as (select unnest(generate_series(date '1995-06-30', date '2001-06-30', interval 6 month))::date as_of) select as_of, count(*)::bigint members, sum((departed<date '2001-01-01')::int)::bigint left_later from d join o on admitted<=as_of and as_of<departed group by 1"


def labels(spark, d):
    """Score dates a year apart against each customer's first filled order: in the gap, positive or negative."""
    o = load(spark, d, "orders")
    deals = o.groupBy(F.col("o_custkey").alias("entity")).agg(F.to_date(F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))).alias("event"))
    days = spark.sql("select explode(sequence(date '1996-01-31', date '2000-01-31', interval 12 months)) as_of")
    df = deals.withColumn("as_of", F.explode(F.array(*[F.lit(r[0]) for r in days.collect()])))
    gap, end = F.date_add("as_of", 90), F.add_months(F.date_add("as_of", 90), 12)
    label = F.when(F.col("event") <= F.col("as_of"), "after").when(F.col("event") <= gap, "in gap").when(end > F.lit("2000-12-31").cast("date"), "unresolved").when(F.col("event") <= end, "positive").otherwise("negative")
    return df.withColumn("label", label).groupBy("as_of", "label").agg(F.count(F.lit(1)).alias("n"))


LABEL_SQL = "with e as (select o_custkey entity, min(case when o_orderstatus='F' then o_orderdate end)::date event from orders group by 1), d as (select unnest(generate_series(date '1996-01-31', date '2000-01-31', interval 12 month))::date as_of) select as_of, case when event<=as_of then 'after' when event<=as_of+90 then 'in gap' when (as_of+90+interval 12 month)::date>date '2000-12-31' then 'unresolved' when event<=(as_of+90+interval 12 month)::date then 'positive' else 'negative' end label, count(*)::bigint n from e, d group by 1,2"


def beta(spark, d):
    w = series.weekly_returns(prices(spark, d))
    market = w.where("symbol = 1").select("from_date", "to_date", F.col("ret").alias("m"))
    pair = w.where("symbol <> 1").join(market, ["from_date", "to_date"])
    agg = pair.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("ret", "m").alias("b"), F.regr_sxx("ret", "m").alias("sxx"), F.regr_syy("ret", "m").alias("syy"), F.regr_r2("ret", "m").alias("r2"))
    ok = F.col("n") >= 30
    sse = F.greatest(F.col("syy") * (1 - F.col("r2")), F.lit(0.0))
    return agg.select("symbol", "n", F.when(ok, F.round("b", 5)).alias("beta"), F.when(ok, F.round(0.67 * F.col("b") + 0.33, 5)).alias("blume"), F.when(ok, F.round(F.sqrt(sse / (F.col("n") - 2) / F.col("sxx")), 5)).alias("se"))


BETA_SQL = "with w as (" + WEEKLY_SQL.replace("round(close/b-1,6) ret", "close/b-1 ret") + "), g as (select x.symbol, count(*) n, regr_slope(x.ret, y.ret) b, regr_sxx(x.ret,y.ret) sxx, regr_syy(x.ret,y.ret) syy, regr_r2(x.ret,y.ret) r2 from w x join w y on y.symbol=1 and x.from_date=y.from_date and x.to_date=y.to_date where x.symbol<>1 group by 1) select symbol, n::bigint n, case when n>=30 then round(b,5) end beta, case when n>=30 then round(0.67*b+0.33,5) end blume, case when n>=30 then round(sqrt(greatest(syy*(1-r2),0)/(n-2)/sxx),5) end se from g"


def company(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("bal"))
    return c.withColumns({"rev": F.abs("bal") + 100.0, "g1": (F.col("entity") % 20) / 100.0, "margin": 0.05 + (F.col("entity") % 7) / 50.0, "rate": 0.08 + (F.col("entity") % 5) / 100.0})


def dcf(spark, d):
    value = v.dcf_value(F.col("rev"), F.col("g1"), F.lit(0.03), F.col("margin"), F.lit(0.2), F.lit(0.25), F.col("rate"), F.lit(0.025), 10)
    return company(spark, d).select("entity", F.round(value, 4).alias("value"))


COMPANY = "c as (select c_custkey entity, abs(c_acctbal)+100.0 rev, (c_custkey%20)/100.0::double g1, 0.05+(c_custkey%7)/50.0::double margin, 0.08+(c_custkey%5)/100.0::double rate from customer)"
DCF_SQL = f"with recursive {COMPANY}, y as (select entity, 0 t, rev::double rev, 0.0::double pv, 0.0::double f, g1, margin, rate from c union all select entity, t+1, rev*(1+g1+(0.03-g1)*t/9.0::double), pv + ({{F}})/power(1+rate, t+0.5), ({{F}}), g1, margin, rate from y where t<10) select entity, round(pv + f*1.025/(rate-0.025)/power(1+rate,9.5),4) as value from y where t=10".replace("{F}", "(rev*(1+g1+(0.03-g1)*t/9.0::double))*(margin+(0.2-margin)*t/9.0::double)*0.75 - 0.01*rev*(1+g1+(0.03-g1)*t/9.0::double) - 0.02*(rev*(1+g1+(0.03-g1)*t/9.0::double)-rev)")


def grid_of(companies):
    axes = companies.withColumn("rate", F.explode(F.array(*[F.lit(x) for x in (0.08, 0.09, 0.1, 0.11, 0.12)]))).withColumn("g", F.explode(F.array(*[F.lit(x) for x in (0.01, 0.015, 0.02, 0.025, 0.03)])))
    return axes.select("entity", "rate", "g", F.round(F.col("rev") * F.col("margin") * (1 + F.col("g")) / F.when(F.col("g") < F.col("rate"), F.col("rate") - F.col("g")) + 1e-7, 4).alias("value"))


def grid(spark, d):
    return grid_of(company(spark, d))


GRID_SQL = f"with {COMPANY} select entity, r.rate::double rate, g.g::double g, round(rev*margin*(1+g.g::double)/(r.rate::double-g.g::double)+1e-7,4) as value from c, (values (0.08),(0.09),(0.1),(0.11),(0.12)) r(rate), (values (0.01),(0.015),(0.02),(0.025),(0.03)) g(g)"


def implied_rate(spark, d):
    """The rate at which a growing perpetuity is worth a price; its closed form is the oracle."""
    c = company(spark, d).withColumn("price", F.col("rev") * F.col("margin") * 12)
    found = v.bisected(lambda r: F.col("rev") * F.col("margin") * 1.02 / (r - 0.02), F.col("price"), 0.0201, 1.0)
    return c.select("entity", F.round(found, 6).alias("rate"))


def treasury(spark, d):
    """Net shares of awards are a sum over awards, so they are summed up and never gathered in a row."""
    strike = F.col("l_extendedprice") / F.col("l_quantity")
    net = v.treasury_shares(F.lit(0.0), F.lit(1200.0), F.array(F.struct(F.col("l_quantity").alias("count"), strike.alias("strike"))))
    li = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), net.alias("net"))
    return li.groupBy("entity").agg(F.round(F.count(F.lit(1)) + F.sum("net"), 3).alias("shares"))


TREASURY_SQL = "select l_suppkey entity, round(count(*) + sum(case when 1200.0>l_extendedprice/l_quantity then l_quantity*(1-l_extendedprice/l_quantity/1200.0) else 0 end),3) shares from lineitem group by 1"


def rating(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("entity"), (F.col("c_acctbal") / 1000).alias("coverage"))
    return c.withColumn("x", v.rating_step(F.col("coverage"))).select("entity", "x.rating", "x.spread")


RATING_SQL = "select c_custkey entity, case " + " ".join(f"when c_acctbal/1000>={f} then '{r}'" for f, r, _ in v.COVERAGE_STEPS) + " else 'D2/D' end rating, case " + " ".join(f"when c_acctbal/1000>={f} then {s}::double" for f, _, s in v.COVERAGE_STEPS) + " else 0.186::double end spread from customer"


def concentration(spark, d):
    q = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.year("o_orderdate").alias("year"), "c_mktsegment").agg(F.sum("o_totalprice").alias("x"))
    share = F.col("x") / F.sum("x").over(Window.partitionBy("year"))
    return q.withColumn("s", share).groupBy("year").agg(F.round(F.sum(F.col("s") * F.col("s")), 6).alias("herfindahl"))


HERFINDAHL_SQL = "with q as (select year(o_orderdate) y, c_mktsegment, sum(o_totalprice) x from orders join customer on o_custkey=c_custkey group by all), s as (select y, x/sum(x) over (partition by y) s from q) select y::int as year, round(sum(s*s),6) herfindahl from s group by y"


def neighbours(spark, d):
    """Top 5 by cosine of every vector whose id is divisible by 20, against all vectors: a stated query set."""
    return nearest_by_cosine(load(spark, d, "embeddings"), "vec_id", "embedding")


NEIGHBOUR_SQL = "with e as (select vec_id, embedding::double[] e from embeddings), n as (select q.vec_id query_id, x.vec_id, round(list_cosine_similarity(q.e, x.e),6) cosine from e q join e x on q.vec_id<>x.vec_id where q.vec_id%20=0), r as (select *, row_number() over (partition by query_id order by cosine desc, vec_id) place from n) select query_id, vec_id, cosine, place::int place from r where place<=5"


def phrases(spark, d):
    """Distinct phrases of each category that a page holds as whole words, whatever their case."""
    found = {"shop": ("price", "cart", "order"), "news": ("report", "today", "press"), "forum": ("reply", "post", "thread")}
    text = F.lower(F.regexp_replace("html", r"<[^>]*>", " "))
    hits = [F.size(F.filter(F.array(*map(F.lit, ps)), lambda p: F.regexp_like(F.col("t"), F.concat(F.lit(r"(^|[^a-z0-9])"), p, F.lit(r"([^a-z0-9]|$)"))))).cast("long").alias(c) for c, ps in found.items()]
    return load(spark, d, "pages").select("page_id", text.alias("t")).select("page_id", *hits)


PHRASE_SQL = "with p as (select page_id, lower(regexp_replace(html, '<[^>]*>', ' ', 'g')) t from pages) select page_id, " + ", ".join("(" + "+".join(f"regexp_matches(t, '(^|[^a-z0-9]){p}([^a-z0-9]|$)')::int" for p in ps) + f")::bigint {c}" for c, ps in {"shop": ("price", "cart", "order"), "news": ("report", "today", "press"), "forum": ("reply", "post", "thread")}.items()) + " from p"


def growth(spark, d):
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))
    before = F.lag("x").over(Window.partitionBy("entity").orderBy("year"))
    return o.select("entity", "year", F.round(v.growth(F.col("x"), before), 6).alias("growth"))


GROWTH_SQL = "with o as (select o_custkey entity, year(o_orderdate) y, round(sum(o_totalprice),2) x from orders group by all), l as (select *, lag(x) over (partition by entity order by y) b from o) select entity, y::int as year, case when b>0 then round(x/b-1,6) end growth from l"

QUERIES = {
    "auc_midrank": (auc, AUC_SQL),
    "calibration": (calibration, CALIBRATION_SQL),
    "ndcg": (ndcg, NDCG_SQL),
    "precision_recall_at_k": (precision_recall, PR_SQL),
    "base_rate_by_year": (base_rate, "select year(o_orderdate)::int as year, count(*)::bigint n, sum((o_orderstatus='F')::int)::bigint positives, round(avg((o_orderstatus='F')::int::double),6) rate from orders group by 1"),
    "popularity": (popularity, "select l_suppkey peer, count(distinct l_partkey)::bigint \"groups\", row_number() over (order by count(distinct l_partkey) desc, l_suppkey)::int place from lineitem group by 1"),
    "most_named": (most_named, "select l_suppkey peer, count(distinct l_partkey)::bigint n from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal<0) group by 1 having n>=500"),
    "co_pairs": (co_pairs, CO_SQL),
    "membership_census": (census, CENSUS_SQL),
    "gap_horizon_labels": (labels, LABEL_SQL),
    "beta_regression": (beta, BETA_SQL),
    "dcf_projection": (dcf, DCF_SQL),
    "sensitivity_grid": (grid, GRID_SQL),
    "bisection_rate": (implied_rate, "select c_custkey entity, round(0.02+1.02/12,6) rate from customer"),
    "treasury_stock": (treasury, TREASURY_SQL),
    "rating_step": (rating, RATING_SQL),
    "segment_herfindahl": (concentration, HERFINDAHL_SQL),
    "cosine_topk": (neighbours, NEIGHBOUR_SQL),
    "phrase_scores": (phrases, PHRASE_SQL),
    "guarded_growth": (growth, GROWTH_SQL),
}
