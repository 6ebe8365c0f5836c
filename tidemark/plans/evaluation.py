"""Queries over folds, model scores, scalers, beta pooling, growth paths and small fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import valuation as v
from tidemark.operators import crosssection as cs
from tidemark.operators import evaluation as ev
from tidemark.plans.models import BETA_SQL, beta
from tidemark.plans.panel import MID, PANEL, Q
from tidemark.plans.signals import rounded, scored
from tidemark.sources.tables import load, quarterly

FOLDS, EMBARGO, LEAST = 4, 120, 300


def folds(spark, d):
    return ev.walk_forward_folds(scored(spark, d), "as_of", FOLDS, embargo_days=EMBARGO, least_train=LEAST)


FOLD_CTE = f"""pd as (select as_of d, count(*) n from t where ret is not null group by 1), pl as (select d, n, row_number() over (order by d) i, count(*) over () nd, (select coalesce(sum(n),0) from pd b where b.d < a.d-{EMBARGO}) tr, (select max(d) from pd b where b.d < a.d-{EMBARGO}) te from pd a),
fi as (select min(i) f from pl where i>=2 and i<=nd-{FOLDS}+1 and tr>={LEAST}), bl as (select pl.*, ntile({FOLDS}) over (order by d)-1 fold from pl, fi where i>=f),
fo as (select fold, min(d) test_start, max(d) test_end, arg_min(te, d) train_end, arg_min(tr, d) n_train, sum(n) n_test from bl group by fold)"""
FOLDS_SQL = f"{PANEL}, {FOLD_CTE} select fold::int fold, train_end, test_start, test_end, n_train::bigint n_train, n_test::bigint n_test, (select coalesce(sum(n),0) from pd where d>=test_start-{EMBARGO} and d<test_start)::bigint n_embargoed from fo"


def fold_scores(spark, d):
    """Per fold the errors of the training mean as a forecast of the test rows."""
    rows = ev.fold_rows(scored(spark, d).select("symbol", "as_of", "ret", "score"), folds(spark, d), "as_of", EMBARGO)
    mean = rows.where("part = 'train'").groupBy("fold").agg(F.avg("ret").alias("p"))
    test = rows.where("part = 'test'").join(F.broadcast(mean), "fold").withColumn("p", F.col("p") + 0.0001 * F.col("score"))
    return rounded(ev.regression_scores(test, "ret", "p", ["fold"]).withColumn("fold", F.col("fold").cast("int")), "mae", "rmse", "rank_ic")


FOLD_SCORES_SQL = f"{PANEL}, {FOLD_CTE}, tm as (select fold, avg(ret) m from fo join t on ret is not null and as_of<test_start-{EMBARGO} group by fold), te as (select fo.fold, ret, m+0.0001::double*score p from fo join tm using (fold) join t on ret is not null and as_of between test_start and test_end), k as (select *, {MID.format(by='fold', v='ret')} a, {MID.format(by='fold', v='p')} b from te) select fold::int fold, count(*)::bigint n, round(avg(abs(ret-p)),6) mae, round(sqrt(avg((ret-p)*(ret-p))),6) rmse, case when count(*)>=3 and min(a)<>max(a) and min(b)<>max(b) then round(corr(a,b),6) end rank_ic from k group by fold"


def validation(spark, d):
    return ev.validation_dates(scored(spark, d), "as_of").withColumnRenamed("d", "as_of")


VALIDATION_SQL = f"{PANEL}, u as (select distinct as_of from t where ret is not null) select as_of, row_number() over (order by as_of) > count(*) over () - greatest(1, floor(count(*) over ()*0.2)) validation from u"


def candidates(spark, d):
    """Line items as candidates of their part: a grade and two scores."""
    li = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item")).agg(F.max("l_linenumber").alias("ln"), F.max("l_quantity").alias("b"), F.max("l_extendedprice").alias("a"))
    return li.withColumn("grade", F.greatest(F.lit(0), F.col("ln") - 4).cast("double"))


CANDIDATES = "cd as (select l_partkey q, l_orderkey*10+l_linenumber item, greatest(0, max(l_linenumber)-4)::double grade, max(l_quantity) b, max(l_extendedprice) a from lineitem group by 1,2)"


def quality(score):
    return lambda spark, d: rounded(ev.ranked_quality(candidates(spark, d), "q", score, "grade", "item", 10), "ndcg", "precision", "recall", "expected")


def quality_cte(score):
    return f"r{score} as (select *, row_number() over (partition by q order by {score} desc, item) s, row_number() over (partition by q order by grade desc, item) i from cd), z{score} as (select q, sum(case when s<=10 then grade/log2(s+1) else 0 end) d, sum(case when i<=10 then grade/log2(i+1) else 0 end) m, sum(case when s<=10 then 1/log2(s+1) else 0 end)*avg(grade) e, sum((s<=10 and grade>0)::int) h, sum((grade>0)::int) rl, sum((s<=10)::int) n from r{score} group by q)"


def quality_sql(score):
    return f"with {CANDIDATES}, {quality_cte(score)} select q, case when m>0 then round(d/m,6) end ndcg, round(h/n,6) \"precision\", case when rl>0 then round(h/rl,6) end recall, case when m>0 then round(e/m,6) end expected from z{score}"


def methods(spark, d):
    """Mean quality of both rankings."""
    c = candidates(spark, d)
    both = [ev.ranked_quality(c, "q", s, "grade", "item", 10).withColumn("method", F.lit(s)) for s in ("a", "b")]
    out = both[0].unionByName(both[1]).groupBy("method").agg(F.count("ndcg").alias("queries"), *[F.round(F.avg(x), 6).alias(x) for x in ("ndcg", "precision", "recall", "expected")])
    return out


METHODS_SQL = f"with {CANDIDATES}, {quality_cte('a')}, {quality_cte('b')}, u as (select 'a' as \"method\", * from za union all select 'b', * from zb) select \"method\", count(case when m>0 then d/m end)::bigint queries, round(avg(case when m>0 then d/m end),6) ndcg, round(avg(h/n),6) \"precision\", round(avg(case when rl>0 then h/rl end),6) recall, round(avg(case when m>0 then e/m end),6) expected from u group by 1"


def lift(spark, d):
    c = candidates(spark, d)
    a, b = (ev.ranked_quality(c, "q", s, "grade", "item", 10) for s in ("a", "b"))
    return rounded(ev.paired_lift(a, b, "q", "ndcg"), "mean", "sd", "won", "se", "t", places=5)


LIFT_SQL = f"with {CANDIDATES}, {quality_cte('a')}, {quality_cte('b')}, x as (select za.d/za.m-zb.d/zb.m d from za join zb using (q) where za.m>0 and zb.m>0), s as (select count(*)::bigint n, avg(d) mean, stddev_samp(d) sd, avg((d>0)::int::double) won from x) select n, round(mean,5) mean, round(sd,5) sd, round(won,5) won, round(sd/sqrt(n),5) se, round(mean/(sd/sqrt(n)),5) t from s"


def scaled(robust):
    def run(spark, d):
        q = quarterly(spark, d)
        s = ev.scaler(q.where(F.col("qtr") <= F.lit("1998-06-30").cast("date")), "total", ["sector"], robust=robust)
        return q.join(F.broadcast(s), "sector").select("entity", "qtr", F.round((F.col("total") - F.col("centre")) / F.col("scale"), 6).alias("z"))

    return run


SCALED_SQL = f"with {Q}, s as (select sector, median(total) m, stddev_pop(total) sd, count(*) n from c where qtr<=date '1998-06-30' group by sector) select entity, qtr, round((total-case when n>=5 then m else 0 end)/case when n>=5 and sd>0 then sd else 1 end,6) z from c join s using (sector)"


def missing(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("entity"), *[F.when(F.col("c_custkey") % k != 0, F.col("c_acctbal")).alias(f"f{k}") for k in (2, 3, 5, 7)])
    return c.select("entity", F.round(ev.missing_share(*[F.col(f"f{k}") for k in (2, 3, 5, 7)]), 6).alias("share"))


def fallback(spark, d):
    q = quarterly(spark, d).where("entity % 13 = 1").withColumn("g", F.concat("sector", F.lit("/"), F.year("qtr").cast("string")))
    return rounded(ev.means_with_fallback(q, "total", "g", 40), "mean", places=3)


FALLBACK_SQL = f"with {Q}, x as (select *, sector||'/'||year(qtr) g from c where entity%13=1) select g, count(*)::bigint n, round(case when count(*)>=40 then avg(total) else (select avg(total) from x) end,3) mean from x group by g"


def trimmed(spark, d):
    p = quarterly(spark, d).groupBy("entity").agg(F.avg("total").alias("x"), F.max("total").alias("y"))
    return ev.trimmed_line(p, "x", "y").select("n", F.round("slope", 5).alias("slope"), F.round("intercept", 2).alias("intercept"))


TRIMMED_SQL = f"with {Q}, p as (select entity, avg(total) x, max(total) y from c group by entity), k as (select quantile_cont(x,0.01) lx, quantile_cont(x,0.99) hx, quantile_cont(y,0.01) ly, quantile_cont(y,0.99) hy from p) select count(*)::bigint n, round(regr_slope(y,x),5) slope, round(regr_intercept(y,x),2) intercept from p, k where x between lx and hx and y between ly and hy"


def betas(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_nationkey") % 5).alias("sector"))
    return beta(spark, d).where("beta is not null").join(F.broadcast(s), "symbol")


BETAS = f"bt as (select z.*, s_nationkey%5 sector from ({BETA_SQL}) z join supplier on s_suppkey=symbol where beta is not null), st as (select sector, avg(beta) m, var_samp(beta) va, count(*) n, min(se) e, median(beta) md from bt group by sector), sh as (select bt.*, st.m, st.va, st.n nn, st.e, st.md, case when st.n>=3 and e>0 and va>0 then va/(va+se*se) else 1.0 end w from bt join st using (sector))"


def shrunk(spark, d):
    out = ev.vasicek(betas(spark, d), "beta", "se", ["sector"])
    return out.select("symbol", F.round("weight", 4).alias("weight"), F.round("shrunk", 4).alias("shrunk"))


def pooled(spark, d):
    return rounded(ev.pooled_beta(betas(spark, d), "beta", "se", ["sector"]), "pooled", places=4)


POOLED_SQL = f"with {BETAS} select sector, count(*)::bigint n, round(case when any_value(nn)>=3 and any_value(e)>0 and any_value(va)>0 then sum((w*beta+(1-w)*m)/(se*se))/sum(1/(se*se)) else any_value(md) end,4) pooled from sh group by sector"


def paths(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("entity"), (F.abs("c_acctbal") + 1).alias("size"))
    path = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: ((F.col("entity") * k * k + F.col("entity")) % 37 - 6) / 80.0)
    c = c.withColumn("path", path)
    return c.withColumns({"cagr": v.path_cagr(F.col("path"), 5), "start": F.get("path", F.lit(0))})


PATHS = "pt as (select c_custkey entity, abs(c_acctbal)+1 size, list_transform(range(1,6), lambda k: ((c_custkey*k*k+c_custkey)%37-6)/80.0::double) path from customer), pc as (select *, power(list_product(list_transform(path, lambda g: 1+g)),1.0/5)-1 cagr, path[1] as start from pt)"


def rates(spark, d):
    return rounded(ev.base_rates(paths(spark, d), "cagr", "start", "size", 0.1, 0.1, 0.05, 4000.0), "all", "alike", "like_size")


RATES_SQL = f"with {PATHS} select count(*)::bigint n, round(avg((cagr>=0.1)::int::double),6) as \"all\", count(*) filter (where abs(start-0.1::double)<=0.05::double)::bigint n_alike, round(avg((cagr>=0.1)::int::double) filter (where abs(start-0.1::double)<=0.05::double),6) alike, count(*) filter (where size between 2000 and 8000)::bigint n_like, round(avg((cagr>=0.1)::int::double) filter (where size between 2000 and 8000),6) like_size from pc"


def curve(spark, d):
    return rounded(ev.persistence(paths(spark, d), "path", 0.03, 5), "share")


CURVE_SQL = f"with {PATHS} select h::int h, count(*)::bigint n, round(avg((list_min(path[1:h])>=0.03::double)::int::double),6) share from pc, range(1,6) r(h) group by h"


def quantiles(spark, d):
    return rounded(ev.quantile_paths(paths(spark, d), "path", "cagr", "entity", (0.1, 0.5, 0.9)), "growth")


QUANTILES_SQL = f"with {PATHS}, r as (select *, row_number() over (order by cagr, entity)-1 i, count(*) over () n from pc), z as (select q::double quantile, path from r, (values (0.1),(0.5),(0.9)) v(q) where i between greatest(0, round_even((q::double-0.05::double)*(n-1),0)) and least(n-1, round_even((q::double+0.05::double)*(n-1),0))) select quantile, y::int as \"year\", round(avg(path[y]),6) growth, count(*)::bigint paths from z, range(1,6) w(y) group by 1,2"


def coverage(spark, d):
    """How often a customer's later growth lies between the 10th and 90th percentile of customers of its band that came before."""
    p = paths(spark, d).withColumns({"band": F.floor(F.col("start") * 20), "late": F.col("entity") % 4 == 0})
    pool = p.where(~F.col("late")).groupBy("band").agg(F.count(F.lit(1)).alias("pool"), F.percentile("cagr", F.lit(0.1)).alias("lo"), F.percentile("cagr", F.lit(0.9)).alias("hi"))
    met = p.where("late").join(F.broadcast(pool.where("pool >= 20")), "band")
    return met.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("cagr").between(F.col("lo"), F.col("hi")).cast("double")), 6).alias("covered"))


COVERAGE_SQL = f"with {PATHS}, b as (select *, floor(start*20)::bigint band, entity%4=0 late from pc), p as (select band, count(*) pool, quantile_cont(cagr,0.1) lo, quantile_cont(cagr,0.9) hi from b where not late group by band having count(*)>=20) select count(*)::bigint n, round(avg((cagr between lo and hi)::int::double),6) covered from b join p using (band) where late"


def fitted(spark, d):
    """Weights of a ridge of log totals on three columns, as rows."""
    c = load(spark, d, "customer").select(F.ln(F.abs("c_acctbal") + 1).alias("y"), (F.col("c_nationkey") / 25.0).alias("x1"), ((F.col("c_custkey") % 10) / 10.0).alias("x2"), F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0).alias("x3"))
    w = ev.ridge(c, "y", ["x1", "x2", "x3"])
    return spark.createDataFrame([(k, round(x, 5) + 0.0) for k, x in w.items()], "name string, weight double")


def ends(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("value"))
    return ev.extremes(c, "value", "entity", 5)


ENDS_SQL = "select * from (select c_custkey entity, c_acctbal as value, 'low' side from customer order by c_acctbal, c_custkey limit 5) union all select * from (select c_custkey, c_acctbal, 'high' from customer order by c_acctbal desc, c_custkey limit 5)"


def classification(spark, d):
    """AUC and Brier score by language of the length as a probability of quality."""
    from tidemark.plans.models import scored as labelled

    df = labelled(spark, d)
    a = cs.auc(df, "quality", "p", ["lang"])
    b = df.groupBy("lang").agg(F.avg(F.pow(F.col("quality") - F.col("p"), 2)).alias("brier"), F.avg(F.pow(F.col("quality") - F.lit(0.8), 2)).alias("baseline"))
    return a.join(b, "lang").select("lang", "n", "positives", *[F.round(x, 6).alias(x) for x in ("auc", "brier", "baseline")])


def _classification_sql():
    from tidemark.plans.models import AUC_SQL, SCORED

    return f"with au as ({AUC_SQL}), {SCORED}, br as (select lang, round(avg(power(quality-p,2)),6) brier, round(avg(power(quality-0.8::double,2)),6) baseline from s group by lang) select * from au join br using (lang)"


QUERIES = {
    "walk_forward_folds": (folds, FOLDS_SQL),
    "fold_scores": (fold_scores, FOLD_SCORES_SQL),
    "validation_dates": (validation, VALIDATION_SQL),
    "ranking_quality": (quality("a"), quality_sql("a")),
    "ranking_methods": (methods, METHODS_SQL),
    "paired_lift": (lift, LIFT_SQL),
    "robust_scaler": (scaled(True), SCALED_SQL),
    "missing_share": (missing, "select c_custkey entity, round(((c_custkey%2=0)::int+(c_custkey%3=0)::int+(c_custkey%5=0)::int+(c_custkey%7=0)::int)/4.0::double,6) share from customer"),
    "means_with_fallback": (fallback, FALLBACK_SQL),
    "trimmed_line": (trimmed, TRIMMED_SQL),
    "vasicek": (shrunk, f"with {BETAS} select symbol, round(w,4) weight, round(w*beta+(1-w)*m,4) shrunk from sh"),
    "pooled_beta": (pooled, POOLED_SQL),
    "growth_base_rate": (rates, RATES_SQL),
    "persistence_curve": (curve, CURVE_SQL),
    "quantile_paths": (quantiles, QUANTILES_SQL),
    "band_coverage": (coverage, COVERAGE_SQL),
    "ridge_weights": (fitted, None),
    "extremes": (ends, ENDS_SQL),
    "classification_scores": (classification, _classification_sql()),
}
