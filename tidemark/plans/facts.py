"""Queries over the fact store: units, dimensions, guards, statement lines, and splits read off restatements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import factstore as fs
from tidemark.operators import splits as sp
from tidemark.sources.tables import load

#: Made-up splits: every how manyth customer, the day, and the ratio.
SPLITS = ((3, "1998-03-01", 2.0), (5, "1999-06-15", 10.0))
#: Customers whose versions a task makes and sorts at most, on average; a customer has 60.
TASK_CUSTOMERS = 2000


def versions(spark, d):
    """A share count a customer and quarter, reported three times a year apart, on the basis of the day it was filed."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey"))
    c = c.repartition(max(8 * spark.sparkContext.defaultParallelism, -(-c.count() // TASK_CUSTOMERS)), "entity")
    ends = spark.sql("select explode(sequence(date '1996-03-01', date '2000-12-01', interval 3 months)) m").select(F.last_day("m").alias("end"))
    v = c.crossJoin(F.broadcast(ends)).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(2))))
    v = v.withColumns({"start": F.add_months(F.trunc("end", "month"), -2), "filed": F.date_add("end", 40 + 365 * F.col("v")), "tag": F.lit("diluted"), "unit": F.lit("shares")})
    val = (1000.0 + F.col("entity")) * (1 + 0.0003 * F.col("v"))
    for k, day, ratio in SPLITS:
        val = val * F.when((F.col("entity") % k == 0) & (F.col("filed") >= F.lit(day).cast("date")), ratio).otherwise(1.0)
    return v.withColumn("val", val).withColumn("ord", F.unix_date("end") * 4 + F.col("v"))


def _val(filed="filed"):
    return "(1000.0::double+entity)*(1+0.0003::double*v)" + "".join(f"*case when entity%{k}=0 and {filed}>=date '{day}' then {r}::double else 1.0::double end" for k, day, r in SPLITS)


VERSIONS = f"vs as (select *, {_val()} val from (select c_custkey entity, e as \"end\", date_trunc('month', e - interval 2 month)::date as start, v, (e+(40+365*v)::int)::date filed from customer, (select last_day(m)::date e from (select unnest(generate_series(date '1996-03-01', date '2000-12-01', interval 3 month)) m)), range(0,3) r(v)))"
PAIRS = "pp as (select * from (select *, lag(filed) over w older, val/lag(val) over w ratio from vs window w as (partition by entity, \"end\" order by filed)) where older is not null)"


def ordered(spark, d):
    return sp.ordered_brackets(sp.brackets(sp.sightings(versions(spark, d))))


def sighted(spark, d):
    return sp.sightings(versions(spark, d))


SIGHTED_SQL = f"with {VERSIONS}, {PAIRS} select entity, f::double factor, older, filed newer, start, \"end\" from pp, (values {','.join(f'({r})' for r in sp.RATIOS)}) t(f) where abs(ratio-f)<0.005*f"


def bracketed(spark, d):
    return sp.brackets(sp.sightings(versions(spark, d)))


BRACKETS_SQL = f"with {VERSIONS}, {PAIRS} " + " union all ".join(f"select entity, {r}::double factor, max(older) lo, min(filed) hi from pp where entity%{k}=0 and older<date '{day}' and filed>=date '{day}' group by entity" for k, day, r in SPLITS)


def basis(spark, d):
    return sp.basis_by_filing(versions(spark, d), ordered(spark, d)).withColumn("basis", F.round("basis", 6))


ANY = " or ".join(f"entity%{k}=0" for k, _, _ in SPLITS)
BEHIND = "*".join(f"case when entity%{k}=0 and filed<date '{day}' then {r}::double else 1.0::double end" for k, day, r in SPLITS)
BASIS_SQL = f"with {VERSIONS} select distinct entity, filed, {BEHIND} basis from vs where {ANY}"


def thresholds(spark, d):
    o = ordered(spark, d)
    return sp.split_thresholds(o, sp.basis_by_filing(versions(spark, d), o))


THRESHOLDS_SQL = f"with {VERSIONS} " + " union all ".join(f"select entity, min(filed) threshold, {r}::double factor from vs where entity%{k}=0 and filed>=date '{day}' group by entity" for k, day, r in SPLITS)


def adjusted(spark, d):
    out = sp.split_adjusted(versions(spark, d), thresholds(spark, d))
    return out.select("entity", "end", "filed", F.round("val", 4).alias("val"))


ADJUSTED_SQL = f"with {VERSIONS} select entity, \"end\", filed, round(val*{BEHIND},4) val from vs"


def facts(spark, d):
    """Line items as facts of a supplier: unit by return flag, dimensions by line number."""
    li = load(spark, d, "lineitem")
    axis = F.when(F.col("l_linenumber") % 4 == 1, F.create_map(F.lit("us:SegmentAxis"), F.col("l_linestatus")))
    axis = axis.when(F.col("l_linenumber") % 4 == 2, F.create_map(F.lit("geo:PlaceAxis"), F.col("l_linestatus")))
    axis = axis.when(F.col("l_linenumber") % 4 == 3, F.create_map(F.lit("us:SegmentAxis"), F.col("l_linestatus"), F.lit("geo:PlaceAxis"), F.col("l_returnflag")))
    unit = F.when(F.col("l_returnflag") == "A", "shares").when(F.col("l_returnflag") == "N", "pure").otherwise("EUR")
    value = F.when(F.col("l_discount") > 0, F.col("l_extendedprice"))
    return li.select(F.col("l_suppkey").alias("entity"), (F.col("l_partkey") % 50).alias("tag"), unit.alias("unit"), F.to_date("l_shipdate").alias("end"), F.when(F.col("l_linenumber") % 2 == 0, F.date_sub("l_shipdate", 90)).alias("start"), value.alias("val"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), axis.alias("dims"), "l_returnflag", "l_linenumber")


FACTS = "fx as (select l_suppkey entity, l_partkey%50 tag, case l_returnflag when 'A' then 'shares' when 'N' then 'pure' else 'EUR' end unit, l_shipdate::date as \"end\", case when l_linenumber%2=0 then (l_shipdate::date-90)::date end as start, case when l_discount>0 then l_extendedprice end val, l_orderkey*10+l_linenumber ord, l_linenumber ln, l_linestatus ls, l_returnflag rf from lineitem)"


def units(spark, d):
    out = fs.preferred_unit(facts(spark, d), ["entity", "tag"])
    return out.groupBy("entity", "tag", "unit").agg(F.count(F.lit(1)).alias("n"))


UNITS_SQL = f"with {FACTS}, u as (select entity, tag, unit, min(ord) o, count(*)::bigint n from fx group by all), b as (select *, row_number() over (partition by entity, tag order by case unit when 'shares' then 2 when 'pure' then 4 else 99 end, o) rn from u) select entity, tag, unit, n from b where rn=1"


def usable(spark, d):
    return fs.usable_rows(facts(spark, d)).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def kinds(spark, d):
    f = facts(spark, d)
    kind = fs.dimension_kind(F.col("dims"), "us:SegmentAxis", "geo:PlaceAxis")
    return f.groupBy("entity", kind.alias("kind"), fs.axis_member(F.col("dims"), "PlaceAxis").alias("place")).agg(F.count(F.lit(1)).alias("n"))


KINDS_SQL = f"with {FACTS} select entity, case ln%4 when 0 then 'consolidated' when 1 then 'segment' when 2 then 'geography' else 'excluded' end kind, case ln%4 when 2 then ls when 3 then rf end place, count(*)::bigint n from fx group by 1,2,3"


def plain(spark, d):
    f = facts(spark, d)
    both = [fs.undimensioned(f, "1998-12-31", instant).groupBy("entity").agg(F.count(F.lit(1)).alias("n")).withColumn("instant", F.lit(instant)) for instant in (True, False)]
    return both[0].unionByName(both[1])


PLAIN_SQL = f"with {FACTS} select entity, (start is null) instant, count(*)::bigint n from fx where ln%4=0 and \"end\"<=date '1998-12-31' group by 1,2"


def indexed(spark, d):
    return fs.first_values(fs.usable_rows(facts(spark, d)).withColumn("o", F.struct("ord", "val")), ["entity", "tag", "end"], "o")


INDEXED_SQL = f"with {FACTS} select entity, tag, \"end\", arg_min(val, struct_pack(o:=ord, v:=val)) val, max(val)-min(val)>0.5 conflict from fx where val is not null group by entity, tag, \"end\""


def zeroes(spark, d):
    f = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("end"), F.col("l_discount").alias("val"))
    return fs.explicitly_zero(f, "entity", "end")


def leaks(spark, d):
    """Orders beside their lines, by whether a line was shipped after the day that is claimed to be known."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("as_of"))
    li = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.to_date(F.max("l_shipdate")).alias("filed"), F.to_date(F.min("l_shipdate")).alias("first"))
    return fs.lookahead(o.join(li, "k"), "as_of", "filed", "first").select("k", "as_of", "filed")


LEAKS_SQL = "select o_orderkey k, o_orderdate::date as_of, max(l_shipdate)::date filed from orders join lineitem on l_orderkey=o_orderkey group by 1,2 having max(l_shipdate)::date > o_orderdate::date"


def guards(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.abs("c_acctbal").alias("a"), (F.abs("c_acctbal") * (F.col("c_custkey") % 13)).alias("b"))
    r = F.when(F.col("a") > 0, F.col("b") / F.col("a"))
    return c.select("entity", fs.dwarfed(F.col("a"), F.col("b"), 3.0).alias("component"), fs.far_apart(F.col("a"), F.col("b"), 10.0).alias("float_off"), fs.basis_factor(F.col("a"), F.col("b"), (2.0, 3.0, 10.0)).alias("basis"), F.array_join(fs.controls(small=r < 5, even=F.col("entity") % 2 == 0), ",").alias("failed"), fs.debt_control(F.col("b"), F.col("a") * 2).alias("debt"))


GUARDS_SQL = "with c as (select c_custkey entity, abs(c_acctbal) a, abs(c_acctbal)*(c_custkey%13) b from customer), r as (select *, case when a>0 then b/a end r from c) select entity, coalesce(a>0, false) and b>3.0*a component, case when a>0 and b>0 then abs(ln(a/b))>ln(10.0) end float_off, case when abs(r-1)<=0.01 then 1.0::double when abs(r-2)<=0.02 then 2.0 when abs(r-3)<=0.03 then 3.0 when abs(r-10)<=0.1 then 10.0 end basis, concat_ws(',', case when r>=5 then 'small' end, case when entity%2<>0 then 'even' end) failed, case when a<=0 then 'no control' when abs(b-2*a)/(2*a)>0.5 then 'refused' when abs(b-2*a)/(2*a)>0.05 then 'warning' else 'ok' end debt from r"


def classes(spark, d):
    f = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("end"), F.col("l_quantity").alias("val"))
    return fs.latest_by_class(f, "entity", "1999-12-31")


CLASSES_SQL = "with g as (select l_suppkey entity, l_shipdate::date as \"end\", sum(l_quantity) shares, count(*)::bigint classes from lineitem where l_shipdate::date<=date '1999-12-31' group by 1,2) select entity, max(\"end\") as \"end\", arg_max(shares, \"end\") shares, arg_max(classes, \"end\") classes from g group by 1"


def corpus(spark, d):
    docs = load(spark, d, "documents").select("source", F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")).alias("filed"), F.substring("text", 1, 40).alias("text"))
    return fs.latest_documents(docs, "source", F.lit("2001-06-30").cast("date"), "filed", "text")


CORPUS_SQL = "with x as (select source, (date '2000-01-01' + (doc_id%900)::int)::date filed, substr(text,1,40) t from documents) select source, max(filed) filed, arg_max(t, struct_pack(f:=filed, t:=t)) as text from x where filed<=date '2001-06-30' group by source"


def statements(spark, d):
    """Statement lines of every customer from what it reports: legs that some leave out."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("entity"), (F.abs("c_acctbal") + 1).alias("x"))
    e = F.col("entity")
    some = lambda k, f: F.when(e % k != 0, F.col("x") * f)
    debt = fs.straight_debt(some(2, 0.5), some(3, 0.1), some(5, 0.7))
    ls = fs.lease(some(2, 0.05), some(4, 0.02), some(3, 0.08))
    op = fs.operating_profit(some(3, 0.2), some(2, 0.18), some(5, 0.01))
    dl = fs.derived_lines(F.col("x"), op["value"], F.col("x") * 0.04, some(2, 0.02), F.col("x") * 0.03, some(7, 0.1), F.col("x") * 0.5, F.col("x") * 0.3, F.col("x") * 0.2, F.col("x") * 0.1)
    sh = fs.diluted_shares(some(2, 1.1), F.col("x"), F.when(e % 4 == 0, -1.0).otherwise(1.0))
    out = c.select("entity", F.round(debt, 4).alias("debt"), F.round(ls["noncurrent"], 4).alias("lease_long"), F.round(ls["current"], 4).alias("lease_short"), F.round(op["value"], 4).alias("ebit"), op["source"].alias("ebit_source"), *[F.round(dl[n], 4).alias(n) for n in ("ebitda", "ebitdar", "ebit_margin", "tax_rate", "working_capital")], F.round(sh, 4).alias("shares"))
    return out


def _some(k, f):
    return f"case when entity%{k}<>0 then x*{f}::double end"


STATEMENTS_SQL = f"with c as (select c_custkey entity, abs(c_acctbal)+1 x from customer), r as (select *, coalesce({_some(3, 0.2)}, {_some(2, 0.18)}+coalesce({_some(5, 0.01)},0)) eb from c) select entity, round(coalesce({_some(2, 0.5)}+coalesce({_some(3, 0.1)},0), {_some(5, 0.7)}, {_some(3, 0.1)}, 0),4) debt, round(case when entity%2<>0 or entity%4<>0 then coalesce({_some(2, 0.05)},0) else coalesce({_some(3, 0.08)},0) end,4) lease_long, round(case when entity%2<>0 or entity%4<>0 then coalesce({_some(4, 0.02)},0) else 0 end,4) lease_short, round(eb,4) ebit, case when entity%3<>0 then 'reported' when entity%2<>0 then 'pretax plus interest' else 'missing' end ebit_source, round(eb+x*0.04::double,4) ebitda, round(eb+x*0.04::double+({_some(2, 0.02)}),4) ebitdar, round(eb/x,4) ebit_margin, round(x*0.03::double/({_some(7, 0.1)}),4) tax_rate, round((x*0.5::double-x*0.2::double)-(x*0.3::double-x*0.1::double),4) working_capital, round(coalesce({_some(2, 1.1)}, case when entity%4=0 then x end),4) shares from r"


def counts(spark, d):
    """Share counts: outstanding with awards, where there is a price and a count."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    e = F.col("entity").cast("double")
    blocks = F.array(F.struct(e.alias("count"), F.lit(10.0).alias("strike")), F.struct((e * 2).alias("count"), F.lit(40.0).alias("strike")), F.struct(F.lit(5.0).alias("count"), F.lit(None).cast("double").alias("strike")))
    price = F.when(F.col("entity") % 5 != 0, (F.col("entity") % 60).cast("double"))
    s = fs.share_count(F.when(F.col("entity") % 7 != 0, e * 100), blocks, F.when(F.col("entity") % 11 != 0, e * 99), price)
    return c.select("entity", F.round(s["shares"], 4).alias("shares"), s["basis"].alias("basis"))


COUNTS_SQL = "with c as (select c_custkey entity, c_custkey::double e, case when c_custkey%5<>0 then (c_custkey%60)::double end p from customer), o as (select *, case when p>0 and entity%7<>0 then e*100+5.0+case when p>10 then e*(1-10.0/p) else 0 end+case when p>40 then e*2*(1-40.0/p) else 0 end end own, case when entity%11<>0 then e*99 end wa from c) select entity, round(coalesce(own, wa),4) shares, case when own is not null then 'outstanding and awards' when wa is not null then 'weighted average' else 'none' end basis from o"


def ranks(spark, d):
    forms = spark.createDataFrame([(f,) for f in ("10-K", "10-Q", "10-K/A", "DEF 14A", "S-1", None)], "form string")
    return forms.select("form", fs.form_rank(F.col("form")).alias("rank"))


QUERIES = {
    "split_sightings": (sighted, SIGHTED_SQL),
    "split_brackets": (bracketed, BRACKETS_SQL),
    "split_basis": (basis, BASIS_SQL),
    "split_thresholds": (thresholds, THRESHOLDS_SQL),
    "split_adjusted": (adjusted, ADJUSTED_SQL),
    "preferred_unit": (units, UNITS_SQL),
    "usable_rows": (usable, f"with {FACTS} select entity, count(*)::bigint n from fx where val is not null group by 1"),
    "dimension_kinds": (kinds, KINDS_SQL),
    "undimensioned": (plain, PLAIN_SQL),
    "first_values": (indexed, INDEXED_SQL),
    "explicitly_zero": (zeroes, "select l_suppkey entity, l_shipdate::date as \"end\", max((l_discount=0)::int)::boolean zero from lineitem group by 1,2"),
    "lookahead_rows": (leaks, LEAKS_SQL),
    "row_guards": (guards, GUARDS_SQL),
    "shares_by_class": (classes, CLASSES_SQL),
    "latest_documents": (corpus, CORPUS_SQL),
    "statement_lines": (statements, STATEMENTS_SQL),
    "share_counts": (counts, COUNTS_SQL),
    "form_ranks": (ranks, "select * from (values ('10-K',0),('10-Q',1),('10-K/A',0),('DEF 14A',2),('S-1',2),(null,2)) t(form, rank)"),
}
