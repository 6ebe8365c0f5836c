"""Queries over page markup, names, phrase evidence, figures in prose and term weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import textops as tx
from tidemark.sources.tables import load

ITEMS = ("item 1", "item 1a", "item 2", "item 7")
PHRASES = {"time": ("year", "day", "week", "on time"), "place": ("city", "river", "street"), "people": ("people", "children", "teacher", "family")}


def stripped(spark, d):
    p = load(spark, d, "pages").select("page_id", tx.strip_markup(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def _strip_sql():
    t = "regexp_replace(coalesce(html,''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)</?(p|div|br|tr|li|h[1-6]|table|ul|ol|section|article)[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    for name, sign in tx.ENTITIES:
        t = f"replace({t}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    t = f"regexp_replace({t}, '[ \\t\\r\\f]+', ' ', 'g')"
    t = f"trim(regexp_replace({t}, ' ?\\n[ \\n]*', chr(10), 'g'), ' '||chr(10))"
    return f"with x as (select page_id, {t} t from pages) select page_id, length(t)::bigint n, md5(t) digest from x"


def codes(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit(" "), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string")).alias("code"))
    return c.select("entity", tx.normalise_code(F.col("code")).alias("code"))


CODES_SQL = "with c as (select c_custkey entity, trim(case when c_custkey%5=0 then ' '||c_custkey when c_custkey%7=0 then c_name else c_custkey::varchar end) code from customer) select entity, case when regexp_matches(code,'^[0-9]+$') then case when length(code)<4 then lpad(code,4,'0') else code end end code from c"


def filing(spark, d):
    """A made-up filing of every customer: a table of contents, then items of different lengths."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    body = lambda k: F.repeat(F.lit("some words "), (F.col("entity") % k + 3).cast("int"))
    contents = F.lit("Item 1\nItem 1A\nItem 2\nItem 7\n")
    text = F.concat(contents, F.repeat(F.lit("cover page "), F.lit(80)), F.lit("\nItem 1 "), body(11), F.lit("\nItem 1A "), body(7), F.lit("\nItem 7 "), body(5))
    return c.withColumn("text", F.when(F.col("entity") % 10 == 0, F.lit("no headers here")).otherwise(text))


def headed(spark, d):
    f = filing(spark, d).withColumn("h", tx.headers(F.col("text"), tuple(sorted(ITEMS, key=len, reverse=True))))
    f = f.withColumn("c", tx.contents_runs(F.col("h")))
    return f.select("entity", F.size("h").alias("headers"), F.size(F.filter("c", lambda x: x)).alias("in_contents"))


HEADED_SQL = "select c_custkey entity, case when c_custkey%10=0 then 0 else 7 end::int headers, case when c_custkey%10=0 then 0 else 7 end::int in_contents from customer"


def sectioned(spark, d):
    body = F.regexp_replace("text", r"(?s)^Item 1\nItem 1A\nItem 2\nItem 7\n", "")
    f = filing(spark, d).repartition(8 * spark.sparkContext.defaultParallelism, "entity").withColumn("text", body).withColumn("s", tx.sections(F.col("text"), ITEMS))
    return f.select("entity", F.transform("s", lambda x: x["name"]).cast("string").alias("items"), F.round(tx.covered_share(F.col("s"), F.col("text")), 6).alias("covered"))


SECTIONED_SQL = "with x as (select c_custkey entity, c_custkey%10=0 none, 880+1 pre, 11*(c_custkey%11+3) a, 11*(c_custkey%7+3) b, 11*(c_custkey%5+3) c from customer), l as (select *, pre+7+a+1+8+b+1+7+c total, (a+1+1)+(b+1+1)+(c+1) got from x) select entity, case when none then '[]' else '[item 1, item 1a, item 7]' end items, case when none then 0.0 else round(got/total::double,6) end covered from l"


def named(spark, d):
    n = F.col("p_name")
    p = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.initcap(n), F.when(F.col("p_partkey") % 2 == 0, ", Inc.").otherwise(" Holdings Ltd")).alias("name"))
    return p.select("k", tx.name_key(F.col("name")).alias("key"), F.concat_ws("|", tx.name_variants(F.col("name"))).alias("variants"))


def _key_sql(n):
    words = f"list_filter(string_split(regexp_replace(lower({n}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return words, f"array_to_string(list_filter({words}, lambda w: not list_contains({list(tx.SUFFIXES)!r}, w)), ' ')"


def _named_sql():
    words, key = _key_sql("name")
    return f"with p as (select p_partkey k, array_to_string(list_transform(string_split(p_name,' '), lambda w: upper(w[1])||lower(w[2:])),' ')||case when p_partkey%2=0 then ', Inc.' else ' Holdings Ltd' end as name from part), w as (select k, array_to_string({words},' ') whole, {key} ky from p), v as (select k, ky, list_distinct(list_filter([whole, ky, case when length(string_split(ky,' ')[1])>=5 then string_split(ky,' ')[1] end], lambda x: x is not null and x <> '')) vs from w) select k, ky as key, (select string_agg(u, '|' order by length(u) desc, u) from (select unnest(vs) u)) variants from v"


def resolved(spark, d):
    reg = load(spark, d, "part").select(F.col("p_partkey").alias("sym"), F.concat(F.col("p_name"), F.lit(" Corp")).alias("title"))
    names = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.upper("p_name"), F.when(F.col("p_partkey") % 9 == 0, " xyz").otherwise("")).alias("name"))
    return tx.resolved_name(names, reg, "name", "title", "sym").select("k", "symbol", "reason")


def _resolved_sql():
    return f"with r as (select {_key_sql(chr(112) + '_name||' + repr(' Corp'))[1]} ky, count(*) n, min(p_partkey) s from part group by 1), m as (select p_partkey k, {_key_sql('upper(p_name)||case when p_partkey%9=0 then ' + repr(' xyz') + ' else ' + repr('') + ' end')[1]} ky from part) select k, case when n=1 then s end symbol, case when n is null then 'no such name' when n>1 then 'more than one' end reason from m left join r using (ky)"


def scrubbed(spark, d):
    docs = load(spark, d, "documents").select("doc_id", tx.scrubbed(F.col("text"), F.array(F.lit("the"), F.lit("of"))).alias("t"))
    return docs.select("doc_id", F.length("t").cast("long").alias("n"))


SCRUBBED_SQL = "select doc_id, length(regexp_replace(regexp_replace(coalesce(text,''), '(?i)\\bthe\\b', '[name]', 'g'), '(?i)\\bof\\b', '[name]', 'g'))::bigint n from documents"


def deglued(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")).alias("t"))
    return p.select("k", tx.deglued(F.col("t")).alias("t"))


DEGLUED_SQL = "select p_partkey k, regexp_replace(array_to_string(list_transform(string_split(p_name,' '), lambda w: upper(w[1])||lower(w[2:])),''), '([a-z])([A-Z][a-z])', '\\1 \\2', 'g') t from part"


def evidence(spark, d):
    docs = load(spark, d, "documents").select("doc_id", tx.phrase_evidence(F.col("text"), PHRASES).alias("e"))
    return docs.select("doc_id", *[F.col(f"e.{k}").alias(k) for k in PHRASES])


PLAIN = "' '||regexp_replace(lower(coalesce(text,'')), '[^a-z0-9]+', ' ', 'g')||' '"
EVIDENCE = f"ev as (select doc_id, source, " + ", ".join("(" + "+".join(f"contains(p, ' {x} ')::int" for x in many) + f")::int \"{k}\"" for k, many in PHRASES.items()) + f" from (select doc_id, source, {PLAIN} p from documents))"


def classed(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", tx.phrase_evidence(F.col("text"), PHRASES).alias("e"))
    x = tx.classified(F.col("e"), tuple(PHRASES), F.substring("source", -1, 1), {"1": "time", "2": "place", "3": "people"})
    shares = tx.evidence_shares(F.col("e"), tuple(PHRASES))
    return docs.select("doc_id", x["category"].alias("category"), F.round(x["confidence"], 6).alias("confidence"), x["reason"].alias("reason"), F.get(shares, F.lit(0))["name"].alias("strongest"))


def _classed_sql():
    k = list(PHRASES)
    g = ", ".join(f'"{x}"' for x in k)
    return f"with {EVIDENCE}, z as (select *, greatest({g}) b, {'+'.join(chr(34) + x + chr(34) for x in k)} w, list_filter([{', '.join(f'case when {chr(34)}{x}{chr(34)}=greatest({g}) and greatest({g})>0 then {x!r} end' for x in k)}], lambda x: x is not null) ld, case right(source,1) when '1' then 'time' when '2' then 'place' when '3' then 'people' end cd from ev), q as (select *, case when len(ld)=1 and b>=2 then ld[1] end le from z) select doc_id, coalesce(le, cd) category, round(case when coalesce(le, cd) is null then 0.0 when le is not null then case when le=cd then 1.0 else b/w::double end else 0.5 end,6) confidence, case when le=cd then 'text and code' when le is not null then 'text' when cd is not null then 'code' when len(ld)>1 then 'tied evidence' else 'no evidence' end reason, case {' '.join(f'when {chr(34)}{x}{chr(34)}=b then {x!r}' for x in sorted(k))} end strongest from q"


def clauses(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    e = F.col("entity").cast("string")
    t = F.concat(F.lit("each share, par value $0.01 per share, converts into $"), e, F.lit(".50 in cash and 0."), e, F.lit(" of a share; in all $"), e, F.lit(".5 million and $1,200, or $2 billion"))
    t = F.when(F.col("entity") % 6 == 0, F.lit("a share of par value $0.001 per share")).otherwise(t)
    m = tx.money(t)
    return c.select("entity", tx.cash_per_share(t).alias("cash"), tx.exchange_ratio(t).alias("ratio"), F.aggregate(m, F.lit(0.0), lambda a, x: a + x).alias("money"), F.size(tx.distinct_within(m, 0.3)).alias("distinct_amounts"))


CLAUSES_SQL = "with c as (select c_custkey e, c_custkey%6=0 par from customer), m as (select *, case when par then [0.001::double] else [0.01::double, e+0.5::double, (e+0.5::double)*1e6, 1200.0, 2e9] end m from c) select e entity, case when not par then e+0.5::double end cash, case when not par then ('0.'||e)::double end ratio, list_sum(m) money, case when par then 1 else (select count(*) from (select unnest(m) x, generate_subscripts(m,1) i) a where not exists (select 1 from (select unnest(m) y, generate_subscripts(m,1) j) b where j<i and abs(x-y)<=0.3*greatest(x,y))) end::int distinct_amounts from m"


def terms(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.substring("text", 1, 400).alias("text"))
    w = tx.term_weights(docs, "doc_id", "text")
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 6).alias("largest"))


TERMS_SQL = f"""with w as (select doc_id, list_filter(string_split(regexp_replace(lower(coalesce(substr(text,1,400),'')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x)>=2 and not list_contains({list(tx.STOP_WORDS)!r}, x)) w from documents),
t as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i]||' '||w[i+1]))) term from w), tf as (select doc_id, term, count(*) tf from t group by all), n as (select count(*) n from documents),
df as (select term, count(*) df from tf group by 1), x as (select doc_id, term, (1+ln(tf))*(ln((1+n)/(1+df)::double)+1) x from tf join df using (term), n where df>=2 and df<=0.8*n), l as (select doc_id, sqrt(sum(x*x)) l from x group by 1)
select doc_id, count(*)::bigint terms, round(sum(x/l),5) total, round(max(x/l),6) largest from x join l using (doc_id) group by doc_id"""


def units(spark, d):
    v = tx.unit_vectors(load(spark, d, "embeddings"), "embedding")
    return v.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), "reason")


UNITS_SQL = "with e as (select vec_id, embedding::double[] v, sqrt(list_sum(list_transform(embedding::double[], lambda x: x*x))) l from embeddings) select vec_id, case when l>0 then round(list_sum(list_transform(v, lambda x: x/l)),5) end total, case when not coalesce(l>0,false) then 'no length' end reason from e"


def candidates(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("entity"), "o_orderkey", F.to_date("o_orderdate").alias("filed"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("rank"))
    o = o.withColumn("filed_key", F.struct("filed", "o_orderkey"))
    return tx.candidates_by_rank(o, "entity", "rank", "filed_key", 3).select("entity", "o_orderkey", "place")


CANDIDATES_SQL = "select * from (select o_custkey entity, o_orderkey, row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end, o_orderdate::date desc, o_orderkey desc)::int place from orders) where place<=3"

QUERIES = {
    "strip_markup": (stripped, _strip_sql()),
    "sic_normalise": (codes, CODES_SQL),
    "filing_headers": (headed, HEADED_SQL),
    "filing_sections": (sectioned, SECTIONED_SQL),
    "name_variants": (named, _named_sql()),
    "resolved_names": (resolved, _resolved_sql()),
    "scrubbed_text": (scrubbed, SCRUBBED_SQL),
    "deglued_text": (deglued, DEGLUED_SQL),
    "phrase_evidence": (evidence, f"with {EVIDENCE} select doc_id, " + ", ".join(f'"{k}"' for k in PHRASES) + " from ev"),
    "evidence_classes": (classed, _classed_sql()),
    "deal_clauses": (clauses, CLAUSES_SQL),
    "tfidf": (terms, TERMS_SQL),
    "unit_vectors": (units, UNITS_SQL),
    "candidate_filings": (candidates, CANDIDATES_SQL),
}
