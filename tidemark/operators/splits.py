"""Share splits read off restated share counts: sightings, brackets, the basis of every filing, adjustment.

Versions are rows (entity, tag, start, end, filed, val) of one period as it was reported again and again. A split is a ratio a board
declares between two versions of a period in filing order; all versions of one filing are on one basis. What is walked in
order is one entity's handful of sightings and filings, so those folds run in the entity's own row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ratios that boards declare, how near a ratio must come to be one of them, and to be a product of them.
RATIOS = (2.0, 3.0, 4.0, 5.0, 10.0, 20.0, 1.5, 2.5, 0.5, 0.1, 0.05)
MATCH, SNAP = 0.005, 0.01
NONE = -(1 << 30)


def usable(versions: DataFrame) -> DataFrame:
    return versions.where("val is not null and val <> 0 and end is not null and filed is not null")


def version_pairs(versions: DataFrame) -> DataFrame:
    """Consecutive versions of every period in filing order: entity, start, end, older, newer, ratio."""
    w = Window.partitionBy("entity", "tag", "start", "end").orderBy("filed", "ord")
    both = usable(versions).withColumns({"older": F.lag("filed").over(w), "_v": F.lag("val").over(w)})
    return both.where("older is not null").select("entity", "tag", "start", "end", "older", F.col("filed").alias("newer"), (F.col("val") / F.col("_v")).alias("ratio"))


def sightings(versions: DataFrame) -> DataFrame:
    """Pairs whose ratio is one a board declares: entity, factor, older, newer, start, end, each once."""
    found = F.coalesce(*[F.when(F.abs(F.col("ratio") - r) < MATCH * r, F.lit(r)) for r in RATIOS])
    return version_pairs(versions).withColumn("factor", found).where("factor is not null").select("entity", "factor", "older", "newer", "start", "end").distinct()


def brackets(seen: DataFrame) -> DataFrame:
    """Sightings whose intervals (older, newer] share a day are one split: entity, factor, lo, hi; one period alone is none.

    A split's sightings are walked in order while their intersection isn't empty, so each cluster's bounds are a running
    greatest and least, kept in a fold over the sorted sightings of one factor of one entity.
    """
    kind = "array<struct<lo:date,hi:date,n:int>>"
    item = F.struct("older", "newer", F.coalesce("start", F.lit("0001-01-01").cast("date")).alias("start"), "end")
    listed = seen.groupBy("entity", "factor").agg(F.array_sort(F.collect_set(item)).alias("s"))
    period = lambda x: F.concat_ws("/", x["start"], x["end"])
    none = F.lit(None).cast("date")
    start = F.struct(none.alias("lo"), none.alias("hi"), F.array().cast("array<string>").alias("seen"), F.array().cast(kind).alias("out"))
    flush = lambda s: F.when(s["lo"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), F.size(s["seen"]).alias("n")))))

    def step(s: Column, x: Column) -> Column:
        lo, hi = F.greatest(s["lo"], x["older"]), F.least(s["hi"], x["newer"])
        joins = s["lo"].isNotNull() & (lo < hi)
        more = F.struct(lo.alias("lo"), hi.alias("hi"), F.array_union(s["seen"], F.array(period(x))).alias("seen"), s["out"].alias("out"))
        fresh = F.struct(x["older"].alias("lo"), x["newer"].alias("hi"), F.array(period(x)).alias("seen"), flush(s).alias("out"))
        return F.when(joins, more).otherwise(fresh)

    spans = listed.select("entity", "factor", F.explode(F.aggregate("s", start, step, flush)).alias("b"))
    return spans.where("b.n >= 2").select("entity", "factor", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))


def ordered_brackets(found: DataFrame) -> DataFrame:
    """One row an entity: its brackets, oldest first, and the products of the factors still to come before and after each."""
    listed = found.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("hi", "lo", "factor"))).alias("b"))
    product = lambda xs: F.aggregate(xs, F.lit(1.0), lambda p, x: p * x["factor"])
    steps = F.transform(F.sequence(F.lit(0), F.size("b")), lambda j: product(F.slice("b", j + 1, F.greatest(F.size("b") - j, F.lit(0)))))
    return listed.withColumn("products", steps)


def snapped(ratio: Column, products: Column) -> Column:
    """The first product within a hundredth of the ratio; null where it is none of them: an ordinary restatement."""
    return F.get(F.filter(products, lambda p: F.abs(ratio - p) <= SNAP * p), F.lit(0))


def basis_by_filing(versions: DataFrame, ordered: DataFrame) -> DataFrame:
    """entity, filed, basis: by how much a filing's share counts lag behind the newest.

    Filings are walked from the newest: each takes, of the later filings it shares a period with, the basis that most of their ratios give, the
    larger of equal votes; without any, the product of splits whose bracket ends after it.
    """
    v = usable(versions).join(ordered.select("entity").hint("shuffle_hash"), "entity", "left_semi").select("entity", "tag", "start", "end", "filed", "val")
    period = v.groupBy("entity", "tag", "start", "end").agg(F.collect_list(F.struct("filed", "val")).alias("vs"))
    alone = lambda o: F.array(F.struct(o["filed"].alias("filed"), F.lit(None).cast("date").alias("later"), F.lit(None).cast("double").alias("ratio")))
    after = lambda o: F.filter("vs", lambda n: F.col("tag").isNotNull() & (n["filed"] > o["filed"]))
    each = lambda o: F.concat(alone(o), F.transform(after(o), lambda n: F.struct(o["filed"].alias("filed"), n["filed"].alias("later"), (n["val"] / o["val"]).cast("double").alias("ratio"))))
    pairs = period.select("entity", F.flatten(F.transform("vs", each)).alias("f"))
    listed = pairs.groupBy("entity").agg(F.flatten(F.collect_list("f")).alias("f")).join(ordered.hint("shuffle_hash"), "entity")
    walk = F.arrow_udf(_walked, "array<struct<filed:date,basis:double>>")
    return listed.select("entity", F.inline(walk("f", "b", "products")))


def _walked(pairs: pa.Array, brackets: pa.Array, products: pa.Array) -> pa.Array:
    """Filings of every entity with their bases; ``pairs`` has a filing's later ones and the ratios to them, or nulls."""
    out_at, out_filed, out_basis = [0], [], []
    ends = [x.value_lengths().to_numpy(zero_copy_only=False).cumsum() for x in (pairs, brackets, products)]
    f, b, steps = pairs.flatten(), brackets.flatten(), products.flatten().to_numpy(zero_copy_only=False)
    day = lambda x: x.cast(pa.int32()).fill_null(NONE).to_numpy(zero_copy_only=False)
    filed, later, ratio = day(f.field("filed")), day(f.field("later")), f.field("ratio").to_numpy(zero_copy_only=False)
    his, factors = day(b.field("hi")).tolist(), b.field("factor").to_pylist()
    i0 = b0 = p0 = 0
    for i1, b1, p1 in zip(*(e.tolist() for e in ends), strict=True):
        # the first product within a hundredth of the ratio
        r, q = ratio[i0:i1, None], steps[None, p0:p1]
        near = np.abs(r - q) <= SNAP * q
        step = np.where(near.any(axis=1), steps[p0:p1][near.argmax(axis=1)], np.nan)
        order = np.argsort(-filed[i0:i1].astype(np.int64), kind="stable")
        days, afters, ways = filed[i0:i1][order].tolist(), later[i0:i1][order].tolist(), step[order].tolist()
        known: dict[int, float] = {}
        at, n = 0, len(days)
        while at < n:
            d, votes = days[at], {}
            while at < n and days[at] == d:
                if ways[at] == ways[at] and afters[at] in known:
                    y = ways[at] * known[afters[at]]
                    votes[y] = votes.get(y, 0) + 1
                at += 1
            if votes:
                known[d] = max(votes, key=lambda y: (votes[y], y))
            else:
                own = 1.0
                for hi, factor in zip(his[b0:b1], factors[b0:b1], strict=True):
                    own = own * factor if d < hi else own
                known[d] = own
        out_filed += known.keys()
        out_basis += known.values()
        out_at.append(len(out_filed))
        i0, b0, p0 = i1, b1, p1
    items = pa.StructArray.from_arrays([pa.array(out_filed, pa.int32()).cast(pa.date32()), pa.array(out_basis, pa.float64())], ["filed", "basis"])
    return pa.ListArray.from_arrays(pa.array(out_at, pa.int32()), items)


def split_thresholds(ordered: DataFrame, basis: DataFrame) -> DataFrame:
    """entity, threshold, factor: what was filed before the threshold is multiplied by the factor.

    A bracket is narrowed by every filing whose basis is known, from below by those still on the old one and from above by those on the new; where the evidence
    contradicts itself the bracket's own end stays. Brackets are hinted to hash tables of their tasks: rows made by an explode
    have no honest estimate, and one row a filing, taken for small, went through the driver to every task.
    """
    met = basis.join(ordered.hint("shuffle_hash"), "entity").withColumn("at", F.array_position("products", snapped(F.col("basis"), F.col("products"))) - 1).where("at >= 0")
    each = met.select("entity", "filed", "at", F.posexplode("b").alias("k", "x"))
    narrowed = each.groupBy("entity", "k", "x").agg(F.max(F.when(F.col("k") >= F.col("at"), F.col("filed"))).alias("_lo"), F.min(F.when(F.col("k") < F.col("at"), F.col("filed"))).alias("_hi"))
    lo, hi = F.greatest(F.col("x.lo"), "_lo"), F.least(F.col("x.hi"), "_hi")
    return narrowed.select("entity", F.when(lo < hi, hi).otherwise(F.col("x.hi")).alias("threshold"), F.col("x.factor").alias("factor"))


def split_adjusted(facts: DataFrame, thresholds: DataFrame, value: str = "val", unit: str = "unit") -> DataFrame:
    """facts with share counts and per-share figures on the newest basis; other units are left as they are.

    Thresholds, one row an entity after their grouping, are hinted to hash tables of their tasks and are never broadcast.
    """
    listed = thresholds.groupBy(F.col("entity").alias("_e")).agg(F.collect_list(F.struct("threshold", "factor")).alias("_t"))
    factor = F.aggregate(F.coalesce("_t", F.array().cast("array<struct<threshold:date,factor:double>>")), F.lit(1.0), lambda p, t: F.when(F.col("filed") < t["threshold"], p * t["factor"]).otherwise(p))
    met = facts.join(listed.hint("shuffle_hash"), F.col("entity") == F.col("_e"), "left").withColumn("_f", factor)
    return met.withColumn(value, F.when(F.col(unit) == "shares", F.col(value) * F.col("_f")).when(F.col(unit) == "USD/shares", F.col(value) / F.col("_f")).otherwise(F.col(value))).drop("_e", "_t", "_f")
