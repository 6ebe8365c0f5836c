"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round rewires edges towards the smallest node each neighbourhood has seen; when nothing changes,
every edge joins a node to its component's smallest. A hot node is a key of pre-aggregated minima and of
joins that AQE splits; no group of neighbours is ever gathered. Rounds are saved tables, so a lost
executor costs a re-read, and their number is logarithmic in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One round: (u, v) with v < u on both sides of the rewiring."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("k"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _stamp(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of a pair with the smallest node it is linked to, as a saved table."""
    first = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = store.save(first, "edges")
    stamp = _stamp(edges)
    while stamp[0]:
        turned = store.save(_starred(_starred(edges, True), False), "edges")
        store.discard(edges)
        edges, before = turned, stamp
        stamp = _stamp(edges)
        if stamp == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
