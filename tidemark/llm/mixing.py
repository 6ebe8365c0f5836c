"""Mixing sources to target weights by a proportionate-fair schedule of blocks.

Documents of a source are put in a seeded hash order and cut into blocks of ``block`` documents. In the
ideal, fluid mix all sources run at once at rates in proportion to their weights, and when one runs
out the others share its rate. Block i of a source may run from the slot in which the fluid mix begins
it and must run by the slot in which that ends it: while no source has run out, from floor((i - 1) / w)
to before ceil(i / w) at its share w. In every slot, of the blocks released, the one with the earliest
deadline runs. As the fluid mix does each block in its window, all deadlines are met and no slot stays
empty, so at any slot every source is within less than one block of its target share.

Weights are taken as exact fractions and windows are whole-number arithmetic, so nothing is rounded to
a frame and no error builds up. The schedule is made on the driver: a few steps a block, its working
memory by sources, its result one number a block in rows of ``frame`` blocks, which are sent to every
task up to ``MOST_PLANNED`` blocks and else written in parts and joined.

Scale: texts are not shuffled to be ranked. A document's rank in its source is its rank in a hash
bucket of that source plus the sizes of the buckets before; buckets hold about ``bucket`` documents
however large a source is, so a source with a third of all rows is spread like any other.

Defined results: a null source is a source of its own; sources without a given weight take the mean
of those given; weights must be positive; repeated rows are placed one by one; ties in the hash go
by doc_id; an empty table gives an empty result; all columns are carried, and the result's own names
win over clashing ones.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import reduce
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import store

OWN = ("block", "slot", "position")
#: Blocks in the plan up to which it is sent to every task; beyond, parts of so many are written.
MOST_PLANNED = 2_000_000


def frame_shares(weights: Mapping, frame: int) -> dict:
    """Whole slots a frame for every source: largest remainders, at least one each. Not the targets, and not used by mix_sources."""
    total = sum(weights.values())
    frame = max(frame, len(weights))
    spare = frame - len(weights)
    exact = {s: spare * w / total for s, w in weights.items()}
    slots = {s: 1 + int(e) for s, e in exact.items()}
    by_rest = sorted(weights, key=lambda s: (int(exact[s]) - exact[s], repr(s)))
    for s in by_rest[: frame - sum(slots.values())]:
        slots[s] += 1
    return slots


def schedule(blocks: Mapping, weights: Mapping) -> Iterator:
    """The source of every slot, by earliest deadline first among released blocks."""
    order = sorted((s for s in blocks if blocks[s]), key=repr)
    exact = [Fraction(str(weights[s])) for s in order]
    whole = lcm(*(w.denominator for w in exact))
    rate = [int(w * whole) for w in exact]
    count = [blocks[s] for s in order]
    # the fluid mix has done count / rate of every source at once: a source runs out when that is its own
    ends = sorted(range(len(order)), key=lambda k: Fraction(count[k], rate[k]))
    ended, alive = [0], [sum(rate)]
    for k in ends:
        ended.append(ended[-1] + count[k])
        alive.append(alive[-1] - rate[k])
    at, done = [0] * len(order), [0] * len(order)

    def window(k: int) -> tuple[int, int]:
        """Release and deadline of the next block of a source; the fluid time is ended + i * alive / rate."""
        j, i, r = at[k], done[k], rate[k]
        while i * rate[ends[j]] > count[ends[j]] * r:
            j += 1
        begin = ended[j] + i * alive[j] // r
        i += 1
        while i * rate[ends[j]] > count[ends[j]] * r:
            j += 1
        at[k] = j
        return begin, ended[j] - (-i * alive[j] // r)

    waiting, ready = [], []
    for k in range(len(order)):
        begin, deadline = window(k)
        heapq.heappush(waiting, (begin, deadline, k))
    for t in range(sum(count)):
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        deadline, k = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a block missed its deadline")
        yield order[k]
        done[k] += 1
        if done[k] < count[k]:
            begin, deadline = window(k)
            heapq.heappush(waiting, (begin, deadline, k))


def edf_frame(slots: Mapping) -> dict:
    """The slot of every block in one frame of whole slots a source."""
    out: dict = {s: [] for s in slots}
    for t, s in enumerate(schedule(slots, slots)):
        out[s].append(t)
    return out


def planned(blocks: Mapping, weights: Mapping, frame: int, most: int) -> Iterator[list[tuple]]:
    """Rows (source, number of the row in its source, slots of up to ``frame`` blocks), about ``most`` blocks at a time."""
    open_rows: dict = {s: array("q") for s in blocks}
    number = dict.fromkeys(blocks, 0)
    rows: list[tuple] = []
    held = 0
    for t, s in enumerate(schedule(blocks, weights)):
        row = open_rows[s]
        row.append(t)
        if len(row) == frame:
            rows.append((s, number[s], row))
            number[s] += 1
            open_rows[s] = array("q")
            held += frame
            if held >= most:
                yield rows
                rows, held = [], 0
    yield rows + [(s, number[s], row) for s, row in open_rows.items() if row]


def _plan_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    names = ("_planned", "_frame", "_places")
    types = (pa.string(), pa.int64(), pa.list_(pa.int64()))
    return spark.createDataFrame(pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names))


def mix_sources(documents: DataFrame, *, weights: Mapping | None = None, temperature: float = 0.5, block: int = 16, frame: int = 1000, bucket: int = 20_000, seed: int = 7) -> DataFrame:
    """All columns and block (number in its source), slot and position (unique order key: slot, then rank in the block).

    Without weights, a source's weight is its number of documents to the power ``temperature``.
    """
    spark = documents.sparkSession
    columns = [c for c in documents.columns if c not in OWN]
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    keyed = documents.select(*columns).withColumns({"_key": key, "_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))})
    sizes = {r["_source"]: r["n"] for r in keyed.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return documents.select(*columns).withColumns({"block": F.lit(0).cast("long"), "slot": F.lit(0).cast("long"), "position": F.lit(0).cast("long")})
    if weights is not None:
        given = {"-" if s is None else f"={s}": float(w) for s, w in weights.items()}
        if min(given.values()) <= 0:
            raise ValueError("weights are positive")
        mean = sum(given.values()) / len(given)
        share = {s: given.get(s, mean) for s in sizes}
    else:
        share = {s: n**temperature for s, n in sizes.items()}
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    small = sum(blocks.values()) <= MOST_PLANNED
    parts = [_plan_table(spark, rows) if small else store.save(_plan_table(spark, rows), "plan") for rows in planned(blocks, share, frame, MOST_PLANNED) if rows]
    table = reduce(DataFrame.unionByName, parts)

    buckets = max(1, -(-sum(sizes.values()) // bucket))
    in_bucket = F.pmod(F.shiftrightunsigned("_key", 8), F.lit(buckets))
    keyed = keyed.withColumn("_bucket", in_bucket)
    counts = keyed.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_source", "_bucket", before.alias("_before"))
    order = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", F.xxhash64(*columns))
    ranked = keyed.withColumn("_row", F.row_number().over(order)).join(offsets, ["_source", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row") - 1).withColumn("block", F.floor(F.col("_rank") / block))
    ranked = ranked.withColumn("_in", F.floor(F.col("block") / frame))
    table = F.broadcast(table) if small else table
    placed = ranked.join(table, (F.col("_source") == F.col("_planned")) & (F.col("_in") == F.col("_frame")))
    placed = placed.withColumn("slot", F.get("_places", F.pmod(F.col("block"), F.lit(frame)).cast("int")))
    position = F.col("slot") * block + F.pmod(F.col("_rank"), F.lit(block))
    return placed.withColumn("position", position).select(*columns, *(F.col(c).cast("long").alias(c) for c in OWN))


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """The rows in the order of the schedule, dealt by ranges of it, so files and partitions keep it."""
    return mixed.repartitionByRange("position").sortWithinPartitions("position")
