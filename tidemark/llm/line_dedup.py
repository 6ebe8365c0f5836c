"""Line dedup: a suffix array over line ids by distributed prefix doubling, in DataFrame expressions only.

A text is the sequence of its lines that hold a word, each named by 128 hash bits. The suffixes of all
sequences are ranked by their first line, then by their first 2, 4, 8, ... lines: the rank of 2k lines is the
place of (rank of k lines here, rank of k lines k places on) among all such pairs in order. Ranks keep the
order of the suffixes. A suffix that no other one equals in k lines needs no further rank and drops out,
so every round works only on what repeats in twice as many lines, and rounds end when nothing does.

Suffixes of one rank at k lines are a longest-common-prefix interval of at least k lines: the
occurrences of one run. Going down again from the longest, each suffix is extended by half as many lines
while another one shares them, which gives its longest common prefix exactly.

Of every interval of at least ``min_lines`` lines, the first place in (doc_id, place) order keeps its run;
every later occurrence that doesn't overlap it in the same document is deleted. Intervals of more lines
lie in those of fewer, so the intervals of exactly ``min_lines`` lines name all lines that go. Single lines
of ``long_words`` words or more go likewise; shorter ones alone (headings, separators) stay. Overlapping
deleted runs join to the maximal repeated runs, reported as spans of line numbers.

Names that only one place has are gone after one aggregation, pre-aggregated in every task. A passage shared
by a third of all documents is one group of an aggregation and one key of a join that AQE splits.

Scale: (name, doc_id, place) rows are shuffled, texts are not unless the lines found are too many to
broadcast (``most_broadcast`` bytes, checked); then they meet in a sort-merge join. Rounds are saved
tables; their number is the logarithm of the longest repeated run.

Defined results: null and empty texts have no lines and pass unchanged (a null stays null); documents
without an id pass unchanged; rows that share an id and a text share their fate, and rows that share
only the id are distinct documents of equal rank; blank lines are never compared, and go with the
deleted line before them; an empty table gives an empty result; all columns of the input are carried,
text replaced, and the result's own names win over clashing ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store

INK = r"[^\x20\x09-\x0D]"
BLANK = r"[\x20\x09-\x0D]+"
OWN = ("n_lines", "n_removed_lines", "longest_run", "removed_spans")
AT = ["_doc", "_print", "_place"]


def _key() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_print")]


def _words_at_least(line: Column, n: int) -> Column:
    """Does a line have so many words; only lines long enough in bytes are split."""
    words = F.size(F.split(F.btrim(line, F.lit(" \t\n\x0b\f\r")), BLANK))
    return F.when(F.octet_length(line) >= 2 * n - 1, words >= n).otherwise(False)


def line_places(documents: DataFrame, long_words: int) -> DataFrame:
    """A row for every line that holds a word: _doc, _print, _place, two hashes of the line, and whether it is long.

    Rows that share an id and a text are one document.
    """
    df = documents.where("doc_id is not null and text is not null").select(*_key(), F.split(F.col("text").cast("string"), "\n", -1).alias("_lines"))
    lines = F.transform(F.filter("_lines", lambda x: x.rlike(INK)), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), _words_at_least(x, long_words).alias("long")))
    # the outer form: an inner one lets the optimizer copy the lines' whole expression into a filter on the scan
    rows = df.select("_doc", "_print", F.posexplode_outer(lines).alias("_place", "_l")).where("_l is not null")
    return rows.select(*AT, F.col("_l.a").alias("_x"), F.col("_l.b").alias("_y"), F.col("_l.long").alias("_long"))


def _ranked(places: DataFrame, also: list[str]) -> DataFrame:
    """Places whose pair (_x, _y) others have too: their place, the pair's _rank in the order of pairs, and the first place that has it.

    The ranks are the running numbers of the pairs sorted by ranges, so they keep the order and needn't be without gaps. Repeated
    rows of one document are one place.
    """
    n = F.count(F.lit(1)).alias("_n")
    least, most = F.struct("_doc", "_place", "_print"), F.struct("_doc", "_place", "_print")
    shared = places.groupBy("_x", "_y").agg(F.min(least).alias("_first"), F.max(most).alias("_last"), n).where("_n > 1 and _first <> _last").select("_x", "_y", "_first")
    ordered = shared.repartitionByRange("_x", "_y").sortWithinPartitions("_x", "_y")
    ranks = store.save(ordered.withColumn("_rank", F.monotonically_increasing_id()), "ranks")
    return store.save(places.join(ranks, ["_x", "_y"]).select(*AT, *also, "_rank", "_first").distinct(), "suffixes")


def suffix_ranks(documents: DataFrame, long_words: int) -> list[DataFrame]:
    """For 1, 2, 4, ... lines the repeated suffixes with their ranks and the first of each rank; the last list entry holds some."""
    levels = [_ranked(line_places(documents, long_words), ["_long"])]
    while not levels[-1].isEmpty():
        k = 2 ** (len(levels) - 1)
        here = levels[-1].select(*AT, F.col("_rank").alias("_x"))
        there = levels[-1].select("_doc", "_print", (F.col("_place") - k).alias("_place"), F.col("_rank").alias("_y"))
        levels.append(_ranked(here.join(there, AT), []))
    return levels[:-1]


def longest_runs(levels: list[DataFrame]) -> DataFrame:
    """_doc, _print and _longest: the longest common prefix, in lines, of any of a document's suffixes with another one."""
    top = len(levels) - 1
    state = levels[top].select(*AT, "_rank", F.lit(2**top).alias("_length"))
    for j in range(top - 1, -1, -1):
        k = 2**j
        step = levels[j].select(*AT, "_rank")
        fresh = step.join(state.select(*AT), AT, "left_anti").select(*AT, "_rank", F.lit(k).alias("_length"))
        ahead = step.select("_doc", "_print", F.col("_place").alias("_to"), F.col("_rank").alias("_y"))
        pairs = state.withColumn("_to", F.col("_place") + F.col("_length")).join(ahead, ["_doc", "_print", "_to"])
        shared = pairs.groupBy("_length", "_rank", "_y").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_doc", "_place", "_print")).alias("_id")).where("_n > 1")
        # a longer prefix is named by its first place, which no other prefix of its length has
        longer = pairs.join(shared, ["_length", "_rank", "_y"]).select(*AT, F.xxhash64("_id", "_length").alias("_r2"), (F.col("_length") + k).alias("_l2"))
        state = state.join(longer, AT, "left").select(*AT, F.coalesce("_r2", "_rank").alias("_rank"), F.coalesce("_l2", "_length").alias("_length"))
        state = store.save(state.unionByName(fresh), "prefixes")
    return state.groupBy("_doc", "_print").agg(F.max("_length").alias("_longest"))


def repeated_lines(documents: DataFrame, min_lines: int = 2, long_words: int = 50) -> DataFrame:
    """_doc, _print, _longest and _covered, the places of lines to delete, for every document with a repeated line; a saved table."""
    if min_lines & (min_lines - 1):
        raise ValueError("min_lines is a power of two")
    levels = suffix_ranks(documents, long_words)
    if not levels:
        return documents.sparkSession.createDataFrame([], "_doc long, _print long, _longest int, _covered array<int>")

    def gone(level: DataFrame, size: int) -> DataFrame:
        later = (F.col("_doc") > F.col("_first._doc")) | ((F.col("_doc") == F.col("_first._doc")) & (F.col("_place") >= F.col("_first._place") + size))
        return level.where(later).select("_doc", "_print", F.explode(F.sequence(F.col("_place"), F.col("_place") + size - 1)).alias("_place"))

    found = gone(levels[0].where("_long"), 1)
    j = min_lines.bit_length() - 1
    if j < len(levels):
        found = found.unionByName(gone(levels[j], min_lines))
    lines = found.groupBy("_doc", "_print").agg(F.sort_array(F.collect_set("_place")).alias("_covered"))
    return store.save(longest_runs(levels).join(lines, ["_doc", "_print"], "left"), "line-runs")


def _spans(gone: str) -> Column:
    """Runs of consecutive line numbers as (first, last) pairs."""
    begins = F.filter(F.transform(gone, lambda g, i: F.when(F.coalesce(F.get(gone, i - 1) != g - 1, F.lit(True)), g)), lambda g: g.isNotNull())
    ends = F.filter(F.transform(gone, lambda g, i: F.when(F.coalesce(F.get(gone, i + 1) != g + 1, F.lit(True)), g)), lambda g: g.isNotNull())
    return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def drop_repeated_lines(documents: DataFrame, *, min_lines: int = 2, long_words: int = 50, most_broadcast: int = 16 << 20) -> DataFrame:
    """All columns of the input with the text that is left, n_lines, n_removed_lines, longest_run and removed_spans."""
    found = repeated_lines(documents, min_lines, long_words)
    n = found.agg(F.sum(F.greatest(F.size("_covered"), F.lit(0)) + 8)).first()[0] or 0
    found = F.broadcast(found) if 4 * n <= most_broadcast else found
    columns = [c for c in documents.columns if c not in OWN]
    left = documents.select(*columns, F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_p"))
    df = left.join(found, (F.col("_d") == F.col("_doc")) & (F.col("_p") == F.col("_print")), "left")
    df = df.withColumn("_lines", F.split(F.col("text").cast("string"), "\n", -1))
    ink = F.filter(F.transform("_lines", lambda line, i: F.when(line.rlike(INK), i)), lambda i: i.isNotNull())
    df = df.withColumn("_at", F.when(F.col("text").isNotNull(), ink))
    df = df.withColumn("_starts", F.when(F.col("_covered").isNotNull(), F.col("_at")))
    # a covered line goes with the blank lines behind it
    stop = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_lines")) - 1
    df = df.withColumn("_gone", F.flatten(F.transform("_covered", lambda k: F.sequence(F.get("_starts", k), stop(k)))))
    df = df.withColumn("_kept", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"))
    text = F.when(F.col("_covered").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n"))
    pairs = F.array().cast("array<struct<first:int,last:int>>")
    own = {
        "text": text,
        "n_lines": F.coalesce(F.size("_at"), F.lit(0)).cast("long"),
        "n_removed_lines": F.coalesce(F.size("_covered"), F.lit(0)).cast("long"),
        "longest_run": F.coalesce("_longest", F.lit(0)).cast("long"),
        "removed_spans": F.when(F.col("_covered").isNull(), pairs).otherwise(_spans("_gone")),
    }
    return df.withColumns({c: store.settled(x) for c, x in own.items()}).select(*columns, *OWN)
