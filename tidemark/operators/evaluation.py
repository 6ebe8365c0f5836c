"""Walk-forward folds, scores of regressions, rankings and classifications, scaling, and small linear fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.crosssection import spearman

#: Observations that the first training window needs, and queries and events that a score needs.
LEAST_TRAIN, LEAST_QUERIES, LEAST_EVENTS = 30, 5, 10


def walk_forward_folds(df: DataFrame, date: str, folds: int, *, embargo_days: int = 0, least_train: int = LEAST_TRAIN) -> DataFrame:
    """fold, train_end, test_start, test_end, n_train, n_test, n_embargoed: expanding folds over the distinct dates.

    The first test block begins at the first date with enough observations before it less the embargo, leaving a date a fold; what
    follows is cut into blocks as even as they go, longer ones first. Only counts by date are ordered. No rows where no split satisfies this.
    """
    per = df.groupBy(F.col(date).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("d")
    line = per.withColumns({"i": F.row_number().over(order), "upto": F.sum("n").over(order), "dates": F.count(F.lit(1)).over(Window.partitionBy())})
    cut = F.date_sub("d", embargo_days)
    before = line.alias("a").join(F.broadcast(per.select(F.col("d").alias("p"), F.col("n").alias("pn"))), F.col("p") < cut, "left")
    trained = before.groupBy("d", "n", "i", "dates").agg(F.coalesce(F.sum("pn"), F.lit(0)).alias("trained"), F.max("p").alias("train_end"))
    first = trained.where((F.col("i") >= 2) & (F.col("i") <= F.col("dates") - folds + 1) & (F.col("trained") >= least_train)).agg(F.min("i").alias("first"))
    tail = trained.crossJoin(F.broadcast(first)).where(F.col("i") >= F.col("first"))
    blocks = tail.withColumn("fold", F.ntile(folds).over(order) - 1)
    agg = blocks.groupBy("fold").agg(F.min("d").alias("test_start"), F.max("d").alias("test_end"), F.min_by("train_end", "d").alias("train_end"), F.min_by("trained", "d").alias("n_train"), F.sum("n").alias("n_test"))
    seen = agg.join(F.broadcast(per), (F.col("d") >= F.date_sub("test_start", embargo_days)) & (F.col("d") < F.col("test_start")), "left")
    return seen.groupBy("fold", "train_end", "test_start", "test_end", "n_train", "n_test").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_embargoed"))


def fold_rows(df: DataFrame, folds: DataFrame, date: str, embargo_days: int) -> DataFrame:
    """Rows of every fold with their part: train strictly before the test less the embargo, test inside it; others are left out."""
    f = folds.select("fold", "test_start", "test_end")
    part = F.when(F.col(date) < F.date_sub("test_start", embargo_days), "train").when(F.col(date).between(F.col("test_start"), F.col("test_end")), "test")
    return df.crossJoin(F.broadcast(f)).withColumn("part", part).where("part is not null").drop("test_start", "test_end")


def validation_dates(df: DataFrame, date: str, share: float = 0.2) -> DataFrame:
    """Distinct dates with whether they are in the last share of them, which is kept for validation."""
    per = df.select(F.col(date).alias("d")).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return per.withColumn("validation", F.row_number().over(Window.orderBy("d")) > n - F.greatest(F.lit(1), F.floor(n * share)))


def regression_scores(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """n, mean absolute and root mean squared error, and rank correlation of each group."""
    gap = F.col(y) - F.col(p)
    errors = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))
    return errors.join(spearman(df, y, p, by, "rank_ic").select(*by, "rank_ic"), by)


def ranked_quality(df: DataFrame, query: str, score: str, grade: str, tie: str, k: int) -> DataFrame:
    """query, ndcg, precision, recall, expected: the ranking by a score, and the gain that a random order would have on average."""
    shown = F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), tie))
    ideal = F.row_number().over(Window.partitionBy(query).orderBy(F.col(grade).desc(), tie))
    gain = lambda place: F.sum(F.when(F.col(place) <= k, F.col(grade) / F.log2(F.col(place) + 1)).otherwise(0.0))
    weight = F.sum(F.when(F.col("_s") <= k, 1 / F.log2(F.col("_s") + 1)).otherwise(0.0))
    hit = F.sum(((F.col("_s") <= k) & (F.col(grade) > 0)).cast("int"))
    relevant = F.sum((F.col(grade) > 0).cast("int"))
    agg = df.withColumns({"_s": shown, "_i": ideal}).groupBy(query).agg(gain("_s").alias("_d"), gain("_i").alias("_m"), (weight * F.avg(grade)).alias("_e"), hit.alias("_h"), relevant.alias("_r"), F.sum((F.col("_s") <= k).cast("int")).alias("_n"))
    some = F.col("_m") > 0
    return agg.select(query, F.when(some, F.col("_d") / F.col("_m")).alias("ndcg"), (F.col("_h") / F.col("_n")).alias("precision"), F.when(F.col("_r") > 0, F.col("_h") / F.col("_r")).alias("recall"), F.when(some, F.col("_e") / F.col("_m")).alias("expected"))


def paired_lift(a: DataFrame, b: DataFrame, query: str, value: str) -> DataFrame:
    """One row: queries, mean and spread of the differences, their error, t and the share of queries won; no error under two queries."""
    met = a.select(query, F.col(value).alias("_a")).join(b.select(query, F.col(value).alias("_b")), query).where("_a is not null and _b is not null").withColumn("_d", F.col("_a") - F.col("_b"))
    out = met.agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean"), F.stddev_samp("_d").alias("sd"), F.avg((F.col("_d") > 0).cast("double")).alias("won"))
    se = F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("sd") / F.sqrt("n"))
    return out.withColumns({"se": se, "t": F.col("mean") / se})


def scaler(df: DataFrame, value: str, by: list[str], *, robust: bool, least: int = 5) -> DataFrame:
    """Centre and scale of a value on training rows: mean and sample spread, or median and population spread; a constant isn't scaled."""
    centre, spread = (F.percentile(value, F.lit(0.5)), F.stddev_pop(value)) if robust else (F.avg(value), F.stddev_samp(value))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), centre.alias("centre"), spread.alias("spread"))
    enough = F.col("n") >= least
    return out.select(*by, F.when(enough, F.col("centre")).otherwise(0.0).alias("centre"), F.when(enough & (F.col("spread") > 0), F.col("spread")).otherwise(1.0).alias("scale"))


def missing_share(*values: Column) -> Column:
    return sum((F.when(v.isNull(), 1).otherwise(0) for v in values), F.lit(0)) / float(len(values))


def means_with_fallback(df: DataFrame, value: str, group: str, least: int = 10) -> DataFrame:
    """group, mean: a group's own mean, or the pooled one where it has too few rows."""
    pooled = df.agg(F.avg(value).alias("_p"))
    own = df.groupBy(group).agg(F.avg(value).alias("_m"), F.count(value).alias("n"))
    return own.crossJoin(F.broadcast(pooled)).select(group, "n", F.when(F.col("n") >= least, F.col("_m")).otherwise(F.col("_p")).alias("mean"))


def trimmed_line(df: DataFrame, x: str, y: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """n, slope and intercept of a straight line through rows whose both sides lie within their percentiles."""
    edges = df.agg(*[F.percentile(c, F.lit(p)).alias(f"_{n}{c}") for c in (x, y) for n, p in (("l", low), ("h", high))])
    kept = df.crossJoin(F.broadcast(edges)).where(F.col(x).between(F.col(f"_l{x}"), F.col(f"_h{x}")) & F.col(y).between(F.col(f"_l{y}"), F.col(f"_h{y}")))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def vasicek(df: DataFrame, beta: str, error: str, by: list[str], least: int = 3) -> DataFrame:
    """Every beta drawn to its group's mean by how sure it is beside the group's spread; unchanged in small or degenerate groups."""
    stats = df.groupBy(*by).agg(F.avg(beta).alias("_m"), F.var_samp(beta).alias("_v"), F.count(beta).alias("_n"), F.min(error).alias("_e"))
    met = df.join(stats, by)
    ok = (F.col("_n") >= least) & (F.col("_e") > 0) & (F.col("_v") > 0)
    w = F.col("_v") / (F.col("_v") + F.col(error) * F.col(error))
    return met.withColumns({"weight": F.when(ok, w).otherwise(1.0), "shrunk": F.when(ok, w * F.col(beta) + (1 - w) * F.col("_m")).otherwise(F.col(beta))}).drop("_m", "_v", "_n", "_e")


def pooled_beta(df: DataFrame, beta: str, error: str, by: list[str], least: int = 3) -> DataFrame:
    """The mean of the shrunk betas weighted by their precision, or the median where they can't be."""
    s = vasicek(df, beta, error, by, least)
    inv = 1 / (F.col(error) * F.col(error))
    out = s.groupBy(*by).agg(F.count(beta).alias("n"), (F.sum(F.when(F.col(error) > 0, F.col("shrunk") * inv)) / F.sum(F.when(F.col(error) > 0, inv))).alias("_w"), F.percentile(beta, F.lit(0.5)).alias("_d"), F.min(error).alias("_e"), F.var_samp(beta).alias("_v"))
    return out.select(*by, "n", F.when((F.col("n") >= least) & (F.col("_e") > 0) & (F.col("_v") > 0), F.col("_w")).otherwise(F.col("_d")).alias("pooled"))


def ridge(df: DataFrame, y: str, xs: list[str], penalty: float = 1.0) -> dict[str, float]:
    """Weights of the closed-form ridge with a free intercept: the sums of products are aggregated, the small system is solved on the driver."""
    import numpy as np

    columns = [F.lit(1.0), *[F.col(c) for c in xs]]
    k = len(columns)
    sums = [F.sum(columns[i] * columns[j]) for i in range(k) for j in range(i, k)] + [F.sum(c * F.col(y)) for c in columns]
    row = df.where(" and ".join(f"`{c}` is not null" for c in [y, *xs])).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    if row["s0"] is None:
        return {}
    values = iter(row)
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = next(values)
    b = np.array(list(values), float)
    a[np.arange(1, k), np.arange(1, k)] += penalty
    return dict(zip(["intercept", *xs], np.linalg.solve(a, b).tolist(), strict=True))


def predicted(df: DataFrame, weights: dict[str, float], out: str = "prediction") -> DataFrame:
    return df.withColumn(out, sum((F.lit(w) if c == "intercept" else F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0)))


def extremes(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The n lowest and n highest rows with their side; both ends are merged from every task's own."""
    low = df.orderBy(F.col(value).asc(), tie).limit(n).withColumn("side", F.lit("low"))
    return low.unionByName(df.orderBy(F.col(value).desc(), tie).limit(n).withColumn("side", F.lit("high")))


def persistence(paths: DataFrame, path: str, growth: float, horizons: int) -> DataFrame:
    """h, n, share: of paths with h years, those that kept at least the growth in each of them."""
    h = paths.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizons)))).where(F.size(path) >= F.col("h"))
    return h.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.avg(F.forall(F.slice(path, F.lit(1), F.col("h")), lambda x: x >= growth).cast("double")).alias("share"))


def base_rates(paths: DataFrame, cagr: str, start: str, size: str, implied: float, at: float, band: float, revenue: float) -> DataFrame:
    """One row: the share of paths that grew as fast as asked, among all, those that started alike and those of like size."""
    hit = (F.col(cagr) >= implied).cast("double")
    alike, like = F.abs(F.col(start) - at) <= band, F.col(size).between(revenue / 2, revenue * 2)
    known = paths.where(F.col(cagr).isNotNull())
    return known.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("all"), F.count(F.when(alike, 1)).alias("n_alike"), F.avg(F.when(alike, hit)).alias("alike"), F.count(F.when(like, 1)).alias("n_like"), F.avg(F.when(like, hit)).alias("like_size"))


def quantile_paths(paths: DataFrame, path: str, cagr: str, tie: str, quantiles: tuple[float, ...], around: float = 0.05) -> DataFrame:
    """quantile, year, growth: the mean path of those around each quantile of the compound growth.

    Bounds round half to even, as places in the sorted order.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = paths.where(F.col(cagr).isNotNull()).withColumns({"_i": F.row_number().over(Window.orderBy(cagr, tie)) - 1, "_n": n})
    q = ranked.withColumn("quantile", F.explode(F.array(*map(F.lit, quantiles))))
    low = F.greatest(F.lit(0), F.bround((F.col("quantile") - around) * (F.col("_n") - 1)))
    high = F.least(F.col("_n") - 1, F.bround((F.col("quantile") + around) * (F.col("_n") - 1)))
    return q.where(F.col("_i").between(low, high)).select("quantile", F.posexplode(path).alias("_y", "_g")).groupBy("quantile", (F.col("_y") + 1).alias("year")).agg(F.avg("_g").alias("growth"), F.count(F.lit(1)).alias("paths"))
