"""Small hand-made cases: ties, refusals, empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import valuation as v
from tidemark.operators import crosssection as cs
from tidemark.operators import pointintime as pit
from tidemark.operators import series

D = dt.date


def test_version_is_chosen_among_those_known(spark):
    f = spark.createDataFrame([(1, "10-Q", D(2020, 5, 1), 1.0), (1, "10-K", D(2021, 2, 1), 2.0), (1, "S-4", D(2021, 6, 1), 3.0)], "p int, form string, filed date, value double")
    rank = F.when(F.col("form").isin("10-K", "10-Q"), 0).otherwise(1)
    pick = lambda day: [r["value"] for r in pit.choose_versions(f, ["p"], rank, "filed", [F.col("value")], day).collect()]
    assert pick("2020-12-31") == [1.0] and pick("2022-01-01") == [2.0] and pick("2019-01-01") == []


def test_zero_does_not_end_a_ladder(spark):
    f = spark.createDataFrame([(1, "a", D(2020, 1, 1), 0.0), (1, "b", D(2020, 1, 1), 5.0), (2, "a", D(2020, 1, 1), 0.0), (3, "a", D(2018, 1, 1), 9.0)], "e int, tag string, date date, value double")
    got = {r["e"]: (r["tag"], r["value"], r["reason"]) for r in pit.first_usable(f, ["e"], "tag", ["a", "b"], "date", "value", "2020-01-05", 20).collect()}
    assert got == {1: ("b", 5.0, None), 2: ("a", 0.0, None), 3: (None, None, "no tag within tolerance")}


def test_asof_keeps_rows_without_a_match(spark):
    left = spark.createDataFrame([(1, D(2020, 1, 2)), (1, D(2019, 1, 1)), (2, D(2020, 1, 1))], "symbol int, as_of date")
    right = spark.createDataFrame([(1, D(2020, 1, 1), 5.0), (1, D(2020, 1, 2), 6.0)], "symbol int, date date, close double")
    got = sorted((r["symbol"], r["as_of"], r["close"]) for r in series.asof(left, right, "symbol", "as_of", "date", "close").collect())
    assert got == [(1, D(2019, 1, 1), None), (1, D(2020, 1, 2), 6.0), (2, D(2020, 1, 1), None)]


def test_spearman_refuses_and_shares_ranks(spark):
    rows = [("t", 1.0, 2.0), ("t", 1.0, 1.0), ("t", 2.0, 3.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0), ("s", 1.0, 1.0), ("s", 2.0, 2.0)]
    got = {r["g"]: r["ic"] for r in cs.spearman(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    assert got["c"] is None and got["s"] is None and got["t"] == pytest.approx(0.8660254)


@pytest.mark.parametrize("n", [1, 4, 5, 6, 9, 10])
def test_leave_one_out_median(spark, n):
    import statistics

    values = [float(x * x % 13) for x in range(n)]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(values)], "g string, i int, x double")
    got = {r["i"]: r["loo_median"] for r in cs.leave_one_out_median(df, "x", ["g"], "i").collect()}
    for i in range(n):
        rest = values[:i] + values[i + 1 :]
        assert got[i] == (statistics.median(rest) if len(rest) >= 4 else None)


def test_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -2.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(v.ratio(F.col("a"), F.col("b"))).collect()] == [0.5, None, None, None]
    one = spark.range(1)
    assert one.select(v.dcf_value(*[F.lit(x) for x in (100.0, 0.1, 0.03, 0.1, 0.2, 0.25, 0.02, 0.025)], 5)).first()[0] is None
    assert one.select(v.rating_step(F.lit(None).cast("double"))["rating"]).first()[0] == "Baa2/BBB"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "symbol int, date date, close double")
    assert series.weekly_returns(empty).count() == 0
    assert cs.calibration(spark.createDataFrame([], "y int, p double"), "y", "p").agg(F.sum("n")).first()[0] == 0
