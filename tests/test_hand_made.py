"""Hand-made cases: 53-week years, missing quarters, solvers out of reach, NaN, splits, outcome order."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import merger as mg
from tidemark.functions import valuation as v
from tidemark.operators import labels as lb
from tidemark.operators import periods as p
from tidemark.operators import splits as sp

D = dt.date
FACTS = "entity int, start date, end date, val double, form string, filed date, ord int"


def test_a_fourth_quarter_is_what_the_year_leaves(spark):
    f = spark.createDataFrame([(1, D(2020, 1, 1), D(2020, 9, 30), 60.0, "10-Q", D(2020, 11, 1), 0), (1, D(2020, 1, 1), D(2020, 12, 31), 100.0, "10-K", D(2021, 2, 1), 1)], FACTS)
    got = {(r["start"], r["end"]): (r["val"], r["filed"]) for r in p.derived_periods(f, ["entity"]).where("derived is not null").collect()}
    assert got == {(D(2020, 10, 1), D(2020, 12, 31)): (40.0, D(2021, 2, 1))}


def test_quarters_of_a_53_week_year_are_tiled(spark):
    ends = [D(2020, 2, 1), D(2020, 5, 2), D(2020, 8, 1), D(2020, 10, 31), D(2021, 2, 6)]
    rows = [(1, a + dt.timedelta(days=1), b, 10.0, "10-Q", b, i) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
    f = spark.createDataFrame(rows, FACTS)
    as_of = spark.createDataFrame([(1, ends[-1]), (1, D(2030, 1, 1))], "entity int, as_of date")
    got = {r["as_of"]: (r["value"], r["method"]) for r in p.trailing_twelve_months(f, as_of, ["entity"]).collect()}
    assert got[ends[-1]] == (40.0, "4 periods tiled") and got[D(2030, 1, 1)] == (None, None)


def test_solvers_say_when_a_target_is_out_of_reach(spark):
    one = spark.range(1)
    rise = one.select(v.solve_monotone(lambda x: x, F.lit(0.25), 0.0, 1.0).alias("s")).first()["s"]
    far = one.select(v.solve_monotone(lambda x: x, F.lit(3.0), 0.0, 1.0).alias("s")).first()["s"]
    assert rise["root"] == pytest.approx(0.25) and rise["reached"]
    assert far["root"] is None and not far["reached"] and far["edge"] == 1.0


def test_nan_is_missing(spark):
    nan = F.lit(math.nan)
    r = spark.range(1).select(v.ratio(F.lit(1.0), nan).alias("a"), v.growth(F.lit(1.0), nan).alias("b"), v.rating_step(nan)["rating"].alias("c"), v.log_size(nan).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (None, None, "Baa2/BBB", None)


def test_guards_of_shares_and_accretion(spark):
    award = F.array(F.struct(F.lit(10.0).alias("count"), F.lit(None).cast("double").alias("strike")))
    r = spark.range(1).select(v.treasury_shares(F.lit(5.0), F.lit(2.0), award).alias("a"), mg.breakeven_synergies(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.2), 0.0).alias("b"), v.project(*[F.lit(x) for x in (-1.0, 0.1, 0.1, 0.1, 0.1, 0.2)]).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (None, None, None)


def test_one_period_is_no_split(spark):
    rows = [(1, "t", D(2020, 1, 1), D(2020, 3, 31), D(2020, 5, 1), 10.0, 0), (1, "t", D(2020, 1, 1), D(2020, 3, 31), D(2021, 5, 1), 40.0, 1)]
    one = spark.createDataFrame(rows, "entity int, tag string, start date, end date, filed date, val double, ord int")
    assert sp.sightings(one).count() == 1 and sp.brackets(sp.sightings(one)).count() == 0


def test_labels_in_their_order(spark):
    members = spark.createDataFrame([(i, None, None) for i in range(5)], "entity int, admitted date, departed date")
    dates = spark.createDataFrame([(D(2020, 1, 31),)], "as_of date")
    events = spark.createDataFrame([(0, D(2020, 1, 31)), (1, D(2020, 2, 15)), (2, D(2020, 9, 1)), (3, D(2030, 1, 1))], "entity int, announced date")
    run = lambda last: {r["entity"]: r["label"] for r in lb.event_labels(members, dates, events, "entity", last).collect()}
    assert run("2025-01-01") == {0: "after", 1: "in gap", 2: "positive", 3: "negative", 4: "negative"}
    assert run("2020-12-31") == {0: "after", 1: "in gap", 2: "unresolved", 3: "unresolved", 4: "unresolved"}
