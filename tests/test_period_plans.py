"""Period queries deal their facts once and meet them in one join, however many tiles a window may have."""

import pytest
from oracle import DATA

from tidemark.plans import registry


@pytest.mark.parametrize(("name", "joins", "exchanges"), [("quarterly_series", 0, 2), ("cover_window", 1, 2), ("ttm_flow", 1, 2), ("ttm_average", 1, 2)])
def test_facts_are_dealt_once(spark, name, joins, exchanges):
    plan = registry.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == joins and plan.count("Exchange ") == exchanges


def test_a_trailing_year_over_periods_of_odd_keys(spark):
    """A null key derives nothing, a null value gives none, and dates that are asked twice are answered twice."""
    from tidemark.operators import periods as p

    rows = [(None, "2020-01-01", "2020-06-30", 1.0), (None, "2020-01-01", "2020-12-31", 3.0), (1, "2020-01-01", "2020-06-30", 1.0), (1, "2020-01-01", "2020-12-31", None), (1, "2019-07-01", "2019-12-31", 5.0)]
    f = spark.createDataFrame([(e, s, t, x, "10-K", "2021-01-01", i) for i, (e, s, t, x) in enumerate(rows)], "entity int, start string, end string, val double, form string, filed string, ord int")
    f = f.selectExpr("entity", "date(start) start", "date(end) end", "val", "form", "date(filed) filed", "ord")
    assert [(r.entity, r.val) for r in p.derived_periods(f, ["entity"]).where("derived is not null").collect()] == [(1, None)]
    as_of = spark.sql("select * from values (1, date '2020-06-30'), (1, date '2020-06-30'), (1, date '2020-12-31'), (2, date '2020-12-31') t(entity, as_of)")
    got = sorted((r.entity, str(r.as_of), r.value, r.method) for r in p.trailing_twelve_months(f, as_of, ["entity"]).collect())
    w = as_of.selectExpr("entity", "date_sub(as_of, 364) `from`", "as_of `to`")
    both = [sorted(map(str, x.collect())) for x in (p.cover_window(p.derived_periods(f, ["entity"]), w, ["entity"]), p.cover_derived(f, w, ["entity"]))]
    assert both[0] == both[1] and len(both[0]) == 4
    assert got == [(1, "2020-06-30", 6.0, "2 periods tiled")] * 2 + [(1, "2020-12-31", None, "single filed annual period"), (2, "2020-12-31", None, None)]
