"""Numpy folds against the column expressions of the same names."""

import numpy as np
from oracle import DATA
from pyspark.sql import functions as F

from tidemark.functions import folds
from tidemark.functions import valuation as v
from tidemark.plans import registry
from tidemark.plans import valuation as plans


def test_values_and_solver_are_those_of_the_expressions(spark):
    c = plans.company(spark, f"{DATA}/sf0.001").unionByName(plans.company(spark, f"{DATA}/sf0.001").limit(1).withColumn("rev", F.lit(None).cast("double")))
    s = v.solve_monotone(lambda g: plans.value_with(None, g1=g), F.col("price"), -0.2, 0.6, 50)
    rows = c.select(*plans.FIGURES, plans.value_with(None).alias("value"), s.alias("s")).collect()
    x = {k: np.array([np.nan if r[k] is None else r[k] for r in rows], float) for k in plans.FIGURES}
    nan = lambda xs: np.array([np.nan if y is None else y for y in xs], float)
    np.testing.assert_allclose(plans.share_value(x), nan(r["value"] for r in rows), rtol=1e-12)
    root, reached, edge = folds.solve_monotone(lambda g: plans.share_value(x, g1=g), x["price"], -0.2, 0.6, 50)
    np.testing.assert_allclose(root, nan(r["s"]["root"] for r in rows), rtol=1e-9)
    assert reached.tolist() == [r["s"]["reached"] for r in rows] and 0 < reached.sum() < len(rows)
    np.testing.assert_array_equal(edge, nan(r["s"]["edge"] for r in rows))


def test_companies_are_valued_over_many_tasks_and_draws_are_not_dealt(spark):
    for name in ("sensitivity_growth", "sensitivity_exit", "implied_duration", "growth_margin_frontier", "simulation_percentiles"):
        plan = registry.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange ") <= 2 and "Join" not in plan, name


def test_a_repeated_company_pools_its_draws(spark, tmp_path):
    one = spark.read.parquet(f"{DATA}/sf0.001/customer.parquet").limit(3).cache()
    one.unionByName(one.limit(1)).write.parquet(f"{tmp_path}/customer.parquet")
    n = sorted(r.n + r.rejected for r in registry.queries()["simulation_percentiles"](spark, str(tmp_path)).collect())
    assert n == [200, 200, 400]
