"""Splits: versions are made in many tasks and dealt by entity, and a filing's basis is the vote of its later ones."""

from oracle import DATA
from pyspark.sql import functions as F

from tidemark.operators import splits as sp
from tidemark.plans import facts, registry


def test_versions_are_not_dealt_again_for_their_pairs(spark):
    plan = registry.queries()["split_basis"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("ENSURE_REQUIREMENTS") == 0


def test_the_larger_of_equal_votes_and_the_brackets_without_any(spark):
    rows = [("a", 1, "2020-01-01", 10.0), ("a", 1, "2021-01-01", 20.0), ("b", 2, "2020-01-01", 10.0), ("b", 2, "2022-01-01", 10.0), (None, 3, "2019-01-01", 7.0)]
    v = spark.createDataFrame([(1, t, p, d, x, i) for i, (t, p, d, x) in enumerate(rows)], "entity int, tag string, p int, d string, val double, ord int")
    v = v.select("entity", "tag", F.lit(None).cast("date").alias("start"), F.make_date(2000 + F.col("p"), F.lit(1), F.lit(1)).alias("end"), F.to_date("d").alias("filed"), "val", "ord")
    ordered = spark.sql("select 1 entity, array(named_struct('hi', date '2020-06-01', 'lo', date '2020-02-01', 'factor', 2.0D)) b, array(2.0D, 1.0D) products")
    got = {str(r.filed): r.basis for r in sp.basis_by_filing(v, ordered).collect()}
    assert got == {"2022-01-01": 1.0, "2021-01-01": 1.0, "2020-01-01": 2.0, "2019-01-01": 2.0}


def test_thresholds_bring_no_table_of_filings_to_the_driver(spark):
    plan = registry.queries()["split_thresholds"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan


def test_tasks_of_versions_grow_with_the_customers(spark, monkeypatch):
    monkeypatch.setattr(facts, "TASK_CUSTOMERS", 2)
    assert facts.versions(spark, f"{DATA}/sf0.001").rdd.getNumPartitions() >= 75


def test_adjustment_brings_no_thresholds_to_the_driver(spark):
    plan = registry.queries()["split_adjusted"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan
