"""Headers of a text are searched once, however many sections there are."""

from oracle import DATA

from tidemark.plans import registry


def test_one_search_a_text(spark):
    plan = registry.queries()["filing_sections"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("regexp_extract_all") <= 2
