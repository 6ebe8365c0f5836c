"""Registered queries against their oracle SQL, and the pipeline's stages against each other."""

import pytest
from oracle import DATA, compare, duck

from tidemark.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match(spark, name):
    assert compare(registry.queries()[name](spark, f"{DATA}/sf0.001"), SQL[name], duck("sf0.001")) == ""


def test_there_is_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        docs = p.store.save(stage(spark, docs, ""), name)
        left = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and set(left) <= ids and len(left) == len(set(left)), name
        if name == "mix_sources":
            assert set(left) == ids
        ids = set(left)
    packed = p.STAGES[-1][1](spark, docs, "")
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids
