"""Every registered analytics query against its oracle SQL."""

import pytest
from oracle import DATA, compare, duck

from tidemark.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck("sf0.001")


def test_every_query_but_a_fit_has_an_oracle():
    assert set(registry.queries()) - set(SQL) == {"ridge_weights"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match(spark, con, name):
    assert compare(registry.queries()[name](spark, f"{DATA}/sf0.001"), SQL[name], con) == ""
