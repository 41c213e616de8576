"""Every registered query agrees with its SQL."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(name, spark, duck, sf_dir):
    assert compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
