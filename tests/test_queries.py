"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import all_queries
from checks.compare import compare

QUERIES, ORACLE = all_queries.QUERIES, all_queries.ORACLE


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    problem = compare(QUERIES[name](spark, sf_dir), duck, ORACLE[name])
    assert problem in (None, "both empty"), problem
