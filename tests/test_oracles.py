"""Every query against its DuckDB SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.compare import connect, difference
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(name, spark, sf_dir, duck):
    assert difference(queries()[name](spark, sf_dir), duck, oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0
