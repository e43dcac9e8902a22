"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, sf_dir).count() > 0
        return
    ok, message = compare(spark, duck, sf_dir, QUERIES[name], ORACLES[name])
    assert ok, message


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["gpi", "combo", "metric", "value"] and frame.count() > 0
