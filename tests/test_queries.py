"""Every query of the library against its SQL twin."""

import pytest
from conftest import SMALL, rows

from wordloom.plans.registry import ORACLES, QUERIES


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert rows(QUERIES[name](spark, SMALL).toArrow()) == rows(duck.sql(ORACLES[name]).to_arrow_table())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["surface", "total", "breadth", "rank", "residual"]
    assert set(QUERIES) <= set(entry.queries())
