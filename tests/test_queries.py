"""Every registered query at the smallest scale, beside its reference SQL."""

import pytest

import __spark_entry__ as entry
import check

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    text, good = check.compare(spark, folder, name, QUERIES[name], ORACLES.get(name))
    assert good, text


def test_entry(spark):
    assert entry.entry(spark).count() > 0
