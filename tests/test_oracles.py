"""Every registered query of the core against its SQL, on the smallest tables."""

import pytest
from compare import spark_rows, sql_rows

from tidemark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, sf, name):
    got, cols = spark_rows(catalogue.QUERIES[name](spark, sf))
    want, names = sql_rows(catalogue.ORACLE[name], sf)
    assert cols == names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).limit(1).count() == 1
