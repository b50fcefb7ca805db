"""Every query of the training-data operators against its SQL, on the smallest test tables, with the plans that are shipped."""

import pytest

from conftest import same_as_sql
from lectern.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, data, name):
    same_as_sql(spark, data, QUERIES[name], SQL[name])


# p3_splits and p6_windows run within their invariants.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"p3_splits", "p6_windows"}))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0
