from __future__ import annotations

import pytest

from sparkdigest import queries as engine
from tests.conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    same_rows(engine.queries()[name](spark, SMALL), duck, engine.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(engine.queries().keys() - engine.oracle_sql().keys()))
def test_query_without_sql_runs(spark, name):
    df = engine.queries()[name](spark, SMALL)
    assert df.count() > 0 and df.columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
