"""Every registered core query that has SQL gives the rows that DuckDB gives; the others run."""

import pytest
from support import rows

from loamgraph.plans import core_queries, core_sql

Q, SQL = core_queries(), core_sql()


@pytest.mark.parametrize("name", list(Q))
def test_query(name, spark, duck, data_dir):
    got = Q[name](spark, data_dir).toPandas()
    if name not in SQL:
        assert list(got.columns)
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(Q)


def test_plans_push_filters(spark, data_dir):
    """Named tags reach the scan, and only the columns needed are read."""
    from loamgraph.operators.tagsearch import TagQuery, search
    from loamgraph.sources.tables import table

    plan = search(table(spark, data_dir, "entity_tags"), TagQuery(all={1}, none={2}))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(tag_id, [1,2])]" in plan
    assert "created_by" not in plan
