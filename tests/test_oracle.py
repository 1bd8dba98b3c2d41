"""Every query of the core with SQL, against that SQL."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from lattica.plans import graph_queries, model_queries, problem_queries, report_queries

MODULES = (graph_queries, model_queries, report_queries, problem_queries)
CORE = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, con, name):
    compare(spark, small, CORE[name], SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, small, name):
    assert CORE[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
