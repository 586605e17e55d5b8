"""Every registered query against the SQL that states its result."""

import pytest
from oracle_check import difference, duck

from docketflow.plans.all_queries import all_queries, all_sql

QUERIES = all_queries()
SQL = all_sql()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    problem, _ = difference(spark, folder, QUERIES[name], SQL.get(name), con)
    assert problem is None


def test_no_result_view_ranks(spark, folder):
    columns = QUERIES["rep9_results"](spark, folder).columns
    assert not [c for c in columns if "rank" in c or "position" in c]


def test_brief_view_has_no_score(spark, folder):
    assert not [c for c in QUERIES["rep14_brief_view"](spark, folder).columns if "score" in c]
