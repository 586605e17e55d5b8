"""Shape of the physical plans."""

import pytest

from docketflow.plans.all_queries import all_queries

QUERIES = all_queries()


def plan(spark, folder, name):
    return QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(spark, folder, name):
    text = plan(spark, folder, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["rep8_recent_events", "ext_topics", "ver_items"])
def test_group_limit_before_the_shuffle(spark, folder, name):
    text = plan(spark, folder, name)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scan_reads_only_needed_columns(spark, folder):
    text = plan(spark, folder, "rep2_submission_stages")
    assert "o_orderpriority" not in text.split("ReadSchema", 1)[1].split("\n")[0]


def test_unit_stage_has_no_shuffle(spark, folder):
    from docketflow.operators import extraction, integrity, view
    from docketflow.plans.deck_entities import deck_units

    units = deck_units(spark, folder)
    before = units._jdf.queryExecution().executedPlan().toString().count("Exchange")
    done = extraction.unit_findings(view.build_views(integrity.flag_units(units)))
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange") == before


def test_pushed_filter(spark, folder):
    from docketflow.plans.catalog import read

    text = read(spark, folder, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text
