"""The decks of near misses tell each threshold apart from one a few points off."""

import pytest

from docketflow import fixed_values as V
from docketflow.plans.all_queries import all_queries
from docketflow.plans import near_miss_queries as N


def rows(spark, folder, name):
    return sorted(map(str, all_queries()[name](spark, folder).collect()))


@pytest.mark.parametrize("constant, name", [
    ("MATCH_THRESHOLD", "int_flags_near_misses"), ("WITHHELD_THRESHOLD", "ctx_views_near_misses"),
    ("IMAGE_TEXT_THRESHOLD", "ctx_views_near_misses"), ("EXCERPT_THRESHOLD", "grd_ground_refs_near_misses")])
def test_a_threshold_that_is_off_gives_other_rows(spark, folder, monkeypatch, constant, name):
    right = rows(spark, folder, name)
    for shift in (-4, 4):
        with monkeypatch.context() as patch:
            patch.setattr(V, constant, getattr(V, constant) + shift)
            assert rows(spark, folder, name) != right


def test_both_sides_of_each_threshold_occur(spark, folder):
    types = {r.type for r in all_queries()["int_flags_near_misses"](spark, folder).collect()}
    assert {"instruction_like_text", "visible_evaluator_address", "not_visible_in_render"} <= types
    views = all_queries()["ctx_views_near_misses"](spark, folder).collect()
    assert {V.WITHHELD_MARK in r.text for r in views} == {True, False}
    assert {r.image_text.count("\n") for r in views if r.image_text} == {0, 1}
    assert {r.verified for r in all_queries()["grd_ground_refs_near_misses"](spark, folder).collect()} == {True, False}


def test_one_similarity_call_a_step(spark, folder):
    """Flags, views and grounding: each has one Python node."""
    plan = all_queries()["grd_ground_refs_near_misses"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2 * 3  # a plan under AQE is printed twice at most
    assert N.near_units(spark, folder).count() > 0
