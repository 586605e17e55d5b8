import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from docketflow.functions.numeric import exact_mean, round_half_even
from docketflow.operators import scoring as S

WEIGHTS = [20.0, 25.0, 20.0, 20.0, 15.0]


@pytest.fixture(scope="module")
def rubric(spark):
    return spark.createDataFrame([(1, i + 1, i, f"C{i + 1}", w) for i, w in enumerate(WEIGHTS)],
                                 "round_id long, criterion_id long, position int, name string, weight double")


@pytest.fixture(scope="module")
def rounds(spark):
    return spark.createDataFrame([(1, 10)], "id long, score_scale_max int")


def sheets(spark, cases):
    rows = [(a, c + 1, float(v), c, "") for a, values in cases.items() for c, v in enumerate(values)]
    scores = spark.createDataFrame(rows, "assignment_id long, criterion_id long, score double, ord long, comment string")
    asg = spark.createDataFrame([(a, 1) for a in cases], "assignment_id long, round_id long")
    return asg, scores


def test_weighted_scores(spark, rubric, rounds):
    asg, scores = sheets(spark, {1: [10] * 5, 2: [5, 8, 6, 7, 4], 3: [6, 5, 4, 5, 5], 4: [6, 5, 4, 4, 5], 5: []})
    got = {r.assignment_id: r.weighted_score for r in S.weighted_score(asg, scores, rubric, rounds).collect()}
    assert got == {1: 100.0, 2: 62.0, 3: 50.0, 4: 48.0, 5: 0.0}


def test_rejections(spark, rubric, rounds):
    asg, scores = sheets(spark, {1: [5], 2: [11, 5, 5, 5, 5], 3: [5, 5.25, 5, 5, 5], 4: [5] * 5, 5: [5] * 5 + [3]})
    got = {r.assignment_id: r.reason for r in S.score_rejections(asg, scores, rubric, rounds).collect()}
    assert got[1].startswith("Please score every criterion (missing: C2, C3")
    assert "between 1 and 10" in got[2] and "half points" in got[3] and got[5] == "Unknown criterion 6" and 4 not in got
    clean = S.clean_scores(asg, scores, rubric, rounds)
    assert clean.count() == 5 and {r.assignment_id for r in clean.collect()} == {4}


@pytest.mark.parametrize("initial,ai,revised,direction,moved,gap", [
    (70.0, 60.0, 70.0, "no_change", 0.0, -10.0), (70.0, 60.0, 65.0, "toward_ai", -5.0, -10.0),
    (70.0, 60.0, 75.0, "away_from_ai", 5.0, -10.0), (50.0, 60.0, 55.0, "toward_ai", 5.0, 10.0),
    (50.0, None, 55.0, "ai_unavailable", 5.0, None), (60.0, 60.0, 65.0, "away_from_ai", 5.0, 0.0),
])
def test_shift(spark, initial, ai, revised, direction, moved, gap):
    df = spark.createDataFrame([(initial, ai, revised)], "i double, a double, r double")
    m = S.shift_metrics(F.col("i"), F.col("a"), F.col("r"))
    row = df.select(*[c.alias(k) for k, c in m.items()]).first()
    assert (row.revision_direction, row.initial_to_revised_difference, row.initial_to_ai_difference) == (direction, moved, gap)


def test_rounding_equals_python(spark):
    rng = random.Random(5)
    values = [62.45, 62.35, 71.25, 15.75, 0.05, 0.25, -2.35, 1e-3, 100.0]
    values += [rng.randint(0, 2000) / 20 for _ in range(3000)] + [rng.uniform(-100, 100) for _ in range(2000)]
    values += [(rng.randint(0, 1000) / 10 + rng.randint(0, 1000) / 10) / 2 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", round_half_even(F.col("v")).alias("one"), round_half_even(F.col("v"), 2).alias("two")).collect():
        assert row.one == round(row.v, 1) and row.two == round(row.v, 2), row


def test_exact_mean(spark):
    rng = random.Random(6)
    values = [rng.randint(0, 1000) / 10 for _ in range(501)]
    want = float(sum(map(Fraction, values)) / len(values))
    for parts in (1, 7):
        got = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts).agg(exact_mean(F.col("v")).alias("m")).first().m
        assert abs(got - want) < 1e-13


def test_finalize_rules(spark, rubric, rounds):
    sheet = "array<struct<criterion_id:bigint,score:double,comment:string>>"
    own = [(c, 5.0, "") for c in range(1, 6)]
    low = [(c, 5.0 if c != 4 else 4.0, "") for c in range(1, 6)]
    noted = [(c, 5.0, "seen" if c == 1 else "") for c in range(1, 6)]
    from datetime import datetime as dt

    when = dt(2024, 1, 1)
    requests = spark.createDataFrame(
        [(1, "keep", None, "", when), (2, "revise", low, " r ", when), (3, "revise", own, "", when),
         (4, "revise", noted, "", when), (5, "keep", None, "", when), (6, "revise", [(1, 99.0, "")], "", when), (7, "keep", None, "", when)],
        f"assignment_id long, decision string, revised_scores {sheet}, reason string, finalized_at timestamp")
    evals = spark.createDataFrame([(a, own, 50.0) for a in (1, 2, 3, 4, 6, 7)], f"assignment_id long, criterion_scores {sheet}, weighted_score double")
    reveals = spark.createDataFrame([(a, True, 60.0, when) for a in (1, 2, 3, 4, 6)], "assignment_id long, ai_available boolean, ai_score_shown double, revealed_at timestamp")
    none = spark.createDataFrame([], "assignment_id long")
    asg = spark.createDataFrame([(a, 1) for a in range(1, 8)], "assignment_id long, round_id long")
    got = {r.assignment_id: r for r in S.finalize_reviews(requests, evals, reveals, none, asg, rubric, rounds).collect()}
    assert got[1].decision == "kept" and got[1].revision_direction == "no_change"
    assert got[2].decision == "revised" and got[2].human_revised_score == 48.0 and got[2].revision_reason == "r"
    assert got[3].decision == "kept"
    assert got[4].decision == "revised" and got[4].revision_direction == "no_change"  # a comment alone is a revision
    assert got[5].rejected.startswith("Submit") and "between" in got[6].rejected and got[7].rejected.startswith("Review")


def test_finalize_cleans_the_revised_sheet(spark, rubric, rounds):
    from datetime import datetime as dt

    sheet, when = "array<struct<criterion_id:bigint,score:double,comment:string>>", dt(2024, 1, 1)
    held = [(c, 5.0, "ok" if c == 1 else "") for c in range(1, 6)]
    padded = [(c, 5.0, "  ok " if c == 1 else None) for c in range(5, 0, -1)]
    empty = [(c, None if c == 2 else 5.0, "") for c in range(1, 6)]
    nan = [(c, float("nan") if c == 2 else 5.0, "") for c in range(1, 6)]
    twice = [*held, (1, 9.0, "ok")]
    requests = spark.createDataFrame(
        [(i, "revise", s, "", when) for i, s in enumerate((padded, empty, nan, twice), 1)],
        f"assignment_id long, decision string, revised_scores {sheet}, reason string, finalized_at timestamp")
    evals = spark.createDataFrame([(i, held, 50.0) for i in range(1, 5)], f"assignment_id long, criterion_scores {sheet}, weighted_score double")
    ai = "array<struct<criterion_id:bigint,score:double>>"
    reveals = spark.createDataFrame([(i, i == 1, 60.0, when, [(1, 7.0)]) for i in range(1, 5)],
                                    f"assignment_id long, ai_available boolean, ai_score_shown double, revealed_at timestamp, ai_criterion_scores {ai}")
    none = spark.createDataFrame([], "assignment_id long")
    asg = spark.createDataFrame([(a, 1) for a in range(1, 5)], "assignment_id long, round_id long")
    got = {r.assignment_id: r for r in S.finalize_reviews(requests, evals, reveals, none, asg, rubric, rounds).collect()}
    assert got[1].decision == "kept" and got[1].revised_criterion_scores == got[1].initial_criterion_scores
    assert [tuple(s) for s in got[1].ai_criterion_scores] == [(1, 7.0)]
    assert "between" in got[2].rejected and "between" in got[3].rejected
    assert got[4].decision == "revised" and got[4].revised_criterion_scores[0].score == 9.0 and got[4].ai_criterion_scores is None
    assert got[4].human_revised_score == 58.0
