"""Rubric scores, score shift after the reveal, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions.numeric import round_half_even
from docketflow.functions.text import fill, strip


def rubric_by_round(rubric: DataFrame) -> DataFrame:
    """One row per round: total weight and the criteria in rubric order."""
    return rubric.groupBy("round_id").agg(
        F.sum("weight").alias("total_weight"),
        F.sort_array(
            F.collect_list(
                F.struct("position", "criterion_id", "name", F.col("weight").cast("double").alias("weight"))
            )
        ).alias("criteria"),
    )


def latest_scores(scores: DataFrame) -> DataFrame:
    """One score per (assignment, criterion): the last in ``ord`` wins."""
    return scores.groupBy("assignment_id", "criterion_id").agg(F.max_by("score", "ord").alias("score"))


def weighted_score(assignments: DataFrame, scores: DataFrame, rubric: DataFrame, rounds: DataFrame) -> DataFrame:
    """assignment_id, round_id, weighted_score on 0..100.

    Criteria without a score add nothing but keep their weight in the divisor.
    """
    totals = rubric.groupBy("round_id").agg(F.sum("weight").alias("total_weight"))
    sums = _weighted_sums(assignments, scores, rubric, rounds)
    divisor = F.coalesce(F.nullif(F.col("total_weight"), F.lit(0.0)), F.lit(1.0))
    return sums.join(totals, "round_id", "left").select(
        "assignment_id",
        "round_id",
        round_half_even(F.coalesce(100 * F.col("value") / divisor, F.lit(0.0))).alias("weighted_score"),
    )


def _weighted_sums(assignments: DataFrame, scores: DataFrame, rubric: DataFrame, rounds: DataFrame) -> DataFrame:
    """assignment_id, round_id, value, n_scored.

    Scores are down to one row per criterion before they are joined, and the
    rubric joins keep the partitioning by assignment, so the sum needs no
    further exchange while the rubric is small.  A sheet has one term per
    criterion of the rubric; they are added in rubric order, because a sum of
    doubles depends on it and is rounded later.
    """
    scale = rounds.select(F.col("id").alias("round_id"), "score_scale_max")
    term = F.col("weight") * (F.col("score") / F.col("score_scale_max"))
    terms = F.sort_array(F.collect_list(F.when(F.col("weight").isNotNull(), F.struct("position", term.alias("term")))))
    return (
        assignments.select("assignment_id", "round_id")
        .join(latest_scores(scores), "assignment_id", "left")
        .join(rubric.select("round_id", "criterion_id", "position", "weight"), ["round_id", "criterion_id"], "left")
        .join(scale, "round_id", "left")
        .groupBy("assignment_id", "round_id")
        .agg(terms.alias("terms"))
        .select(
            "assignment_id", "round_id", F.size("terms").cast("bigint").alias("n_scored"),
            F.aggregate("terms", F.lit(0.0), lambda a, t: a + F.coalesce(t["term"], F.lit(0.0))).alias("value"),
        )
    )


def score_problem(score: Column, scale: Column) -> Column:
    """The rule a score breaks, whatever its criterion; a score that is null or not a number is out of range."""
    return F.when(
        score.isNull() | F.isnan(score) | ~score.between(1, scale), fill(V.SCORE_ERRORS["range"], scale=scale)
    ).when(score * 2 != F.rint(score * 2), F.lit(V.SCORE_ERRORS["step"]))


def clean_comment(comment: Column) -> Column:
    return F.substring(strip(F.coalesce(comment, F.lit(""))), 1, V.COMMENT_LIMIT)


def clean_sheet(scores: Column, criteria: Column) -> Column:
    """A sheet held as an array, in rubric order; the last entry of a criterion counts."""
    last = F.transform(criteria, lambda c: F.try_element_at(
        F.filter(scores, lambda s: s["criterion_id"] == c["criterion_id"]), F.lit(-1)))
    return F.transform(F.filter(last, lambda s: s.isNotNull()), lambda s: F.struct(
        s["criterion_id"].cast("bigint").alias("criterion_id"), s["score"].cast("double").alias("score"),
        clean_comment(s["comment"]).alias("comment")))


def weighted_score_of(scores: Column, criteria: Column, scale: Column) -> Column:
    """Weighted score of an ``array<struct<criterion_id,score,…>>`` against rubric structs."""
    by_id = F.map_from_entries(F.transform(scores, lambda s: F.struct(s["criterion_id"], s["score"])))
    total = F.aggregate(criteria, F.lit(0.0), lambda acc, c: acc + c["weight"])
    value = F.aggregate(
        criteria,
        F.lit(0.0),
        lambda acc, c: acc + F.coalesce(c["weight"] * (F.element_at(by_id, c["criterion_id"]) / scale), F.lit(0.0)),
    )
    return round_half_even(100 * value / F.when(total == 0, 1.0).otherwise(total))


def sheet_problem(scores: Column, criteria: Column, scale: Column) -> Column:
    """First broken rule of one sheet held as an array, else its missing criteria, else null."""

    def problem(s: Column) -> Column:
        return F.when(
            ~F.exists(criteria, lambda c: c["criterion_id"] == s["criterion_id"]),
            fill(V.SCORE_ERRORS["unknown"], criterion=s["criterion_id"]),
        ).otherwise(score_problem(s["score"].cast("double"), scale))

    rows = F.filter(F.transform(scores, problem), lambda p: p.isNotNull())
    absent = F.filter(
        criteria, lambda c: ~F.exists(scores, lambda s: s["criterion_id"] == c["criterion_id"])
    )
    names = F.array_join(F.transform(absent, lambda c: c["name"]), ", ")
    return F.when(F.size(rows) > 0, F.get(rows, F.lit(0))).when(
        F.size(absent) > 0, fill(V.SCORE_ERRORS["missing"], names=names)
    )


def score_violations(assignments: DataFrame, scores: DataFrame, rubric: DataFrame, rounds: DataFrame) -> DataFrame:
    """Every score row that breaks a rule: assignment_id, ord, criterion_id, reason."""
    known = rubric.select("round_id", "criterion_id", F.lit(True).alias("known"))
    scale = rounds.select(F.col("id").alias("round_id"), "score_scale_max")
    reason = F.when(
        F.col("known").isNull(), fill(V.SCORE_ERRORS["unknown"], criterion=F.col("criterion_id"))
    ).otherwise(score_problem(F.col("score").cast("double"), F.col("score_scale_max")))
    return (
        scores.join(assignments.select("assignment_id", "round_id"), "assignment_id")
        .join(known, ["round_id", "criterion_id"], "left")
        .join(scale, "round_id")
        .withColumn("reason", reason)
        .filter("reason is not null")
        .select("assignment_id", "ord", "criterion_id", "reason")
    )


def score_rejections(assignments: DataFrame, scores: DataFrame, rubric: DataFrame, rounds: DataFrame) -> DataFrame:
    """assignment_id, reason: the first broken rule of a sheet, else its missing criteria."""
    first = score_violations(assignments, scores, rubric, rounds).groupBy("assignment_id").agg(
        F.min_by("reason", "ord").alias("row_reason")
    )
    scored = (
        scores.select("assignment_id", "criterion_id")
        .join(assignments.select("assignment_id", "round_id"), "assignment_id")
        .join(rubric.select("round_id", "criterion_id"), ["round_id", "criterion_id"], "left_semi")
        .groupBy("assignment_id")
        .agg(F.collect_set("criterion_id").alias("scored"))
    )
    missing = F.filter(
        F.col("criteria"),
        lambda c: ~F.array_contains(F.coalesce(F.col("scored"), F.array().cast("array<bigint>")),
                                    c["criterion_id"].cast("bigint")),
    )
    names = F.array_join(F.transform(missing, lambda c: c["name"]), ", ")
    return (
        assignments.select("assignment_id", "round_id")
        .join(rubric_by_round(rubric), "round_id")
        .join(scored.withColumn("scored", F.col("scored").cast("array<bigint>")), "assignment_id", "left")
        .join(first, "assignment_id", "left")
        .select(
            "assignment_id",
            F.coalesce(
                "row_reason",
                F.when(F.size(missing) > 0, fill(V.SCORE_ERRORS["missing"], names=names)),
            ).alias("reason"),
        )
        .filter("reason is not null")
    )


def clean_scores(assignments: DataFrame, scores: DataFrame, rubric: DataFrame, rounds: DataFrame) -> DataFrame:
    """Accepted sheets, one row per criterion in rubric order, comments trimmed."""
    rejected = score_rejections(assignments, scores, rubric, rounds)
    latest = (
        scores.withColumn("comment", clean_comment(F.col("comment")))
        .groupBy("assignment_id", "criterion_id")
        .agg(F.max_by(F.struct("score", "comment"), "ord").alias("s"))
    )
    return (
        latest.join(rejected, "assignment_id", "left_anti")
        .join(assignments.select("assignment_id", "round_id"), "assignment_id")
        .join(rubric.select("round_id", "criterion_id", "position"), ["round_id", "criterion_id"])
        .select(
            "assignment_id", "position", "criterion_id",
            F.col("s.score").cast("double").alias("score"), F.col("s.comment").alias("comment"),
        )
    )


def shift_metrics(initial: Column, machine: Column, revised: Column) -> dict[str, Column]:
    """Differences to one decimal and the direction of a revision."""
    to_revised = round_half_even(revised - initial)
    to_machine = round_half_even(machine - initial)
    direction = (
        F.when(machine.isNull(), "ai_unavailable")
        .when(to_revised == 0, "no_change")
        .when(F.signum(to_revised) == F.signum(to_machine), "toward_ai")
        .otherwise("away_from_ai")
    )
    return {
        "initial_to_ai_difference": to_machine,
        "initial_to_revised_difference": to_revised,
        "revision_direction": direction,
    }


def elapsed_seconds(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1e6)


def review_minutes(opened: Column, submitted: Column) -> Column:
    return elapsed_seconds(opened, submitted) / 60


def mean_review_minutes(opened: str = "opened_at", submitted: str = "submitted_at") -> Column:
    """Mean over a group, summed in whole microseconds; null when none is finished."""
    micros = F.unix_micros(F.col(submitted).cast("timestamp")) - F.unix_micros(F.col(opened).cast("timestamp"))
    return F.sum(micros) / (F.count(micros) * F.lit(6e7))


def finalize_reviews(
    requests: DataFrame, evaluations: DataFrame, reveals: DataFrame, revisions: DataFrame,
    assignments: DataFrame, rubric: DataFrame, rounds: DataFrame,
) -> DataFrame:
    """One row per finalize request: the revision, or ``rejected`` with the reason.

    requests: assignment_id, decision {keep,revise}, revised_scores
    array<struct<criterion_id,score,comment>>, reason, finalized_at.  A revised
    sheet is cleaned like a submitted one before the two are compared.
    evaluations hold their cleaned sheet in criterion_scores; reveals may hold
    the machine's criteria in ai_criterion_scores.
    """
    scale = rounds.select(F.col("id").alias("round_id"), "score_scale_max")
    done = revisions.select("assignment_id", F.lit(True).alias("done"))
    machine = "ai_criterion_scores" if "ai_criterion_scores" in reveals.columns else F.lit(None).alias("ai_criterion_scores")
    shown = reveals.select("assignment_id", "ai_available", "ai_score_shown", "revealed_at", machine)
    joined = (
        requests.join(assignments.select("assignment_id", "round_id"), "assignment_id")
        .join(
            evaluations.select(
                "assignment_id", "criterion_scores", F.col("weighted_score").alias("human_initial_score")
            ),
            "assignment_id", "left",
        )
        .join(shown, "assignment_id", "left")
        .join(done, "assignment_id", "left")
        .join(rubric_by_round(rubric), "round_id")
        .join(scale, "round_id")
    )
    asked = F.col("decision") == "revise"
    ordered = clean_sheet(F.col("revised_scores"), F.col("criteria"))
    stored = F.transform("criterion_scores", lambda s: F.struct(
        s["criterion_id"].cast("bigint").alias("criterion_id"), s["score"].cast("double").alias("score"),
        s["comment"].alias("comment")))
    given = asked & (F.coalesce(F.size("revised_scores"), F.lit(0)) > 0)
    changed = given & ~F.col("sheet").eqNullSafe(F.col("stored"))
    rejected = (
        F.when(F.col("human_initial_score").isNull(), V.FINALIZE_ERRORS["no_evaluation"])
        .when(F.col("revealed_at").isNull(), V.FINALIZE_ERRORS["no_reveal"])
        .when(F.col("done"), V.FINALIZE_ERRORS["done"])
        .when(asked & ~given, V.FINALIZE_ERRORS["no_scores"])
        .when(asked, sheet_problem(F.col("revised_scores"), F.col("criteria"), F.col("score_scale_max")))
    )
    staged = (
        joined.withColumn("stored", stored)
        .withColumn("sheet", F.when(given, ordered).otherwise(F.col("stored")))
        .withColumn("rejected", rejected)
        .withColumn("changed", F.coalesce(changed, F.lit(False)))
        .withColumn("ai_score", F.when(F.col("ai_available"), F.col("ai_score_shown")))
        .withColumn(
            "human_revised_score",
            F.when(
                F.col("changed") & F.col("rejected").isNull(),
                weighted_score_of(F.col("sheet"), F.col("criteria"), F.col("score_scale_max")),
            ).otherwise(F.col("human_initial_score")),
        )
    )
    metrics = shift_metrics(F.col("human_initial_score"), F.col("ai_score"), F.col("human_revised_score"))
    ok = F.col("rejected").isNull()
    return staged.select(
        "assignment_id",
        "rejected",
        F.when(ok, F.when(F.col("changed"), "revised").otherwise("kept")).alias("decision"),
        F.when(ok, F.col("human_initial_score")).alias("human_initial_score"),
        F.when(ok, F.col("ai_score")).alias("ai_score"),
        F.when(ok, F.col("human_revised_score")).alias("human_revised_score"),
        F.when(ok, strip(F.col("reason"))).alias("revision_reason"),
        F.when(ok, F.col("stored")).alias("initial_criterion_scores"),
        F.when(ok, F.col("sheet")).alias("revised_criterion_scores"),
        F.when(ok & F.col("ai_available"), F.col("ai_criterion_scores")).alias("ai_criterion_scores"),
        *[F.when(ok, c).alias(k) for k, c in metrics.items()],
        F.when(ok, round_half_even(elapsed_seconds(F.col("revealed_at"), F.col("finalized_at")))).alias(
            "seconds_since_reveal"
        ),
    )


def rubric_check(rounds: DataFrame, rubric: DataFrame) -> DataFrame:
    """round_id, n_criteria, total_weight, problem (null when the rubric is usable)."""
    facts = rubric.groupBy("round_id").agg(
        F.count("*").alias("n_criteria"),
        F.sum("weight").alias("total_weight"),
        F.countDistinct(F.lower(strip(F.col("name")))).alias("n_names"),
    )
    n = F.coalesce("n_criteria", F.lit(0))
    shown = F.regexp_replace(F.format_string("%.4f", F.col("total_weight")), r"\.?0+$", "")
    problem = (
        F.when(n == 0, V.RUBRIC_ERRORS["empty"])
        .when(F.abs(F.col("total_weight") - 100) > 0.01, fill(V.RUBRIC_ERRORS["total"], total=shown))
        .when(F.col("n_names") != n, V.RUBRIC_ERRORS["names"])
    )
    return rounds.select(F.col("id").alias("round_id")).join(facts, "round_id", "left").select(
        "round_id", n.alias("n_criteria"), "total_weight", problem.alias("problem")
    )


def rubric_locked(rounds: DataFrame, assignments: DataFrame) -> DataFrame:
    locked = assignments.groupBy("round_id").agg(
        F.bool_or(F.col("status").isin("submitted", "completed")).alias("locked")
    )
    return rounds.select(F.col("id").alias("round_id")).join(locked, "round_id", "left").select(
        "round_id", F.coalesce("locked", F.lit(False)).alias("rubric_locked")
    )


def draft_total(assignments: DataFrame, scores: DataFrame, rubric: DataFrame, rounds: DataFrame) -> DataFrame:
    """The total shown while scoring: null until complete, halves rounded up."""
    totals = rubric.groupBy("round_id").agg(
        F.sum("weight").alias("total_weight"), F.count("*").alias("n_criteria")
    )
    divisor = F.when(F.col("total_weight") == 0, 1.0).otherwise(F.col("total_weight"))
    total = F.floor(1000 * F.col("value") / divisor + 0.5) / 10
    return _weighted_sums(assignments, scores, rubric, rounds).join(totals, "round_id").select(
        "assignment_id", F.when(F.col("n_scored") == F.col("n_criteria"), total).alias("draft_total")
    )


def compare_criteria(human: DataFrame, machine: DataFrame, revised: DataFrame) -> DataFrame:
    """Per assignment and criterion: own, machine and revised score, machine − own, moved."""
    keys = ["assignment_id", "criterion_id"]
    return (
        human.select(*keys, F.col("score").alias("own_score"))
        .join(machine.select(*keys, F.col("score").alias("ai_score")), keys, "left")
        .join(revised.select(*keys, F.col("score").alias("revised_score")), keys, "left")
        .withColumn("difference", F.col("ai_score") - F.col("own_score"))
        .withColumn("changed", F.coalesce(F.col("revised_score") != F.col("own_score"), F.lit(False)))
    )
