"""Dashboards, results and work lists.  No view ranks submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions.numeric import exact_mean, round_half_even
from docketflow.functions.text import lookup
from docketflow.operators.scoring import mean_review_minutes, review_minutes
from docketflow.operators.skew import first_per_group

PROCESSED = ["ready", "partially_processed"]


def latest_analysis(analyses: DataFrame) -> DataFrame:
    """The analysis with the highest id of each submission."""
    rest = [c for c in analyses.columns if c != "submission_id"]
    return (
        analyses.groupBy("submission_id")
        .agg(F.max_by(F.struct(*rest), "id").alias("a"))
        .select("submission_id", "a.*")
    )


def primary_file(files: DataFrame) -> DataFrame:
    """The file with the lowest id of each submission."""
    rest = [c for c in files.columns if c != "submission_id"]
    return (
        files.groupBy("submission_id")
        .agg(F.min_by(F.struct(*rest), "id").alias("f"))
        .select("submission_id", "f.*")
    )


def _progress(assignments: DataFrame) -> DataFrame:
    """Assignment counts of a submission, pre-aggregated before the shuffle."""
    return assignments.groupBy("submission_id").agg(
        F.count("*").alias("n_assigned"),
        F.count_if(F.col("status") == "completed").alias("n_completed"),
        F.count_if(F.col("status") != "assigned").alias("n_started"),
    )


def submission_stages(submissions: DataFrame, assignments: DataFrame) -> DataFrame:
    """submissions + n_assigned, n_completed, stage."""
    n = F.coalesce("n_assigned", F.lit(0))
    done = F.coalesce("n_completed", F.lit(0))
    started = F.coalesce("n_started", F.lit(0))
    stage = (
        F.when(F.col("status").isin("uploaded", "processing"), "processing")
        .when((F.col("status") == "processing_failed") & (n == 0), "failed")
        .when((n > 0) & (done == n), "completed")
        .when(started > 0, "in_review")
        .otherwise("awaiting_review")
    )
    return (
        submissions.join(_progress(assignments), submissions["id"] == F.col("submission_id"), "left")
        .select(submissions["*"], n.alias("n_assigned"), done.alias("n_completed"), stage.alias("stage"))
    )


def round_totals(submissions: DataFrame, assignments: DataFrame) -> DataFrame:
    """The eight submission counts of each round."""
    stage = F.col("stage")
    return (
        submission_stages(submissions, assignments)
        .groupBy("round_id")
        .agg(
            F.count("*").alias("submissions"),
            F.count_if(F.col("status").isin(PROCESSED)).alias("processed"),
            F.count_if(stage == "processing").alias("processing"),
            F.count_if(F.col("status") == "processing_failed").alias("failed"),
            F.count_if(stage == "awaiting_review").alias("awaiting_review"),
            F.count_if(stage == "in_review").alias("in_review"),
            F.count_if(stage == "completed").alias("completed"),
            F.count_if(stage != "completed").alias("remaining"),
        )
    )


def assignment_totals(rounds: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assignment counts, completion share and mean review minutes of each round."""
    status = F.col("status")
    facts = assignments.groupBy("round_id").agg(
        F.count("*").alias("total"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status.isin("in_progress", "submitted")).alias("in_progress"),
        F.count_if(status == "assigned").alias("not_started"),
        mean_review_minutes().alias("minutes"),
    )
    zero = F.lit(0)
    return (
        rounds.select(F.col("id").alias("round_id"))
        .join(facts, "round_id", "left")
        .select(
            "round_id",
            *[F.coalesce(c, zero).alias(c) for c in ("total", "completed", "in_progress", "not_started")],
            F.when(F.col("total") > 0, round_half_even(100 * F.col("completed") / F.col("total")))
            .otherwise(0.0)
            .alias("completion_pct"),
            round_half_even(F.col("minutes")).alias("avg_review_minutes"),
        )
    )


def attention_list(
    submissions: DataFrame, assignments: DataFrame, analyses: DataFrame, system_name: str = "the system"
) -> DataFrame:
    """round_id, submission_id, team_name, kind, reason — several rows per submission.

    submissions carry not_assessed_count and integrity_summary of their pack.
    """
    status, n_open = F.col("status"), F.col("not_assessed_count")
    failed = status == "processing_failed"
    partial_reason = F.concat(
        F.lit("Partially assessed: "), n_open.cast("string"), F.lit(" item"),
        F.when(n_open != 1, "s").otherwise(""),
        F.lit(f" {system_name} could not reliably evaluate (e.g. images, external links)."),
    )

    def row(cond: Column, kind: str, reason: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), reason.alias("reason")))

    R = V.ATTENTION_REASONS
    rows = F.array(
        row(failed, "processing_failed",
            F.coalesce(F.nullif(F.col("processing_error"), F.lit("")), F.lit(R["processing_failed"]))),
        row(status == "partially_processed", "partial", F.lit(R["partial"])),
        row((status == "ready") & (n_open > 0), "partial", partial_reason),
        row(F.col("integrity_status").isin(V.ATTENTION_STATUSES) & ~failed, "integrity",
            F.coalesce(F.nullif(F.col("integrity_summary"), F.lit("")), F.lit(R["integrity"]))),
        row(F.col("analysis_status") == "failed", "ai_failed", F.lit(R["ai_failed"])),
        row(status.isin(*PROCESSED, "processing_failed") & (F.col("n_assigned") == 0), "unassigned",
            F.lit(R["unassigned"])),
    )
    analysis = latest_analysis(analyses.select("id", "submission_id", F.col("status").alias("analysis_status")))
    return (
        submission_stages(submissions, assignments)
        .join(analysis.select(F.col("submission_id").alias("id"), "analysis_status"), "id", "left")
        .select("round_id", F.col("id").alias("submission_id"), "team_name",
                F.inline(F.filter(rows, lambda r: r.isNotNull())))
    )


def attention_groups(attention: DataFrame) -> DataFrame:
    """Per round and kind: rows and their fixed position; most urgent first."""
    position = F.array_position(F.array(*[F.lit(k) for k in V.ATTENTION_ORDER]), F.col("kind"))
    return attention.groupBy("round_id", "kind").agg(F.count("*").alias("items")).select(
        "round_id", "kind", position.cast("int").alias("position"), "items"
    )


def attention_submissions(attention: DataFrame) -> DataFrame:
    return attention.groupBy("round_id").agg(F.countDistinct("submission_id").alias("submissions"))


def stage_shares(totals: DataFrame) -> DataFrame:
    """Share of each stage bar, one row per round and stage."""
    bars = ["completed", "in_review", "awaiting_review", "processing", "failed"]
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(b).alias("bar"), F.col(b).alias("n")) for i, b in enumerate(bars)
    ])
    return totals.select("round_id", "submissions", F.inline(cells)).select(
        "round_id", "position", "bar", "n", (100.0 * F.col("n") / F.greatest("submissions", F.lit(1))).alias("pct")
    )


def judge_rows(assignments: DataFrame, users: DataFrame) -> DataFrame:
    """Per round and judge: assigned, completed, in progress, mean minutes."""
    status = F.col("status")
    return (
        assignments.groupBy("round_id", "judge_id")
        .agg(
            F.count("*").alias("assigned"),
            F.count_if(status == "completed").alias("completed"),
            F.count_if(status.isin("in_progress", "submitted")).alias("in_progress"),
            round_half_even(mean_review_minutes()).alias("avg_review_minutes"),
        )
        .join(users.select(F.col("id").alias("judge_id"), "name"), "judge_id")
        .select("round_id", "judge_id", "name", "assigned", "completed", "in_progress", "avg_review_minutes")
    )


def recent_events(events: DataFrame, n: int = V.RECENT_EVENTS) -> DataFrame:
    """The latest ``n`` events of every round."""
    return first_per_group(
        events.filter("round_id is not null"), ["round_id"], [F.desc("created_at"), F.desc("id")], n
    )


def _finished(assignments: DataFrame, evaluations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Completed assignments that have a revision, with both scores."""
    return (
        assignments.filter("status = 'completed'")
        .select("assignment_id", "submission_id", "round_id")
        .join(revisions, "assignment_id")
        .join(evaluations.select("assignment_id", "weighted_score", "recommendation"), "assignment_id", "left")
    )


def results(
    submissions: DataFrame, assignments: DataFrame, evaluations: DataFrame, revisions: DataFrame,
    analyses: DataFrame,
) -> DataFrame:
    """One row per submission; scores stay null until every judge is done.

    Present it ordered by round and lower-cased team name (``ordered_results``).
    """
    done = (
        _finished(assignments, evaluations, revisions)
        .groupBy("submission_id")
        .agg(
            F.count("*").alias("n_done"),
            exact_mean(F.col("human_revised_score")).alias("final_mean"),
            exact_mean(F.col("weighted_score")).alias("initial_mean"),
            F.min("human_revised_score").alias("final_min"),
            F.max("human_revised_score").alias("final_max"),
            F.count_if(F.col("decision") == "revised").alias("n_revised"),
            *[F.count_if(F.col("recommendation") == r).alias(f"rec_{r}") for r in V.RECOMMENDATIONS],
        )
    )
    assigned = assignments.groupBy("submission_id").agg(F.count("*").alias("n_assigned"))
    analysis = latest_analysis(analyses.select(
        "id", "submission_id", F.col("status").alias("analysis_status"), "ai_overall_score"
    )).drop("id")
    n_done = F.coalesce("n_done", F.lit(0))
    n_assigned = F.coalesce("n_assigned", F.lit(0))
    complete = (n_assigned > 0) & (n_done == n_assigned)
    spread = F.when(n_done > 1, round_half_even(F.col("final_max") - F.col("final_min")))
    recommendations = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(r).alias("k"), F.col(f"rec_{r}").alias("v")) for r in V.RECOMMENDATIONS]),
        lambda e: e["v"] > 0,
    ))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return (
        submissions.select(F.col("id").alias("submission_id"), "round_id", "team_name", "title", "integrity_status")
        .join(assigned, "submission_id", "left")
        .join(done, "submission_id", "left")
        .join(analysis, "submission_id", "left")
        .select(
            "submission_id", "round_id", "team_name", "title",
            complete.alias("judging_complete"),
            n_done.alias("judges_completed"),
            n_assigned.alias("judges_assigned"),
            F.when(complete, round_half_even(F.col("final_mean"))).alias("human_final_mean"),
            F.when(complete, round_half_even(F.col("initial_mean"))).alias("human_initial_mean"),
            F.when(complete, F.col("final_min")).alias("human_final_min"),
            F.when(complete, F.col("final_max")).alias("human_final_max"),
            F.when(complete, spread).alias("spread"),
            F.coalesce(complete & (spread >= V.SPREAD_THRESHOLD), F.lit(False)).alias("needs_calibration"),
            F.when(complete, recommendations).otherwise(empty).alias("recommendations"),
            F.coalesce("n_revised", F.lit(0)).alias("revisions"),
            F.when(complete & (F.col("analysis_status") == "completed"), F.col("ai_overall_score")).alias("ai_score"),
            "integrity_status",
        )
    )


def ordered_results(rows: DataFrame) -> DataFrame:
    return rows.orderBy("round_id", F.lower("team_name"), "submission_id")


def shift_summary(
    rounds: DataFrame, assignments: DataFrame, evaluations: DataFrame, revisions: DataFrame
) -> DataFrame:
    """How scores moved after the reveal, one row per round."""
    has_machine = F.col("ai_score").isNotNull()
    revised = F.col("decision") == "revised"
    way = F.col("revision_direction")

    def mean_abs(cond: Column, value: Column) -> Column:
        return round_half_even(exact_mean(F.when(cond, F.abs(value))))

    facts = _finished(assignments, evaluations, revisions).groupBy("round_id").agg(
        F.count("*").alias("evaluations_finalized"),
        F.count_if(F.col("decision") == "kept").alias("kept"),
        F.count_if(revised).alias("revised"),
        F.count_if(way == "toward_ai").alias("toward_ai"),
        F.count_if(way == "away_from_ai").alias("away_from_ai"),
        F.count_if(way == "ai_unavailable").alias("ai_unavailable"),
        mean_abs(has_machine, F.col("initial_to_ai_difference")).alias("mean_abs_initial_to_ai"),
        mean_abs(has_machine, F.col("ai_score") - F.col("human_revised_score")).alias("mean_abs_revised_to_ai"),
        mean_abs(revised, F.col("initial_to_revised_difference")).alias("mean_abs_revision"),
    )
    counts = ["evaluations_finalized", "kept", "revised", "toward_ai", "away_from_ai", "ai_unavailable"]
    means = ["mean_abs_initial_to_ai", "mean_abs_revised_to_ai", "mean_abs_revision"]
    return rounds.select(F.col("id").alias("round_id")).join(facts, "round_id", "left").select(
        "round_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], *means
    )


def shift_dataset(
    submissions: DataFrame, assignments: DataFrame, evaluations: DataFrame, reveals: DataFrame,
    revisions: DataFrame, users: DataFrame,
) -> DataFrame:
    """The 20-column export: one row per finished review."""
    final = revisions.select(
        "assignment_id", "human_initial_score", "ai_score", "human_revised_score", "decision", "revision_reason",
        "initial_to_ai_difference", "initial_to_revised_difference", "revision_direction", "seconds_since_reveal",
        F.col("created_at").alias("finalized_at"),
    )
    minutes = round_half_even(review_minutes(F.col("opened_at"), F.col("submitted_at")), 2)
    return (
        assignments.select("assignment_id", "submission_id", "judge_id", "opened_at", "submitted_at")
        .join(final, "assignment_id")
        .join(reveals.select("assignment_id", "revealed_at"), "assignment_id", "left")
        .join(evaluations.select("assignment_id", "recommendation"), "assignment_id", "left")
        .join(submissions.select(F.col("id").alias("submission_id"), "round_id", "team_name"), "submission_id")
        .join(users.select(F.col("id").alias("judge_id"), F.col("name").alias("judge_name")), "judge_id", "left")
        .withColumn("review_minutes", minutes)
        .select(*V.SHIFT_COLUMNS)
    )


def assignment_rows(
    assignments: DataFrame, submissions: DataFrame, files: DataFrame, analyses: DataFrame, revisions: DataFrame
) -> DataFrame:
    """Work-list rows: review minutes, verify counts, pages, final score.

    analyses carry ``verify_these array<struct<severity,…>>`` of their brief.
    """
    analysis = latest_analysis(analyses.select(
        "id", "submission_id", F.col("status").alias("analysis_status"),
        F.size("verify_these").alias("n_verify"),
        F.size(F.filter("verify_these", lambda v: v["severity"] == "high")).alias("n_high"),
    )).drop("id")
    file = primary_file(files.select("id", "submission_id", "file_type", "page_count")).drop("id")
    subs = submissions.select(
        F.col("id").alias("submission_id"), "team_name", "title", F.col("status").alias("submission_status"),
        "integrity_status", "not_assessed_count",
    )
    minutes = round_half_even(review_minutes(F.col("opened_at"), F.col("submitted_at")))
    return (
        assignments.join(subs, "submission_id")
        .join(file, "submission_id", "left")
        .join(analysis, "submission_id", "left")
        .join(revisions.select("assignment_id", F.col("human_revised_score").alias("final_score")),
              "assignment_id", "left")
        .select(
            "assignment_id", "judge_id", "round_id", "submission_id", "status", "assigned_at",
            minutes.alias("review_minutes"), "team_name", "title", "submission_status", "integrity_status",
            "file_type", F.col("page_count").alias("pages"),
            F.coalesce("analysis_status", F.lit("pending")).alias("analysis_status"),
            F.greatest(F.coalesce("n_verify", F.lit(0)), F.lit(0)).alias("verify_count"),
            F.greatest(F.coalesce("n_high", F.lit(0)), F.lit(0)).alias("high_priority_count"),
            F.coalesce("not_assessed_count", F.lit(0)).alias("not_assessed_count"),
            "final_score",
        )
    )


def needs_attention(rows: DataFrame) -> DataFrame:
    """Open assignment rows whose submission needs a closer look."""
    odd = (
        F.coalesce(F.col("integrity_status") != "no_discrepancy_detected", F.lit(False))
        | (F.col("analysis_status") == "failed")
        | F.col("submission_status").isin("processing_failed", "partially_processed")
    )
    return rows.filter((F.col("status") != "completed") & odd)


def judge_dashboard(rows: DataFrame) -> DataFrame:
    """Per judge: counts, mean minutes and open rows that need attention."""
    status = F.col("status")
    attention = needs_attention(rows).groupBy("judge_id").agg(F.count("*").alias("n"))
    return (
        rows.groupBy("judge_id")
        .agg(
            F.count("*").alias("assigned"),
            F.count_if(status == "completed").alias("completed"),
            F.count_if(status != "completed").alias("remaining"),
            F.count_if(status.isin("in_progress", "submitted")).alias("in_progress"),
            round_half_even(exact_mean(F.col("review_minutes"))).alias("avg_review_minutes"),
        )
        .join(attention, "judge_id", "left")
        .select("judge_id", "assigned", "completed", "remaining", "in_progress", "avg_review_minutes",
                F.coalesce("n", F.lit(0)).alias("needs_attention"))
    )


def next_assignment(assignments: DataFrame) -> DataFrame:
    """Per judge: the started one assigned first, else the untouched one assigned first; share done."""
    started = F.col("status").isin("in_progress", "submitted")
    waiting = F.col("status") == "assigned"
    order = F.when(started, 0).when(waiting, 1)
    key = F.when(order.isNotNull(), F.struct(order, F.col("assigned_at"), F.col("assignment_id")))
    return assignments.groupBy("judge_id").agg(
        F.min(key)["assignment_id"].alias("next_assignment_id"),
        (100.0 * F.count_if(F.col("status") == "completed") / F.count("*")).alias("completion_pct"),
    )


def submission_summaries(
    submissions: DataFrame, files: DataFrame, analyses: DataFrame, assignments: DataFrame
) -> DataFrame:
    """List rows with file, analysis state, stage and judge counts; present by creation time."""
    file = primary_file(files.select("id", "submission_id", "original_filename", "file_type", "size_bytes",
                                     "page_count")).drop("id")
    analysis = latest_analysis(
        analyses.select("id", "submission_id", F.col("status").alias("analysis_status"))
    ).drop("id")
    return (
        submission_stages(submissions, assignments)
        .withColumnRenamed("id", "submission_id")
        .join(file, "submission_id", "left")
        .join(analysis, "submission_id", "left")
        .select(
            "submission_id", "round_id", "team_name", "title", "status", "stage", "processing_error",
            "integrity_status", "integrity_summary", "not_assessed_count",
            F.coalesce("analysis_status", F.lit("pending")).alias("analysis_status"),
            F.when(F.col("original_filename").isNotNull(), F.struct(
                F.col("original_filename").alias("name"), F.col("file_type").alias("type"), "size_bytes",
                F.col("page_count").alias("pages"))).alias("file"),
            "created_at", "n_assigned", "n_completed",
        )
    )


def submission_judges(assignments: DataFrame, users: DataFrame) -> DataFrame:
    """The judges of each submission, one row each (the list beside a summary row)."""
    return assignments.join(users.select(F.col("id").alias("judge_id"), "name"), "judge_id").select(
        "submission_id", "assignment_id", "judge_id", F.col("name").alias("judge_name"), "status"
    )


def round_list(rounds: DataFrame, submissions: DataFrame) -> DataFrame:
    """Rounds with their submission count; present newest first."""
    n = submissions.groupBy(F.col("round_id").alias("id")).agg(F.count("*").alias("n"))
    return rounds.join(n, "id", "left").select(
        *rounds.columns, F.coalesce("n", F.lit(0)).alias("submission_count")
    )


# --- gated views -----------------------------------------------------------

BRIEF_COLUMNS = ["submission_id", "status", "engine", "model", "pipeline_version", "completed_at"]


def judge_brief_view(analyses: DataFrame) -> DataFrame:
    """What a judge may see before submitting: an allow-list without any score."""
    status = F.col("status")
    note = F.when(status == "failed", V.ATTENTION_REASONS["ai_failed"]).when(
        status.isin("pending", "running"), "AI analysis in progress. Human review can begin."
    )
    return latest_analysis(analyses).select(
        *[c for c in BRIEF_COLUMNS if c in ["submission_id", *analyses.columns]],
        note.alias("message"),
        F.when(status == "completed", F.col("brief")).alias("brief"),
    )


def judge_reveal_view(
    assignments: DataFrame, evaluations: DataFrame, reveals: DataFrame, analyses: DataFrame
) -> DataFrame:
    """The machine score per assignment: only after submission and reveal."""
    latest = latest_analysis(analyses.select(
        "id", "submission_id", "assessment", F.col("ai_overall_score").alias("machine_score")
    )).drop("id")
    shown = F.col("submitted") & F.col("ai_available") & F.col("assessment").isNotNull()
    revealed = F.col("revealed_at").isNotNull() & F.coalesce("submitted", F.lit(False))
    return (
        assignments.select("assignment_id", "submission_id", "judge_id")
        .join(evaluations.select("assignment_id", F.lit(True).alias("submitted")), "assignment_id", "left")
        .join(reveals.select("assignment_id", "ai_available", "revealed_at"), "assignment_id", "left")
        .join(latest, "submission_id", "left")
        .select(
            "assignment_id", "submission_id", "judge_id", revealed.alias("revealed"),
            F.when(revealed & shown, F.col("assessment")).alias("assessment"),
            F.when(revealed & shown, F.col("machine_score")).alias("ai_score"),
            F.when(revealed & ~F.coalesce(shown, F.lit(False)), V.ATTENTION_REASONS["ai_failed"]).alias("message"),
        )
    )


def organizer_score_view(assignments: DataFrame, revisions: DataFrame) -> DataFrame:
    """Single scores and decisions: only once all judges of the submission are done."""
    facts = _progress(assignments).select(
        "submission_id", (F.col("n_assigned") == F.col("n_completed")).alias("judging_complete")
    )
    return (
        assignments.select("assignment_id", "submission_id", "judge_id", "status")
        .join(facts, "submission_id")
        .join(revisions.select("assignment_id", "human_revised_score", F.col("decision").alias("d")),
              "assignment_id", "left")
        .select(
            "assignment_id", "submission_id", "judge_id", "status", "judging_complete",
            F.when(F.col("judging_complete"), F.col("human_revised_score")).alias("final_score"),
            F.when(F.col("judging_complete"), F.col("d")).alias("decision"),
        )
    )


# --- lists of a brief ------------------------------------------------------

def verify_groups(items: DataFrame) -> DataFrame:
    """Verify items per submission and severity, high first."""
    return items.groupBy("submission_id", "severity").agg(F.count("*").alias("items")).select(
        "submission_id", "severity", lookup(F.col("severity"), {"high": "0", "medium": "1", "low": "2"})
        .cast("int").alias("position"), "items",
    )


def unique_slides(refs: Column) -> Column:
    """References of an item, the first of each slide."""
    return F.filter(
        refs,
        lambda r, i: ~F.exists(F.slice(refs, F.lit(1), i), lambda e: e["slide_id"] == r["slide_id"]),
    )


def split_flags(flags: DataFrame) -> DataFrame:
    """Flags with ``actionable``: informational ones have the lowest status."""
    return flags.withColumn("actionable", F.col("status") != "no_discrepancy_detected")

