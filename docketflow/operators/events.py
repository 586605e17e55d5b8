"""Audit events, finding responses, access scope and the review life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions.text import lookup

EVENT_COLUMNS = [
    "id", "organization_id", "round_id", "submission_id", "actor_id", "actor_label", "action",
    "entity_type", "entity_id", "details", "created_at",
]


def complete_events(raw: DataFrame, users: DataFrame) -> DataFrame:
    """Events ready to append: actor label, and organization from the actor when not given.

    System events have no actor; they would all be one key of the join and go past it.
    """
    actors = users.select(
        F.col("id").alias("actor_id"), F.col("name").alias("actor_name"), F.col("role").alias("actor_role"),
        F.col("organization_id").alias("actor_org"),
    )
    label = F.when(
        F.col("actor_name").isNotNull(),
        F.concat(F.col("actor_name"), F.lit(" ("), F.col("actor_role"), F.lit(")")),
    ).otherwise("system")
    nobody = [F.lit(None).cast(actors.schema[c].dataType).alias(c) for c in actors.columns if c != "actor_id"]
    known = raw.filter("actor_id is not null").join(actors, "actor_id", "left")
    return (
        known.unionByName(raw.filter("actor_id is null").select("*", *nobody))
        .withColumn("actor_label", label)
        .withColumn("organization_id", F.coalesce("organization_id", "actor_org"))
        .withColumn("details", F.coalesce("details", F.lit("{}")))
        .select(*EVENT_COLUMNS)
    )


def append_events(events: DataFrame, path: str) -> None:
    """Append only; a day folder keeps later time filters from reading the whole log."""
    events.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def matching(events: DataFrame, round_id: int, submission_id: int | None, action: str | None) -> DataFrame:
    rows = events.filter(F.col("round_id") == round_id)
    if submission_id:
        rows = rows.filter(F.col("submission_id") == submission_id)
    if action:
        rows = rows.filter(F.startswith(F.col("action"), F.lit(action)))
    return rows


def audit_page(
    events: DataFrame, round_id: int, submission_id: int | None = None, action: str | None = None,
    limit: int = 100, offset: int = 0,
) -> DataFrame:
    """One page of a round's events, newest first."""
    if not 1 <= limit <= V.AUDIT_PAGE_LIMIT or offset < 0:
        raise ValueError(f"limit must be 1..{V.AUDIT_PAGE_LIMIT} and offset not negative")
    rows = matching(events, round_id, submission_id, action)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def audit_total(
    events: DataFrame, round_id: int, submission_id: int | None = None, action: str | None = None
) -> DataFrame:
    return matching(events, round_id, submission_id, action).agg(F.count("*").alias("total"))


def action_prefix(action: Column) -> Column:
    """The audit filter an action falls under, if any."""
    chain = None
    for prefix in V.ACTION_FILTERS:
        hit = F.startswith(action, F.lit(prefix))
        chain = F.when(hit, prefix) if chain is None else chain.when(hit, prefix)
    return chain


def filter_counts(events: DataFrame) -> DataFrame:
    """Per round and audit filter: matching events; "all" counts every event."""
    found = events.select(
        "round_id",
        F.explode(F.array_compact(F.array(F.lit("all"), action_prefix(F.col("action"))))).alias("filter"),
    )
    return found.groupBy("round_id", "filter").agg(F.count("*").alias("events")).withColumn(
        "label", lookup(F.col("filter"), {"all": V.ALL_ACTIONS_LABEL, **V.ACTION_FILTERS})
    )


def latest_responses(responses: DataFrame, reveals: DataFrame) -> DataFrame:
    """One response per (assignment, finding): the last write, and whether it preceded the reveal."""
    latest = (
        responses.groupBy("assignment_id", "finding_key")
        .agg(F.max_by(F.struct("response", "note", "updated_at"), F.struct("updated_at", "id")).alias("r"))
        .select("assignment_id", "finding_key", "r.response", F.trim("r.note").alias("note"), "r.updated_at")
    )
    return latest.join(reveals.select("assignment_id", "revealed_at"), "assignment_id", "left").select(
        "assignment_id", "finding_key", "response", "note", "updated_at",
        (F.col("revealed_at").isNull() | (F.col("updated_at") < F.col("revealed_at"))).alias("before_ai_reveal"),
    )


def visible_submissions(submissions: DataFrame, rounds: DataFrame, assignments: DataFrame, users: DataFrame) -> DataFrame:
    """scope, holder, submission_id: who may open a submission.

    Organizers see every submission of their organization, so that scope is held
    once by the organization instead of once per organizer; judges hold only the
    submissions of their organization they are assigned to.
    """
    subs = submissions.select(F.col("id").alias("submission_id"), "round_id").join(
        rounds.select(F.col("id").alias("round_id"), "organization_id"), "round_id"
    )
    active = users.filter("is_active")
    managed = active.filter("role = 'organizer'").select("organization_id").distinct()
    judges = active.filter("role = 'judge'").select(F.col("id").alias("judge_id"), "organization_id")
    by_org = subs.join(managed, "organization_id", "left_semi").select(
        F.lit("organization").alias("scope"), F.col("organization_id").alias("holder"), "submission_id"
    )
    by_judge = (
        assignments.select("judge_id", "submission_id").distinct()
        .join(judges, "judge_id")
        .join(subs.select("submission_id", "organization_id"), ["submission_id", "organization_id"])
        .select(F.lit("judge").alias("scope"), F.col("judge_id").alias("holder"), "submission_id")
    )
    return by_org.unionByName(by_judge)


def visible_to(
    submissions: DataFrame, rounds: DataFrame, assignments: DataFrame, users: DataFrame, user_id: int
) -> DataFrame:
    """submission_id of everything one user may open."""
    me = users.filter((F.col("id") == user_id) & F.col("is_active")).select("organization_id", "role")
    held = assignments.filter(F.col("judge_id") == user_id).select("submission_id", F.lit(True).alias("held")).distinct()
    return (
        submissions.select(F.col("id").alias("submission_id"), "round_id")
        .join(rounds.select(F.col("id").alias("round_id"), "organization_id"), "round_id")
        .join(me, "organization_id")
        .join(held, "submission_id", "left")
        .filter("role = 'organizer' or held")
        .select("submission_id")
    )


def own_assignments(assignments: DataFrame, users: DataFrame) -> DataFrame:
    judges = users.filter("role = 'judge' and is_active").select(F.col("id").alias("judge_id"))
    return assignments.join(judges, "judge_id", "left_semi")


# --- life cycle ------------------------------------------------------------

# Event that moves an assignment to a state, in order.
LIFECYCLE = [
    ("assignment.created", "assigned"),
    ("review.opened", "in_progress"),
    ("evaluation.submitted", "submitted"),
    ("evaluation.kept", "completed"),
    ("evaluation.revised", "completed"),
]


def lifecycle_rank(action: Column) -> Column:
    """0 for unrelated events, 1..4 in the order of the states."""
    ranks = {"assigned": 1, "in_progress": 2, "submitted": 3, "completed": 4}
    return F.coalesce(lookup(action, {a: str(ranks[s]) for a, s in LIFECYCLE}).cast("int"), F.lit(0))


def state_of_rank(rank: Column) -> Column:
    return lookup(rank, {1: "assigned", 2: "in_progress", 3: "submitted", 4: "completed"})


def assignment_states(events: DataFrame) -> DataFrame:
    """State of every assignment from its events: states only move forward.

    The first opening counts; a submission without one counts as the opening.
    """
    action = F.col("action")

    def first_at(*names: str) -> Column:
        return F.min(F.when(action.isin(*names), F.col("created_at")))

    rows = events.filter((F.col("entity_type") == "assignment") & (lifecycle_rank(action) > 0))
    return rows.groupBy(F.col("entity_id").alias("assignment_id")).agg(
        state_of_rank(F.max(lifecycle_rank(action))).alias("status"),
        F.coalesce(first_at("review.opened"), first_at("evaluation.submitted")).alias("opened_at"),
        first_at("evaluation.submitted").alias("submitted_at"),
        first_at("evaluation.kept", "evaluation.revised").alias("completed_at"),
    )


def lifecycle_violations(events: DataFrame) -> DataFrame:
    """Events the guards would have refused: assignment_id, event_id, reason.

    Only the first submit, reveal and finish may exist, a reveal needs a submit
    before it, a finish needs a reveal before it, and responses end with the
    finish.  Everything is decided from per-assignment minima joined back, so no
    assignment's events are collected or ordered in one place.
    """
    action = F.col("action")
    key = F.struct("created_at", "id")
    finish = action.isin("evaluation.kept", "evaluation.revised")
    rows = events.filter(F.col("entity_type") == "assignment").select(
        F.col("entity_id").alias("assignment_id"), "id", "created_at", "action"
    )
    firsts = rows.groupBy("assignment_id").agg(
        F.min(F.when(action == "evaluation.submitted", key)).alias("submit"),
        F.min(F.when(action == "ai.revealed", key)).alias("reveal"),
        F.min(F.when(finish, key)).alias("finish"),
    )
    late = F.lit(False)
    reason = (
        F.when((action == "evaluation.submitted") & (key > F.col("submit")), "Evaluation already submitted.")
        .when((action == "ai.revealed") & F.coalesce(key < F.col("submit"), F.col("submit").isNull()),
              "Submit your own evaluation before viewing the AI assessment.")
        .when(finish & F.coalesce(key < F.col("submit"), F.col("submit").isNull()), V.FINALIZE_ERRORS["no_evaluation"])
        .when(finish & F.coalesce(key < F.col("reveal"), F.col("reveal").isNull()), V.FINALIZE_ERRORS["no_reveal"])
        .when(finish & (key > F.col("finish")), V.FINALIZE_ERRORS["done"])
        .when((action == "finding.responded") & F.coalesce(key > F.col("finish"), late), V.FINALIZE_ERRORS["done"])
    )
    return (
        rows.filter(finish | action.isin("evaluation.submitted", "ai.revealed", "finding.responded"))
        .join(firsts, "assignment_id")
        .withColumn("reason", reason)
        .filter("reason is not null")
        .select("assignment_id", F.col("id").alias("event_id"), "action", "reason")
    )
