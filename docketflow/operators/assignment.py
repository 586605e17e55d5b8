"""Assigning judges to submissions."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.operators.skew import running_total


def eligible_judges(users: DataFrame) -> DataFrame:
    """Active judges numbered by id within their organization (from 0)."""
    judges = users.filter((F.col("role") == "judge") & F.col("is_active")).select(
        "organization_id", F.col("id").alias("judge_id")
    )
    return running_total(judges, ["organization_id"], "judge_id", {"judge_index": F.lit(1)})


def auto_assign_empty(
    rounds: DataFrame, submissions: DataFrame, users: DataFrame, chosen: DataFrame | None = None, seats: int | None = None
) -> DataFrame:
    """Balanced assignment of rounds that hold no assignment yet.

    ``chosen`` (judge_id) limits the judges of this call, ``seats`` replaces the
    rounds' own number of judges per submission.

    From equal loads "least loaded, then lowest id" simply deals judges out in
    turn: seat ``k`` of the ``r``-th submission goes to judge
    ``(r * seats + k) mod judges``.  No step depends on an earlier one.
    """
    judges = eligible_judges(
        users if chosen is None else users.join(chosen.select(F.col("judge_id").alias("id")), "id", "left_semi"))
    crowd = judges.groupBy("organization_id").agg(F.count("*").alias("n_judges"))
    per_round = rounds.select(
        F.col("id").alias("round_id"), "organization_id",
        (F.col("judges_per_submission") if seats is None else F.lit(seats)).alias("seats"),
    ).join(crowd, "organization_id")
    ranked = running_total(
        submissions.select("round_id", F.col("id").alias("submission_id")),
        ["round_id"], "submission_id", {"place": F.lit(1)},
    )
    dealt = (
        ranked.join(per_round, "round_id")
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.least("seats", "n_judges") - 1)))
        .withColumn("judge_index", F.pmod(F.col("place") * F.col("seats") + F.col("k"), F.col("n_judges")))
    )
    return dealt.join(judges, ["organization_id", "judge_index"]).select("round_id", "submission_id", "judge_id")


_STEP_SCHEMA = (
    "round_id bigint, kind string, step bigint, submission_id bigint, "
    "head array<array<bigint>>, cycle array<array<bigint>>"
)


def _deal(steps: pd.DataFrame, judges: pd.DataFrame) -> pd.DataFrame:
    """Walk one round: steps are single part-filled submissions or runs of empty ones.

    A run is only walked until the pattern of relative loads repeats; its picks
    are returned as a head and a cycle, so the work depends on the number of
    judges and part-filled submissions, not on the number of submissions.
    """
    if steps.empty or judges.empty:
        return pd.DataFrame(columns=["round_id", "kind", "step", "submission_id", "head", "cycle"])
    load = {int(j): int(n) for j, n in zip(judges["judge_id"], judges["load"])}
    heap = [(n, j) for j, n in load.items()]
    heapq.heapify(heap)

    def seat(taken: set[int], free: int) -> list[int]:
        chosen, skipped = [], []
        while len(chosen) < free and heap:
            n, j = heapq.heappop(heap)
            if j in taken:
                skipped.append((n, j))
            else:
                chosen.append(j)
        for j in chosen:
            load[j] += 1
            skipped.append((load[j], j))
        for entry in skipped:
            heapq.heappush(heap, entry)
        return chosen

    def shape() -> tuple:
        low = min(load.values())
        return tuple(n - low for n in load.values())

    out = []
    for row in steps.sort_values(["step", "kind"]).itertuples():
        seats = int(row.seats)
        if row.kind == "part":
            taken = {int(j) for j in row.taken}
            out.append((row.round_id, "part", row.step, row.submission_id, [seat(taken, seats - len(taken))], []))
            continue
        # Once loads are level, picks repeat after every judge got equally many.
        period = max(1, len(load) // math.gcd(len(load), min(seats, len(load))))
        length, picks, before = int(row.length), [], shape()
        head = length
        while len(picks) < length:
            picks.append(seat(set(), seats))
            if len(picks) % period == 0:
                after = shape()
                if after == before:
                    head = len(picks) - period
                    break
                before = after
        cycle = picks[head:]
        rest = length - len(picks)
        if rest:
            for i, picked in enumerate(cycle):
                for j in picked:
                    load[j] += rest // period + (1 if i < rest % period else 0)
            heap = [(n, j) for j, n in load.items()]
            heapq.heapify(heap)
        out.append((row.round_id, "run", row.step, None, picks[:head], cycle))
    return pd.DataFrame(out, columns=["round_id", "kind", "step", "submission_id", "head", "cycle"])


def auto_assign(rounds: DataFrame, submissions: DataFrame, users: DataFrame, assignments: DataFrame) -> DataFrame:
    """Balanced assignment on top of existing assignments.

    The order of picks matters only through the loads.  Full submissions drop
    out; empty ones between two part-filled ones are counted, not listed; the
    walk over these counts is the one sequential part, per round, and each empty
    submission then reads its picks from its run by position.
    """
    seats = F.col("judges_per_submission").alias("seats")
    per_round = rounds.select(F.col("id").alias("round_id"), "organization_id", seats)
    held = assignments.groupBy("submission_id").agg(F.collect_set("judge_id").alias("taken"))
    open_subs = (
        submissions.select("round_id", F.col("id").alias("submission_id"))
        .join(held, "submission_id", "left")
        .join(per_round, "round_id")
        .withColumn("taken", F.coalesce("taken", F.array().cast("array<bigint>")))
        .filter(F.size("taken") < F.col("seats"))
        .withColumn("part", (F.size("taken") > 0).cast("int"))
    )
    counted = running_total(
        open_subs, ["round_id"], "submission_id", {"step": F.col("part"), "empties": 1 - F.col("part")}
    )
    parts = counted.filter("part = 1").select(
        "round_id", F.lit("part").alias("kind"), (F.col("step") + 1).alias("step"),
        "submission_id", "seats", "taken", F.lit(1).cast("bigint").alias("length"),
    )
    empties = counted.filter("part = 0")
    run_starts = empties.groupBy("round_id", "step").agg(
        F.min("empties").alias("start"), F.count("*").alias("length"), F.first("seats").alias("seats")
    )
    runs = run_starts.select(
        "round_id", F.lit("run").alias("kind"), "step", F.lit(None).cast("bigint").alias("submission_id"),
        "seats", F.array().cast("array<bigint>").alias("taken"), "length",
    )
    # A part-filled submission comes before the run that follows it: "part" < "run".
    steps = parts.unionByName(runs)
    pool = users.filter((F.col("role") == "judge") & F.col("is_active")).select(
        "organization_id", F.col("id").alias("judge_id")
    )
    loads = assignments.groupBy("round_id", "judge_id").agg(F.count("*").alias("load"))
    judges = (
        per_round.join(steps.select("round_id").distinct(), "round_id")
        .join(pool, "organization_id")
        .join(loads, ["round_id", "judge_id"], "left")
        .select("round_id", "judge_id", F.coalesce("load", F.lit(0)).alias("load"))
    )
    dealt = steps.groupBy("round_id").cogroup(judges.groupBy("round_id")).applyInPandas(_deal, _STEP_SCHEMA)
    to_parts = dealt.filter("kind = 'part'").select(
        "round_id", "submission_id", F.explode(F.col("head")[0]).alias("judge_id")
    )
    at = F.col("empties") - F.col("start")
    n_head = F.size("head")
    picks = F.when(at < n_head, F.get("head", at.cast("int"))).otherwise(
        F.get("cycle", F.pmod(at - n_head, F.greatest(F.size("cycle"), F.lit(1))).cast("int"))
    )
    run_picks = dealt.filter("kind = 'run'").select("round_id", "step", "head", "cycle")
    to_runs = (
        empties.join(run_starts.select("round_id", "step", "start"), ["round_id", "step"])
        .join(run_picks, ["round_id", "step"])
        .select("round_id", "submission_id", F.explode(picks).alias("judge_id"))
    )
    return to_parts.unionByName(to_runs)


def check_manual(requests: DataFrame, submissions: DataFrame, users: DataFrame, assignments: DataFrame) -> DataFrame:
    """requests(round_id, organization_id, submission_id, judge_id) + reject_reason."""
    subs = submissions.select(F.col("id").alias("submission_id"), F.col("round_id").alias("sub_round"))
    judges = users.filter("role = 'judge'").select(
        F.col("id").alias("judge_id"), F.col("organization_id").alias("judge_org")
    )
    pairs = assignments.select("submission_id", "judge_id", F.lit(True).alias("held")).distinct()
    found = F.coalesce(F.col("sub_round") == F.col("round_id"), F.lit(False))
    known = F.coalesce(F.col("judge_org") == F.col("organization_id"), F.lit(False))
    reason = (
        F.when(~found, V.ASSIGN_ERRORS["submission"])
        .when(~known, V.ASSIGN_ERRORS["judge"])
        .when(F.col("held"), V.ASSIGN_ERRORS["taken"])
    )
    return (
        requests.join(subs, "submission_id", "left")
        .join(judges, "judge_id", "left")
        .join(pairs, ["submission_id", "judge_id"], "left")
        .select(*requests.columns, reason.alias("reject_reason"))
    )


def unassign(assignments: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assignments left, refused requests): only untouched assignments can go."""
    untouched = requests.join(
        assignments.filter("status = 'assigned'").select("assignment_id"), "assignment_id", "left_semi"
    )
    kept = assignments.join(untouched.select("assignment_id"), "assignment_id", "left_anti")
    refused = (
        requests.join(assignments.select("assignment_id", "status"), "assignment_id")
        .filter("status <> 'assigned'")
        .select("assignment_id", F.lit(V.ASSIGN_ERRORS["started"]).alias("reason"))
    )
    return kept, refused


def judge_load(rounds: DataFrame, users: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every judge of a round's organization with assigned and completed counts."""
    counts = assignments.groupBy("round_id", "judge_id").agg(
        F.count("*").alias("assigned"), F.count_if(F.col("status") == "completed").alias("completed")
    )
    judges = users.filter("role = 'judge'").select("organization_id", F.col("id").alias("judge_id"), "name")
    return (
        rounds.select(F.col("id").alias("round_id"), "organization_id")
        .join(judges, "organization_id")
        .join(counts, ["round_id", "judge_id"], "left")
        .select(
            "round_id", "judge_id", "name",
            F.coalesce("assigned", F.lit(0)).alias("assigned"),
            F.coalesce("completed", F.lit(0)).alias("completed"),
        )
    )


def below_target(rounds: DataFrame, submissions: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per round: submissions holding fewer judges than the round asks for."""
    held = assignments.groupBy("submission_id").agg(F.count("*").alias("n"))
    short: Column = F.coalesce("n", F.lit(0)) < F.col("judges_per_submission")
    return (
        submissions.select(F.col("id").alias("submission_id"), "round_id")
        .join(held, "submission_id", "left")
        .join(rounds.select(F.col("id").alias("round_id"), "judges_per_submission"), "round_id")
        .groupBy("round_id")
        .agg(F.count_if(short).alias("below_target"))
    )
