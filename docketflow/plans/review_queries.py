"""Registered queries: scoring, assignment, reporting, events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions import display
from docketflow.operators import assignment as A
from docketflow.operators import audit_pages as AP
from docketflow.operators import events as E
from docketflow.operators import reporting as R
from docketflow.operators import scoring as S
from docketflow.plans.catalog import Catalog, read
from docketflow.plans.dialect import duck_lookup, duck_mean, duck_round, quote
from docketflow.plans.review_entities import duck_entities, entity
from docketflow.session import ensure_checkpoint_dir

CATALOG = Catalog()


def _micros(*names: str):
    return [F.unix_micros(F.col(n)).alias(n) for n in names]


def _get(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [entity(spark, folder, n) for n in names]


_LATEST_SCORES = """
latest AS (SELECT assignment_id, criterion_id,
    arg_max(score, {'a': shipped, 'b': price, 'c': l_partkey, 'd': l_suppkey, 'e': l_discount, 'f': l_tax, 'g': score}) AS score
  FROM scores GROUP BY ALL)"""

_WEIGHTED = _LATEST_SCORES + f""",
weighted AS (SELECT a.assignment_id, a.round_id, {duck_round('''coalesce(100 * sum(r.weight * (l.score / 50))
    / (SELECT sum(weight) FROM rubric q WHERE q.round_id = a.round_id), 0.0)''')} AS weighted_score
  FROM assignments a LEFT JOIN latest l USING (assignment_id)
  LEFT JOIN rubric r ON r.round_id = a.round_id AND r.criterion_id = l.criterion_id
  GROUP BY a.assignment_id, a.round_id)"""


# --- scoring ---------------------------------------------------------------

@CATALOG.query("sco1_weighted_score", duck_entities("rubric", "assignments", "scores").rstrip() + "," + _WEIGHTED + """
SELECT assignment_id, round_id, weighted_score FROM weighted""")
def weighted_score(spark, folder):
    rounds, rubric, asg, scores = _get(spark, folder, "rounds", "rubric", "assignments", "scores")
    return S.weighted_score(asg, scores, rubric, rounds)


@CATALOG.query("sco1_results_by_submission", duck_entities("rubric", "assignments", "scores").rstrip() + "," + _WEIGHTED + f"""
SELECT a.submission_id, a.round_id, count(*) AS judges_completed,
  {duck_round(duck_mean('w.weighted_score'))} AS mean_score,
  min(w.weighted_score) AS min_score, max(w.weighted_score) AS max_score,
  CASE WHEN count(*) > 1 THEN {duck_round('max(w.weighted_score) - min(w.weighted_score)')} END AS spread,
  coalesce(count(*) > 1 AND {duck_round('max(w.weighted_score) - min(w.weighted_score)')} >= 15, FALSE) AS needs_calibration
FROM assignments a JOIN weighted w USING (assignment_id) WHERE a.status = 'completed'
GROUP BY a.submission_id, a.round_id""")
def flagship(spark, folder):
    """Line-item scores to weighted scores to one row per submission."""
    from docketflow.functions.numeric import exact_mean, round_half_even

    rounds, rubric, asg, scores = _get(spark, folder, "rounds", "rubric", "assignments", "scores")
    done = asg.filter("status = 'completed'")
    weighted = S.weighted_score(done, scores, rubric, rounds)
    value = F.col("weighted_score")
    spread = F.when(F.count("*") > 1, round_half_even(F.max(value) - F.min(value)))
    return (
        done.select("assignment_id", "submission_id")
        .join(weighted, "assignment_id")
        .groupBy("submission_id", "round_id")
        .agg(
            F.count("*").alias("judges_completed"),
            round_half_even(exact_mean(value)).alias("mean_score"),
            F.min(value).alias("min_score"),
            F.max(value).alias("max_score"),
            spread.alias("spread"),
            F.coalesce(spread >= V.SPREAD_THRESHOLD, F.lit(False)).alias("needs_calibration"),
        )
    )


_VIOLATIONS = """
rowed AS (SELECT s.*, a.round_id, {'a': shipped, 'b': price, 'c': l_partkey, 'd': l_suppkey, 'e': l_discount, 'f': l_tax, 'g': s.score} AS ord,
    CASE WHEN r.criterion_id IS NULL THEN 'Unknown criterion ' || s.criterion_id
      WHEN NOT (s.bad BETWEEN 1 AND 50) THEN 'Scores must be between 1 and 50'
      WHEN s.bad * 2 <> round(s.bad * 2) THEN 'Scores must be whole or half points' END AS reason
  FROM (SELECT *, score + CASE WHEN l_partkey % 19 = 0 THEN 0.25 WHEN l_partkey % 17 = 0 THEN 50 WHEN l_partkey % 2 = 0 THEN 0.5 ELSE 0 END AS bad
        FROM scores) s
  JOIN assignments a USING (assignment_id)
  LEFT JOIN rubric r ON r.round_id = a.round_id AND r.criterion_id = s.criterion_id)"""


def _odd_scores(spark, folder):
    """Line-item scores with some broken ones, so that every check has work."""
    part = F.col("l_partkey")
    shift = F.when(part % 19 == 0, 0.25).when(part % 17 == 0, 50.0).when(part % 2 == 0, 0.5).otherwise(0.0)
    return entity(spark, folder, "scores").withColumn("score", F.col("score") + shift)


@CATALOG.query("sco2_score_violations", duck_entities("rubric", "assignments", "scores").rstrip() + "," + _VIOLATIONS + """
SELECT assignment_id, criterion_id, reason, count(*) AS n FROM rowed WHERE reason IS NOT NULL GROUP BY ALL""")
def violations(spark, folder):
    rounds, rubric, asg = _get(spark, folder, "rounds", "rubric", "assignments")
    bad = S.score_violations(asg, _odd_scores(spark, folder), rubric, rounds)
    return bad.groupBy("assignment_id", "criterion_id", "reason").agg(F.count("*").alias("n"))


_REJECTIONS = _VIOLATIONS + """,
firsts AS (SELECT assignment_id, arg_min(reason, ord) FILTER (WHERE reason IS NOT NULL) AS row_reason,
    list(DISTINCT criterion_id) AS scored FROM rowed GROUP BY 1),
rejections AS (SELECT a.assignment_id, coalesce(f.row_reason, CASE WHEN count(r.criterion_id) FILTER (WHERE NOT coalesce(list_contains(f.scored, r.criterion_id), FALSE)) > 0
    THEN 'Please score every criterion (missing: ' || string_agg(r.name, ', ' ORDER BY r.position)
      FILTER (WHERE NOT coalesce(list_contains(f.scored, r.criterion_id), FALSE)) || ')' END) AS reason
  FROM assignments a JOIN rubric r ON r.round_id = a.round_id LEFT JOIN firsts f USING (assignment_id)
  GROUP BY a.assignment_id, f.row_reason)"""


@CATALOG.query("sco2_score_rejections", duck_entities("rubric", "assignments", "scores").rstrip() + "," + _REJECTIONS + """
SELECT * FROM rejections WHERE reason IS NOT NULL""")
def rejections(spark, folder):
    rounds, rubric, asg = _get(spark, folder, "rounds", "rubric", "assignments")
    return S.score_rejections(asg, _odd_scores(spark, folder), rubric, rounds)


@CATALOG.query("sco2_clean_scores", duck_entities("rubric", "assignments", "scores").rstrip() + "," + _REJECTIONS + """
SELECT o.assignment_id, r.position, o.criterion_id, arg_max(o.bad, o.ord) AS score, trim(arg_max(o.comment, o.ord)) AS comment
FROM rowed o JOIN rejections j ON j.assignment_id = o.assignment_id AND j.reason IS NULL
JOIN rubric r ON r.round_id = o.round_id AND r.criterion_id = o.criterion_id GROUP BY 1, 2, 3""")
def clean(spark, folder):
    rounds, rubric, asg = _get(spark, folder, "rounds", "rubric", "assignments")
    return S.clean_scores(asg, _odd_scores(spark, folder), rubric, rounds)


@CATALOG.query("sco3_shift_metrics", duck_entities("revisions") + """
SELECT assignment_id, initial_to_ai_difference, initial_to_revised_difference, revision_direction FROM revisions""")
def shift_metrics(spark, folder):
    rev = entity(spark, folder, "revisions")
    m = S.shift_metrics(F.col("human_initial_score"), F.col("ai_score"), F.col("human_revised_score"))
    return rev.select("assignment_id", *[c.alias(k) for k, c in m.items()])


def _finalize_inputs(spark, folder):
    """A finalize request for every assignment: revised sheets from its line items.

    Line numbers beyond the rubric are folded into it except for every seventh
    assignment; comments come padded, null, equal and changed, scores null,
    moved and unchanged.
    """
    rounds, rubric, asg, scores, evals, reveals = _get(
        spark, folder, "rounds", "rubric", "assignments", "scores", "evaluations", "reveals"
    )
    of = F.col("assignment_id")
    rows = S.latest_scores(scores).select(
        "assignment_id", F.col("criterion_id").alias("raw"), "score",
        F.when(of % 7 == 0, F.col("criterion_id")).otherwise((F.col("criterion_id") - 1) % 5 + 1).alias("criterion_id"),
        F.when(of % 5 == 2, "").otherwise("ok").alias("held_comment"),
        F.when((of % 23 == 0) & (F.col("criterion_id") == 2), F.lit(None))
        .when((F.col("criterion_id") == 4) & (F.col("score") > 5), F.col("score") - of % 3)
        .otherwise(F.col("score")).cast("double").alias("new_score"),
        F.when(of % 5 == 0, " ok ").when(of % 5 == 2, F.lit(None)).when(of % 5 == 4, "changed").otherwise("ok").alias("new_comment"),
    )
    lists = F.sort_array(F.collect_list(F.struct(
        "raw", "criterion_id", "score", "held_comment", "new_score", "new_comment")))
    sheets = rows.groupBy("assignment_id").agg(lists.alias("all"))
    revised = F.transform("all", lambda s: F.struct(
        s["criterion_id"].alias("criterion_id"), s["new_score"].alias("score"), s["new_comment"].alias("comment")))
    held = F.transform("all", lambda s: F.struct(
        s["criterion_id"].alias("criterion_id"), s["score"].alias("score"), s["held_comment"].alias("comment")))
    held_in_order = (
        sheets.join(asg.select("assignment_id", "round_id"), "assignment_id")
        .join(S.rubric_by_round(rubric), "round_id")
        .select("assignment_id", S.clean_sheet(held, F.col("criteria")).alias("criterion_scores"))
    )
    evaluations = evals.select("assignment_id", "weighted_score").join(held_in_order, "assignment_id", "left")
    machine = sheets.select("assignment_id", F.transform("all", lambda s: F.struct(
        s["raw"].alias("criterion_id"), (s["score"] / 5).alias("score"))).alias("ai_criterion_scores"))
    requests = asg.join(sheets, "assignment_id", "left").select(
        "assignment_id",
        F.when(of % 2 == 0, "revise").otherwise("keep").alias("decision"),
        F.when(of % 10 != 0, revised).alias("revised_scores"),
        F.lit(" why ").alias("reason"),
        (F.coalesce("submitted_at", "assigned_at") + F.expr("INTERVAL 75 SECOND")).alias("finalized_at"),
    )
    done = entity(spark, folder, "revisions").filter("ai_score is null").select("assignment_id")
    return requests, evaluations, reveals.join(machine, "assignment_id", "left"), done, asg, rubric, rounds


_FINALIZE = _LATEST_SCORES + f""",
raws AS (SELECT assignment_id, criterion_id AS raw, score, CASE WHEN assignment_id % 7 = 0 THEN criterion_id ELSE (criterion_id - 1) % 5 + 1 END AS cid,
    CASE WHEN assignment_id % 5 = 2 THEN '' ELSE 'ok' END AS held_comment,
    CASE WHEN assignment_id % 23 = 0 AND criterion_id = 2 THEN NULL WHEN criterion_id = 4 AND score > 5 THEN score - assignment_id % 3 ELSE score END AS new_score,
    CASE WHEN assignment_id % 5 = 2 THEN '' WHEN assignment_id % 5 = 4 THEN 'changed' ELSE 'ok' END AS new_comment FROM latest),
judged AS (SELECT w.*, a.round_id, r.weight, r.position, r.name,
    CASE WHEN r.criterion_id IS NULL THEN 'Unknown criterion ' || w.cid
      WHEN w.new_score IS NULL OR NOT (w.new_score BETWEEN 1 AND 50) THEN 'Scores must be between 1 and 50'
      WHEN w.new_score * 2 <> round(w.new_score * 2) THEN 'Scores must be whole or half points' END AS problem
  FROM raws w JOIN assignments a USING (assignment_id) LEFT JOIN rubric r ON r.round_id = a.round_id AND r.criterion_id = w.cid),
firsts AS (SELECT assignment_id, arg_min(problem, raw) FILTER (WHERE problem IS NOT NULL) AS row_problem, list(DISTINCT cid) AS cids FROM judged GROUP BY 1),
lasts AS (SELECT assignment_id, cid, position, weight, arg_max({{'s': score, 'c': held_comment, 'n': new_score, 'm': new_comment}}, raw) AS e
  FROM judged WHERE position IS NOT NULL GROUP BY ALL),
lists AS (SELECT assignment_id, string_agg(cid || '|' || CAST(e.s AS DOUBLE) || '|' || e.c, ';' ORDER BY position) AS held,
    string_agg(cid || '|' || coalesce(CAST(CAST(e.n AS DOUBLE) AS STRING), '') || '|' || e.m, ';' ORDER BY position) AS revised,
    sum(weight * (e.n / 50) ORDER BY position) AS value FROM lasts GROUP BY 1),
machine AS (SELECT assignment_id, string_agg(criterion_id || '|' || CAST(score / 5 AS DOUBLE), ';' ORDER BY criterion_id) AS ai_list FROM latest GROUP BY 1),
absent AS (SELECT a.assignment_id, string_agg(r.name, ', ' ORDER BY r.position) AS names FROM assignments a JOIN rubric r ON r.round_id = a.round_id
  LEFT JOIN firsts f USING (assignment_id) WHERE NOT coalesce(list_contains(f.cids, r.criterion_id), FALSE) GROUP BY 1),
joined AS (SELECT a.assignment_id, a.round_id, e.weighted_score, v.revealed_at, v.ai_available, v.ai_score_shown, d.assignment_id AS done,
    a.assignment_id % 2 = 0 AS asked, a.assignment_id % 10 <> 0 AND f.assignment_id IS NOT NULL AS given,
    coalesce(f.row_problem, 'Please score every criterion (missing: ' || b.names || ')') AS problem, l.held, l.revised, l.value, m.ai_list
  FROM assignments a LEFT JOIN evaluations e USING (assignment_id) LEFT JOIN reveals v USING (assignment_id)
  LEFT JOIN (SELECT assignment_id FROM revisions WHERE ai_score IS NULL) d USING (assignment_id)
  LEFT JOIN firsts f USING (assignment_id) LEFT JOIN lists l USING (assignment_id) LEFT JOIN absent b USING (assignment_id)
  LEFT JOIN machine m USING (assignment_id)),
checked AS (SELECT *, CASE WHEN weighted_score IS NULL THEN 'Submit your evaluation first.'
      WHEN revealed_at IS NULL THEN 'Review the AI assessment before finishing.'
      WHEN done IS NOT NULL THEN 'This evaluation is already complete.'
      WHEN asked AND NOT given THEN 'Provide revised scores.' WHEN asked THEN problem END AS rejected,
    CASE WHEN ai_available THEN ai_score_shown END AS ai, asked AND given AND held <> revised AS changed FROM joined),
total AS (SELECT c.*, CASE WHEN changed THEN {duck_round('100 * value / (SELECT sum(weight) FROM rubric q WHERE q.round_id = c.round_id)')}
    ELSE weighted_score END AS final FROM checked c),
diffs AS (SELECT *, {duck_round('final - weighted_score')} AS dr, {duck_round('ai - weighted_score')} AS da FROM total)
SELECT assignment_id, rejected, CASE WHEN rejected IS NULL THEN CASE WHEN changed THEN 'revised' ELSE 'kept' END END AS decision,
  CASE WHEN rejected IS NULL THEN weighted_score END AS human_initial_score,
  CASE WHEN rejected IS NULL THEN ai END AS ai_score, CASE WHEN rejected IS NULL THEN final END AS human_revised_score,
  CASE WHEN rejected IS NULL THEN 'why' END AS revision_reason,
  CASE WHEN rejected IS NULL THEN coalesce(held, '') END AS initial_list,
  CASE WHEN rejected IS NULL THEN coalesce(CASE WHEN asked AND given THEN revised ELSE held END, '') END AS revised_list,
  CASE WHEN rejected IS NULL AND ai_available THEN coalesce(ai_list, '') END AS ai_list,
  CASE WHEN rejected IS NULL THEN da END AS initial_to_ai_difference,
  CASE WHEN rejected IS NULL THEN dr END AS initial_to_revised_difference,
  CASE WHEN rejected IS NULL THEN CASE WHEN ai IS NULL THEN 'ai_unavailable' WHEN dr = 0 THEN 'no_change'
    WHEN sign(dr) = sign(da) THEN 'toward_ai' ELSE 'away_from_ai' END END AS revision_direction,
  CASE WHEN rejected IS NULL THEN 15.0::DOUBLE END AS seconds_since_reveal
FROM diffs"""


def _listed(scores: str, *fields: str):
    """A sheet as text."""
    part = F.transform(scores, lambda s: F.concat_ws("|", *[F.coalesce(s[f].cast("string"), F.lit("")) for f in fields]))
    return F.array_join(part, ";")


@CATALOG.query("sco4_finalize_reviews", duck_entities(
    "rubric", "assignments", "scores", "evaluations", "reveals", "revisions").rstrip() + "," + _FINALIZE)
def finalize(spark, folder):
    done = S.finalize_reviews(*_finalize_inputs(spark, folder))
    ok = F.col("rejected").isNull()
    return done.withColumns({
        "initial_list": F.when(ok, F.coalesce(_listed("initial_criterion_scores", "criterion_id", "score", "comment"), F.lit(""))),
        "revised_list": F.when(ok, F.coalesce(_listed("revised_criterion_scores", "criterion_id", "score", "comment"), F.lit(""))),
        "ai_list": F.when(ok & F.col("ai_score").isNotNull(), F.coalesce(_listed("ai_criterion_scores", "criterion_id", "score"), F.lit(""))),
    }).drop("initial_criterion_scores", "revised_criterion_scores", "ai_criterion_scores")


@CATALOG.query("sco5_review_minutes", duck_entities("assignments", "reveals", "revisions") + f"""
SELECT a.assignment_id, (epoch_us(a.submitted_at) - epoch_us(a.opened_at)) / 1e6 / 60 AS review_minutes,
  {duck_round('(epoch_us(r.created_at) - epoch_us(v.revealed_at)) / 1e6')} AS seconds_since_reveal
FROM assignments a LEFT JOIN reveals v USING (assignment_id) LEFT JOIN revisions r USING (assignment_id)""")
def minutes(spark, folder):
    from docketflow.functions.numeric import round_half_even

    asg, reveals, revisions = _get(spark, folder, "assignments", "reveals", "revisions")
    return (
        asg.join(reveals, "assignment_id", "left").join(revisions.select("assignment_id", "created_at"), "assignment_id", "left")
        .select(
            "assignment_id",
            S.review_minutes(F.col("opened_at"), F.col("submitted_at")).alias("review_minutes"),
            round_half_even(S.elapsed_seconds(F.col("revealed_at"), F.col("created_at"))).alias("seconds_since_reveal"),
        )
    )


@CATALOG.query("sco6_rubric_check", duck_entities("rounds", "rubric") + """
SELECT d.id AS round_id, count(r.criterion_id) AS n_criteria, sum(r.weight) AS total_weight,
  CASE WHEN count(r.criterion_id) = 0 THEN 'Define at least one criterion'
    WHEN abs(sum(r.weight) - 100) > 0.01 THEN 'Criterion weights must add up to 100% (currently ' || CAST(sum(r.weight) AS INT) || '%)'
    WHEN count(DISTINCT lower(trim(r.name))) <> count(r.criterion_id) THEN 'Criterion names must be unique' END AS problem
FROM rounds d LEFT JOIN rubric r ON r.round_id = d.id GROUP BY d.id""")
def rubric_check(spark, folder):
    return S.rubric_check(*_get(spark, folder, "rounds", "rubric"))


@CATALOG.query("sco7_rubric_locked", duck_entities("rounds", "assignments") + """
SELECT d.id AS round_id, coalesce(bool_or(a.status IN ('submitted', 'completed')), FALSE) AS rubric_locked
FROM rounds d LEFT JOIN assignments a ON a.round_id = d.id GROUP BY d.id""")
def rubric_locked(spark, folder):
    return S.rubric_locked(*_get(spark, folder, "rounds", "assignments"))


@CATALOG.query("sco8_draft_total", duck_entities("rubric", "assignments", "scores").rstrip() + "," + _LATEST_SCORES + """
SELECT a.assignment_id, CASE WHEN count(r.criterion_id) = 5
  THEN floor(1000 * sum(r.weight * (l.score / 50)) / (SELECT sum(weight) FROM rubric q WHERE q.round_id = a.round_id) + 0.5) / 10 END AS draft_total
FROM assignments a LEFT JOIN latest l USING (assignment_id)
LEFT JOIN rubric r ON r.round_id = a.round_id AND r.criterion_id = l.criterion_id GROUP BY a.assignment_id, a.round_id""")
def draft_total(spark, folder):
    rounds, rubric, asg, scores = _get(spark, folder, "rounds", "rubric", "assignments", "scores")
    return S.draft_total(asg, scores, rubric, rounds)


@CATALOG.query("sco9_compare_criteria", duck_entities("scores").rstrip() + "," + _LATEST_SCORES + """,
own AS (SELECT * FROM latest), ai AS (SELECT assignment_id, criterion_id, CASE WHEN criterion_id % 3 <> 0 THEN score / 5 END AS s FROM latest),
rev AS (SELECT assignment_id, criterion_id, CASE WHEN assignment_id % 4 <> 0 THEN score + assignment_id % 2 END AS s FROM latest)
SELECT o.assignment_id, o.criterion_id, o.score AS own_score, a.s AS ai_score, r.s AS revised_score,
  a.s - o.score AS difference, coalesce(r.s <> o.score, FALSE) AS changed
FROM own o LEFT JOIN ai a USING (assignment_id, criterion_id) LEFT JOIN rev r USING (assignment_id, criterion_id)""")
def compare(spark, folder):
    own = S.latest_scores(entity(spark, folder, "scores"))
    machine = own.withColumn("score", F.when(F.col("criterion_id") % 3 != 0, F.col("score") / 5))
    revised = own.withColumn("score", F.when(F.col("assignment_id") % 4 != 0, F.col("score") + F.col("assignment_id") % 2))
    return S.compare_criteria(own, machine, revised)


# --- assignment ------------------------------------------------------------

@CATALOG.query("asg1_auto_assign_empty", duck_entities("rounds", "submissions", "users") + """
, j AS (SELECT organization_id, id AS judge_id, row_number() OVER (PARTITION BY organization_id ORDER BY id) - 1 AS idx,
    count(*) OVER (PARTITION BY organization_id) AS n FROM users WHERE role = 'judge' AND is_active),
s AS (SELECT s.round_id, s.id AS submission_id, r.organization_id, r.judges_per_submission AS per,
    row_number() OVER (PARTITION BY s.round_id ORDER BY s.id) - 1 AS place FROM submissions s JOIN rounds r ON r.id = s.round_id)
SELECT s.round_id, s.submission_id, j.judge_id FROM s, unnest(range(10)) t(k), j
WHERE j.organization_id = s.organization_id AND t.k < least(s.per, j.n) AND j.idx = (s.place * s.per + t.k) % j.n""")
def auto_assign_empty(spark, folder):
    return A.auto_assign_empty(*_get(spark, folder, "rounds", "submissions", "users"))


@CATALOG.query("asg1_auto_assign_chosen", duck_entities("rounds", "submissions", "users") + """
, j AS (SELECT organization_id, id AS judge_id, row_number() OVER (PARTITION BY organization_id ORDER BY id) - 1 AS idx,
    count(*) OVER (PARTITION BY organization_id) AS n FROM users WHERE role = 'judge' AND is_active AND title IN ('BUILDING', 'MACHINERY')),
s AS (SELECT s.round_id, s.id AS submission_id, r.organization_id, 2 AS per,
    row_number() OVER (PARTITION BY s.round_id ORDER BY s.id) - 1 AS place FROM submissions s JOIN rounds r ON r.id = s.round_id)
SELECT s.round_id, s.submission_id, j.judge_id FROM s, unnest(range(10)) t(k), j
WHERE j.organization_id = s.organization_id AND t.k < least(s.per, j.n) AND j.idx = (s.place * s.per + t.k) % j.n""")
def auto_assign_chosen(spark, folder):
    """Two seats per submission for the judges of two trades."""
    rounds, subs, users = _get(spark, folder, "rounds", "submissions", "users")
    chosen = users.filter("title in ('BUILDING', 'MACHINERY')").select(F.col("id").alias("judge_id"))
    return A.auto_assign_empty(rounds, subs, users, chosen, 2)


def _manual_requests(spark, folder):
    return read(spark, folder, "orders").select(
        (F.expr("o_orderkey div 5") % 25).alias("round_id"),
        (F.col("o_orderkey") % 5).alias("organization_id"),
        F.expr("o_orderkey div 3").alias("submission_id"),
        F.expr("o_custkey").alias("judge_id"),
    )


@CATALOG.query("asg2_manual_check", duck_entities("submissions", "users", "assignments") + f"""
, q AS (SELECT (o_orderkey // 5) % 25 AS round_id, o_orderkey % 5 AS organization_id, o_orderkey // 3 AS submission_id, o_custkey AS judge_id FROM orders)
SELECT q.*, CASE WHEN s.id IS NULL OR s.round_id <> q.round_id THEN 'Submission not found'
    WHEN u.id IS NULL OR u.role <> 'judge' OR u.organization_id <> q.organization_id THEN 'Judge not found'
    WHEN EXISTS (SELECT 1 FROM assignments a WHERE a.submission_id = q.submission_id AND a.judge_id = q.judge_id)
      THEN 'Judge is already assigned to this submission' END AS reject_reason
FROM q LEFT JOIN submissions s ON s.id = q.submission_id LEFT JOIN users u ON u.id = q.judge_id""")
def manual_check(spark, folder):
    subs, users, asg = _get(spark, folder, "submissions", "users", "assignments")
    return A.check_manual(_manual_requests(spark, folder), subs, users, asg)


@CATALOG.query("asg3_unassign_kept", duck_entities("assignments") + """
SELECT assignment_id, status FROM assignments WHERE NOT (status = 'assigned' AND assignment_id % 3 = 0)""")
def unassign_kept(spark, folder):
    asg = entity(spark, folder, "assignments")
    kept, _ = A.unassign(asg, asg.filter("assignment_id % 3 = 0").select("assignment_id"))
    return kept.select("assignment_id", "status")


@CATALOG.query("asg3_unassign_refused", duck_entities("assignments") + f"""
SELECT assignment_id, {quote(V.ASSIGN_ERRORS['started'])} AS reason FROM assignments WHERE status <> 'assigned' AND assignment_id % 3 = 0""")
def unassign_refused(spark, folder):
    asg = entity(spark, folder, "assignments")
    return A.unassign(asg, asg.filter("assignment_id % 3 = 0").select("assignment_id"))[1]


@CATALOG.query("asg4_judge_load", duck_entities("rounds", "users", "assignments") + """
SELECT r.id AS round_id, u.id AS judge_id, u.name, count(a.assignment_id) AS assigned,
  count(a.assignment_id) FILTER (WHERE a.status = 'completed') AS completed
FROM rounds r JOIN users u ON u.organization_id = r.organization_id AND u.role = 'judge'
LEFT JOIN assignments a ON a.round_id = r.id AND a.judge_id = u.id GROUP BY ALL""")
def judge_load(spark, folder):
    return A.judge_load(*_get(spark, folder, "rounds", "users", "assignments"))


@CATALOG.query("asg5_below_target", duck_entities("rounds", "submissions", "assignments") + """
SELECT s.round_id, count(*) FILTER (WHERE coalesce(n, 0) < r.judges_per_submission) AS below_target
FROM submissions s JOIN rounds r ON r.id = s.round_id
LEFT JOIN (SELECT submission_id, count(*) AS n FROM assignments GROUP BY 1) a ON a.submission_id = s.id GROUP BY 1""")
def below_target(spark, folder):
    return A.below_target(*_get(spark, folder, "rounds", "submissions", "assignments"))


# --- reporting -------------------------------------------------------------

_STAGES = """
progress AS (SELECT submission_id, count(*) AS n_assigned, count(*) FILTER (WHERE status = 'completed') AS n_completed,
    count(*) FILTER (WHERE status <> 'assigned') AS n_started FROM assignments GROUP BY 1),
staged AS (SELECT s.*, coalesce(n_assigned, 0) AS n_assigned, coalesce(n_completed, 0) AS n_completed,
  CASE WHEN s.status IN ('uploaded', 'processing') THEN 'processing'
    WHEN s.status = 'processing_failed' AND n_assigned IS NULL THEN 'failed'
    WHEN n_assigned = n_completed THEN 'completed' WHEN n_started > 0 THEN 'in_review' ELSE 'awaiting_review' END AS stage
  FROM submissions s LEFT JOIN progress p ON p.submission_id = s.id)"""
_STAGED = duck_entities("submissions", "assignments").rstrip() + "," + _STAGES
_TOTALS = """SELECT round_id, count(*) AS submissions, count(*) FILTER (WHERE status IN ('ready', 'partially_processed')) AS processed,
  count(*) FILTER (WHERE stage = 'processing') AS processing, count(*) FILTER (WHERE status = 'processing_failed') AS failed,
  count(*) FILTER (WHERE stage = 'awaiting_review') AS awaiting_review, count(*) FILTER (WHERE stage = 'in_review') AS in_review,
  count(*) FILTER (WHERE stage = 'completed') AS completed, count(*) FILTER (WHERE stage <> 'completed') AS remaining
FROM staged GROUP BY round_id"""


@CATALOG.query("rep1_latest_analysis", duck_entities("analyses") + """
SELECT submission_id, max(id) AS id, arg_max(status, id) AS status, arg_max(ai_overall_score, id) AS ai_overall_score
FROM analyses GROUP BY 1""")
def latest_analysis(spark, folder):
    a = entity(spark, folder, "analyses")
    return R.latest_analysis(a.select("id", "submission_id", "status", "ai_overall_score"))


@CATALOG.query("rep1_primary_file", duck_entities("files") + """
SELECT submission_id, min(id) AS id, arg_min(original_filename, id) AS original_filename, arg_min(page_count, id) AS page_count
FROM files GROUP BY 1""")
def primary_file(spark, folder):
    return R.primary_file(entity(spark, folder, "files").select("id", "submission_id", "original_filename", "page_count"))


@CATALOG.query("rep2_submission_stages", _STAGED + " SELECT id, status, n_assigned, n_completed, stage FROM staged")
def stages(spark, folder):
    subs, asg = _get(spark, folder, "submissions", "assignments")
    return R.submission_stages(subs, asg).select("id", "status", "n_assigned", "n_completed", "stage")


@CATALOG.query("rep3_round_totals", _STAGED + _TOTALS)
def totals(spark, folder):
    return R.round_totals(*_get(spark, folder, "submissions", "assignments"))


@CATALOG.query("rep4_assignment_totals", duck_entities("rounds", "assignments") + f"""
SELECT r.id AS round_id, count(a.assignment_id) AS total, count(*) FILTER (WHERE a.status = 'completed') AS completed,
  count(*) FILTER (WHERE a.status IN ('in_progress', 'submitted')) AS in_progress, count(*) FILTER (WHERE a.status = 'assigned') AS not_started,
  CASE WHEN count(a.assignment_id) > 0 THEN {duck_round("100 * count(*) FILTER (WHERE a.status = 'completed') / count(a.assignment_id)")} ELSE 0.0 END AS completion_pct,
  {duck_round("CAST(sum(epoch_us(a.submitted_at) - epoch_us(a.opened_at)) AS DOUBLE) / (count(a.submitted_at) * 6e7)")} AS avg_review_minutes
FROM rounds r LEFT JOIN assignments a ON a.round_id = r.id GROUP BY r.id""")
def assignment_totals(spark, folder):
    return R.assignment_totals(*_get(spark, folder, "rounds", "assignments"))


_ATTENTION = duck_entities("submissions", "assignments", "analyses").rstrip() + "," + _STAGES + """,
last AS (SELECT submission_id, arg_max(status, id) AS analysis_status FROM analyses GROUP BY 1),
full_rows AS (SELECT s.*, l.analysis_status FROM staged s LEFT JOIN last l ON l.submission_id = s.id),
attention AS (
SELECT round_id, id AS submission_id, team_name, 'processing_failed' AS kind,
  coalesce(nullif(processing_error, ''), 'Document could not be processed.') AS reason FROM full_rows WHERE status = 'processing_failed'
UNION ALL SELECT round_id, id, team_name, 'partial', 'Partially assessed: some content could not be processed. Judges should review those parts of the original.'
  FROM full_rows WHERE status = 'partially_processed'
UNION ALL SELECT round_id, id, team_name, 'partial', 'Partially assessed: ' || not_assessed_count || CASE WHEN not_assessed_count = 1 THEN ' item' ELSE ' items' END ||
  ' the system could not reliably evaluate (e.g. images, external links).' FROM full_rows WHERE status = 'ready' AND not_assessed_count > 0
UNION ALL SELECT round_id, id, team_name, 'integrity', coalesce(nullif(integrity_summary, ''), 'Integrity warning') FROM full_rows
  WHERE integrity_status <> 'no_discrepancy_detected' AND status <> 'processing_failed'
UNION ALL SELECT round_id, id, team_name, 'ai_failed', 'AI analysis unavailable. Human review can continue.' FROM full_rows WHERE analysis_status = 'failed'
UNION ALL SELECT round_id, id, team_name, 'unassigned', 'No judges assigned yet — every submission needs human review.' FROM full_rows
  WHERE status IN ('ready', 'partially_processed', 'processing_failed') AND n_assigned = 0)
"""


def _attention(spark, folder):
    subs, asg, ana = _get(spark, folder, "submissions", "assignments", "analyses")
    # the judges of every tenth submission sit on the one before it, so that some have none
    moved = F.when(F.col("submission_id") % 10 == 3, F.col("submission_id") - 1).otherwise(F.col("submission_id"))
    return R.attention_list(subs, asg.withColumn("submission_id", moved), ana)


_ATTENTION = _ATTENTION.replace("FROM assignments GROUP BY 1)", """FROM (
  SELECT * REPLACE (CASE WHEN submission_id % 10 = 3 THEN submission_id - 1 ELSE submission_id END AS submission_id) FROM assignments) GROUP BY 1)""")


@CATALOG.query("rep6_attention_list", _ATTENTION + "SELECT * FROM attention")
def attention(spark, folder):
    return _attention(spark, folder)


@CATALOG.query("rep17_attention_groups", _ATTENTION + """SELECT round_id, kind,
  CAST(list_position(['processing_failed', 'integrity', 'ai_failed', 'unassigned', 'partial'], kind) AS INT) AS position, count(*) AS items
FROM attention GROUP BY 1, 2""")
def attention_groups(spark, folder):
    return R.attention_groups(_attention(spark, folder))


@CATALOG.query("rep17_attention_submissions", _ATTENTION + "SELECT round_id, count(DISTINCT submission_id) AS submissions FROM attention GROUP BY 1")
def attention_submissions(spark, folder):
    return R.attention_submissions(_attention(spark, folder))


@CATALOG.query("rep17_stage_shares", _STAGED + f", t AS ({_TOTALS})" + """
SELECT round_id, p AS position, b AS bar, n, 100.0::DOUBLE * n / greatest(submissions, 1) AS pct FROM (
  SELECT round_id, submissions, unnest([0, 1, 2, 3, 4]) AS p, unnest(['completed', 'in_review', 'awaiting_review', 'processing', 'failed']) AS b,
    unnest([completed, in_review, awaiting_review, processing, failed]) AS n FROM t)""")
def stage_shares(spark, folder):
    return R.stage_shares(R.round_totals(*_get(spark, folder, "submissions", "assignments")))


@CATALOG.query("rep7_judge_rows", duck_entities("users", "assignments") + f"""
SELECT a.round_id, a.judge_id, u.name, count(*) AS assigned, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status IN ('in_progress', 'submitted')) AS in_progress,
  {duck_round("CAST(sum(epoch_us(submitted_at) - epoch_us(opened_at)) AS DOUBLE) / (count(submitted_at) * 6e7)")} AS avg_review_minutes
FROM assignments a JOIN users u ON u.id = a.judge_id GROUP BY 1, 2, 3""")
def judge_rows(spark, folder):
    users, asg = _get(spark, folder, "users", "assignments")
    return R.judge_rows(asg, users)


@CATALOG.query("rep8_recent_events", duck_entities("audit") + """
SELECT round_id, rn, id, action, epoch_us(created_at) AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY created_at DESC, id DESC) AS rn FROM audit) WHERE rn <= 8""")
def recent_events(spark, folder):
    ev = entity(spark, folder, "audit").select("round_id", "id", "action", "created_at")
    return R.recent_events(ev).select("round_id", "rn", "id", "action", *_micros("created_at"))


_RESULTS = duck_entities("submissions", "assignments", "evaluations", "revisions", "analyses") + f""",
fin AS (SELECT a.submission_id, a.round_id, r.*, e.weighted_score, e.recommendation FROM assignments a
  JOIN revisions r USING (assignment_id) LEFT JOIN evaluations e USING (assignment_id) WHERE a.status = 'completed'),
done AS (SELECT submission_id, count(*) AS n_done, {duck_round(duck_mean('human_revised_score'))} AS fm, {duck_round(duck_mean('weighted_score'))} AS im,
    min(human_revised_score) AS lo, max(human_revised_score) AS hi, count(*) FILTER (WHERE decision = 'revised') AS nr,
    count(*) FILTER (WHERE recommendation = 'advance') AS ra, count(*) FILTER (WHERE recommendation = 'discuss') AS rd,
    count(*) FILTER (WHERE recommendation = 'do_not_advance') AS rn FROM fin GROUP BY 1),
held AS (SELECT submission_id, count(*) AS n FROM assignments GROUP BY 1),
last AS (SELECT submission_id, arg_max(status, id) AS st, arg_max(ai_overall_score, id) AS sc FROM analyses GROUP BY 1),
base AS (SELECT s.id AS submission_id, s.round_id, s.team_name, s.title, s.integrity_status, coalesce(n, 0) > 0 AND coalesce(n_done, 0) = n AS complete,
    coalesce(n_done, 0) AS n_done, coalesce(n, 0) AS n, fm, im, lo, hi, CASE WHEN n_done > 1 THEN {duck_round('hi - lo')} END AS sp, nr, ra, rd, rn, st, sc
  FROM submissions s LEFT JOIN held h ON h.submission_id = s.id LEFT JOIN done d ON d.submission_id = s.id LEFT JOIN last l ON l.submission_id = s.id)
"""


@CATALOG.query("rep9_results", _RESULTS + """
SELECT submission_id, round_id, team_name, title, complete AS judging_complete, n_done AS judges_completed, n AS judges_assigned,
  CASE WHEN complete THEN fm END AS human_final_mean, CASE WHEN complete THEN im END AS human_initial_mean,
  CASE WHEN complete THEN lo END AS human_final_min, CASE WHEN complete THEN hi END AS human_final_max,
  CASE WHEN complete THEN sp END AS spread, coalesce(complete AND sp >= 15, FALSE) AS needs_calibration,
  CASE WHEN complete THEN concat_ws(',', CASE WHEN ra > 0 THEN 'advance:' || ra END, CASE WHEN rd > 0 THEN 'discuss:' || rd END,
    CASE WHEN rn > 0 THEN 'do_not_advance:' || rn END) ELSE '' END AS recommendations,
  coalesce(nr, 0) AS revisions, CASE WHEN complete AND st = 'completed' THEN sc END AS ai_score, integrity_status
FROM base""")
def results(spark, folder):
    rows = R.results(*_get(spark, folder, "submissions", "assignments", "evaluations", "revisions", "analyses"))
    shown = F.array_join(F.transform(F.map_entries("recommendations"),
                                     lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return rows.withColumn("recommendations", shown)


@CATALOG.query("rep10_calibration", _RESULTS + """
SELECT submission_id, sp AS spread FROM base WHERE complete AND sp >= 15""")
def calibration(spark, folder):
    rows = R.results(*_get(spark, folder, "submissions", "assignments", "evaluations", "revisions", "analyses"))
    return rows.filter("needs_calibration").select("submission_id", "spread")


@CATALOG.query("rep11_shift_summary", duck_entities("rounds", "assignments", "evaluations", "revisions") + f"""
SELECT d.id AS round_id, count(r.assignment_id) AS evaluations_finalized, count(*) FILTER (WHERE decision = 'kept') AS kept,
  count(*) FILTER (WHERE decision = 'revised') AS revised, count(*) FILTER (WHERE revision_direction = 'toward_ai') AS toward_ai,
  count(*) FILTER (WHERE revision_direction = 'away_from_ai') AS away_from_ai, count(*) FILTER (WHERE revision_direction = 'ai_unavailable') AS ai_unavailable,
  {duck_round(duck_mean('abs(initial_to_ai_difference)', 'ai_score IS NOT NULL'))} AS mean_abs_initial_to_ai,
  {duck_round(duck_mean('abs(ai_score - human_revised_score)', 'ai_score IS NOT NULL'))} AS mean_abs_revised_to_ai,
  {duck_round(duck_mean('abs(initial_to_revised_difference)', "decision = 'revised'"))} AS mean_abs_revision
FROM rounds d LEFT JOIN assignments a ON a.round_id = d.id AND a.status = 'completed' LEFT JOIN revisions r USING (assignment_id) GROUP BY d.id""")
def shift_summary(spark, folder):
    return R.shift_summary(*_get(spark, folder, "rounds", "assignments", "evaluations", "revisions"))


@CATALOG.query("src21_shift_dataset", duck_entities("submissions", "assignments", "evaluations", "reveals", "revisions", "users") + """
SELECT s.round_id, s.id AS submission_id, s.team_name, a.judge_id, u.name AS judge_name, epoch_us(a.opened_at) AS opened_at,
  epoch_us(a.submitted_at) AS submitted_at, epoch_us(v.revealed_at) AS revealed_at, epoch_us(r.created_at) AS finalized_at,
  round_even((epoch_us(a.submitted_at) - epoch_us(a.opened_at)) / 6e7, 2) AS review_minutes, r.human_initial_score, r.ai_score,
  r.human_revised_score, r.decision, r.revision_reason, r.initial_to_ai_difference, r.initial_to_revised_difference,
  r.revision_direction, r.seconds_since_reveal, e.recommendation
FROM revisions r JOIN assignments a USING (assignment_id) JOIN submissions s ON s.id = a.submission_id
LEFT JOIN reveals v USING (assignment_id) LEFT JOIN evaluations e USING (assignment_id) LEFT JOIN users u ON u.id = a.judge_id""")
def shift_dataset(spark, folder):
    rows = R.shift_dataset(*_get(spark, folder, "submissions", "assignments", "evaluations", "reveals", "revisions", "users"))
    for name in ("opened_at", "submitted_at", "revealed_at", "finalized_at"):
        rows = rows.withColumn(name, F.unix_micros(name))
    return rows


def _rows(spark, folder):
    return R.assignment_rows(*_get(spark, folder, "assignments", "submissions", "files", "analyses", "revisions"))


_ROWS = duck_entities("assignments", "submissions", "files", "analyses", "revisions") + f""",
f AS (SELECT submission_id, arg_min(page_count, id) AS pages, arg_min(file_type, id) AS file_type FROM files GROUP BY 1),
l AS (SELECT submission_id, arg_max(status, id) AS st, arg_max(severities, id) AS sv FROM analyses GROUP BY 1),
rows_ AS (SELECT a.assignment_id, a.judge_id, a.round_id, a.submission_id, a.status, a.assigned_at,
  {duck_round('(epoch_us(a.submitted_at) - epoch_us(a.opened_at)) / 1e6 / 60')} AS review_minutes, s.team_name, s.title,
  s.status AS submission_status, s.integrity_status, f.file_type, f.pages, coalesce(l.st, 'pending') AS analysis_status,
  coalesce(len(list_filter(string_split(sv, ','), lambda x: x <> '')), 0) AS verify_count,
  coalesce(len(list_filter(string_split(sv, ','), lambda x: x = 'high')), 0) AS high_priority_count,
  s.not_assessed_count, r.human_revised_score AS final_score
FROM assignments a JOIN submissions s ON s.id = a.submission_id LEFT JOIN f ON f.submission_id = s.id
LEFT JOIN l ON l.submission_id = s.id LEFT JOIN revisions r USING (assignment_id)),
odd AS (SELECT * FROM rows_ WHERE status <> 'completed' AND (integrity_status <> 'no_discrepancy_detected' OR analysis_status = 'failed'
  OR submission_status IN ('processing_failed', 'partially_processed')))
"""


@CATALOG.query("rep13_assignment_rows", _ROWS + "SELECT * REPLACE (epoch_us(assigned_at) AS assigned_at) FROM rows_")
def assignment_rows(spark, folder):
    return _rows(spark, folder).withColumn("assigned_at", F.unix_micros("assigned_at"))


@CATALOG.query("rep12_judge_dashboard", _ROWS + f"""
SELECT judge_id, count(*) AS assigned, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status <> 'completed') AS remaining, count(*) FILTER (WHERE status IN ('in_progress', 'submitted')) AS in_progress,
  {duck_round(duck_mean('review_minutes'))} AS avg_review_minutes, (SELECT count(*) FROM odd WHERE odd.judge_id = rows_.judge_id) AS needs_attention
FROM rows_ GROUP BY judge_id""")
def judge_dashboard(spark, folder):
    return R.judge_dashboard(_rows(spark, folder))


@CATALOG.query("rep12_judge_attention", _ROWS + "SELECT judge_id, assignment_id FROM odd")
def judge_attention(spark, folder):
    return R.needs_attention(_rows(spark, folder)).select("judge_id", "assignment_id")


@CATALOG.query("rep19_next_assignment", duck_entities("assignments") + """
SELECT judge_id, coalesce(arg_min(assignment_id, {'a': assigned_at, 'b': assignment_id}) FILTER (WHERE status IN ('in_progress', 'submitted')),
  arg_min(assignment_id, {'a': assigned_at, 'b': assignment_id}) FILTER (WHERE status = 'assigned')) AS next_assignment_id,
  100.0::DOUBLE * count(*) FILTER (WHERE status = 'completed') / count(*) AS completion_pct
FROM assignments GROUP BY judge_id""")
def next_assignment(spark, folder):
    return R.next_assignment(entity(spark, folder, "assignments"))


@CATALOG.query("rep14_brief_view", duck_entities("analyses") + """
SELECT submission_id, arg_max(status, id) AS status, arg_max(engine, id) AS engine, arg_max(pipeline_version, id) AS pipeline_version,
  CASE arg_max(status, id) WHEN 'failed' THEN 'AI analysis unavailable. Human review can continue.'
    WHEN 'running' THEN 'AI analysis in progress. Human review can begin.' END AS message,
  CASE WHEN arg_max(status, id) = 'completed' THEN arg_max(severities, id) END AS brief
FROM analyses GROUP BY 1""")
def brief_view(spark, folder):
    ana = entity(spark, folder, "analyses").withColumnRenamed("severities", "brief").drop("verify_these")
    return R.judge_brief_view(ana)


@CATALOG.query("rep14_reveal_view", duck_entities("assignments", "evaluations", "reveals", "analyses") + """
, l AS (SELECT submission_id, max(id) AS id FROM analyses GROUP BY 1),
x AS (SELECT a.assignment_id, a.submission_id, a.judge_id, e.assignment_id IS NOT NULL AND v.assignment_id IS NOT NULL AS revealed,
    coalesce(v.ai_available, FALSE) AND n.status = 'completed' AS ok, n.severities, n.ai_overall_score
  FROM assignments a LEFT JOIN evaluations e USING (assignment_id) LEFT JOIN reveals v USING (assignment_id)
  LEFT JOIN l ON l.submission_id = a.submission_id LEFT JOIN analyses n ON n.id = l.id)
SELECT assignment_id, submission_id, judge_id, revealed, CASE WHEN revealed AND ok THEN severities END AS assessment,
  CASE WHEN revealed AND ok THEN ai_overall_score END AS ai_score,
  CASE WHEN revealed AND NOT coalesce(ok, FALSE) THEN 'AI analysis unavailable. Human review can continue.' END AS message FROM x""")
def reveal_view(spark, folder):
    asg, evals, reveals, ana = _get(spark, folder, "assignments", "evaluations", "reveals", "analyses")
    ana = ana.withColumn("assessment", F.when(F.col("status") == "completed", F.col("severities")))
    return R.judge_reveal_view(asg, evals, reveals, ana)


@CATALOG.query("rep14_organizer_scores", duck_entities("assignments", "revisions") + """
, p AS (SELECT submission_id, bool_and(status = 'completed') AS c FROM assignments GROUP BY 1)
SELECT a.assignment_id, a.submission_id, a.judge_id, a.status, p.c AS judging_complete,
  CASE WHEN p.c THEN r.human_revised_score END AS final_score, CASE WHEN p.c THEN r.decision END AS decision
FROM assignments a JOIN p USING (submission_id) LEFT JOIN revisions r USING (assignment_id)""")
def organizer_scores(spark, folder):
    return R.organizer_score_view(*_get(spark, folder, "assignments", "revisions"))


@CATALOG.query("rep15_submission_summaries", duck_entities("submissions", "files", "analyses", "assignments").rstrip() + "," + _STAGES + """,
f AS (SELECT submission_id, arg_min(original_filename, id) AS fn, arg_min(size_bytes, id) AS sz FROM files GROUP BY 1),
l AS (SELECT submission_id, arg_max(status, id) AS st FROM analyses GROUP BY 1)
SELECT s.id AS submission_id, s.round_id, s.team_name, s.title, s.status, s.stage, s.processing_error, s.integrity_status, s.integrity_summary,
  s.not_assessed_count, coalesce(l.st, 'pending') AS analysis_status, f.fn AS file_name, f.sz AS size_bytes, epoch_us(s.created_at) AS created_at, s.n_assigned, s.n_completed
FROM staged s LEFT JOIN f ON f.submission_id = s.id LEFT JOIN l ON l.submission_id = s.id""")
def submission_summaries(spark, folder):
    rows = R.submission_summaries(*_get(spark, folder, "submissions", "files", "analyses", "assignments"))
    return rows.select(
        "submission_id", "round_id", "team_name", "title", "status", "stage", "processing_error", "integrity_status",
        "integrity_summary", "not_assessed_count", "analysis_status", F.col("file.name").alias("file_name"),
        F.col("file.size_bytes").alias("size_bytes"), *_micros("created_at"), "n_assigned", "n_completed")


@CATALOG.query("rep15_submission_judges", duck_entities("assignments", "users") + """
SELECT a.submission_id, a.assignment_id, a.judge_id, u.name AS judge_name, a.status FROM assignments a JOIN users u ON u.id = a.judge_id""")
def submission_judges(spark, folder):
    return R.submission_judges(*_get(spark, folder, "assignments", "users"))


@CATALOG.query("rep16_round_list", duck_entities("rounds", "submissions") + """
SELECT r.id, r.name, r.status, epoch_us(r.created_at) AS created_at, count(s.id) AS submission_count
FROM rounds r LEFT JOIN submissions s ON s.round_id = r.id GROUP BY ALL""")
def round_list(spark, folder):
    rows = R.round_list(*_get(spark, folder, "rounds", "submissions"))
    return rows.select("id", "name", "status", *_micros("created_at"), "submission_count").orderBy(F.desc("created_at"), "id")


# --- events ----------------------------------------------------------------

@CATALOG.query("aud1_complete_events", duck_entities("audit", "users") + """
SELECT a.id, coalesce(a.organization_id, u.organization_id) AS organization_id, a.round_id, a.submission_id, a.actor_id,
  CASE WHEN u.id IS NULL THEN 'system' ELSE u.name || ' (' || u.role || ')' END AS actor_label, a.action, a.entity_type, a.entity_id,
  coalesce(a.details, '{}') AS details, epoch_us(a.created_at) AS created_at
FROM (SELECT * REPLACE (CASE WHEN id % 10 = 0 THEN NULL ELSE actor_id END AS actor_id) FROM audit) a LEFT JOIN users u ON u.id = a.actor_id""")
def complete_events(spark, folder):
    audit, users = _get(spark, folder, "audit", "users")
    raw = audit.withColumn("actor_id", F.when(F.col("id") % 10 != 0, F.col("actor_id")))
    return E.complete_events(raw, users).withColumn("created_at", F.unix_micros("created_at"))


@CATALOG.query("aud2_audit_page", duck_entities("audit") + """
SELECT id, action, epoch_us(created_at) AS created_at FROM (SELECT * FROM audit WHERE round_id = 3 AND starts_with(action, 'evaluation')
  ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 5)""")
def audit_page(spark, folder):
    ev = entity(spark, folder, "audit")
    return E.audit_page(ev, 3, action="evaluation", limit=20, offset=5).select("id", "action", *_micros("created_at"))


_PAGE = "SELECT id, action, epoch_us(created_at) AS created_at FROM (SELECT * FROM audit WHERE round_id = 3 ORDER BY created_at DESC, id DESC LIMIT {} OFFSET {})"


def _indexed(spark, folder):
    """The log in folders of days with its index, written in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/docketflow/log-{uuid.uuid4().hex}"
    AP.append_with_index(entity(spark, folder, "audit"), f"{path}/events", f"{path}/index")
    return spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/index")


@CATALOG.query("aud2_deep_page", duck_entities("audit") + _PAGE.format(25, 90))
def deep_page(spark, folder):
    events, index = _indexed(spark, folder)
    return AP.deep_page(events, index, 3, limit=25, offset=90).select("id", "action", *_micros("created_at"))


@CATALOG.query("aud2_pages_by_cursor", duck_entities("audit") + _PAGE.format(45, 0))
def pages_by_cursor(spark, folder):
    """Three pages, each from the last row of the one before."""
    events, index = _indexed(spark, folder)
    after, pages = None, None
    for _ in range(3):
        page = AP.next_page(events, index, 3, after, limit=15)
        pages = page if pages is None else pages.unionByName(page)
        last = page.orderBy("created_at", "id").select(F.unix_micros("created_at"), "id").first()
        if last is None:
            break
        after = tuple(last)
    return pages.select("id", "action", *_micros("created_at"))


@CATALOG.query("aud2_audit_total", duck_entities("audit") + "SELECT count(*) AS total FROM audit WHERE round_id = 3 AND starts_with(action, 'submission')")
def audit_total(spark, folder):
    return E.audit_total(entity(spark, folder, "audit"), 3, action="submission")


@CATALOG.query("aud3_action_labels", duck_entities("audit") + f"""
SELECT action, {duck_lookup('action', V.ACTION_LABELS, 'action')} AS label, count(*) AS events FROM audit GROUP BY 1, 2""")
def action_labels(spark, folder):
    ev = entity(spark, folder, "audit").groupBy("action").agg(F.count("*").alias("events"))
    return ev.select("action", display.action_label(F.col("action")).alias("label"), "events")


@CATALOG.query("aud3_filter_counts", duck_entities("audit") + ", f AS (" + " UNION ALL ".join(
    f"SELECT round_id, {quote(p)} AS filter, {quote(l)} AS label FROM audit WHERE starts_with(action, {quote(p)})"
    for p, l in V.ACTION_FILTERS.items()) + """ UNION ALL SELECT round_id, 'all', 'All events' FROM audit)
SELECT round_id, filter, label, count(*) AS events FROM f GROUP BY ALL""")
def filter_counts(spark, folder):
    return E.filter_counts(entity(spark, folder, "audit"))


@CATALOG.query("aud4_latest_responses", duck_entities("responses", "reveals") + """
, l AS (SELECT assignment_id, finding_key, arg_max({'r': response, 'n': trim(note), 'u': updated_at}, {'u': updated_at, 'i': id}) AS x FROM responses GROUP BY 1, 2)
SELECT l.assignment_id, finding_key, x.r AS response, x.n AS note, epoch_us(x.u) AS updated_at,
  v.revealed_at IS NULL OR x.u < v.revealed_at AS before_ai_reveal FROM l LEFT JOIN reveals v USING (assignment_id)""")
def latest_responses(spark, folder):
    return E.latest_responses(*_get(spark, folder, "responses", "reveals")).withColumn("updated_at", F.unix_micros("updated_at"))


@CATALOG.query("aud5_visible_submissions", duck_entities("submissions", "rounds", "assignments", "users") + """
SELECT 'organization' AS scope, r.organization_id AS holder, s.id AS submission_id FROM submissions s JOIN rounds r ON r.id = s.round_id
WHERE EXISTS (SELECT 1 FROM users u WHERE u.organization_id = r.organization_id AND u.role = 'organizer' AND u.is_active)
UNION ALL SELECT DISTINCT 'judge', u.id, s.id FROM assignments a JOIN users u ON u.id = a.judge_id AND u.role = 'judge' AND u.is_active
JOIN submissions s ON s.id = a.submission_id JOIN rounds r ON r.id = s.round_id AND r.organization_id = u.organization_id""")
def visible_submissions(spark, folder):
    return E.visible_submissions(*_get(spark, folder, "submissions", "rounds", "assignments", "users"))


@CATALOG.query("aud5_visible_to_user", duck_entities("submissions", "rounds", "assignments", "users") + """
SELECT s.id AS submission_id FROM submissions s JOIN rounds r ON r.id = s.round_id JOIN users u ON u.id = 7 AND u.is_active AND u.organization_id = r.organization_id
WHERE u.role = 'organizer' OR EXISTS (SELECT 1 FROM assignments a WHERE a.judge_id = u.id AND a.submission_id = s.id)""")
def visible_to_user(spark, folder):
    return E.visible_to(*_get(spark, folder, "submissions", "rounds", "assignments", "users"), 7)


@CATALOG.query("aud5_own_assignments", duck_entities("assignments", "users") + """
SELECT assignment_id, judge_id FROM assignments a JOIN users u ON u.id = a.judge_id AND u.role = 'judge' AND u.is_active""")
def own_assignments(spark, folder):
    return E.own_assignments(*_get(spark, folder, "assignments", "users")).select("assignment_id", "judge_id")


@CATALOG.query("aud6_assignment_states", duck_entities("audit") + """
, m AS (SELECT entity_id AS assignment_id, CASE action WHEN 'assignment.created' THEN 1 WHEN 'review.opened' THEN 2 WHEN 'evaluation.submitted' THEN 3
    WHEN 'evaluation.kept' THEN 4 WHEN 'evaluation.revised' THEN 4 ELSE 0 END AS k, action, epoch_us(created_at) AS t FROM audit)
SELECT assignment_id, ['assigned', 'in_progress', 'submitted', 'completed'][max(k)] AS status,
  coalesce(min(t) FILTER (WHERE k = 2), min(t) FILTER (WHERE k = 3)) AS opened_at, min(t) FILTER (WHERE k = 3) AS submitted_at,
  min(t) FILTER (WHERE k = 4) AS completed_at FROM m WHERE k > 0 GROUP BY 1""")
def assignment_states(spark, folder):
    rows = E.assignment_states(entity(spark, folder, "audit"))
    return rows.select("assignment_id", "status", *_micros("opened_at", "submitted_at", "completed_at"))


@CATALOG.query("aud6_lifecycle_violations", duck_entities("audit") + """
, e AS (SELECT entity_id AS assignment_id, id, action, row(created_at, id) AS k FROM audit),
f AS (SELECT assignment_id, min(k) FILTER (WHERE action = 'evaluation.submitted') AS s, min(k) FILTER (WHERE action = 'ai.revealed') AS r,
    min(k) FILTER (WHERE action IN ('evaluation.kept', 'evaluation.revised')) AS d FROM e GROUP BY 1),
x AS (SELECT e.*, CASE
    WHEN action = 'evaluation.submitted' AND k > s THEN 'Evaluation already submitted.'
    WHEN action = 'ai.revealed' AND (s IS NULL OR k < s) THEN 'Submit your own evaluation before viewing the AI assessment.'
    WHEN action IN ('evaluation.kept', 'evaluation.revised') AND (s IS NULL OR k < s) THEN 'Submit your evaluation first.'
    WHEN action IN ('evaluation.kept', 'evaluation.revised') AND (r IS NULL OR k < r) THEN 'Review the AI assessment before finishing.'
    WHEN action IN ('evaluation.kept', 'evaluation.revised') AND k > d THEN 'This evaluation is already complete.'
    WHEN action = 'finding.responded' AND d IS NOT NULL AND k > d THEN 'This evaluation is already complete.' END AS reason
  FROM e JOIN f USING (assignment_id))
SELECT assignment_id, id AS event_id, action, reason FROM x WHERE reason IS NOT NULL""")
def lifecycle_violations(spark, folder):
    return E.lifecycle_violations(entity(spark, folder, "audit"))
