"""The whole analysis as one DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.operators import brief, extraction, integrity, not_assessed, rubric, verify, view
from docketflow.plans.catalog import deal
from docketflow.session import cut
from docketflow.sources.files import check_page_limit
from docketflow.sources.units import partial_submissions, with_render_notes


@dataclass
class Analysis:
    """Tables of one run; every field is a DataFrame keyed by submission_id."""

    flagged: DataFrame
    views: DataFrame
    findings: DataFrame
    facts: DataFrame
    topics: DataFrame
    claims: DataFrame
    parts: DataFrame


@dataclass
class Seen:
    """Units with their flags and what analysis may see of them, written once for all branches that read them."""

    flagged: DataFrame
    views: DataFrame


def see(units: DataFrame) -> Seen:
    """Flags and views of ``units``, stored; every row is work, so stored rows are dealt to tasks again."""
    flagged = cut(integrity.flag_units(units), "flagged")
    return Seen(flagged, cut(view.build_views(deal(flagged)), "views"))


def analyse(
    units: DataFrame, submissions: DataFrame, rubric_rows: DataFrame, rounds: DataFrame, stored: bool = False, seen: Seen | None = None
) -> Analysis:
    """units → flags → views → findings → topics, claims → criteria → verify → brief parts.

    With ``stored`` the findings are written once to the checkpoint folder: they
    are small, cost one pass over all texts, and feed every later branch.  ``seen``
    are the flags and views of the same units, where a run has stored them before.
    """
    flagged = seen.flagged if seen else integrity.flag_units(units)
    views = seen.views if seen else view.build_views(flagged)
    findings = extraction.unit_findings(deal(views) if seen else views)
    if stored:
        findings = cut(findings, "findings")
    borders = extraction.border_approaches(findings)
    if stored:
        borders = cut(borders, "borders")
    facts = extraction.with_border_approaches(extraction.submission_facts(findings), borders)
    topic_rows = extraction.topics(findings, facts)
    claim_rows = extraction.claims(findings, facts)
    state = extraction.submission_state(findings, submissions, facts, topic_rows, claim_rows)
    assessed = rubric.with_criteria(state, rubric_rows, rounds)
    verified = verify.verify_items(assessed, claim_rows)
    return Analysis(flagged, views, findings, facts, topic_rows, claim_rows, brief.with_brief_parts(verified))


def documents(
    run: Analysis, units: DataFrame, submissions: DataFrame, rounds: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(packs, briefs) of the submissions within their round's page limit."""
    limits = check_page_limit(units, submissions.withColumnRenamed("submission_id", "id"), rounds)
    accepted = limits.filter("reject_reason is null").select("submission_id")
    reports = integrity.report(integrity.flag_rows(run.flagged), submissions)
    items = not_assessed.not_assessed(units, submissions)
    noted = with_render_notes(run.flagged)
    packs = not_assessed.evidence_packs(
        noted, items, reports, submissions, partial_submissions(noted), accepted
    )
    final = brief.final_verify_rows(run.parts, brief.integrity_items(run.flagged))
    return packs, brief.briefs(run.parts, final, packs, rubric.issues(run.parts, run.claims))


def analysis_status(submissions: DataFrame, completed: DataFrame, failures: DataFrame) -> DataFrame:
    """submission_id, status, error_message: a failed stage leaves no partial result."""
    return (
        submissions.select("submission_id")
        .join(failures.select("submission_id", F.substring("error", 1, 1000).alias("error_message")),
              "submission_id", "left")
        .join(completed.select("submission_id", F.lit(True).alias("done")).distinct(), "submission_id", "left")
        .select(
            "submission_id",
            F.when(F.col("error_message").isNotNull(), "failed").when(F.col("done"), "completed")
            .otherwise("pending").alias("status"),
            "error_message",
        )
    )
