"""Findings that come from plugged-in stages, from their answers to the brief.

Answers are tables with nested references.  All references of a run are grounded
together and stored, so the views are joined once; the checks on findings without evidence
follow, and the rows take the shape that ``brief.briefs`` assembles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.operators import brief
from docketflow.operators.grounding import REF_FIELDS, REF_TYPE, ground_refs, keep_items, unscore_unlinked
from docketflow.session import cut

_REFS = f"array<{REF_TYPE}>"


@dataclass
class Findings:
    """Flat tables of one run, each with submission_id, ``ord`` and ``evidence``."""

    topics: DataFrame  # topic, label
    claims: DataFrame  # id, text, category, supporting_evidence_found
    criteria: DataFrame  # criterion_id, criterion, weight, assessed, finding, score, reason, issues
    items: DataFrame  # id, title, description, type, severity, label, related_criteria
    strengths: DataFrame  # id, text


def of_answers(extraction: DataFrame, rubric: DataFrame, verification: DataFrame, writer: DataFrame, known: DataFrame) -> Findings:
    """Decoded answers (submission_id, value) as flat tables.

    ``rubric`` holds checked criteria (``plugins.check_criteria``); ``known`` names the
    criteria of each submission: submission_id, criterion_id, weight.
    """

    def opened(answers: DataFrame, column: str) -> DataFrame:
        rows = answers.select("submission_id", F.posexplode(column).alias("ord", "x"))
        return rows.select("submission_id", "ord", "x.*")

    criteria = opened(rubric, "criteria").withColumn("criterion_id", F.col("criterion_id").cast("bigint"))
    return Findings(
        opened(extraction, "value.topics"), opened(extraction, "value.claims"),
        criteria.join(known, ["submission_id", "criterion_id"]).withColumnRenamed("not_assessed_reason", "reason"),
        opened(verification, "value.items"), opened(writer, "value.strengths"),
    )


def ground(found: Findings, views: DataFrame) -> Findings:
    """Findings with grounded evidence: topics, claims and strengths without any go, unlinked
    criteria lose their score, and items that need evidence go without it."""
    tables = {"topics": found.topics, "claims": found.claims, "criteria": found.criteria, "items": found.items, "strengths": found.strengths}

    def owner(name: str) -> Column:
        return F.concat(F.lit(f"{name}:"), F.col("ord").cast("string"))

    refs = None
    for name, rows in tables.items():
        own = rows.select("submission_id", owner(name).alias("owner"), F.posexplode("evidence").alias("ord", "r")).select(
            "submission_id", "owner", "ord", "r.slide_id", "r.excerpt")
        refs = own if refs is None else refs.unionByName(own)
    ref = F.struct("ord", F.struct(*REF_FIELDS).cast(REF_TYPE).alias("ref"))
    lists = cut(ground_refs(refs, views, stored=True).groupBy("submission_id", "owner").agg(
        F.transform(F.sort_array(F.collect_list(ref)), lambda x: x["ref"]).alias("grounded")), "grounded")

    def with_evidence(name: str) -> DataFrame:
        rows = tables[name].withColumn("owner", owner(name)).join(lists, ["submission_id", "owner"], "left")
        return rows.withColumn("evidence", F.coalesce("grounded", F.array().cast(_REFS))).drop("owner", "grounded")

    has = F.size("evidence") > 0
    return Findings(
        with_evidence("topics").filter(has), with_evidence("claims").filter(has),
        unscore_unlinked(with_evidence("criteria")), keep_items(with_evidence("items")), with_evidence("strengths").filter(has),
    )


def _rows(table: DataFrame, name: str, *columns: str) -> DataFrame:
    """One array per submission, in the order of the answer; a submission's answers are bounded documents."""
    listed = F.sort_array(F.collect_list(F.struct("ord", F.struct(*columns).alias("x"))), asc=True)
    return table.groupBy("submission_id").agg(F.transform(listed, lambda r: r["x"]).alias(name))


def highlights(topics: DataFrame) -> DataFrame:
    """submission_id, highlights: topics in display order, others behind them, "team" left out."""
    place = F.array_position(F.array(*[F.lit(t) for t in V.HIGHLIGHT_ORDER]), F.col("topic"))
    shown = topics.filter((place > 0) | (F.col("topic") != "team")).withColumn(
        "ord", F.when(place > 0, place).otherwise(len(V.HIGHLIGHT_ORDER) + 1 + F.col("ord")).cast("int"))
    rows = _rows(shown, "t", "label", F.slice("evidence", F.lit(1), F.lit(3)).alias("evidence"))
    return rows.select("submission_id", F.transform("t", lambda t, i: F.struct(
        F.concat(F.lit("e"), (i + 1).cast("string")).alias("id"), t["label"].alias("label"), t["evidence"].alias("evidence"),
    )).alias("highlights"))


def brief_parts(found: Findings, extraction: DataFrame, writer: DataFrame, scale: DataFrame) -> DataFrame:
    """Grounded findings as one row per submission, as ``brief.briefs`` takes them.

    ``scale`` gives submission_id and scale (largest score).
    """
    empty = {
        "highlights": f"array<struct<id:string,label:string,evidence:{_REFS}>>",
        "strengths": f"array<struct<id:string,text:string,evidence:{_REFS}>>",
        "verify": "array<struct<id:string,title:string,description:string,type:string,severity:string,"
                  f"evidence:{_REFS},label:string,related_criteria:array<string>>>",
    }
    said = writer.select("submission_id", F.col("value.overview").alias("overview"), F.col("value.verify_order").alias("verify_order"))
    parts = (
        said.join(extraction.select("submission_id", F.col("value.target_users").alias("target_users")), "submission_id")
        .join(_rows(found.criteria, "criteria", "criterion_id", "criterion", "weight", "assessed", "finding", "evidence", "score", "reason"), "submission_id")
        .join(scale, "submission_id")
        .join(highlights(found.topics), "submission_id", "left")
        .join(_rows(found.strengths, "strengths", "id", "text", "evidence"), "submission_id", "left")
        .join(_rows(found.items, "verify", "id", "title", "description", "type", "severity", "evidence", "label", "related_criteria"), "submission_id", "left")
    )
    filled = parts.withColumns({name: F.coalesce(F.col(name).cast(kind), F.array().cast(kind)) for name, kind in empty.items()})
    listed = F.slice(brief.order_items(F.col("verify"), F.col("verify_order")), F.lit(1), F.lit(V.MAX_ORDERED_VERIFY))
    return filled.withColumn("coverage", brief.coverage()).withColumn("assessment", brief.assessment()).withColumn("listed_verify", listed)


def issues(found: Findings) -> DataFrame:
    """submission_id, criterion_id, ord, type, description, severity."""
    rows = found.criteria.select("submission_id", "criterion_id", F.posexplode("issues").alias("ord", "i"))
    return rows.select("submission_id", "criterion_id", F.col("ord").cast("bigint").alias("ord"), "i.type", "i.description", "i.severity")
