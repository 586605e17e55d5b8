"""The brief, the hidden assessment and the table of cited evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions.numeric import round_half_even
from docketflow.functions.columns import fixed_column
from docketflow.functions.text import fill, matches, page_label, truncate
from docketflow.operators.grounding import REF_FIELDS, REF_TYPE
from docketflow.operators.skew import running_total

_T = V.VERIFY_TEXT
_NO_REFS = f"array<{REF_TYPE}>"


def _topic(key: str) -> Column:
    return F.coalesce(F.element_at("topics", F.lit(key)), F.array().cast(_NO_REFS))


def _citing(refs: Column, pattern: str) -> Column:
    return F.filter(refs, lambda r: matches(r["excerpt"], pattern))


@fixed_column
def strengths() -> Column:
    """Strength structs of a submission's row: first applicable rule per topic, at most six."""
    cells, used = [], {}
    for topic, text, extra in V.STRENGTH_RULES:
        refs = _topic(topic)
        if extra:
            refs = _citing(refs, extra)
        applies = F.size(refs) > 0
        if topic == "validation":
            backed = F.exists(refs, lambda r: matches(r["excerpt"], V.SUPPORT_PATTERN))
            applies = applies & ((F.col("n_supported") > 0) | backed)
        if topic in used:
            applies = applies & ~used[topic]
        used[topic] = used[topic] | applies if topic in used else applies
        cells.append(F.when(applies, F.struct(
            F.lit(text).alias("text"), F.slice(refs, F.lit(1), F.lit(2)).alias("evidence"))))
    found = F.filter(F.array(*cells), lambda s: s.isNotNull())
    numbered = F.transform(found, lambda s, i: F.struct(
        F.concat(F.lit("s"), (i + 1).cast("string")).alias("id"), s["text"].alias("text"),
        s["evidence"].alias("evidence")))
    return F.slice(numbered, F.lit(1), F.lit(V.MAX_STRENGTHS))


@fixed_column
def highlights() -> Column:
    """Topics in display order, "team" left out; ids count the topics that are present."""
    labels = {t[0]: t[1] for t in V.TOPICS}
    others = [t[0] for t in V.TOPICS if t[0] not in V.HIGHLIGHT_ORDER and t[0] != "team"]
    cells = [
        F.when(F.map_contains_key("topics", F.lit(k)), F.struct(
            F.lit(labels[k]).alias("label"), F.slice(_topic(k), F.lit(1), F.lit(3)).alias("evidence")))
        for k in V.HIGHLIGHT_ORDER + others
    ]
    numbered = F.transform(
        F.filter(F.array(*cells), lambda h: h.isNotNull()),
        lambda h, i: F.struct(F.concat(F.lit("e"), (i + 1).cast("string")).alias("id"), h["label"].alias("label"),
                              h["evidence"].alias("evidence")),
    )
    return F.filter(numbered, lambda h: F.size(h["evidence"]) > 0)


@fixed_column
def coverage() -> Column:
    """Where each criterion is addressed — no judgement, no score."""

    def one(c: Column) -> Column:
        n = F.size(F.array_distinct(F.transform(c["evidence"], lambda r: r["slide_id"])))
        return F.struct(
            c["criterion_id"].alias("criterion_id"), c["criterion"].alias("criterion"),
            F.slice(c["evidence"], F.lit(1), F.lit(4)).alias("evidence"),
            F.when(n == 0, "not_found").when(n == 1, "limited").otherwise("addressed").alias("coverage"),
        )

    return F.transform("criteria", one)


@fixed_column
def assessment() -> Column:
    """Scores clamped to the scale; the total covers assessed weight only."""
    scale = F.col("scale").cast("double")
    scored = F.transform(
        F.filter("criteria", lambda c: c["assessed"] & c["score"].isNotNull()),
        lambda c: F.struct(c["weight"].alias("w"),
                           F.greatest(F.lit(1.0), F.least(scale, c["score"])).alias("s")),
    )
    weight = F.aggregate(scored, F.lit(0.0), lambda acc, c: acc + c["w"])
    value = F.aggregate(scored, F.lit(0.0), lambda acc, c: acc + c["w"] * (c["s"] / F.col("scale")))
    total = F.aggregate("criteria", F.lit(0.0), lambda acc, c: acc + c["weight"])
    return F.struct(
        F.col("scale").alias("score_scale_max"),
        F.when(weight != 0, round_half_even(100 * value / weight)).alias("overall_score"),
        round_half_even(100 * weight / F.when(total == 0, 1.0).otherwise(total)).alias("assessed_weight"),
    )


def with_brief_parts(verified: DataFrame) -> DataFrame:
    """verified + strengths, highlights, coverage, assessment, verify_order, listed_verify."""
    return (
        verified.withColumn("strengths", strengths())
        .withColumn("highlights", highlights())
        .withColumn("coverage", coverage())
        .withColumn("assessment", assessment())
        .withColumn("verify_order", F.slice(F.transform("verify", lambda v: v["id"]), F.lit(1),
                                            F.lit(V.VERIFY_ORDER_LIMIT)))
        .withColumn("listed_verify", F.slice(
            order_items(F.col("verify"), F.col("verify_order")), F.lit(1), F.lit(V.MAX_ORDERED_VERIFY)))
    )


def order_items(items: Column, order: Column) -> Column:
    """Items named in ``order`` first, in that order; the rest behind them."""
    named = F.filter(
        F.transform(order, lambda k: F.get(F.filter(items, lambda v: v["id"] == k), F.lit(0))),
        lambda v: v.isNotNull(),
    )
    rest = F.filter(items, lambda v: ~F.array_contains(order, v["id"]))
    return F.concat(named, rest)


def integrity_items(flagged: DataFrame) -> DataFrame:
    """submission_id, number, id, … one verify item per warning flag, in page order.

    Numbers come from per-unit counts.
    """
    warning = F.filter("flags", lambda f: f["status"].isin("suspicious_instruction_detected", "potential_discrepancy"))
    units = flagged.withColumn("w", warning).filter(F.size("w") > 0).select("submission_id", "page_number", "w")
    placed = running_total(units, ["submission_id"], "page_number", {"before": F.size("w")})
    rows = placed.select("submission_id", "page_number", "before", F.posexplode("w").alias("ord", "f"))
    suspicious = F.col("f.status") == "suspicious_instruction_detected"
    where = page_label(F.col("page_number"))
    number = F.col("before") + F.col("ord") + 1
    ref = F.struct(
        F.col("f.slide_id").alias("slide_id"), truncate(F.col("f.excerpt"), 200).alias("excerpt"),
        F.col("page_number").cast("int").alias("page_number"), F.lit(True).alias("verified"),
        F.when(F.col("f.location") == "speaker_notes", "speaker_notes").otherwise("text").alias("via"),
    )
    return rows.select(
        "submission_id", number.alias("number"), F.concat(F.lit("i"), number.cast("string")).alias("id"),
        F.when(suspicious, fill(_T["integrity_suspicious"], where=where))
        .otherwise(fill(_T["integrity_potential"], where=where)).alias("title"),
        F.concat(
            F.col("f.detail"), F.when(F.col("f.withheld_from_ai"), _T["integrity_withheld"]).otherwise(""),
            F.lit(_T["integrity_tail"]),
        ).alias("description"),
        F.lit("integrity").alias("type"),
        F.when(suspicious, "high").otherwise("medium").alias("severity"),
        F.when(F.col("f.excerpt") != "", F.array(ref)).otherwise(F.array().cast(_NO_REFS)).alias("evidence"),
    )


def final_verify_rows(parts: DataFrame, integrity: DataFrame) -> DataFrame:
    """submission_id, part (0 integrity, 1 analysis), number, id, title, … as listed in the brief."""
    own = parts.select("submission_id", F.posexplode("listed_verify").alias("ord", "v")).select(
        "submission_id", F.lit(1).alias("part"), (F.col("ord") + 1).cast("bigint").alias("number"),
        "v.id", "v.title", "v.description", "v.type", "v.severity", "v.evidence", "v.label", "v.related_criteria",
    )
    return own.unionByName(
        integrity.withColumn("part", F.lit(0)).withColumn("label", F.lit(None).cast("string"))
        .withColumn("related_criteria", F.array().cast("array<string>"))
    )


def evidence_rows(parts: DataFrame, integrity: DataFrame) -> DataFrame:
    """Every citation of the brief and the assessment: finding_key, ord, slide, excerpt, verified.

    A submission's own citations are one array of its row, opened once.
    """

    def cited(column: str, prefix: str, key: str) -> Column:
        return F.transform(column, lambda x: F.struct(
            F.concat(F.lit(prefix), x[key].cast("string")).alias("finding_key"), x["evidence"].alias("evidence")))

    own = F.concat(
        cited("highlights", "evidence:", "id"), cited("strengths", "strength:", "id"),
        cited("listed_verify", "verify:", "id"), cited("criteria", "criterion:", "criterion_id"))
    rows = parts.select("submission_id", F.inline(own)).unionByName(
        integrity.select("submission_id", F.concat(F.lit("verify:"), "id").alias("finding_key"), "evidence"))
    return rows.select("submission_id", "finding_key", F.posexplode("evidence").alias("ord", "r")).select(
        "submission_id", "finding_key", "ord", *[f"r.{f}" for f in REF_FIELDS])


def briefs(
    parts: DataFrame, final_verify: DataFrame, packs: DataFrame, issue_rows: DataFrame, engine: str = "rule-based",
    model: str | None = None, stages: list[str] | None = None, note: str = V.PROVENANCE_NOTE,
) -> DataFrame:
    """submission_id, brief, assessment_document: nested documents of accepted submissions.

    ``packs`` holds only submissions within the page limit of their round, which
    bounds the lists gathered here; the flat tables hold everything.
    """
    keep = packs.select("submission_id")
    listed = F.transform(
        F.sort_array(F.collect_list(F.struct(
            "part", "number", "id", "title", "description", "type", "severity", "evidence", "label",
            "related_criteria"))),
        lambda v: F.struct(*[v[c].alias(c) for c in (
            "id", "title", "description", "type", "severity", "evidence", "label", "related_criteria")]),
    )
    verify = final_verify.join(keep, "submission_id", "left_semi").groupBy("submission_id").agg(
        listed.alias("verify_these")
    )
    by_criterion = (
        issue_rows.join(keep, "submission_id", "left_semi")
        .groupBy("submission_id", "criterion_id")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "type", "description", "severity"))).alias("issues"))
        .groupBy("submission_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("criterion_id", "issues"))).alias("issues"))
    )
    report = F.col("pack.integrity")
    message = F.when(
        report["status"] == "no_discrepancy_detected", V.INTEGRITY_CLEAR_MESSAGE
    ).otherwise(fill(V.INTEGRITY_WARNING_MESSAGE, summary=report["summary"]))
    item_type = "array<struct<id:string,title:string,description:string,type:string,severity:string," \
                f"evidence:{_NO_REFS},label:string,related_criteria:array<string>>>"
    brief = F.struct(
        "overview", "target_users", F.col("highlights").alias("evidence_highlights"), "strengths",
        F.coalesce("verify_these", F.array().cast(item_type)).alias("verify_these"),
        F.col("pack.not_assessed").alias("not_assessed"),
        F.struct(report["status"].alias("status"), message.alias("message"), report["flags"].alias("flags"),
                 report["limitations"].alias("limitations")).alias("integrity"),
        F.col("coverage").alias("rubric_coverage"),
        F.struct(
            F.lit(engine).alias("engine"), F.lit(model).cast("string").alias("model"),
            F.lit(V.PIPELINE_VERSION).alias("pipeline_version"),
            F.array(*[F.lit(s) for s in stages or V.STAGE_NAMES]).alias("stages"), F.lit(note).alias("note"),
        ).alias("provenance"),
    )
    issue_type = "array<struct<ord:bigint,type:string,description:string,severity:string>>"
    criteria = F.transform("criteria", lambda c: F.struct(
        c["criterion_id"].alias("criterion_id"), c["criterion"].alias("criterion"), c["assessed"].alias("assessed"),
        c["finding"].alias("finding"), c["evidence"].alias("evidence"),
        F.transform(
            F.coalesce(F.element_at("issues", c["criterion_id"]), F.array().cast(issue_type)),
            lambda i: F.struct(i["type"].alias("type"), i["description"].alias("description"),
                               i["severity"].alias("severity")),
        ).alias("issues"),
        c["score"].alias("score"), c["reason"].alias("not_assessed_reason"),
    ))
    document = F.struct(
        F.lit(V.ASSESSMENT_LABEL).alias("label"), F.col("assessment.score_scale_max").alias("score_scale_max"),
        F.col("assessment.overall_score").alias("overall_score"),
        F.col("assessment.assessed_weight").alias("assessed_weight"), criteria.alias("criteria"),
        F.lit(engine).alias("engine"), F.lit(model).cast("string").alias("model"),
    )
    return (
        parts.join(packs, "submission_id")
        .join(verify, "submission_id", "left")
        .join(by_criterion, "submission_id", "left")
        .select("submission_id", brief.alias("brief"), document.alias("assessment_document"))
    )
