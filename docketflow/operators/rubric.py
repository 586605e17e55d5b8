"""Evidence, issues and preliminary scores per rubric criterion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions.text import fill, join_labels, let, matches, page_label, truncate
from docketflow.operators.grounding import distinct_refs

_COMPETITION = "competition"


def _hinted(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[
        F.when(matches(text, p), F.array(*[F.lit(t) for t in topics])).otherwise(none)
        for p, topics in V.CRITERION_HINTS
    ]))


def criteria_by_round(rubric: DataFrame) -> DataFrame:
    """round_id, criteria array<struct<position,criterion_id,name,weight,topics>>.

    The name decides which topics count; the description only when the name
    gives none.
    """
    by_name = _hinted(F.col("name"))
    both = _hinted(F.concat_ws(" ", "name", F.coalesce("description", F.lit(""))))
    staged = rubric.withColumn("_n", by_name).withColumn(
        "topics", F.when(F.size("_n") > 0, F.col("_n")).otherwise(both)
    )
    return staged.groupBy("round_id").agg(F.sort_array(F.collect_list(F.struct(
        "position", F.col("criterion_id").cast("bigint").alias("criterion_id"), "name",
        F.col("weight").cast("double").alias("weight"), "topics",
    ))).alias("criteria"))


def _category_in(category: str, topics: Column) -> Column:
    return F.arrays_overlap(F.array(*[F.lit(t) for t in V.CLAIM_TOPICS[category]]), topics)


def _by_slide(refs: Column) -> Column:
    """Distinct refs sorted by slide key, equal keys in order of appearance."""
    indexed = F.transform(F.array_distinct(refs), lambda r, i: F.struct(r["slide_id"].alias("k"), i.alias("i"), r.alias("r")))
    return F.transform(F.sort_array(indexed), lambda x: x["r"])


def _assess(c: Column, refs: Column, scale: Column) -> Column:
    open_claims = F.col("open_claims")

    def open_of(category: str) -> Column:
        return F.when(
            _category_in(category, c["topics"]), F.coalesce(F.element_at(open_claims, F.lit(category)), F.lit(0))
        ).otherwise(0)

    medium = sum((open_of(k) for k in V.CLAIM_TOPICS if k != "novelty"), F.lit(0))
    low = open_of("novelty")
    no_rivals = F.array_contains(c["topics"], _COMPETITION) & ~F.map_contains_key("topics", F.lit(_COMPETITION))
    n_medium = medium + no_rivals.cast("int")
    n_issues = n_medium + low
    n_refs = F.size(refs)
    n_slides = F.size(F.array_distinct(F.transform(refs, lambda r: r["slide_id"])))
    validated = F.array_contains(c["topics"], "validation") & F.map_contains_key("topics", F.lit("validation"))
    specific = F.exists(refs, lambda r: matches(r["excerpt"], r"\d"))
    raw = (
        4.0 + F.least(F.lit(3.0), n_slides.cast("double"))
        + F.when(validated, 1.5).otherwise(0.0) + F.when(specific, 0.5).otherwise(0.0)
        - (n_medium * V.ISSUE_PENALTY["medium"] + low * V.ISSUE_PENALTY["low"])
    )
    score = F.rint(F.greatest(F.lit(1.0), F.least(F.lit(10.0), raw)) * scale / 10 * 2) / 2
    found = n_refs > 0
    labels = join_labels(F.transform(refs, lambda r: page_label(r["page_number"])))
    located = F.concat(
        F.lit("Relevant content appears on "), labels, F.lit(" ("), n_refs.cast("string"), F.lit(" supporting point"),
        F.when(n_refs != 1, "s").otherwise(""), F.lit(" located"),
        F.when(validated, ", including validation data").otherwise(""), F.lit(")."),
        F.when(n_issues > 0, F.concat(
            F.lit(" "), n_issues.cast("string"), F.lit(" point"), F.when(n_issues != 1, "s").otherwise(""),
            F.lit(" need"), F.when(n_issues == 1, "s").otherwise(""), F.lit(" verification."),
        )).otherwise(""),
    )
    return F.struct(
        c["position"].alias("position"), c["criterion_id"].alias("criterion_id"), c["name"].alias("criterion"),
        c["weight"].alias("weight"), c["topics"].alias("topics"), found.alias("assessed"),
        F.when(found, located).otherwise(fill(V.NO_EVIDENCE_FINDING, criterion=F.lower(c["name"]))).alias("finding"),
        distinct_refs(F.slice(refs, F.lit(1), F.lit(5))).alias("evidence"),
        n_issues.cast("bigint").alias("n_issues"),
        F.when(found, score).alias("score"),
        F.when(~found, V.NO_EVIDENCE_REASON).alias("reason"),
    )


def with_criteria(state: DataFrame, rubric: DataFrame, rounds: DataFrame) -> DataFrame:
    """state + scale, criteria array (one assessed struct per criterion of the round).

    A criterion sees at most 36 refs, so all of it happens inside the
    submission's row after one join with the rubric.  Its refs come from the
    built-in topics, already grounded in their units; stages plugged in from
    outside go through ``grounding.unscore_unlinked``.
    """
    scale = rounds.select(F.col("id").alias("round_id"), F.col("score_scale_max").alias("scale"))

    def one(c: Column) -> Column:
        gathered = F.flatten(F.transform(
            F.filter(c["topics"], lambda t: F.map_contains_key("topics", t)),
            lambda t: F.element_at("topics", t),
        ))
        return let(_by_slide(gathered), lambda refs: _assess(c, refs, F.col("scale")))

    return (
        state.join(criteria_by_round(rubric), "round_id")
        .join(scale, "round_id")
        .withColumn("criteria", F.transform("criteria", one))
    )


def criterion_rows(assessed: DataFrame) -> DataFrame:
    return assessed.select("submission_id", F.inline("criteria"))


def issues(assessed: DataFrame, claim_rows: DataFrame) -> DataFrame:
    """submission_id, criterion_id, ord, type, description, severity — one row per issue.

    Unsupported claims in order of appearance, then missing competition.
    """
    crit = assessed.select("submission_id", F.explode("criteria").alias("c"), F.col("topics").alias("found")).select(
        "submission_id", F.col("c.criterion_id").alias("criterion_id"), F.col("c.topics").alias("topics"), "found"
    )
    open_claims = claim_rows.filter(~F.col("supported")).select("submission_id", "claim_no", "text", "category")
    bears = F.lit(False)
    for category in V.CLAIM_TOPICS:
        bears = bears | ((F.col("category") == category) & _category_in(category, F.col("topics")))
    from_claims = open_claims.join(crit, "submission_id").filter(bears).select(
        "submission_id", "criterion_id", F.col("claim_no").alias("ord"), F.lit("unsupported_claim").alias("type"),
        fill(V.UNSUPPORTED_ISSUE, claim=truncate(F.col("text"), 110)).alias("description"),
        F.when(F.col("category") == "novelty", "low").otherwise("medium").alias("severity"),
    )
    missing = crit.filter(
        F.array_contains("topics", _COMPETITION) & ~F.map_contains_key("found", F.lit(_COMPETITION))
    ).select(
        "submission_id", "criterion_id", F.lit(1 << 60).cast("bigint").alias("ord"),
        F.lit("missing_information").alias("type"), F.lit(V.MISSING_COMPETITION_ISSUE).alias("description"),
        F.lit("medium").alias("severity"),
    )
    return from_claims.unionByName(missing)
