"""Points a human should verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions.columns import fixed_column
from docketflow.functions.text import fill, lookup, matches, page_label, short_claim
from docketflow.operators.grounding import REF_TYPE, distinct_refs
from docketflow.operators.skew import first_per_group

ITEM_TYPE = (
    "struct<rank:int,number:bigint,id:string,title:string,description:string,type:string,severity:string,"
    f"evidence:array<{REF_TYPE}>,label:string,related_criteria:array<string>>"
)
_T = V.VERIFY_TEXT


def _rank(severity: Column) -> Column:
    return lookup(severity, {k: str(v) for k, v in V.SEVERITY_ORDER.items()}).cast("int")


def _item(number, title, description, kind, severity, evidence, label=None, related=None) -> Column:
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)

    severity = col(severity)
    return F.struct(
        _rank(severity).alias("rank"), number.cast("bigint").alias("number"),
        F.concat(F.lit("v"), number.cast("string")).alias("id"), col(title).alias("title"),
        col(description).alias("description"), col(kind).alias("type"), severity.alias("severity"),
        evidence.alias("evidence"), col(label).cast("string").alias("label"),
        (related if related is not None else F.array().cast("array<string>")).alias("related_criteria"),
    ).cast(ITEM_TYPE)


def claim_items(claim_rows: DataFrame) -> DataFrame:
    """submission_id, item: one verify item per unsupported claim."""
    text, category = F.col("text"), F.col("category")
    target = matches(text, V.TARGET_PATTERN)
    headline = F.contains(text, F.lit("%")) | F.contains(text, F.lit("$"))
    severity = (
        F.when(target, "low").when(category.isin("impact", "market") & headline, "high")
        .when(category == "business", "low").otherwise("medium")
    )
    description = (
        F.when(target, _T["target"]).when(category == "novelty", _T["novelty"]).otherwise(_T["claim"])
    )
    title = F.concat(F.when(target, "Stated target: ").otherwise("Claimed: "), short_claim(text))
    item = _item(
        F.col("unsupported_no"), title, description,
        F.when(category == "technical", "feasibility_gap").otherwise("unsupported_claim"), severity,
        F.array("ref"), F.when(category == "novelty", V.SIMILARITY_LABEL),
    )
    return claim_rows.filter("unsupported_no is not null").select("submission_id", item.alias("item"))


@fixed_column
def _other_items() -> Column:
    """Dependency, appendix, differentiation and rubric items, numbered after the claims."""
    makers = []
    for i, (key, title, _, _, severity, wording) in enumerate(V.DEPENDENCIES):
        hits = F.element_at("mentions", F.lit(i))
        present = F.coalesce(F.size(hits) > 0, F.lit(False)) & ~F.get("explained", F.lit(i))

        def dependency(n, hits=hits, title=title, severity=severity, wording=wording):
            refs = distinct_refs(F.transform(hits, lambda h: h["ref"]))
            return _item(n, title, fill(wording, what=F.get(hits, F.lit(0))["what"]), "feasibility_gap", severity, refs)

        makers.append((present, dependency))
    appendix = F.col("appendix")
    makers.append((
        ~F.col("has_appendix") & appendix.isNotNull(),
        lambda n: _item(n, _T["appendix_title"], fill(_T["appendix"], label=page_label(appendix["page_number"])),
                        "missing_information", "medium", F.array(appendix)),
    ))
    known = F.coalesce(*[
        F.when(F.get("approaches", F.lit(i)), label) for i, (_, label) in enumerate(V.COMMON_APPROACHES)
    ])
    solution = F.coalesce(
        F.slice(F.element_at("topics", F.lit("solution")), F.lit(1), F.lit(1)), F.array().cast(f"array<{REF_TYPE}>")
    )
    middle = F.when(known.isNotNull(), fill(_T["differentiation_known"], pattern=known)).otherwise(
        _T["differentiation_unknown"]
    )
    makers.append((
        ~F.map_contains_key("topics", F.lit("competition")),
        lambda n: _item(
            n, _T["differentiation_title"],
            F.concat(F.lit(_T["differentiation_head"]), middle, F.lit(_T["differentiation_tail"])),
            "potential_similarity", "medium", solution, V.SIMILARITY_LABEL),
    ))
    missing = F.transform(F.filter("criteria", lambda c: ~c["assessed"]), lambda c: c["criterion"])
    makers.append((
        F.size(missing) > 0,
        lambda n: _item(
            n, _T["missing_title"],
            F.concat(F.lit(_T["missing_head"]), F.array_join(missing, ", "), F.lit(_T["missing_tail"])),
            "missing_information", F.when(F.size(missing) > 1, "medium").otherwise("low"),
            F.array().cast(f"array<{REF_TYPE}>"), related=missing),
    ))
    items, number = [], F.col("n_open")
    for present, make in makers:
        number = number + present.cast("int")
        items.append(F.when(present, make(number)))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def verify_items(assessed: DataFrame, claim_rows: DataFrame) -> DataFrame:
    """assessed + verify array: the first eight by severity, then by number.

    Of the claims only the eight foremost of a submission can be among them, and
    these are chosen before the shuffle.
    """
    top = first_per_group(
        claim_items(claim_rows).select("submission_id", "item"), ["submission_id"],
        [F.col("item.rank"), F.col("item.number")], V.MAX_VERIFY_ITEMS,
    ).groupBy("submission_id").agg(F.collect_list("item").alias("_claims"))
    both = F.concat(F.coalesce("_claims", F.array().cast(f"array<{ITEM_TYPE}>")), _other_items())
    kept = F.slice(F.sort_array(both), F.lit(1), F.lit(V.MAX_VERIFY_ITEMS))
    grounded = F.filter(kept, lambda v: ~v["type"].isin(V.EVIDENCE_REQUIRED) | (F.size(v["evidence"]) > 0))
    return (
        assessed.withColumn("mentions", F.coalesce(
            "mentions",
            F.map_from_arrays(F.array().cast("array<int>"),
                              F.array().cast(f"array<array<struct<what:string,ref:{REF_TYPE}>>>")),
        ))
        .join(top, "submission_id", "left")
        .withColumn("verify", grounded)
        .drop("_claims")
    )


def verify_rows(verified: DataFrame) -> DataFrame:
    return verified.select("submission_id", F.posexplode("verify").alias("ord", "v")).select(
        "submission_id", "ord", "v.*"
    ).drop("rank")
