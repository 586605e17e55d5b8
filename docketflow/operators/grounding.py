"""Checking citations against what analysis was allowed to see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions.similarity import contained, first_reaching, may_reach
from docketflow.functions.text import let, normalize, strip, truncate
from docketflow.operators.skew import first_per_group
from docketflow.session import cut

SOURCES = [("text", "text"), ("speaker_notes", "notes"), ("ocr", "image_text")]
REF_FIELDS = ["slide_id", "excerpt", "page_number", "verified", "via"]
REF_TYPE = "struct<slide_id:string,excerpt:string,page_number:int,verified:boolean,via:string>"


def locate(df: DataFrame, excerpts: str, target: str) -> DataFrame:
    """Add ``target``: map of normalized excerpt → source it was found in.

    ``excerpts`` is an array column of the same row as the view columns.  Text is
    tried first, then notes, then image text.  An excerpt goes to the similarity
    function only if a source that may be like it comes before the first one that
    contains it; all sources of a row are searched in one call.
    """
    wanted, hays, judged, open_, places = (f"_{target}_{x}" for x in ("wanted", "hays", "judged", "open", "places"))
    vias = F.array(*[F.lit(via) for via, _ in SOURCES])

    def first(e: Column) -> Column:
        """The place of a source that settles an excerpt; -1 for none, null for one that is open."""
        chain = F.lit(-1)
        for i in reversed(range(len(SOURCES))):
            hay = F.col(hays)[i]
            chain = F.when(contained(hay, e), i).when((hay != "") & may_reach(e, hay, V.EXCERPT_THRESHOLD), F.lit(None)).otherwise(chain)
        return chain.cast("int")

    staged = (
        df.withColumn(wanted, F.when(
            ~F.col("withheld"), F.filter(F.array_distinct(F.transform(excerpts, normalize)), lambda e: e != ""),
        ).otherwise(F.array().cast("array<string>")))
        .withColumn(hays, F.when(F.size(wanted) > 0, F.array(*[normalize(F.col(source)) for _, source in SOURCES])))
        .withColumn(judged, F.transform(wanted, lambda e: F.struct(e.alias("e"), first(e).alias("at"))))
        .withColumn(open_, F.transform(F.filter(judged, lambda x: x["at"].isNull()), lambda x: x["e"]))
    )
    busy = F.size(open_) > 0
    found = first_reaching(F.when(busy, F.col(open_)), F.when(busy, F.col(hays)), V.EXCERPT_THRESHOLD)
    staged = staged.withColumn(places, found)
    at = lambda x: F.coalesce(x["at"], F.element_at(places, F.array_position(open_, x["e"]).cast("int")))
    hits = F.filter(F.transform(judged, lambda x: F.struct(x["e"].alias("k"), at(x).alias("at"))), lambda x: x["at"] >= 0)
    pairs = F.transform(hits, lambda x: F.struct(x["k"].alias("k"), F.element_at(vias, x["at"] + 1).alias("v")))
    return staged.withColumn(target, F.map_from_entries(pairs)).drop(wanted, hays, judged, open_, places)


def reference(excerpt: Column, located: Column) -> Column:
    """A citation of the row's own unit."""
    return let(F.element_at(located, normalize(excerpt)), lambda via: F.struct(
        F.col("slide_id").alias("slide_id"), excerpt.alias("excerpt"),
        F.col("page_number").cast("int").alias("page_number"),
        via.isNotNull().alias("verified"), F.coalesce(via, F.lit("unknown")).alias("via"),
    ))


def ground_refs(refs: DataFrame, views: DataFrame, stored: bool = False) -> DataFrame:
    """refs(submission_id, owner, ord, slide_id, excerpt) → known, verified, distinct refs.

    References to unknown slides go; of equal excerpts of one slide the first
    stays.  Used for findings that come from outside (plugged-in stages); the
    built-in rules ground inside the unit's row instead.

    A slide's text meets the different excerpts cited from it once: they are
    gathered to the slide (as many as answers cite, a few per finding), searched
    there, and only where each was found goes back to the references.  With ``stored`` the
    references are written with their normalized excerpts, instead of being made for both joins.
    """
    cited = refs.withColumn("slide_id", F.lower(strip(F.col("slide_id")))).withColumn(
        "excerpt", truncate(F.col("excerpt"), 240)).withColumn("_norm", normalize(F.col("excerpt")))
    if stored:
        cited = cut(cited, "cited")
    wanted = cited.groupBy("submission_id", "slide_id").agg(F.collect_set("_norm").alias("_excerpts"))
    known = views.select("submission_id", "slide_id", "page_number", "text", "notes", "image_text", "withheld")
    # Few bytes are much work here, so the joined slides keep all tasks of a shuffle instead of being drawn together.
    met = known.join(wanted, ["submission_id", "slide_id"])
    met = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = locate(met, "_excerpts", "_via").select(
        "submission_id", "slide_id", "page_number", "_via")
    via = F.element_at("_via", F.col("_norm"))
    rows = cited.join(found, ["submission_id", "slide_id"]).select(
        "submission_id", "owner", "ord", "slide_id", "excerpt", "page_number",
        via.isNotNull().alias("verified"), F.coalesce(via, F.lit("unknown")).alias("via"), "_norm",
    )
    return first_per_group(rows, ["submission_id", "owner", "slide_id", "_norm"], [F.col("ord")], 1).drop("_norm", "rn")


def distinct_refs(refs: Column) -> Column:
    """Of references with equal slide and normalized excerpt the first stays (short arrays)."""
    return F.filter(
        refs,
        lambda r, i: ~F.exists(
            F.slice(refs, F.lit(1), i),
            lambda e: (e["slide_id"] == r["slide_id"]) & (normalize(e["excerpt"]) == normalize(r["excerpt"])),
        ),
    )


def unscore_unlinked(criteria: DataFrame) -> DataFrame:
    """Assessed criteria without evidence become unassessed, without a score."""
    linked = F.size("evidence") > 0
    lost = F.col("assessed") & ~linked
    return (
        criteria.withColumn("reason", F.when(lost, V.UNLINKED_REASON).otherwise(F.col("reason")))
        .withColumn("assessed", F.col("assessed") & linked)
        .withColumn("score", F.when(F.col("assessed"), F.col("score")))
    )


def keep_items(items: DataFrame) -> DataFrame:
    """Verify items that may stand without evidence or have some; similarity items get their label."""
    needs = F.col("type").isin(V.EVIDENCE_REQUIRED)
    label = F.when(
        (F.col("type") == "potential_similarity") & (F.coalesce("label", F.lit("")) == ""), V.SIMILARITY_LABEL
    ).otherwise(F.col("label"))
    return items.filter(~needs | (F.size("evidence") > 0)).withColumn("label", label)
