"""What could not be assessed, and the Evidence Pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions.columns import fixed_column
from docketflow.functions.text import fill, is_video_host, page_label, url_host, word_count

UNIT = ["submission_id", "page_number"]
ITEM_TYPE = "struct<area:string,reason:string,slide_id:string>"


def _item(area: Column, reason: Column) -> Column:
    return F.struct(area.alias("area"), reason.alias("reason"), F.col("slide_id").alias("slide_id")).cast(ITEM_TYPE)


def _list(condition: Column, *items: Column) -> Column:
    return F.when(condition, F.array(*items)).otherwise(F.array().cast(f"array<{ITEM_TYPE}>"))


@fixed_column
def unit_items() -> Column:
    """Items of one unit, in order."""
    N = V.NOT_ASSESSED
    label = page_label(F.col("page_number"))

    def area(suffix: str) -> Column:
        return F.concat(label, F.lit(suffix))

    def link(uri: Column) -> Column:
        host = url_host(uri)
        kind = F.when(is_video_host(host), " linked video content").otherwise(" linked external content")
        return _item(F.concat(label, kind), fill(N["link"], label=label, host=host))

    hidden = _list(F.lit(True), _item(area(" (hidden slide)"), fill(N["hidden"], label=label)))
    visual = F.when(
        F.col("ocr_status") == "completed", fill(N["visual_read"], label=label)
    ).otherwise(fill(N["visual_unread"], label=label))
    failed_notes = F.filter("own_notes", lambda n: F.contains(F.lower(n), F.lit("failed")))
    shown = F.concat(
        _list(~F.col("rendered") & F.col("renderable"),
              _item(area(" visual content"), fill(N["not_rendered"], label=label))),
        _list(F.col("has_visual_content") & (word_count(F.col("text")) < V.VISUAL_WORD_LIMIT),
              _item(area(" images/diagrams"), visual)),
        F.transform("links", link),
        _list(F.col("has_embedded_media"), _item(area(" embedded media"), fill(N["media"], label=label))),
        F.transform(failed_notes, lambda n: _item(area(" text"), n)),
    )
    return F.when(F.col("hidden"), hidden).otherwise(shown)


def not_assessed(units: DataFrame, submissions: DataFrame) -> DataFrame:
    """submission_id, part, page_number, ord, area, reason, slide_id.

    Order: part (0 document first, 1 units, 2 document last), page, ord.
    units: renderable and ``processing_notes`` as parsed (render errors not yet
    appended); submissions: submission_id, renderable, ocr_available, doc_notes.
    """
    per_unit = (
        units.withColumn("own_notes", F.col("processing_notes"))
        .select(*UNIT, F.posexplode(unit_items()).alias("ord", "i"))
        .select("submission_id", F.lit(1).alias("part"), "page_number", "ord", "i.*")
    )
    N = V.NOT_ASSESSED
    notes = F.array_join("doc_notes", "; ")
    head = F.concat(
        F.lit(N["document_render_head"]),
        F.when(F.size("doc_notes") > 0, F.concat(F.lit(" ("), notes, F.lit(")"))).otherwise(""),
        F.lit(N["document_render_tail"]),
    )
    first = F.struct(F.lit(0).alias("part"), F.lit("Slide rendering").alias("area"), head.alias("reason"))
    last = F.struct(
        F.lit(2).alias("part"), F.lit("Visual integrity comparison").alias("area"),
        F.lit(N["document_no_ocr"]).alias("reason"),
    )
    document = submissions.select(
        "submission_id",
        F.when(~F.col("renderable"), first).when(~F.col("ocr_available"), last).alias("d"),
    ).filter("d is not null")
    return per_unit.unionByName(document.select(
        "submission_id", "d.part", F.lit(0).alias("page_number"), F.lit(0).alias("ord"), "d.area", "d.reason",
        F.lit(None).cast("string").alias("slide_id"),
    ))


def evidence_packs(
    flagged_units: DataFrame, items: DataFrame, reports: DataFrame, submissions: DataFrame,
    partial: DataFrame, accepted: DataFrame,
) -> DataFrame:
    """submission_id, pack: the nested document of each accepted submission.

    ``accepted`` comes from the page limit of the round (at most 300 pages), which
    is what bounds the arrays built here; all other operators use the flat tables.
    submissions: submission_id, source_file, file_type, ocr_available, renderable,
    created_at, parser, renderer, ocr.
    """
    keep = accepted.select("submission_id")
    kind = F.when(F.col("file_type") == "pptx", "slide_number").otherwise("page_number")
    unit = F.struct(
        "page_number", "slide_id", F.lit("slide").alias("source_type"),
        F.struct(kind.alias("kind"), F.col("page_number").cast("string").alias("value")).alias("source_location"),
        "title", "text", "speaker_notes", "ocr_text", "ocr_status", "has_visual_content", "links",
        F.col("flags").alias("integrity_flags"), "processing_notes",
    )
    units = (
        flagged_units.join(keep, "submission_id", "left_semi")
        .join(submissions.select("submission_id", "file_type"), "submission_id")
        .groupBy("submission_id")
        .agg(F.sort_array(F.collect_list(unit)).alias("units"), F.count("*").alias("page_count"))
    )
    listed = (
        items.join(keep, "submission_id", "left_semi")
        .groupBy("submission_id")
        .agg(F.sort_array(F.collect_list(F.struct("part", "page_number", "ord", "area", "reason", "slide_id"))).alias("n"))
    )
    empty = F.array().cast(f"array<{ITEM_TYPE}>")
    bare = F.transform("n", lambda i: F.struct(
        i["area"].alias("area"), i["reason"].alias("reason"), i["slide_id"].alias("slide_id")))
    off = F.lit(V.COMPONENTS["unavailable"])
    components = F.create_map(
        F.lit("validator"), F.lit(V.COMPONENTS["validator"]),
        F.lit("parser"), F.col("parser"),
        F.lit("renderer"), F.when(F.col("renderable"), F.col("renderer")).otherwise(off),
        F.lit("ocr"), F.when(F.col("ocr_available"), F.col("ocr")).otherwise(off),
        F.lit("integrity"), F.lit(V.COMPONENTS["integrity"]),
    )
    flags = F.flatten(F.transform("units", lambda u: u["integrity_flags"]))
    pack = F.struct(
        F.lit("1.0").alias("schema_version"), "submission_id", "source_file", "file_type", "page_count", "units",
        F.coalesce(bare, empty).alias("not_assessed"),
        F.struct(
            F.col("status"), F.col("summary"), flags.alias("flags"),
            F.lit(V.REPORT_METHOD).alias("method"), F.lit(V.REPORT_LIMITATIONS).alias("limitations"),
        ).alias("integrity"),
        F.when(F.col("partial"), "partial").otherwise("complete").alias("processing_status"),
        components.alias("ingestion"),
        "created_at",
    )
    return (
        units.join(submissions, "submission_id")
        .join(reports, "submission_id")
        .join(partial, "submission_id")
        .join(listed, "submission_id", "left")
        .select("submission_id", pack.alias("pack"))
    )
