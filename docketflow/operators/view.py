"""What analysis may see of a unit.

Text flagged as hidden is removed here, and later stages read nothing but this
view.  Everything is decided inside the unit's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions.similarity import hopeful, score_maps, score_of, unsettled
from docketflow.functions.text import normalize, split_lines, split_sentences, strip

VIEW_COLUMNS = [
    "submission_id", "page_number", "slide_id", "team_name", "submission_title", "title", "text", "notes",
    "image_text", "withheld", "links",
]


def _excerpts(location: str) -> Column:
    chosen = F.filter("flags", lambda f: (
        f["withheld_from_ai"] & (f["location"] == location) & (f["excerpt"] != "")
    ))
    return F.transform(chosen, lambda f: normalize(F.regexp_replace(f["excerpt"], "…+$", "")))


def _withheld_lines(df: DataFrame, source: str, location: str, target: str) -> DataFrame:
    """Add the lines of ``source``, the withheld excerpts of its place, and the lines whose likeness to these is open."""
    lines, long, rest, open_ = (f"_{target}_{x}" for x in ("lines", "long", "rest", "open"))
    present = (F.size(f"_{target}_all") > 0) & (F.coalesce(source, F.lit("")) != "")
    row = F.transform(
        F.when(present, split_lines(F.col(source))),
        lambda x: F.struct(x.alias("line"), normalize(x).alias("norm")),
    )
    return (
        df.withColumn(f"_{target}_all", _excerpts(location))
        .withColumn(long, F.filter(f"_{target}_all", lambda e: F.length(e) >= V.MIN_WITHHELD_CHARS))
        .withColumn(lines, row)
        .withColumn(rest, F.when(
            F.size(long) > 0, unsettled(F.transform(lines, lambda x: x["norm"]), F.col(long))
        ))
        .withColumn(open_, hopeful(F.col(rest), F.col(long), V.WITHHELD_THRESHOLD))
    )


def _drop_withheld(df: DataFrame, source: str, target: str, scores: Column) -> DataFrame:
    """Add ``target``: ``source`` without the lines that repeat a withheld excerpt.

    Neighbouring dropped lines leave one mark.
    """
    lines, long, rest, open_ = (f"_{target}_{x}" for x in ("lines", "long", "rest", "open"))

    def judged(x: Column) -> Column:
        drop = (F.size(long) > 0) & (x["norm"] != "") & (
            score_of(x["norm"], F.col(rest), F.col(open_), scores) >= V.WITHHELD_THRESHOLD
        )
        return F.struct(drop.alias("drop"), F.when(drop, V.WITHHELD_MARK).otherwise(x["line"]).alias("line"))

    shown = f"_{target}_shown"
    staged = df.withColumn(shown, F.transform(lines, judged))
    # A dropped line right after a mark adds nothing.
    kept = F.filter(shown, lambda x, i: ~(
        x["drop"] & (i > 0) & F.coalesce(F.get(shown, i - 1)["line"] == V.WITHHELD_MARK, F.lit(False))
    ))
    text = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    return staged.withColumn(
        target, F.when(F.col(lines).isNotNull(), text).otherwise(F.coalesce(source, F.lit("")))
    ).drop(f"_{target}_all", lines, long, rest, open_, shown)


def _image_lines(df: DataFrame) -> DataFrame:
    """Add the recognized lines of visual units, the text layer, and the lines whose likeness to it is open."""
    wanted = F.col("has_visual_content") & (F.coalesce("ocr_text", F.lit("")) != "")
    lines = F.filter(
        F.transform(
            F.when(wanted, split_lines(F.col("ocr_text"))),
            lambda x: F.struct(strip(x).alias("line"), normalize(x).alias("norm")),
        ),
        lambda x: F.length(x["norm"]) >= V.MIN_IMAGE_LINE_CHARS,
    )
    layer = normalize(F.col("raw_text"))
    return (
        df.withColumn("_image_lines", lines)
        .withColumn("_image_layer", F.when(wanted & (layer != ""), F.array(layer)))
        .withColumn("_image_rest", unsettled(F.transform("_image_lines", lambda x: x["norm"]), F.col("_image_layer")))
        .withColumn("_image_open", hopeful(F.col("_image_rest"), F.col("_image_layer"), V.IMAGE_TEXT_THRESHOLD))
    )


def _image_text(df: DataFrame, scores: Column) -> DataFrame:
    """Add ``image_text``: recognized lines of visual units that the text layer lacks."""
    fresh = F.filter("_image_lines", lambda x: (
        F.col("_image_layer").isNull()
        | (score_of(x["norm"], F.col("_image_rest"), F.col("_image_open"), scores) < V.IMAGE_TEXT_THRESHOLD)
    ))
    joined = F.array_join(F.transform(fresh, lambda x: x["line"]), "\n")
    return df.withColumn("image_text", F.coalesce(joined, F.lit(""))).drop(
        "_image_lines", "_image_layer", "_image_rest", "_image_open")


def build_views(flagged: DataFrame) -> DataFrame:
    """Flagged units → one view per unit.

    A unit withheld as a whole keeps only a mark; otherwise withheld lines leave
    the text and the notes.  All open likenesses of a row are scored in one call.
    """
    missing = {
        n: F.lit("") for n in ("team_name", "submission_title") if n not in flagged.columns
    }
    whole = F.exists("flags", lambda f: f["withheld_from_ai"] & (f["location"] == "slide"))
    staged = flagged.withColumns(missing).withColumn("raw_text", F.coalesce("text", F.lit("")))
    staged = _withheld_lines(staged, "raw_text", "slide_text", "shown_text")
    staged = _withheld_lines(staged, "speaker_notes", "speaker_notes", "shown_notes")
    staged = _image_lines(staged).withColumn("_scores", score_maps([
        (F.col("_shown_text_open"), F.col("_shown_text_long"), V.WITHHELD_THRESHOLD),
        (F.col("_shown_notes_open"), F.col("_shown_notes_long"), V.WITHHELD_THRESHOLD),
        (F.col("_image_open"), F.col("_image_layer"), V.IMAGE_TEXT_THRESHOLD),
    ]))
    staged = _drop_withheld(staged, "raw_text", "shown_text", F.col("_scores")[0])
    staged = _drop_withheld(staged, "speaker_notes", "shown_notes", F.col("_scores")[1])
    staged = _image_text(staged, F.col("_scores")[2]).withColumn("withheld", whole)
    gone = F.col("withheld")
    return staged.select(
        "submission_id", "page_number", "slide_id", "team_name", "submission_title",
        F.coalesce("title", F.lit("")).alias("title"),
        F.when(gone, V.WITHHELD_MARK).otherwise(F.col("shown_text")).alias("text"),
        F.when(gone, "").otherwise(F.col("shown_notes")).alias("notes"),
        F.when(gone, "").otherwise(F.col("image_text")).alias("image_text"),
        "withheld",
        "links",
    )


def with_sentences(views: DataFrame) -> DataFrame:
    """views + sentences (without the title), note_sentences, image_sentences, all_text."""
    title = normalize(F.col("title"))
    parts = F.filter(F.array("title", "text", "notes", "image_text"), lambda p: p != "")
    return (
        views.withColumn("_title", title)
        .withColumn("sentences", F.filter(split_sentences(F.col("text")), lambda s: normalize(s) != F.col("_title")))
        .withColumn("note_sentences", split_sentences(F.col("notes")))
        .withColumn("image_sentences", split_sentences(F.col("image_text")))
        .withColumn("all_text", F.array_join(parts, "\n"))
        .drop("_title")
    )


def _tagged(source: str, column: str) -> Column:
    return F.transform(column, lambda s, i: F.struct(F.lit(source).alias("source"), i.alias("ord"), s.alias("sentence")))


def sentence_rows(views: DataFrame) -> DataFrame:
    """submission_id, page_number, source {text,notes,image}, ord, sentence; one pass over the views."""
    tagged = F.concat(*[
        _tagged(source, column) for source, column in (("text", "sentences"), ("notes", "note_sentences"), ("image", "image_sentences"))
    ])
    return with_sentences(views).select("submission_id", "page_number", F.inline(tagged))


def total_weight(rubric: DataFrame) -> DataFrame:
    """round_id, total_weight; a total of 0 counts as 1."""
    total = F.sum("weight")
    return rubric.groupBy("round_id").agg(F.when(total == 0, 1.0).otherwise(total).alias("total_weight"))
