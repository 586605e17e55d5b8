"""Building evidence units: one row per slide or page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions.text import clean_text, let, split_lines, strip, unit_key
from docketflow.operators.skew import running_total

UNIT = ["submission_id", "page_number"]


def first_line_title(text: Column) -> Column:
    """Title of a title shape: its first line, 200 characters, blank as null."""
    first = F.get(F.split(clean_text(text), "\n"), F.lit(0))
    return F.nullif(F.substring(first, 1, V.TITLE_LIMIT), F.lit(""))


def title_by_size(lines: Column) -> Column:
    """Title from ordered ``array<struct<ord,text,size>>``: the largest line.

    A later line replaces the title only when it is larger by more than half a
    point, so the result depends on the order and is a fold, not a maximum.
    """
    start = F.struct(F.lit(None).cast("double").alias("size"), F.lit(None).cast("string").alias("text"))

    def step(best: Column, line: Column) -> Column:
        text = strip(line["text"])
        size = line["size"].cast("double")
        better = (text != "") & (best["size"].isNull() | (size > best["size"] + V.TITLE_SIZE_STEP))
        return F.when(better, F.struct(size.alias("size"), text.alias("text"))).otherwise(best)

    return F.substring(F.aggregate(lines, start, step)["text"], 1, V.TITLE_LIMIT)


def titles_by_size(lines: DataFrame) -> DataFrame:
    """lines(submission_id, page_number, ord, text, size) → title per unit."""
    ordered = F.sort_array(F.collect_list(F.struct("ord", "text", F.col("size").cast("double").alias("size"))))
    return lines.groupBy(*UNIT).agg(ordered.alias("lines")).select(*UNIT, title_by_size(F.col("lines")).alias("title"))


def assemble_text(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(submission_id, page_number, ord, text, cells) → text per unit.

    ``cells`` (array, else null) marks a table row: cells joined by " | ", rows
    without any content skipped.  The rows of a unit come from one file page,
    whose size the intake limits.
    """
    cells = F.transform("cells", clean_text)
    row = F.when(F.exists(cells, lambda c: c != ""), F.array_join(cells, " | "))
    line = F.when(F.col("cells").isNotNull(), row).otherwise(F.nullif(strip(F.col("text")), F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct("ord", "line")))
    joined = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return (
        paragraphs.withColumn("line", line)
        .filter("line is not null")
        .groupBy(*UNIT)
        .agg(clean_text(joined).alias("text"))
    )


def merge_links(links: DataFrame) -> DataFrame:
    """links(submission_id, page_number, uri) → distinct sorted links per unit."""
    return (
        links.filter(F.coalesce("uri", F.lit("")) != "")
        .groupBy(*UNIT)
        .agg(F.sort_array(F.collect_set("uri")).alias("links"))
    )


def content_flags(shapes: DataFrame) -> DataFrame:
    """shapes(submission_id, page_number, kind) → visual content, embedded media per unit."""
    return shapes.groupBy(*UNIT).agg(
        F.bool_or(F.col("kind").isin("picture", "chart")).alias("has_visual_content"),
        F.bool_or(F.col("kind").isin("media", "embedded_object", "linked_object")).alias("has_embedded_media"),
    )


# --- unit builders ---------------------------------------------------------

def _with_defaults(units: DataFrame) -> DataFrame:
    defaults = {
        "title": F.lit(None).cast("string"),
        "speaker_notes": F.lit(None).cast("string"),
        "hidden": F.lit(False),
        "has_visual_content": F.lit(False),
        "has_embedded_media": F.lit(False),
        "links": F.array().cast("array<string>"),
        "processing_notes": F.array().cast("array<string>"),
        "signals": F.array().cast("array<struct<ord:int,text:string,reason:string,detail:string>>"),
    }
    missing = {k: v for k, v in defaults.items() if k not in units.columns}
    return units.withColumns(missing).withColumn("slide_id", unit_key(F.col("page_number")))


def units_from_documents(documents: DataFrame, lines_per_unit: int = 12) -> DataFrame:
    """documents(submission_id, text) → units of ``lines_per_unit`` lines; nothing is cut off."""
    def blocks(lines: Column) -> Column:
        last = F.greatest(F.ceil(F.size(lines) / lines_per_unit), F.lit(1)).cast("int") - 1
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.array_join(F.slice(lines, i * lines_per_unit + 1, F.lit(lines_per_unit)), "\n"),
        )

    exploded = documents.select("submission_id", F.posexplode(let(split_lines(F.col("text")), blocks)).alias("pos", "block"))
    units = exploded.select(
        "submission_id", (F.col("pos") + 1).alias("page_number"), clean_text(F.col("block")).alias("text")
    )
    return _with_defaults(units.withColumn("title", first_line_title(F.col("text"))))


def units_from_conversations(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) → one unit per turn; system turns are notes."""
    is_note = F.col("role") == "system"
    units = turns.select(
        F.col("conv_id").alias("submission_id"),
        (F.col("turn") + 1).cast("int").alias("page_number"),
        F.when(is_note, "").otherwise(clean_text(F.col("text"))).alias("text"),
        F.when(is_note, F.nullif(clean_text(F.col("text")), F.lit(""))).alias("speaker_notes"),
    )
    return _with_defaults(units.withColumn("title", first_line_title(F.col("text"))))


def html_links(html: Column) -> Column:
    return F.sort_array(F.array_distinct(
        F.filter(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)), lambda u: u != "")
    ))


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts and styles out, block ends as line breaks."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", " ")
    blocks = F.regexp_replace(bare, r"(?i)</(p|div|li|h[1-6]|tr|ul|ol|article|nav|section|footer|header)>|<br\s*/?>", "\n")
    text = F.regexp_replace(blocks, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return clean_text(text)


def units_from_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) → one unit per page with title, links and media flags."""
    html = F.col("html")
    units = pages.select(
        F.col("page_id").alias("submission_id"),
        F.lit(1).alias("page_number"),
        F.nullif(
            F.substring(strip(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)), 1, V.TITLE_LIMIT), F.lit("")
        ).alias("title"),
        html_text(html).alias("text"),
        html_links(html).alias("links"),
        html.rlike(r"(?i)<(img|svg|canvas)\b").alias("has_visual_content"),
        html.rlike(r"(?i)<(video|audio|object|embed)\b").alias("has_embedded_media"),
    )
    return _with_defaults(units)


# --- rendering and recognition outcomes ------------------------------------

def render_map(units: DataFrame, rendered_files: DataFrame) -> DataFrame:
    """units + renderable, render_page, rendered, render_error.

    rendered_files(submission_id, n_pages; null when the file could not be
    converted, failed_pages map<int,string>).  Pages follow the units when the
    counts agree, the visible units when only those were rendered, and are not
    attached at all otherwise.  Counts are joined to the unit keys, not to their
    texts.
    """
    keys = units.select(*UNIT, "hidden")
    counts = keys.groupBy("submission_id").agg(
        F.count("*").alias("n_units"), F.count_if(~F.col("hidden")).alias("n_visible")
    )
    n_pages = F.col("n_pages")
    by_all, by_visible = n_pages == F.col("n_units"), n_pages == F.col("n_visible")
    renderable = F.coalesce(by_all | by_visible, F.lit(False))
    page = F.when(by_all, F.col("place")).when(by_visible & ~F.col("hidden"), F.col("visible_place"))
    placed = running_total(
        keys, ["submission_id"], "page_number",
        {"place": F.lit(1), "visible_place": (~F.col("hidden")).cast("int")},
    )
    failure = F.element_at("failed_pages", F.col("render_page"))
    R = V.RENDER_REASONS
    error = (
        F.when(~F.col("renderable"), R["unavailable"])
        .when(F.col("render_page").isNull() & F.col("hidden"), R["hidden"])
        .when(F.col("render_page").isNull(), R["no_page"])
        .when(failure.isNotNull(), F.concat(F.lit("Rendering failed: "), failure))
    )
    mapped = (
        placed.join(counts, "submission_id")
        .join(rendered_files.select("submission_id", "n_pages", "failed_pages"), "submission_id", "left")
        .withColumn("renderable", renderable)
        .withColumn("render_page", page.cast("int"))
        .withColumn("render_error", error)
        .select(*UNIT, "renderable", "render_page", F.col("render_error").isNull().alias("rendered"), "render_error")
    )
    return units.join(mapped, UNIT)


def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes(submission_id, page_number, ord, x, y, text) → recognized text per unit.

    Rows of 20 pixels top to bottom, then left to right; blank boxes are dropped.
    """
    place = F.struct(F.rint(F.col("y") / 20).alias("row"), "x", "ord", "text")
    texts = F.transform(F.sort_array(F.collect_list(place)), lambda b: b["text"])
    return boxes.filter(strip(F.col("text")) != "").groupBy(*UNIT).agg(F.array_join(texts, "\n").alias("raw_text"))


def ocr_outcome(units: DataFrame) -> DataFrame:
    """units(rendered, ocr_available, ocr_failed, raw_text) + ocr_text, ocr_status."""
    text = strip(F.coalesce("raw_text", F.lit("")))
    read = F.col("rendered") & F.col("ocr_available") & ~F.coalesce("ocr_failed", F.lit(False))
    status = (
        F.when(~F.col("rendered"), "not_run")
        .when(~F.col("ocr_available"), "unavailable")
        .when(~read, "failed")
        .when(text == "", "empty")
        .otherwise("completed")
    )
    return units.withColumn("ocr_status", status).withColumn("ocr_text", F.when(read, text))


def with_render_notes(units: DataFrame) -> DataFrame:
    """Append the render error of visible units to their notes."""
    notes = F.col("processing_notes")
    extra = F.when(F.col("render_error").isNotNull() & ~F.col("hidden"), F.array("render_error"))
    return units.withColumn("processing_notes", F.coalesce(F.concat(notes, extra), notes))


def with_hidden_notes(units: DataFrame) -> DataFrame:
    """Append the note that a slide is hidden (slide decks only)."""
    notes = F.col("processing_notes")
    return units.withColumn(
        "processing_notes", F.when(F.col("hidden"), F.concat(notes, F.array(F.lit(V.HIDDEN_SLIDE_NOTE)))).otherwise(notes)
    )


def partial_submissions(units: DataFrame) -> DataFrame:
    """submission_id, partial: nothing renderable, or any note that mentions a failure."""
    failed = F.exists("processing_notes", lambda n: F.contains(F.lower(n), F.lit("failed")))
    return units.groupBy("submission_id").agg(
        (F.bool_or(failed) | ~F.bool_or("renderable")).alias("partial")
    )


def replace_units(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """All units of re-processed submissions replaced; running it twice changes nothing."""
    gone = fresh.select("submission_id").distinct()
    return existing.join(gone, "submission_id", "left_anti").unionByName(fresh, allowMissingColumns=True)
