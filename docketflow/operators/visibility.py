"""Structural visibility: which spans of a page are unlikely to be seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions.numeric import contrast_ratio, one_decimal
from docketflow.functions.text import fill, strip

UNIT = ["submission_id", "page_number"]
_WHITE = 1.0


def _signal(reason: str, detail: Column) -> Column:
    return F.struct(F.lit(reason).alias("reason"), detail.alias("detail"))


def _points(size: Column) -> Column:
    return fill(V.SIGNAL_DETAILS["tiny"], size=one_decimal(size))


def _low_contrast(bg: tuple[Column, Column, Column]) -> Column:
    ratio = contrast_ratio((F.col("r"), F.col("g"), F.col("b")), bg)
    return F.coalesce(ratio < V.LOW_CONTRAST_RATIO, F.lit(False))


def classify_spans(spans: DataFrame) -> DataFrame:
    """Page spans that look hidden: keys, ord, text, reason, detail; the first rule wins.

    spans: submission_id, page_number, ord, text, size, opacity, mode, x0..y1,
    page_x0..page_y1, r, g, b, bg_r, bg_g, bg_b (colours 0..1, null if unknown).
    """
    D = V.SIGNAL_DETAILS
    text = strip(F.col("text"))
    outside = ~(
        (F.greatest("x0", "page_x0") < F.least("x1", "page_x1"))
        & (F.greatest("y0", "page_y0") < F.least("y1", "page_y1"))
    )
    size = F.coalesce("size", F.lit(12.0))
    found = (
        F.when((F.coalesce("mode", F.lit(0)) == 3) | (F.coalesce("opacity", F.lit(1.0)) == 0),
               _signal("invisible_text_layer", F.lit(D["invisible_mode"])))
        .when(size < V.PDF_TINY_FONT_PT, _signal("tiny_text", _points(size)))
        .when(outside, _signal("off_slide_content", F.lit(D["off_page"])))
        .when(_low_contrast((F.col("bg_r"), F.col("bg_g"), F.col("bg_b"))),
              _signal("low_contrast_text", F.lit(D["low_contrast"])))
    )
    return (
        spans.withColumn("text", text)
        .filter(F.length("text") >= 3)
        .withColumn("s", found)
        .filter("s is not null")
        .select(*UNIT, "ord", "text", "s.reason", "s.detail")
    )


def off_slide(left: Column, top: Column, width: Column, height: Column, slide_w: Column, slide_h: Column) -> Column:
    """Shape entirely beside the slide; shapes without a position are on it."""
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    beside = (left >= slide_w) | (top >= slide_h) | (left + w <= 0) | (top + h <= 0)
    return F.coalesce(beside, F.lit(False)) & left.isNotNull() & top.isNotNull()


def classify_runs(runs: DataFrame) -> DataFrame:
    """Slide paragraphs that look hidden, from their runs.

    runs: submission_id, page_number, para (paragraph order), run, text, size,
    r, g, b, left, top, width, height, slide_w, slide_h, hidden_shape,
    fill_r/g/b, slide_r/g/b.  The background is the shape fill, else the slide's,
    else white.  Runs are reduced to the first conspicuous one per paragraph.
    """
    D = V.SIGNAL_DETAILS
    bg = tuple(
        F.when(F.col("fill_r").isNotNull(), F.col(f"fill_{c}"))
        .when(F.col("slide_r").isNotNull(), F.col(f"slide_{c}"))
        .otherwise(F.lit(_WHITE))
        for c in ("r", "g", "b")
    )
    found = F.when(
        strip(F.col("text")) != "",
        F.when(F.col("size") < V.SLIDE_TINY_FONT_PT, _signal("tiny_text", _points(F.col("size")))).when(
            _low_contrast(bg), _signal("low_contrast_text", F.lit(D["low_contrast"]))
        ),
    )
    beside = off_slide(*[F.col(c) for c in ("left", "top", "width", "height", "slide_w", "slide_h")])
    paragraph = runs.withColumn("s", found).groupBy(*UNIT, "para").agg(
        strip(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]
        ), "")).alias("text"),
        F.bool_or(beside).alias("beside"),
        F.bool_or("hidden_shape").alias("hidden_shape"),
        F.min_by("s", F.when(F.col("s").isNotNull(), F.col("run"))).alias("s"),
    )
    signal = (
        F.when(F.col("beside"), _signal("off_slide_content", F.lit(D["off_slide"])))
        .when(F.col("hidden_shape"), _signal("invisible_text_layer", F.lit(D["hidden_shape"])))
        .otherwise(F.col("s"))
    )
    return (
        paragraph.filter("text <> ''")
        .withColumn("signal", signal)
        .filter("signal is not null")
        .select(*UNIT, F.col("para").alias("ord"), "text", "signal.reason", "signal.detail")
    )


def median_background(samples: DataFrame) -> DataFrame:
    """samples(keys, ord, r, g, b in 0..255) → upper median by channel sum, on 0..1.

    A region is sampled at about 12 x 4 points, so its list is short.
    """
    ordered = F.sort_array(F.collect_list(F.struct(
        (F.col("r") + F.col("g") + F.col("b")).alias("total"), "sample", "r", "g", "b"
    )))
    middle = F.get("s", F.floor(F.size("s") / 2).cast("int"))
    return samples.groupBy(*UNIT, "ord").agg(ordered.alias("s")).select(
        *UNIT, "ord", *[(middle[c] / 255).alias(f"bg_{c}") for c in ("r", "g", "b")]
    )


def merge_signals(signals: DataFrame) -> DataFrame:
    """Join neighbouring signals of the same reason; the first detail stays.

    All windows stay inside one page.
    """
    window = Window.partitionBy(*UNIT).orderBy("ord")
    started = F.coalesce((F.col("reason") != F.lag("reason").over(window)), F.lit(True)).cast("int")
    return (
        signals.withColumn("_new", started)
        .withColumn("_island", F.sum("_new").over(window))
        .groupBy(*UNIT, "_island")
        .agg(
            F.min("ord").alias("ord"),
            F.array_join(F.transform(
                F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]
            ), " ").alias("text"),
            F.first("reason").alias("reason"),
            F.min_by("detail", "ord").alias("detail"),
        )
        .drop("_island")
    )


def attach_signals(units: DataFrame, signals: DataFrame) -> DataFrame:
    """units + signals array<struct<ord,text,reason,detail>> of their page."""
    lists = signals.groupBy(*UNIT).agg(
        F.sort_array(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), "text", "reason", "detail")))
        .alias("signals")
    )
    empty = F.array().cast("array<struct<ord:int,text:string,reason:string,detail:string>>")
    return units.drop("signals").join(lists, UNIT, "left").withColumn("signals", F.coalesce("signals", empty))
