"""Integrity flags of a unit and the report of a submission.

All flags of a unit are computed from the unit's own row: its lines, signals,
notes and recognized text are arrays, so this stage has no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions.similarity import hopeful, score_maps, score_of, unsettled
from docketflow.functions.columns import fixed_column
from docketflow.functions.text import (
    content_lines,
    fill,
    let,
    looks_like_instruction,
    lookup,
    normalize,
    truncate,
)
from docketflow.operators.skew import first_per_group

UNIT = ["submission_id", "page_number"]
FLAG_TYPE = (
    "struct<slide_id:string,type:string,status:string,location:string,excerpt:string,detail:string,"
    "withheld_from_ai:boolean>"
)
_SUSPICIOUS = "suspicious_instruction_detected"
_POTENTIAL = "potential_discrepancy"


def _flag(kind, status, location: str, excerpt, detail, withheld: bool) -> Column:
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        F.col("slide_id").alias("slide_id"), col(kind).alias("type"), col(status).alias("status"),
        F.lit(location).alias("location"), col(excerpt).alias("excerpt"), col(detail).alias("detail"),
        F.lit(withheld).alias("withheld_from_ai"),
    ).cast(FLAG_TYPE)


def _one(condition: Column, flag: Column) -> Column:
    return F.when(condition, F.array(flag)).otherwise(F.array().cast(f"array<{FLAG_TYPE}>"))


@fixed_column
def _hidden_flags() -> Column:
    D = V.FLAG_DETAILS
    text = F.coalesce("text", F.lit(""))
    instruction = looks_like_instruction(text)
    detail = F.concat(
        F.lit(D["hidden_slide"]), F.when(instruction, D["hidden_slide_instruction"]).otherwise("")
    )
    flag = _flag(
        F.when(instruction, "instruction_like_text").otherwise("hidden_slide"),
        F.when(instruction, _SUSPICIOUS).otherwise(_POTENTIAL),
        "slide", truncate(text, 220), detail, True,
    )
    return _one(F.col("hidden") & (text != ""), flag)


@fixed_column
def _structural_flags() -> Column:
    D = V.FLAG_DETAILS

    def flag(signal: Column) -> Column:
        instruction = looks_like_instruction(signal["text"])
        label = lookup(signal["reason"], V.STRUCTURAL_LABELS, signal["reason"])
        detail = F.concat(
            fill(D["structural"], label=label),
            F.when(instruction, D["structural_instruction"]).otherwise(""),
            F.when(signal["detail"].rlike(r"\d"), F.concat(F.lit(" ("), signal["detail"], F.lit(")"))).otherwise(""),
        )
        return _flag(
            F.when(instruction, "instruction_like_text").otherwise(signal["reason"]),
            F.when(instruction, _SUSPICIOUS).otherwise(_POTENTIAL),
            "slide_text", truncate(signal["text"], 220), detail, True,
        )

    return F.transform("signals", flag)


@fixed_column
def _comparable_lines() -> Column:
    """Lines worth comparing: long enough and not part of a text already flagged."""
    text = F.coalesce("text", F.lit(""))
    flagged = F.filter(
        F.concat(
            F.when(F.col("hidden") & (text != ""), F.array(normalize(text))).otherwise(
                F.array().cast("array<string>")
            ),
            F.transform("signals", lambda s: normalize(s["text"])),
        ),
        lambda s: s != "",
    )
    lines = F.transform(
        content_lines(text), lambda x: F.struct(x.alias("line"), normalize(x).alias("norm"))
    )

    def worth(known: Column):
        return lambda x: (
            (F.length(x["norm"]) >= V.MIN_LINE_CHARS)
            & (F.size(F.split(x["norm"], " ")) >= V.MIN_LINE_WORDS)
            & ~F.exists(known, lambda s: F.contains(s, x["norm"]) | F.contains(x["norm"], s))
        )

    return let(flagged, lambda known: F.transform(
        F.filter(lines, worth(known)),
        lambda x: F.struct(x["line"].alias("line"), x["norm"].alias("norm"),
                           looks_like_instruction(x["line"]).alias("instruction")),
    ))


@fixed_column
def _comparison_flags() -> Column:
    D = V.FLAG_DETAILS
    hidden_lines = F.filter("_scored", lambda x: ~x["seen"])
    instructions = F.transform(F.filter(hidden_lines, lambda x: x["instruction"]), lambda x: x["line"])
    benign = F.transform(F.filter(hidden_lines, lambda x: ~x["instruction"]), lambda x: x["line"])
    n_benign = F.size(benign)
    enough = (n_benign >= V.BENIGN_MIN_LINES) & (
        n_benign / F.greatest(F.size("_scored"), F.lit(1)) >= V.BENIGN_MIN_SHARE
    )
    seen = F.filter("_scored", lambda x: x["seen"] & x["instruction"])
    return F.concat(
        _one(F.size(instructions) > 0, _flag(
            "instruction_like_text", _SUSPICIOUS, "slide_text",
            truncate(F.array_join(instructions, " "), 220), D["hidden_instruction"], True)),
        _one(enough, _flag(
            "not_visible_in_render", _POTENTIAL, "slide_text", truncate(F.array_join(benign, " / "), 220),
            F.concat(n_benign.cast("string"), F.lit(D["benign"])), False)),
        F.transform(seen, lambda x: _flag(
            "visible_evaluator_address", "no_discrepancy_detected", "slide_text",
            truncate(x["line"], 220), D["visible_address"], False)),
    )


@fixed_column
def _unavailable_flags() -> Column:
    D = V.FLAG_DETAILS
    detail = F.concat(
        F.when(~F.col("rendered"), D["not_rendered"]).otherwise(D["not_read"]), F.lit(D["no_comparison"])
    )
    return F.array(_flag("visual_check_unavailable", "manual_review_required", "slide", "", detail, False))


@fixed_column
def _note_flags() -> Column:
    lines = F.filter(content_lines(F.col("speaker_notes")), looks_like_instruction)
    return F.transform(lines, lambda x: _flag(
        "speaker_note_instruction", _SUSPICIOUS, "speaker_notes", truncate(x, 220),
        V.FLAG_DETAILS["note_instruction"], True))


def flag_units(units: DataFrame) -> DataFrame:
    """units + flags: hidden slide, structural, comparison, notes — in that order.

    Needs hidden, signals, text, speaker_notes, ocr_text, ocr_status, rendered.
    """
    has_text = ~F.col("hidden") & (F.coalesce("text", F.lit("")) != "")
    compared = has_text & F.col("ocr_status").isin("completed", "empty") & F.col("rendered")
    unavailable = has_text & ~compared & ((F.col("ocr_status") == "failed") | ~F.col("rendered"))
    empty_lines = F.array().cast("array<struct<line:string,norm:string,instruction:boolean>>")
    staged = (
        units.withColumn("_lines", F.when(compared, _comparable_lines()).otherwise(empty_lines))
        .withColumn("_render", normalize(F.col("ocr_text")))
        .withColumn("_rest", F.when(
            F.col("_render") != "",
            let(F.array("_render"), lambda h: unsettled(F.transform("_lines", lambda x: x["norm"]), h)),
        ))
    )
    staged = staged.withColumn("_open", hopeful(F.col("_rest"), F.array("_render"), V.MATCH_THRESHOLD))
    scored = staged.withColumn(
        "_scores", score_maps([(F.col("_open"), F.array("_render"), V.MATCH_THRESHOLD)])[0]
    ).withColumn("_scored", F.transform("_lines", lambda x: F.struct(
        x["line"].alias("line"), x["instruction"].alias("instruction"),
        ((F.col("_render") != "") & (score_of(x["norm"], F.col("_rest"), F.col("_open"), F.col("_scores")) >= V.MATCH_THRESHOLD)).alias("seen"),
    )))
    comparison = (
        F.when(compared, _comparison_flags())
        .when(unavailable, _unavailable_flags())
        .otherwise(F.array().cast(f"array<{FLAG_TYPE}>"))
    )
    return scored.withColumn(
        "flags", F.concat(_hidden_flags(), _structural_flags(), comparison, _note_flags())
    ).drop("_lines", "_render", "_rest", "_open", "_scores", "_scored")


def flag_rows(flagged: DataFrame) -> DataFrame:
    """One row per flag; ``ord`` is its place inside the unit."""
    return flagged.select(*UNIT, F.posexplode("flags").alias("ord", "f")).select(*UNIT, "ord", "f.*")


def severity(status: Column) -> Column:
    return lookup(status, {k: str(v) for k, v in V.INTEGRITY_SEVERITY.items()}).cast("int")


def report(flags: DataFrame, submissions: DataFrame) -> DataFrame:
    """submission_id, status, summary.  submissions(submission_id, ocr_available).

    The pages named in the summary need at most four page numbers per status:
    the rest is a count.
    """
    keys = ["submission_id", "severity"]
    counted = flags.select("submission_id", severity(F.col("status")).alias("severity"), "page_number").distinct().select(
        *keys, "page_number", F.lit(1).cast("bigint").alias("n_pages"), F.array("page_number").alias("pages"))
    # count and first pages in one pass: by blocks of pages, so that no list holds more than a block gives
    for width in (1 << 8, 1 << 16, 1 << 31):
        counted = (
            counted.groupBy(*keys, F.floor(F.col("page_number") / width).alias("block"))
            .agg(F.min("page_number").alias("page_number"), F.sum("n_pages").alias("n_pages"),
                 F.slice(F.sort_array(F.flatten(F.collect_list("pages"))), F.lit(1), F.lit(4)).alias("pages"))
            .drop("block")
        )
    worst = counted.groupBy("submission_id").agg(F.max_by(F.struct("severity", "n_pages", "pages"), "severity").alias("w"))
    top = worst.select("submission_id", "w.*")
    level = F.greatest(
        F.coalesce("severity", F.lit(0)),
        F.when(F.col("ocr_available"), 0).otherwise(V.INTEGRITY_SEVERITY["manual_review_required"]),
    )
    own = F.col("severity") == F.col("level")
    listed = F.array_join(F.transform("pages", lambda p: F.concat(F.lit("Slide "), p.cast("string"))), ", ")
    where = (
        F.when(own & (F.col("n_pages") > 4), F.concat(F.col("n_pages").cast("string"), F.lit(" slides")))
        .when(own, listed)
        .otherwise(V.WHERE_FALLBACK)
    )
    S = V.REPORT_SUMMARIES
    status = lookup(F.col("level"), {v: k for k, v in V.INTEGRITY_SEVERITY.items()})
    summary = (
        F.when(F.col("level") == 0, S["no_discrepancy_detected"])
        .when(F.col("level") == 1, fill(S["potential_discrepancy"], where=where))
        .when(F.col("level") == 3, fill(S["suspicious_instruction_detected"], where=where))
        .when(~F.col("ocr_available"), S["no_ocr"])
        .otherwise(fill(S["manual_review_required"], where=where))
    )
    return (
        submissions.select("submission_id", "ocr_available")
        .join(top, "submission_id", "left")
        .withColumn("level", level)
        .select("submission_id", status.alias("status"), summary.alias("summary"))
    )
