"""User-supplied functions: parsers, renderers, recognizers and model-backed stages.

Spark partitions the work and calls the user's function on batches; every
function has a fixed input and output schema, and an error of one item becomes a
row, never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.schemas import ALLOWED, model_contract

PARSED_SCHEMA = (
    "submission_id bigint, page_number int, title string, text string, speaker_notes string, hidden boolean, "
    "has_visual_content boolean, has_embedded_media boolean, links array<string>, processing_notes array<string>, "
    "signals array<struct<ord:int,text:string,reason:string,detail:string>>, error string"
)
RENDERED_SCHEMA = "submission_id bigint, n_pages int, failed_pages map<int,string>, error string"
RECOGNIZED_SCHEMA = "submission_id bigint, page_number int, raw_text string, ocr_failed boolean"
VALIDATED_SCHEMA = "submission_id bigint, file_type string, reject_reason string"


@dataclass(frozen=True)
class Plugin:
    """``run`` maps one input row (a dict) to output rows (dicts)."""

    kind: str
    run: Callable[[dict], list[dict]]
    file_types: tuple[str, ...] = ()


_KINDS = {
    "validator": VALIDATED_SCHEMA,
    "parser": PARSED_SCHEMA,
    "renderer": RENDERED_SCHEMA,
    "recognizer": RECOGNIZED_SCHEMA,
}


class Registry:
    """Plugins by kind; parsers also by file type."""

    def __init__(self) -> None:
        self._plugins: list[Plugin] = []

    def register(self, plugin: Plugin) -> None:
        if plugin.kind not in _KINDS:
            raise ValueError(f"unknown kind {plugin.kind}")
        self._plugins.append(plugin)

    def find(self, kind: str, file_type: str | None = None) -> Plugin:
        for plugin in self._plugins:
            if plugin.kind == kind and (file_type is None or file_type in plugin.file_types):
                return plugin
        raise LookupError(f"No {kind} registered for .{file_type}" if file_type else f"No {kind} registered")


def apply_plugin(rows: DataFrame, plugin: Plugin) -> DataFrame:
    """Run a plugin over ``rows``; an exception becomes an output row that says so."""
    schema = _KINDS[plugin.kind]
    names = [part.split()[0] for part in _top_level(schema)]
    run = plugin.run

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    found = run(row)
                except Exception as problem:
                    failure = f"{type(problem).__name__}: {problem}"
                    found = [{"error": failure, "reject_reason": failure, "ocr_failed": True,
                              "page_number": row.get("page_number", 0)}]
                out += [{"submission_id": row["submission_id"], **item} for item in found]
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda x: x.notna(), None) if out else (
                pd.DataFrame(columns=names))

    return rows.mapInPandas(batches, schema)


def _top_level(ddl: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(ddl[start:i].strip())
            start = i + 1
    return parts + [ddl[start:].strip()]


def parse_files(files: DataFrame, registry: Registry, file_types: tuple[str, ...] = ("pdf", "pptx")) -> DataFrame:
    """files(submission_id, file_type, content) → parsed units (or an error row) per file."""
    parts = []
    for kind in file_types:
        subset = files.filter(F.col("file_type") == kind)
        parts.append(apply_plugin(subset, registry.find("parser", kind)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- stages ----------------------------------------------------------------

@dataclass(frozen=True)
class Stage:
    """A replaceable analysis stage: DataFrame in, DataFrame with ``contract`` columns out."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    contract: T.StructType


def run_stage(state: DataFrame, stage: Stage) -> DataFrame:
    """Apply a stage and check that it kept its contract."""
    out = state.transform(stage.run)
    have = {f.name: f.dataType for f in out.schema.fields}
    for field in stage.contract.fields:
        if field.name not in have:
            raise ValueError(f"{stage.name}: column {field.name} is missing")
        if have[field.name].simpleString() != field.dataType.simpleString():
            raise ValueError(f"{stage.name}: column {field.name} has type {have[field.name].simpleString()}")
    return out


# --- model-backed stages ---------------------------------------------------

def escape_markup(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def render_submissions(
    views: DataFrame, submissions: DataFrame, items: DataFrame, accepted: DataFrame
) -> DataFrame:
    """submission_id, document: the marked-up text a model gets.

    Only submissions within their round's page limit (``accepted``) are rendered,
    as only those are analysed; each is one bounded document.
    """
    e = escape_markup

    def block(tag: str, column: str) -> Column:
        body = F.concat(F.lit(f"<{tag}>\n"), e(F.col(column)), F.lit(f"\n</{tag}>"))
        return F.when(F.coalesce(F.col(column), F.lit("")) != "", body)

    head = F.concat(
        F.lit('<slide id="'), F.col("slide_id"), F.lit('" page="'), F.col("page_number").cast("string"), F.lit('"'),
        F.when(F.col("title") != "", F.concat(F.lit(' title="'), e(F.col("title")), F.lit('"'))).otherwise(""),
        F.lit(">"),
    )
    links = F.when(
        F.size("links") > 0,
        F.concat(F.lit("<links_not_followed>"), e(F.array_join("links", ", ")), F.lit("</links_not_followed>")),
    )
    text = F.concat(F.lit("<text>\n"), e(F.col("text")), F.lit("\n</text>"))
    slide = F.concat_ws(
        "\n", head, text, block("speaker_notes", "notes"), block("image_text_ocr", "image_text"), links, F.lit("</slide>")
    )
    keep = accepted.select("submission_id")
    slides = (
        views.join(keep, "submission_id", "left_semi")
        .select("submission_id", "page_number", slide.alias("slide"))
        .groupBy("submission_id")
        .agg(F.sort_array(F.collect_list(F.struct("page_number", "slide"))).alias("s"), F.count("*").alias("pages"))
    )
    open_items = (
        items.join(keep, "submission_id", "left_semi")
        .groupBy("submission_id")
        .agg(F.sort_array(F.collect_list(F.struct("part", "page_number", "ord", "reason"))).alias("n"))
    )
    start = F.concat(
        F.lit('<submission team="'), e(F.col("team_name")), F.lit('" title="'), e(F.col("title")),
        F.lit('" file_type="'), F.col("file_type"), F.lit('" pages="'), F.col("pages").cast("string"), F.lit('">'),
    )
    listed = F.when(
        F.size("n") > 0,
        F.concat(F.lit("<not_processed>\n"),
                 F.array_join(F.transform("n", lambda i: F.concat(F.lit("- "), e(i["reason"]))), "\n"),
                 F.lit("\n</not_processed>")),
    )
    document = F.concat_ws(
        "\n", start, F.array_join(F.transform("s", lambda x: x["slide"]), "\n"), F.lit("</submission>"), listed
    )
    return (
        submissions.join(slides, "submission_id")
        .join(open_items, "submission_id", "left")
        .select("submission_id", document.alias("document"))
    )


def render_rubric(rubric: DataFrame, rounds: DataFrame) -> DataFrame:
    """round_id, rubric_json, criterion_ids."""
    row = F.struct(
        "position", "criterion_id", "name", F.coalesce("description", F.lit("")).alias("description"),
        F.col("weight").alias("weight_percent"),
    )
    rows = rubric.groupBy("round_id").agg(F.sort_array(F.collect_list(row)).alias("c"))
    scale = rounds.select(F.col("id").alias("round_id"), F.concat(
        F.lit("1-"), F.col("score_scale_max").cast("string")).alias("score_scale"))
    bare = F.transform("c", lambda c: F.struct(*[
        c[n].alias(n) for n in ("criterion_id", "name", "description", "weight_percent")]))
    return rows.join(scale, "round_id").select(
        "round_id", F.to_json(F.struct("score_scale", bare.alias("criteria"))).alias("rubric_json"),
        F.transform("c", lambda c: c["criterion_id"].cast("bigint")).alias("criterion_ids"),
    )


def contract_problems(value, schema: T.DataType, path: str = "") -> list[str]:
    """Where a decoded answer breaks its contract; objects are closed."""
    here = path or "answer"
    if isinstance(schema, T.StructType):
        if not isinstance(value, dict):
            return [f"{here}: not an object"]
        found = [f"{here}: unexpected field {k}" for k in value if k not in schema.names]
        for field in schema.fields:
            if value.get(field.name) is None:
                if not field.nullable:
                    found.append(f"{here}: {field.name} is required")
                continue
            found += contract_problems(value[field.name], field.dataType, f"{path}.{field.name}" if path else field.name)
        return found
    if isinstance(schema, T.ArrayType):
        if not isinstance(value, list):
            return [f"{here}: not a list"]
        return [p for item in value for p in contract_problems(item, schema.elementType, path)]
    expected = {"string": str, "boolean": bool, "integer": int, "long": int, "double": (int, float)}[schema.typeName()]
    if not isinstance(value, expected) or (isinstance(value, bool) and schema.typeName() != "boolean"):
        return [f"{here}: expected {schema.typeName()}"]
    closed = ALLOWED.get(tuple(path.split(".")[-2:]))
    return [f"{here}: {value!r} is not allowed"] if closed and value not in closed else []


def call_model(
    prompts: DataFrame, call: Callable[[str], str], contract: T.StructType, stage: str, keys: str = "submission_id bigint"
) -> DataFrame:
    """prompts(submission_id, prompt) → submission_id, answer (JSON), error.

    ``call`` turns a prompt into the model's JSON text.  An object that breaks
    the contract is asked for once more with the problems named.  After that,
    for text that is no JSON object, and on any exception, the submission has an
    error and no answer.  ``keys`` names other columns of ``prompts`` that go with the answer.
    """
    shape = model_contract(contract)
    names = [part.split()[0] for part in _top_level(keys)]

    def attempt(prompt: str) -> tuple[str | None, list[str]]:
        value = json.loads(call(prompt))
        if not isinstance(value, dict):
            raise TypeError("the answer is not a JSON object")
        problems = contract_problems(value, shape)
        return (None, problems) if problems else (json.dumps(value, ensure_ascii=False), [])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for *key, prompt in zip(*[frame[n] for n in names], frame["prompt"]):
                try:
                    answer, problems = attempt(prompt)
                    if problems:
                        listed = "".join(f"\n* {p}" for p in problems[:5])
                        answer, problems = attempt(f"{prompt}\n\nThe last answer broke its contract:{listed}\nAnswer again in full.")
                    error = f"{stage}: model output failed schema validation" if problems else None
                except json.JSONDecodeError:
                    answer, error = None, f"{stage}: model output is not JSON"
                except Exception as problem:
                    answer, error = None, f"{type(problem).__name__}: {problem}"
                out.append((*key, answer, error))
            yield pd.DataFrame(out, columns=[*names, "answer", "error"])

    return prompts.select(*names, "prompt").mapInPandas(batches, f"{keys}, answer string, error string")


def decode_answers(answers: DataFrame, contract: T.StructType) -> DataFrame:
    """Answers as columns of the contract; rows with an error keep null."""
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in model_contract(contract).fields])
    return answers.withColumn("value", F.from_json("answer", nullable))


def check_criteria(decoded: DataFrame, known: DataFrame) -> DataFrame:
    """Rubric answers: unknown criteria dropped; missing ones fail the submission.

    known(submission_id, criterion_ids array<bigint>)
    """
    kept = F.filter(
        F.col("value.criteria"), lambda c: F.array_contains("criterion_ids", c["criterion_id"].cast("bigint"))
    )
    missing = F.array_except(
        "criterion_ids", F.transform("criteria", lambda c: c["criterion_id"].cast("bigint"))
    )
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(
        F.size(missing) > 0,
        F.concat(
            F.lit("rubric_analyzer: no assessment returned for criteria ["),
            F.array_join(F.transform(F.sort_array(missing), lambda m: m.cast("string")), ", "), F.lit("]"),
        ),
    )
    return (
        decoded.join(known, "submission_id")
        .withColumn("criteria", kept)
        .withColumn("error", error)
        .select("submission_id", F.when(F.col("error").isNull(), F.col("criteria")).alias("criteria"), "error")
    )

