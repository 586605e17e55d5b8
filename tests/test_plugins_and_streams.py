import json
from datetime import datetime as dt
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from docketflow import schemas as C
from docketflow.operators import plugins as P
from docketflow.operators.events import append_events
from docketflow.streaming import live


def test_parser_plugin_and_errors(spark):
    def parse(row):
        if row["content"] == b"bad":
            raise ValueError("damaged")
        return [{"page_number": i + 1, "text": t, "links": []} for i, t in enumerate(row["content"].decode().split("|"))]

    registry = P.Registry()
    registry.register(P.Plugin("parser", parse, ("pdf",)))
    with pytest.raises(LookupError):
        registry.find("parser", "pptx")
    with pytest.raises(ValueError):
        registry.register(P.Plugin("printer", parse))
    files = spark.createDataFrame([(1, "pdf", bytearray(b"a|b")), (2, "pdf", bytearray(b"bad"))],
                                  "submission_id long, file_type string, content binary")
    rows = P.parse_files(files, registry, ("pdf",)).collect()
    assert sorted((r.submission_id, r.page_number, r.text) for r in rows if not r.error) == [(1, 1, "a"), (1, 2, "b")]
    assert [r.error for r in rows if r.submission_id == 2] == ["ValueError: damaged"]


def test_stage_contract(spark):
    df = spark.createDataFrame([(1,)], "submission_id long")
    contract = C._struct(overview=C.S)
    ok = P.Stage("writer", lambda d: d.withColumn("overview", F.lit("x")), contract)
    assert P.run_stage(df, ok).first().overview == "x"
    with pytest.raises(ValueError):
        P.run_stage(df, P.Stage("writer", lambda d: d, contract))


GOOD = {"overview": "o", "strengths": [{"id": "s1", "text": "t", "evidence": [{"slide_id": "slide_01", "excerpt": "e"}]}], "verify_order": ["v1"]}


def test_model_stage_retries_once_then_fails(spark):
    def call(prompt):
        kind = prompt.split()[0]
        if kind == "boom":
            raise RuntimeError("no network")
        if kind == "good" or (kind == "second" and "broke its contract" in prompt):
            return json.dumps(GOOD)
        if kind in ("extra", "second"):
            return json.dumps(GOOD | {"verified": True})
        if "broke its contract" in prompt:
            return json.dumps(GOOD)  # never asked: text that is no JSON fails at once
        return "[1]" if kind == "list" else "not json"

    prompts = spark.createDataFrame([(1, "good x"), (2, "second x"), (3, "never x"), (4, "boom x"), (5, "extra x"), (6, "list x")], "submission_id long, prompt string")
    answers = P.call_model(prompts, call, C.BRIEF_WRITER, "brief_writer")
    got = {r.submission_id: r for r in P.decode_answers(answers, C.BRIEF_WRITER).collect()}
    assert got[1].value.overview == "o" and got[2].value.strengths[0].evidence[0].slide_id == "slide_01"
    assert got[5].answer is None and "schema validation" in got[5].error
    assert got[3].answer is None and "is not JSON" in got[3].error
    assert got[6].answer is None and "not a JSON object" in got[6].error
    assert "no network" in got[4].error


def test_contract_derivation():
    ref = C.model_contract(C.EVIDENCE_REF)
    assert ref.names == ["slide_id", "excerpt"] and not any(f.nullable for f in ref.fields)
    bad = {"items": [{"id": "v1", "title": "t", "description": "d", "type": "rumour", "severity": "high", "evidence": []}]}
    assert P.contract_problems(bad, C.model_contract(C.VERIFICATION)) == ["items.type: 'rumour' is not allowed"]


def test_rubric_answers_must_cover_all_criteria(spark):
    crit = "array<struct<criterion_id:int,score:double>>"
    decoded = spark.createDataFrame([(1, ([(1, 5.0), (2, 5.0), (9, 1.0)],), None), (2, ([(1, 5.0)],), None)],
                                    f"submission_id long, value struct<criteria:{crit}>, error string")
    known = spark.createDataFrame([(1, [1, 2]), (2, [1, 2])], "submission_id long, criterion_ids array<bigint>")
    got = {r.submission_id: r for r in P.check_criteria(decoded, known).collect()}
    assert [c.criterion_id for c in got[1].criteria] == [1, 2] and got[2].criteria is None and "[2]" in got[2].error


def test_prompt_rendering(spark):
    views = spark.createDataFrame(
        [(1, 2, "slide_02", "B", "two", "", "", ["http://x"]), (1, 1, "slide_01", "A & <b>", "one < 2", "note", "img", [])],
        "submission_id long, page_number int, slide_id string, title string, text string, notes string, image_text string, links array<string>")
    subs = spark.createDataFrame([(1, "T&T", "Deck", "pdf")], "submission_id long, team_name string, title string, file_type string")
    items = spark.createDataFrame([(1, 1, 1, 0, "reason <1>")], "submission_id long, part int, page_number int, ord int, reason string")
    text = P.render_submissions(views, subs, items, subs).first().document
    assert text.startswith('<submission team="T&amp;T" title="Deck" file_type="pdf" pages="2">\n<slide id="slide_01" page="1" title="A &amp; &lt;b&gt;">')
    assert text.index("slide_01") < text.index("slide_02") and "<links_not_followed>http://x" in text
    assert text.endswith("</submission>\n<not_processed>\n- reason &lt;1&gt;\n</not_processed>")
    rubric = spark.createDataFrame([(1, 2, 1, "B", None, 40.0), (1, 1, 0, "A", "d", 60.0)],
                                   "round_id long, criterion_id long, position int, name string, description string, weight double")
    row = P.render_rubric(rubric, spark.createDataFrame([(1, 10)], "id long, score_scale_max int")).first()
    assert json.loads(row.rubric_json)["criteria"][0]["weight_percent"] == 60.0 and row.criterion_ids == [1, 2]


SCHEMA = "id long, round_id long, submission_id long, actor_id long, action string, entity_type string, entity_id long, created_at timestamp"
T0 = dt(2024, 1, 1, 9, 0)


def log(spark, path):
    names = ["assignment.created", "review.opened", "evaluation.submitted", "evaluation.kept", "submission.uploaded", "submission.ingested"]
    rows = [(i, 1, 5, 3, a, "assignment", 8, T0 + timedelta(minutes=i)) for i, a in enumerate(names)]
    rows.append((50, 1, 5, 3, "review.opened", "assignment", 9, T0 + timedelta(hours=2)))
    append_events(spark.createDataFrame(rows, SCHEMA), path)
    return live.read_event_stream(spark, path, spark.createDataFrame([], SCHEMA).schema)


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    events = log(spark, str(tmp_path / "log"))
    status = {r.assignment_id: r.status for r in drain(live.current_status(events), "st", "complete")}
    assert status == {8: "completed", 9: "in_progress"}
    assert drain(live.submission_status(events), "sub", "complete")[0].last_action == "submission.ingested"
    counts = drain(live.activity_counts(events), "ac", "complete")
    assert sum(r.events for r in counts) == 7
    minutes = drain(live.review_durations(events), "du", "complete")
    assert [(r.assignment_id, r.review_minutes) for r in minutes] == [(8, 1.0)]
    sessions = drain(live.reviewer_sessions(events), "se", "complete")
    assert sorted(r.events for r in sessions) == [1, 6]


def test_review_of_any_length_and_first_opening(spark):
    rows = [
        (1, 1, 5, 3, "review.opened", "assignment", 8, T0), (2, 1, 5, 3, "review.opened", "assignment", 8, T0 + timedelta(days=3)),
        (3, 1, 5, 3, "evaluation.submitted", "assignment", 8, T0 + timedelta(days=30)),
        (4, 1, 5, 3, "evaluation.submitted", "assignment", 9, T0),
    ]
    got = live.review_durations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.assignment_id, r.review_minutes) for r in got] == [(8, 30 * 24 * 60.0)]


def arrivals(spark, folder, batches):
    """An event stream that gets one file per batch, one per trigger, in order."""
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)


def event(i, minutes, action="review.opened", of=8):
    return (i, 1, 5, 3, action, "assignment", of, T0 + timedelta(minutes=minutes))


def test_late_events_fall_behind_the_watermark(spark, tmp_path):
    batches = [[event(1, 0), event(2, 5)], [event(3, 300)], [event(4, 400)], [event(5, 1)], [event(6, 401)]]
    events = arrivals(spark, str(tmp_path / "late"), batches)
    rows = drain(live.activity_counts(events, late="1 hour"), "late", "append")
    first = [r for r in rows if r.window_start == T0]
    assert [r.events for r in first] == [2]  # the event of the fourth file came after its window was closed
    assert not [r for r in rows if r.window_start >= T0 + timedelta(minutes=400)]  # still open


def test_update_mode_sends_changes_only(spark, tmp_path):
    batches = [[event(1, 0), event(2, 1, of=9)], [event(3, 9, "evaluation.submitted")], [event(4, 5, "review.opened")]]
    events = arrivals(spark, str(tmp_path / "update"), batches)
    rows = drain(live.current_status(events), "upd", "update")
    assert sorted((r.assignment_id, r.status) for r in rows) == [
        (8, "in_progress"), (8, "submitted"), (8, "submitted"), (9, "in_progress")]


def test_incremental_intake(spark, tmp_path):
    inbox, known = tmp_path / "in", str(tmp_path / "known")
    inbox.mkdir()

    def describe(batch):
        return batch.withColumn("submission_id", F.regexp_extract("path", r"(\d+)\.pdf", 1).cast("long")).withColumn("round_id", F.lit(1))

    def arrive(**files):
        for name, body in files.items():
            (inbox / f"{name[1:]}.pdf").write_bytes(body)
        q = live.intake_batches(live.read_upload_stream(spark, str(inbox)), known, str(tmp_path / "ck"), describe).start()
        q.processAllAvailable()
        q.stop()

    arrive(f1=b"same", f2=b"other")
    arrive(f3=b"same", f4=b"new")
    got = {r.submission_id: r.duplicate_of for r in spark.read.parquet(f"{known}/marks").collect()}
    assert got == {1: None, 2: None, 3: 1, 4: None}
