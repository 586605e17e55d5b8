import csv
import io
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from docketflow.plans.all_queries import all_queries
from docketflow.plans.review_entities import entity
from docketflow.operators import reporting as R
from docketflow.operators.visibility import attach_signals
from docketflow.schemas import CONTRACTS
from docketflow.sources import files as FI
from docketflow.sources import sinks
from docketflow.sources import units as UN
from docketflow import fixed_values as V


def archive(*names):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return buffer.getvalue()


def test_files_from_disk(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 hello")
    (tmp_path / "b.pptx").write_bytes(archive("[Content_Types].xml", "ppt/slides/slide1.xml"))
    (tmp_path / "c.pptx").write_bytes(archive("word/document.xml", "[Content_Types].xml"))
    (tmp_path / "d.pptx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "e.pdf").write_bytes(b"")
    uploads = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in ("a.pdf", "b.pptx", "c.pptx", "d.pptx", "e.pdf")], "path string")
    read = FI.with_content(uploads, FI.read_files(spark, str(tmp_path)))
    typed = FI.file_digests(FI.sniff_file_type(read)).withColumn("original_filename", FI.base_name(F.col("path")))
    got = {r.original_filename: r for r in typed.collect()}
    assert {k: r.file_type for k, r in got.items()} == {"a.pdf": "pdf", "b.pptx": "pptx", "c.pptx": None, "d.pptx": None, "e.pdf": None}
    assert got["a.pdf"].size_bytes == 14 and len(got["a.pdf"].sha256) == 64
    rounds = spark.createDataFrame([(1, 25, ["pdf", "pptx"])], "id long, max_file_size_mb int, allowed_file_types array<string>")
    checked = FI.validate_files(typed.withColumn("round_id", F.lit(1)), rounds)
    reasons = {r.original_filename: r.reject_reason for r in checked.collect()}
    assert reasons["a.pdf"] is None and reasons["e.pdf"] == "File is empty." and reasons["c.pptx"].startswith("Unsupported")


def test_title_fold_depends_on_order(spark):
    rows = [(1, 1, 0, "small", 10.0), (1, 1, 1, "bit larger", 10.4), (1, 1, 2, "largest", 10.8), (1, 2, 0, " ", 30.0), (1, 2, 1, "only", 5.0)]
    df = spark.createDataFrame(rows, "submission_id long, page_number int, ord int, text string, size double")
    assert {r.page_number: r.title for r in UN.titles_by_size(df).collect()} == {1: "largest", 2: "only"}


def test_reading_order(spark):
    rows = [(1, 1, 0, 50.0, 9.0, "right"), (1, 1, 1, 5.0, 5.0, "left"), (1, 1, 2, 0.0, 45.0, "below"), (1, 1, 3, 0.0, 0.0, "  ")]
    df = spark.createDataFrame(rows, "submission_id long, page_number int, ord int, x double, y double, text string")
    assert UN.reading_order(df).first().raw_text == "left\nright\nbelow"


def test_shift_csv(spark, folder, tmp_path):
    names = ["submissions", "assignments", "evaluations", "reveals", "revisions", "users"]
    data = R.shift_dataset(*[entity(spark, folder, n) for n in names])
    sinks.write_shift_csv(data, str(tmp_path / "out"))
    sinks.write_shift_parquet(data, str(tmp_path / "pq"))
    rows = [r for p in (tmp_path / "out").glob("*.csv") for r in csv.DictReader(p.open())]
    assert len(rows) == data.count() == spark.read.parquet(str(tmp_path / "pq")).count()
    assert list(rows[0]) == V.SHIFT_COLUMNS
    assert any(r["ai_score"] == "" for r in rows) and rows[0]["opened_at"].endswith(("Z", "+00:00"))


def test_units_are_replaced_in_their_buckets(spark, tmp_path):
    path = str(tmp_path / "units")
    base = spark.createDataFrame([(s, p, "old") for s in range(6) for p in (1, 2)], "submission_id long, page_number int, text string")
    sinks.write_units(base, path, buckets=4)
    fresh = spark.createDataFrame([(2, 1, "new")], "submission_id long, page_number int, text string")
    for _ in range(2):
        stored = spark.read.parquet(path)
        touched = stored.join(
            fresh.select(F.pmod(F.xxhash64("submission_id"), F.lit(4)).alias("bucket")).distinct(), "bucket", "left_semi").drop("bucket")
        sinks.write_units(UN.replace_units(touched.checkpoint() if spark.sparkContext.getCheckpointDir() else touched.cache(), fresh), path, buckets=4)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 11 and [r.text for r in rows if r.submission_id == 2] == ["new"]


def test_schema_and_json_sinks(spark, folder, tmp_path):
    sinks.export_schemas(CONTRACTS, str(tmp_path / "schemas"), spark)
    assert spark.read.json(str(tmp_path / "schemas")).count() == len(CONTRACTS) == 7
    docs = spark.createDataFrame([(1, "x")], "submission_id long, t string").select("submission_id", F.struct("t").alias("pack"))
    sinks.write_json_documents(docs, "pack", str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().submission_id == 1


def test_attach_signals(spark):
    units = spark.createDataFrame([(1, 1), (1, 2)], "submission_id long, page_number int")
    signals = spark.createDataFrame([(1, 1, 1, "b", "tiny_text", "d"), (1, 1, 0, "a", "tiny_text", "d")],
                                    "submission_id long, page_number int, ord int, text string, reason string, detail string")
    got = {r.page_number: [s.text for s in r.signals] for r in attach_signals(units, signals).collect()}
    assert got == {1: ["a", "b"], 2: []}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(all_queries()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_part():
    root = Path(__file__).resolve().parents[1]
    for path in [*root.glob("docketflow/**/*.py"), *root.glob("*.py"), *root.glob("tests/*.py")]:
        if "llm" in path.parts or path.name in ("corpus_pipeline.py", "__spark_entry__.py"):
            continue
        assert "import corpus_pipeline" not in path.read_text().replace('"import corpus_pipeline"', "")
        assert "docketflow.llm" not in path.read_text().replace('"docketflow.llm"', "")


def test_hidden_note(spark):
    df = spark.createDataFrame([(True, ["a"]), (False, ["b"])], "hidden boolean, processing_notes array<string>")
    got = {r.hidden: r.processing_notes for r in UN.with_hidden_notes(df).collect()}
    assert got == {True: ["a", V.HIDDEN_SLIDE_NOTE], False: ["b"]}


def test_round_limit_is_taken_as_it_is(spark):
    units = spark.range(400).selectExpr("1L submission_id").unionByName(spark.range(401).selectExpr("2L submission_id"))
    subs = spark.createDataFrame([(1, 1), (2, 1)], "id long, round_id long")
    rounds = spark.createDataFrame([(1, 400)], "id long, max_pages int")
    got = {r.submission_id: r.reject_reason for r in FI.check_page_limit(units, subs, rounds).collect()}
    assert got[1] is None and "at most 400" in got[2]


def test_archives_by_their_directory(spark):
    import struct

    good = archive("[Content_Types].xml", "ppt/a.xml")
    remark = io.BytesIO(good)
    with zipfile.ZipFile(remark, "a") as z:
        z.comment = b"PK\x05\x06 a remark that holds the mark of the end record"
    bodies = {
        "deck": good, "deck_with_many_parts": archive(*[f"x{i}" for i in range(3000)], "ppt/b", "[Content_Types].xml"),
        "deck_after_other_bytes": b"PK\x03\x04" + b"." * 99 + good, "letter": archive("[Content_Types].xml", "word/ppt/a.xml"),
        "names_in_content": archive("a.txt") + b"ppt/ [Content_Types].xml", "empty_archive": b"PK\x05\x06" + bytes(18),
        "cut": good[:-22], "start_only": b"PK\x03\x04", "wrong_length": good[:-10] + struct.pack("<I", 1 << 31) + good[-6:],
    }
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in bodies.items()], "name string, content binary")
    got = {r.name for r in FI.sniff_file_type(files).collect() if r.file_type == "pptx"}
    assert got == {"deck", "deck_with_many_parts", "deck_after_other_bytes"}


def test_written_schemas_read_back(spark, tmp_path):
    import json

    from pyspark.sql import types as T

    sinks.export_schemas(CONTRACTS, str(tmp_path / "s"), spark)
    got = {r.name: T.StructType.fromJson(json.loads(r.schema)) for r in spark.read.json(str(tmp_path / "s")).collect()}
    assert got == CONTRACTS
