import contextlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.operators import answers as A
from docketflow.operators import grounding as G
from docketflow.plans import catalog


@contextlib.contextmanager
def unset(spark, name):
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(name, before)


@pytest.mark.parametrize("rows", [0, 1, 3_000, 20_000])
def test_rows_of_one_file_are_dealt_to_tasks(spark, tmp_path, rows):
    spark.range(rows).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    with unset(spark, catalog.SPREAD):
        dealt = catalog.read_dealt(spark, str(tmp_path), "conversations")
        sizes = [r[1] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == rows and dealt.distinct().count() == rows
    assert max(sizes, default=0) <= catalog.ROWS_OF_A_TASK + 8
    assert len(sizes) >= min(8, rows // catalog.FEW_ROWS)


def test_the_setting_still_decides(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert catalog.read_dealt(spark, str(tmp_path), "conversations").rdd.getNumPartitions() == 4


def test_no_task_takes_in_more_than_a_batch_of_documents(spark, tmp_path, monkeypatch):
    sizes = []
    plain = A.call_model

    def counted(asked, *rest):
        sizes.extend(r[1] for r in asked.groupBy(F.spark_partition_id()).count().collect())
        return plain(asked, *rest)

    monkeypatch.setattr(A, "call_model", counted)
    spark.range(700).selectExpr("id AS submission_id", "concat('deck ', id) AS prompt").coalesce(1).write.parquet(f"{tmp_path}/prompts")
    contract = T.StructType([T.StructField("text", T.StringType(), False)])
    rows = A.ask(spark.read.parquet(f"{tmp_path}/prompts"), lambda prompt: '{"text": "seen"}', contract, "reader", A.AnswerStore(f"{tmp_path}/answers"))
    assert rows.filter("answer is not null").count() == 700
    assert sum(sizes) == 700 and max(sizes) <= A.BATCH + 8


def test_cited_slides_keep_the_tasks_of_a_shuffle(spark):
    views = spark.range(400).selectExpr(
        "id AS submission_id", "1 AS page_number", "'slide_01' AS slide_id", "concat('text number ', id) AS text", "'' AS notes", "'' AS image_text", "false AS withheld")
    refs = spark.range(400).selectExpr("id AS submission_id", "'o' AS owner", "0 AS ord", "'slide_01' AS slide_id", "concat('text number ', id) AS excerpt")
    seen = []
    plain = G.locate

    def counted(df, *rest):
        seen.append(len({r[0] for r in df.select(F.spark_partition_id()).distinct().collect()}))
        return plain(df, *rest)

    G.locate, kept = counted, G.locate
    try:
        found = G.ground_refs(refs, views)
    finally:
        G.locate = kept
    assert found.filter("via = 'text'").count() == 400
    assert seen == [4]
