"""A run with plugged-in stages reads its texts a fixed number of times, however many submissions it has."""

import json

import pytest
from pyspark.sql import types as T

from docketflow.operators import answers as A
from docketflow.operators import integrity as I
from docketflow.operators import view as VW
from docketflow.plans.all_queries import all_queries

CONTRACT = T.StructType([T.StructField("text", T.StringType(), False)])


@pytest.fixture
def decks(spark, tmp_path):
    said = [(c, t, "system" if t == 3 else "user", f"Line {t} of talk {c}.\nWe measured 40 clinics and cut waiting by 35%.") for c in range(1, 7) for t in range(4)]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.range(5).selectExpr("CAST(id AS INT) AS r_regionkey").coalesce(1).write.parquet(f"{tmp_path}/region.parquet")
    return str(tmp_path)


def test_units_are_flagged_and_seen_once(spark, decks, monkeypatch):
    calls = []
    for module, name in ((I, "flag_units"), (VW, "build_views")):
        plain = getattr(module, name)
        monkeypatch.setattr(module, name, lambda rows, plain=plain, name=name: calls.append(name) or plain(rows))
    rows = all_queries()["udf3_brief"](spark, decks)
    assert sorted(calls) == ["build_views", "flag_units"]
    # the assembly starts from stored flags and grounded findings: nothing is compared again
    assert "ArrowEvalPython" not in rows._jdf.queryExecution().toString()
    got = {r.submission_id: r for r in rows.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert all(r.overview == "A deck of 4 slides" and r.strengths == "s1,s3" for r in got.values())


def test_a_wave_reads_its_own_prompts(spark, tmp_path, monkeypatch):
    read = []
    plain = A.call_model

    def watched(asked, *rest):
        read.append(asked._jdf.queryExecution().toString())
        assert not set(asked.inputFiles()) & set(prompts.inputFiles())
        return plain(asked, *rest)

    monkeypatch.setattr(A, "call_model", watched)
    path = f"{tmp_path}/prompts"
    spark.range(40).selectExpr("id AS submission_id", "concat('deck ', id % 30) AS prompt").write.parquet(path)
    prompts, store = spark.read.parquet(path), A.AnswerStore(f"{tmp_path}/answers")
    said = A.ask(prompts, lambda prompt: json.dumps({"text": prompt}), CONTRACT, "reader", store, wave=10)
    got = {r.submission_id: json.loads(r.answer)["text"] for r in said.collect()}
    assert got == {i: f"deck {i % 30}" for i in range(40)}
    assert len(read) == 3 and all(f"= {number})]" in plan.split("PartitionFilters: [")[1].split(", ReadSchema")[0] for number, plan in enumerate(read))


def test_a_submission_with_two_prompts_gets_the_answer_of_each(spark, tmp_path):
    path = f"{tmp_path}/prompts"
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (None, "c")], "submission_id long, prompt string").write.parquet(path)
    store = A.AnswerStore(f"{tmp_path}/answers")
    said = A.ask(spark.read.parquet(path), lambda prompt: json.dumps({"text": prompt.upper()}), CONTRACT, "reader", store)
    got = sorted((str(r.submission_id), json.loads(r.answer)["text"] if r.answer else None) for r in said.collect())
    assert got == [("1", "A"), ("1", "B"), ("2", "B"), ("None", None)]
