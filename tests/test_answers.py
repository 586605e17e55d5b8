import json
from pathlib import Path

import pytest
from pyspark.sql import types as T

from docketflow.operators import answers as A
from docketflow.operators import plugins as P

CONTRACT = T.StructType([T.StructField("text", T.StringType(), False)])


def model(folder, broken=()):
    """A model that leaves a file for each question; some prompts make it fail."""
    folder = str(folder)

    def call(prompt):
        import uuid

        Path(folder, uuid.uuid4().hex).write_text(prompt)
        if prompt in broken:
            raise RuntimeError("model is down")
        return json.dumps({"text": prompt.upper()})

    return call


def prompts(spark, rows, tmp_path, name):
    path = f"{tmp_path}/{name}"
    spark.createDataFrame(rows, "submission_id long, prompt string").write.parquet(path)
    return spark.read.parquet(path)


def result(df):
    return {r.submission_id: (json.loads(r.answer)["text"] if r.answer else None, r.error) for r in df.collect()}


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return folder


def asked(calls):
    return sorted(p.read_text() for p in calls.iterdir())


def test_only_new_prompts_are_asked(spark, tmp_path, calls):
    store = A.AnswerStore(f"{tmp_path}/store")
    first = prompts(spark, [(1, "a"), (2, "b"), (3, "a")], tmp_path, "p1")
    assert result(A.ask(first, model(calls), CONTRACT, "s", store)) == {1: ("A", None), 2: ("B", None), 3: ("A", None)}
    assert asked(calls) == ["a", "b"]  # equal prompts once
    assert result(A.ask(first, model(calls), CONTRACT, "s", store)) == {1: ("A", None), 2: ("B", None), 3: ("A", None)}
    assert asked(calls) == ["a", "b"]
    second = prompts(spark, [(1, "a"), (2, "b2"), (4, "c")], tmp_path, "p2")
    assert result(A.ask(second, model(calls), CONTRACT, "s", store)) == {1: ("A", None), 2: ("B2", None), 4: ("C", None)}
    assert asked(calls) == ["a", "b", "b2", "c"]
    old = A.superseded(second, CONTRACT, "s", store).collect()
    assert [(r.submission_id, json.loads(r.answer)["text"]) for r in old] == [(2, "B")]
    other = T.StructType([*CONTRACT.fields, T.StructField("more", T.StringType(), True)])
    assert all(r.error for r in A.ask(first, model(calls), other, "s", store).collect())  # another contract is another question
    assert asked(calls).count("a") == 2
    A.ask(first, model(calls), CONTRACT, "t", store).collect()  # and so is another stage
    assert asked(calls).count("a") == 3


def test_failures_are_reported_and_asked_again(spark, tmp_path, calls):
    store = A.AnswerStore(f"{tmp_path}/store")
    rows = prompts(spark, [(1, "a"), (2, "b")], tmp_path, "p")
    got = result(A.ask(rows, model(calls, broken=("b",)), CONTRACT, "s", store))
    assert got == {1: ("A", None), 2: (None, "RuntimeError: model is down")}
    assert result(A.ask(rows, model(calls), CONTRACT, "s", store)) == {1: ("A", None), 2: ("B", None)}
    assert asked(calls) == ["a", "b", "b"]


def test_a_killed_run_resumes_behind_its_last_wave(spark, tmp_path, calls, monkeypatch):
    store = A.AnswerStore(f"{tmp_path}/store")
    names = [f"p{i}" for i in range(12)]
    rows = prompts(spark, list(enumerate(names)), tmp_path, "p")
    whole, done = P.call_model, []

    def dies(*args):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append(1)
        return whole(*args)

    with monkeypatch.context() as patch:
        patch.setattr(A, "call_model", dies)
        with pytest.raises(KeyboardInterrupt):
            A.ask(rows, model(calls), CONTRACT, "s", store, wave=3)
    before = asked(calls)
    assert 0 < len(before) < 12 and sorted(json.loads(r.answer)["text"].lower() for r in store.read(spark).collect()) == before
    got = result(A.ask(rows, model(calls), CONTRACT, "s", store, wave=3))
    assert got == {i: (n.upper(), None) for i, n in enumerate(names)} and asked(calls) == sorted(names)


def test_no_prompts(spark, tmp_path, calls):
    store = A.AnswerStore(f"{tmp_path}/store")
    rows = spark.createDataFrame([], "submission_id long, prompt string")
    assert A.ask(rows, model(calls), CONTRACT, "s", store).collect() == []
