import numpy as np
from helpers import documents, folder_of, written
from test_pii import base
from test_resemblance import brute_linked, brute_runs
from test_simhash import brute_classes

import corpus_pipeline
from docketflow.llm import decontaminate, pieces


def test_stages_on_the_test_data(spark, tmp_path):
    """Each stage against a plain computation on what the one before it kept."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    items = [decontaminate.plain_words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if number + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        docs = written(out, tmp_path, name)
        after = {r.doc_id: r for r in docs.collect()}
        gone = set(before) - set(after)
        if name == "quality":
            assert gone and all(labels.get(i) != 1 for i in gone) and all(labels.get(i) != 0 for i in after)
        elif name == "near_dedup":
            sets = {i: brute_runs(r.text) for i, r in before.items()}
            classes = brute_classes(sorted(before), lambda a, b: brute_linked(sets[a], sets[b]))
            assert gone and set(after) == set(classes.values())
        elif name == "decontaminate":
            leaks = {i for i, r in before.items() if any(b" ".join(w) in b" ".join(decontaminate.plain_words(r.text)) for w in items)}
            assert gone == leaks
        elif name == "mask_pii":
            assert not gone and not any(base(r.text) for r in after.values())
            assert all(r.text == before[i].text for i, r in after.items() if not base(before[i].text) and "token" not in before[i].text.lower())
        else:
            vocabulary = pieces.Pieces.load()
            assert not gone and all(pieces.joined(np.array(r.piece_ids), vocabulary) == r.text for r in after.values())
        before = after
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == set(before)


def test_odd_tables(spark, tmp_path):
    texts = ["some words to keep in the corpus", None, "", "some words to keep in the corpus", "mail a@b.com now and then"]
    tables = {
        "documents": documents(spark, texts, ids=[4, 5, 6, 4, None], clashing=True),
        "labels": spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([], "item_id long, text string"),
    }
    rows = corpus_pipeline.run(spark, folder_of(tmp_path, **tables)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows if r.text) == [(0, "mail [EMAIL] now and then"), (4, "some words to keep in the corpus")]
    assert sum(not r.text for r in rows) == 1
    tables["documents"] = tables["documents"].limit(0)
    assert corpus_pipeline.run(spark, folder_of(tmp_path / "none", **tables)).count() == 0
