import numpy as np
from helpers import documents, folder_of

from docketflow.llm import quality


def test_pairwise_term_is_all_pairs():
    rng = np.random.default_rng(0)
    width = 6
    m = quality.Machine(0.3, rng.normal(size=width), rng.normal(size=(width, 3)), np.zeros(0), np.ones(0))
    x = rng.normal(size=(4, width))
    for row, got in zip(x, m.logits(x)):
        pairs = sum(m.factors[i] @ m.factors[j] * row[i] * row[j] for i in range(width) for j in range(i))
        assert abs(0.3 + row @ m.weights + pairs - got) < 1e-9


def test_held_out_accuracy(spark, queries):
    folder = "/root/testdata/sf0.01"
    rows = queries["op6_quality_classifier"](spark, folder).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert held and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(labels[r.doc_id] == r.predicted for r in held) >= 0.95 * len(held)


def test_odd_tables(spark, tmp_path, queries):
    texts = ["fine words of prose here", None, "", "x" * 300_000, "bad | bad | bad", "fine words of prose here"]
    docs = documents(spark, texts, ids=[1, 2, 3, 4, 5, None], clashing=True)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (2, None, 0), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    rows = queries["op6_quality_classifier"](spark, folder_of(tmp_path, documents=docs, labels=labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_labels_do_not_leak(spark):
    """A held-out row's label changes no score."""
    docs = documents(spark, [f"good prose number {i}" if i % 2 else f"{i} | {i} | {i}" for i in range(40)])
    label = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and i in held)) for i in range(40)], "doc_id long, quality int")
    held = {r.doc_id for r in quality.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int")).collect() if r.held_out}
    assert held
    scores = [sorted((r.doc_id, r.score) for r in quality.quality_scores(docs, label(f)).collect()) for f in (False, True)]
    assert scores[0] == scores[1]


def test_one_row_for_each_chosen_label(spark, monkeypatch):
    """An id that holds most of the rows does not push the other labels out of the sample."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda stats, shares, y: seen.append(y))
    ids = [*range(40), *range(1000, 1001), *[7] * 500]
    docs = documents(spark, [f"text of {i}" for i in ids], ids=ids)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(7, 1)] * 100, "doc_id long, quality int")
    quality.learn(docs, labels, sample_rows=40)
    assert len(seen[0]) == 40 and sum(seen[0]) == 20
