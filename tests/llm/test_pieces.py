import collections
import math

import numpy as np
import pytest
from helpers import documents, folder_of

from docketflow.llm import pieces as p
from docketflow.llm.common import splitmix

ODD = ["", "a", "é日本▁x\t y   z \n\n  ", "   ", "\n", "the " * 500, "x" * 30_000, None, "▁▁", "🎉 emoji", "a b", "�", "a\x00b"]


@pytest.fixture(scope="module")
def vocabulary():
    return p.Pieces.load()


def test_round_trip(vocabulary):
    ids = p.segment(ODD, np.arange(len(ODD), dtype=np.uint64), p.Lattices(vocabulary))
    assert [p.joined(i, vocabulary) for i in ids] == [t or "" for t in ODD]


def test_draws_follow_the_key_only(vocabulary):
    texts = [f"there were {i} of them here" for i in range(30)]
    keys = splitmix(np.arange(30, dtype=np.uint64))
    known = p.Lattices(vocabulary)
    together = p.segment(texts, keys, known)
    for i in (0, 7, 29):
        for lattices in (known, p.Lattices(vocabulary)):
            assert (p.segment(texts[i : i + 1], keys[i : i + 1], lattices)[0] == together[i]).all()
    same = p.segment(["there were many of them here"] * 40, splitmix(np.arange(40, dtype=np.uint64)), known)
    assert len({tuple(s) for s in same}) > 3


def test_sampled_paths_follow_their_weight(vocabulary):
    word, number = " here", {t: i for i, t in enumerate(vocabulary.texts) if i >= vocabulary.first}

    def paths(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            if rest[:k] in number:
                for more in paths(rest[k:]):
                    yield (number[rest[:k]], *more)

    weight = {q: math.exp(sum(vocabulary.weights[i] for i in q)) for q in paths(word.encode())}
    n = 50_000
    lattices = p.Lattices(vocabulary)
    ids, counts = lattices.sample(lattices.places([word] * n), splitmix(np.arange(n, dtype=np.uint64)))
    seen = collections.Counter(tuple(x) for x in np.split(ids, np.cumsum(counts)[:-1]))
    assert set(seen) <= set(weight)
    for q, w in weight.items():
        assert abs(seen[q] / n - w / sum(weight.values())) < 0.01


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    texts = [f"some words number {i} été 日本" for i in range(60)]
    keys = splitmix(np.arange(60, dtype=np.uint64))
    want = p.segment(texts, keys, p.Lattices(vocabulary))
    monkeypatch.setattr(p, "MOST_NODES", 40)
    monkeypatch.setattr(p, "WORDS_AT_ONCE", 3)
    lattices = p.Lattices(vocabulary)
    got = [p.segment([t], keys[i : i + 1], lattices)[0] for i, t in enumerate(texts)]
    assert all((a == b).all() for a, b in zip(want, got))


def test_query_is_lossless(spark, tmp_path, queries):
    docs = documents(spark, [*ODD, "a"], ids=[*range(len(ODD)), 1], clashing=True)
    rows = queries["op2_sentencepiece"](spark, folder_of(tmp_path, documents=docs)).collect()
    assert len(rows) == len(ODD) + 1 and all(r.lossless and r.n_pieces == len(r.piece_ids) for r in rows)
    assert len({tuple(r.piece_ids) for r in rows if r.doc_id == 1}) == 1
    assert p.encode_documents(docs.limit(0)).count() == 0


def test_pieces_and_plain_bytes_of_the_test_data(spark, queries):
    rows = queries["op2_sentencepiece"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.lossless for r in rows)


def test_decode_and_the_stage(spark):
    """Ids decode to their text, null and empty lists to the empty text; the pipeline's stage says so."""
    import corpus_pipeline

    texts = ["some words, été", None, "", " two  spaces ", "\n", "word " * 50_000, "漢字 🎈"]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in corpus_pipeline.to_pieces(spark, docs, "").collect()}
    assert [rows[i].lossless for i in range(len(texts))] == [True] * len(texts)
    vocabulary = p.Pieces.load()
    lists = spark.createDataFrame([(i, r.piece_ids) for i, r in rows.items()] + [(-1, None), (-2, [])], "i long, ids array<int>")
    got = {r.i: r.t for r in lists.select("i", p.decode(lists.ids, vocabulary).alias("t")).collect()}
    assert got == {**{i: t or "" for i, t in enumerate(texts)}, -1: "", -2: ""}
