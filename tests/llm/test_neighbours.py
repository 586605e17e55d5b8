import collections
import math

import numpy as np
from helpers import folder_of

from docketflow.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, row long, block int, id string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 0, 1, 2, "x") for i, v in zip(ids, vectors)], SCHEMA)


def brute(vectors, ids, query, k=10):
    q = np.array(vectors[query], dtype=np.float32).astype(float)
    found = [(math.dist(q, np.array(v, dtype=np.float32).astype(float)), ids[i]) for i, v in enumerate(vectors) if i != query]
    return sorted(found)[:k]


def test_recall_on_the_test_data(spark, queries):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    vectors, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    got = collections.defaultdict(list)
    for r in queries["op8_approximate_neighbours"](spark, folder).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    share = []
    for q, found in got.items():
        assert [x[0] for x in sorted(found)] == list(range(1, 11))
        distance = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        for _, i, s in found:
            assert abs(distance[ids == i][0] - s) < 1e-12
        distance[ids == q] = np.inf
        share.append(len({x[1] for x in found} & set(ids[np.argsort(distance)[:10]].tolist())) / 10)
    assert np.mean(share) >= 0.95


def test_odd_vectors_ties_and_repeats(spark, tmp_path, queries):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(30, 4)).round(2).tolist()
    vectors[3] = vectors[7] = vectors[0]
    good = [list(v) for v in vectors]
    odd = [None, [], [0.0] * 4, [1.0, None, 0.0, 1.0], [math.nan, 1.0, 1.0, 1.0], [math.inf, 1.0, 1.0, 1.0], [1.0, 2.0]]
    ids = [0, *range(1, 30)]
    folder = folder_of(tmp_path, embeddings=table(spark, good + odd, [*ids, 100, 200, 300, 400, 500, 600, 700]))
    rows = queries["op8_approximate_neighbours"](spark, folder).collect()
    assert {r.query_id for r in rows} == {0}
    found = [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"])]
    want = brute(good, ids, 0)
    assert [v for v, _ in found] == [i for _, i in want]
    assert np.allclose([s for _, s in found], [s for s, _ in want], atol=1e-12)
    repeated = queries["op8_approximate_neighbours"](spark, folder_of(tmp_path / "b", embeddings=table(spark, [good[0], good[0], good[1]], [0, 0, 5])))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in repeated.collect()) == [(0, 1, 0), (0, 1, 0), (0, 2, 5), (0, 2, 5)]


def test_empty_table(spark, tmp_path, queries):
    assert queries["op8_approximate_neighbours"](spark, folder_of(tmp_path, embeddings=table(spark, []))).count() == 0


def test_footrule_is_the_sum_over_asked_pivots():
    rng = np.random.default_rng(2)
    vectors, pivots, queries_ = rng.normal(size=(50, 5)), rng.normal(size=(20, 5)), rng.normal(size=(3, 5))
    files = neighbours.InvertedFiles(vectors, pivots, 8)
    orders = neighbours.nearest_pivots(vectors, pivots, 8)
    for order in neighbours.nearest_pivots(queries_, pivots, 6):
        place = [{p: i for i, p in enumerate(o)} for o in orders.tolist()]
        want = [sum(abs(at - mine.get(p, 8)) for at, p in enumerate(order.tolist())) for mine in place]
        assert files.footrule(order).tolist() == want
