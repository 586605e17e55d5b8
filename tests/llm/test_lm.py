import collections
import itertools
import math
import re
import zlib

import numpy as np
from helpers import documents, folder_of

from docketflow.llm import lm


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", low) + ["\n"]


def check_base(rows, texts):
    counts = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[t] > 0 for t in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own), rel_tol=1e-9)


def test_base_score_and_gain(spark, queries):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries["op3_lm_scoring"](spark, folder).collect()
    assert len(rows) == len(texts)
    check_base(rows, texts)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_texts(spark, tmp_path, queries):
    texts = [None, "", " \t\n", "A a b b c", "été É", "w " * 40_000, "A a b b c"] + [f"a b {i}" for i in range(25)]
    docs = documents(spark, texts, clashing=True)
    rows = queries["op3_lm_scoring"](spark, folder_of(tmp_path, documents=docs)).collect()
    check_base(rows, dict(enumerate(texts)))
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert lm.score_documents(docs.limit(0)).count() == 0
    repeated = documents(spark, ["a b", "a c", "a b"], ids=[3, 3, None])
    assert lm.score_documents(repeated).count() == 3


def test_model_is_a_distribution_over_short_texts():
    """Summed over all class sequences of a length, the forward recursion gives one."""
    rng = np.random.default_rng(3)
    model = lm.Model(lm._normal(rng.random(2), 0), lm._normal(rng.random((2, 2)), 1), lm._normal(rng.random((3, 2)), 0))
    texts = [np.array(t) for t in itertools.product(range(3), repeat=4)]
    chain = lm.Chains(np.array([4] * len(texts)))
    logs, _ = chain.forward(model.emit, np.concatenate(texts), model.start, model.move)
    assert math.isclose(np.exp(logs).sum(), 1.0, rel_tol=1e-9)


def test_baum_welch_never_lowers_the_likelihood(monkeypatch):
    rng = np.random.default_rng(9)
    texts = [rng.choice([1, 2, 3, 4] if i % 2 else [3, 4, 5, 6], size=30) for i in range(40)]
    model, before = lm.first_model(texts, 2), -math.inf
    for _ in range(6):
        chain = lm.Chains(np.array([30] * 40))
        now = chain.forward(model.emit, np.concatenate(texts), model.start, model.move)[0].sum()
        assert now >= before - 1e-3 * abs(now)
        before = now
        start, move, emit = lm.expected_counts(model, texts)
        model = lm.Model(lm._normal(start, 0), lm._normal(move, 1), lm._normal(emit + 1e-9, 0))
