import itertools

import numpy as np
from helpers import documents, folder_of

from docketflow.llm import language
from docketflow.llm.chains import Chains

EN = "the and of to in is it that was for on are with this from they have been were their".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()


def sample(n, rng, words):
    return " ".join(rng.choice(words, size=n))


def test_posteriors_against_enumeration():
    rng = np.random.default_rng(4)
    emit, move, start = rng.random((7, 3)), rng.random((3, 3)), rng.random(3)
    lengths = [4, 1, 0, 5, 4]
    symbols = rng.integers(0, 7, sum(lengths))
    chain = Chains(np.array(lengths))
    logs, kept = chain.forward(emit, symbols, start, move)
    moves = chain.smooth(move, kept, moves=True)
    kept = chain.in_order(kept)
    want_moves, at = np.zeros((3, 3)), 0
    for i, n in enumerate(lengths):
        total, state = 0.0, np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            w = 1.0
            for t, s in enumerate(path):
                w *= (start[s] if t == 0 else move[path[t - 1], s]) * emit[symbols[at + t], s]
            total += w
            for t, s in enumerate(path):
                state[t, s] += w
        for t in range(1, n):
            for a, b in itertools.product(range(3), repeat=2):
                part = sum(
                    np.prod([(start[s] if u == 0 else move[p[u - 1], s]) * emit[symbols[at + u], s] for u, s in enumerate(p)])
                    for p in itertools.product(range(3), repeat=n) if p[t - 1] == a and p[t] == b)
                want_moves[a, b] += part / total
        if n:
            assert np.isclose(logs[i], np.log(total)) and np.allclose(kept[at : at + n], state / total)
        else:
            assert logs[i] == 0
        at += n
    assert np.allclose(moves, want_moves)
    assert np.allclose(chain.sums(kept)[2], 0)


def test_held_out_accuracy(spark, queries):
    folder = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries["op10_language_id"](spark, folder).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and held and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def test_words_of_switched_text():
    rng = np.random.default_rng(6)
    windows = [(lang, sample(40, rng, words).split()) for lang, words in (("en", EN), ("de", DE)) for _ in range(60)]
    field = language.fit(windows)
    text = sample(15, rng, EN).split() + sample(15, rng, DE).split()
    _, _, chance = field.word_chances([text])
    labels = [field.languages[i] for i in chance.argmax(axis=1)]
    truth = ["en"] * 15 + ["de"] * 15
    both = set(EN) & set(DE)
    own = [a == b for a, b, w in zip(labels, truth, text) if w not in both]
    assert sum(own) >= 0.9 * len(own)


def test_odd_tables(spark, tmp_path, queries):
    rng = np.random.default_rng(8)
    texts = [sample(30, rng, EN if i % 2 else DE) for i in range(40)] + [None, "", "123 !! 4", "the " * 60_000, "x" * 50_000, "²"]
    langs = ["en" if i % 2 else "de" for i in range(40)] + ["en", None, "en", None, None, None]
    docs = documents(spark, texts, langs=langs, clashing=True)
    rows = {r.doc_id: r for r in queries["op10_language_id"](spark, folder_of(tmp_path, documents=docs)).collect()}
    assert len(rows) == 46
    assert all(rows[i].lang_pred == langs[i] for i in range(40))
    assert [(rows[i].lang_pred, rows[i].score) for i in (40, 41, 42, 45)] == [("und", 0.0)] * 4
    assert rows[43].lang_pred == "en" and rows[44].lang_pred in ("en", "de")
    unknown = language.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in unknown} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def test_every_language_is_learned_from(spark, monkeypatch):
    """Neither many languages nor an id with most of the rows keeps a language out of the sample."""
    seen = []
    monkeypatch.setattr(language, "SAMPLE_TOTAL", 300)
    monkeypatch.setattr(language, "fit", seen.extend)
    langs = [f"l{i % 20:02}" for i in range(400)] + ["rare"] * 3 + ["l00"] * 800
    texts = [f"{name} word " * 200 for name in langs]
    docs = documents(spark, texts, langs=langs, ids=[*range(403), *[7777] * 800])
    language.learn(docs)
    counts = {name: sum(x == name for x, _ in seen) for name in set(langs)}
    assert len(seen) == 300 and min(counts.values()) >= 14 and max(counts.values()) <= 15
    assert all(set(own) <= {"word", "rare", "l"} for _, own in seen)
