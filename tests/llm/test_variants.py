import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents, folder_of

from docketflow.llm import variants


def plain_words(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_force(docs):
    """Every pair of words compared."""
    words = plain_words(docs)
    rows = {}
    for w, n in words.items():
        others = [(-words[v], v) for v in words if near(w, v)]
        best = min(others, default=None)
        formed = best is not None and -best[0] >= 10 * n
        rows[w] = [n, len(others), best[1] if formed else None, -best[0] if formed else None]
    out = set()
    for w, (n, n_near, form, form_n) in rows.items():
        root = w
        while rows[root][2] is not None:
            root = rows[root][2]
        out.add((w, n, n_near, form, form_n, root))
    return out


def rows_of(df):
    found = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def edited(rng, word):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abzéÿ×") + word[i:], word[:i] + rng.choice("abzé") + word[i + 1 :]])


def corpus(rng):
    bases = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(6, 12))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaab", "Ünlöckétt"]
    words = []
    for b in bases:
        first, second, third = edited(rng, b), edited(rng, b), None
        third = edited(rng, first)
        words += [b] * rng.choice([3, 40, 300]) + [first] * rng.choice([2, 4, 30]) + [second] * rng.choice([1, 2, 3]) + [third] * 2
    rng.shuffle(words)
    return [" ".join(words[i : i + 50]).replace("abc", "ABC") for i in range(0, len(words), 50)]


@pytest.mark.parametrize("most_bits", [1 << 29, 1 << 10])
def test_query_against_brute_force(spark, tmp_path, queries, monkeypatch, most_bits):
    monkeypatch.setattr(variants, "MOST_BITS", most_bits)  # the second one deals the vocabulary to slices
    monkeypatch.setattr(variants, "AT_ONCE", 1 << 12)
    rng = random.Random(6)
    texts = [*corpus(rng), None, "", "short words only", "×÷×÷×÷× ×÷×÷×÷×", "abcdefgh1abcdefgh", "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + "y", "x" * 2999 + "y"]
    texts += [texts[0]] * 3
    ids = [*rng.sample(range(-(2**61), 2**61), len(texts) - 3), None, 4, 4]
    folder = folder_of(tmp_path, documents=documents(spark, texts, ids=ids, clashing=True).repartition(4))
    want = brute_force(list(zip(ids, texts)))
    assert any(form and root != form for _, _, _, form, _, root in want)  # chains of forms
    assert rows_of(queries["op11_spelling_variants"](spark, folder)) == want


def test_empty_tables(spark):
    for texts in ([], [None, "", "a b"], ["onlyonce andanother"]):
        docs = documents(spark, texts or ["x"]).limit(len(texts))
        out = variants.group_variants(docs)
        assert out.collect() == []
        assert dict(out.dtypes) == {"word": "string", "n": "bigint", "n_near": "bigint", "form": "string", "form_n": "bigint", "root": "string"}


def test_filters_hold_every_word_and_few_others(spark, monkeypatch):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.choice([7, 8, 9, 70, 90]))) for _ in range(5000)})
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    counts = Counter(variants.shard_of(len(w)) for w in words)
    for slices in (1, 3):
        held = np.zeros(len(words), dtype=int)
        for number in range(slices):
            filters = variants.build(table, variants.Filters(counts, number, slices))
            assert filters.table.shape == (filters.blocks, 8) and filters.blocks * 512 <= len(words) * variants.WORD_BITS / slices + 512 * len(counts)
            for length, places in variants._by_length(words):
                hashes = variants.finished(variants.Codes([words[i] for i in places], length).whole, length)
                held[places[filters.hold(hashes, variants.shard_of(length))]] += 1
            others = variants.finished(variants.Codes(["".join(rng.choice("klmnopq") for _ in range(8)) for _ in range(20_000)], 8).whole, 8)
            assert len(filters.hold(others, variants.shard_of(8))) < 60
        assert (held == 1).all()


def test_roots_follow_long_chains(spark):
    links = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(40)] + [("v", "w030")]
    found = {r.word: r.root for r in variants.roots(spark.createDataFrame(links, "word string, root string")).collect()}
    assert set(found.values()) == {"w040"} and len(found) == 41
