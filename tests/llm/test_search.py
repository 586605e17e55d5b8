import math
import random
import re
from collections import Counter

import pytest
from helpers import CLASHING, documents, folder_of
from pyspark.sql import functions as F

from docketflow.llm import search

ITEMS = "item_id long, text string"


def plain_terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", low)


def brute_force(docs, items, best=10):
    """Every document scored for every item, row by row."""
    bags = [(key, Counter(plain_terms(t))) for key, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    count, total = sum(1 for n in sizes if n), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for (key, bag), n in zip(bags, sizes):
            m = 100 - 75 + (75 * n * count) // total if n else 0
            score = sum(weight[t] * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in plain_terms(text) if t in bag)
            if score > 0:
                scored.append((-score, key is None, key))
        scored.sort(key=lambda x: (x[0], x[1], 0 if x[2] is None else x[2]))
        out += [(item, rank + 1, key, -s) for rank, (s, _, key) in enumerate(scored[:best])]
    return out


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(rng, n):
    words = [f"w{i}" for i in range(300)] + ["Été", "naïve", "日本", "a_b", "don't", "X9"]
    weights = [1 / (1 + i) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("blocks", [16, 8192])
def test_query_against_brute_force(spark, tmp_path, queries, monkeypatch, blocks):
    monkeypatch.setattr(search, "BLOCK_DOCS", blocks)
    monkeypatch.setattr(search, "GROUP_ITEMS", 3)
    rng = random.Random(blocks)
    texts = corpus(rng, 150)
    texts += [texts[3]] * 40 + [None, "", " .,", "w0 " * 20_000, "W0 w299 É"]
    ids = rng.sample(range(-(2**61), 2**61), len(texts) - 4) + [None, 5, 5, 2**60 + 1]
    items = [(i, t) for i, t in enumerate(corpus(rng, 12))] + [(7, "w0 w0 w1 W1"), (7, "nothing here is known zzz"), (None, "w5 w6"), (20, None), (21, "")]
    items.append((22, " ".join(f"w{i}" for i in range(300))))
    folder = folder_of(tmp_path, documents=documents(spark, texts, ids=ids, clashing=True).repartition(6),
                       benchmark=spark.createDataFrame([(*r, 1, "r", "k", 2, 0.5, 3, 4) for r in items], f"{ITEMS}, {CLASHING}"))
    assert rows_of(queries["op12_ranked_search"](spark, folder)) == sorted(brute_force(list(zip(ids, texts)), items), key=str)


def test_one_text_in_most_rows_and_the_cut_of_accumulators(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_DOCS", 64)
    rng = random.Random(9)
    texts = ["common words w1 w2 w3 here"] * 400 + corpus(rng, 200)
    rng.shuffle(texts)
    items = [(1, "common words w1 w2"), (2, "w40 w50 w60 w1 w0"), (3, "w0")]
    docs = documents(spark, texts)
    found = search.search(docs, spark.createDataFrame(items, ITEMS))
    assert rows_of(found) == sorted(brute_force(list(enumerate(texts)), items), key=str)
    # What cannot reach the tenth score stays behind in an early stage.
    import numpy as np
    import pandas as pd

    bundle = pd.DataFrame({"item": [1], "block": [0], "part": [0], "rest": [[5, 0, 0, 0]], "docs": [[]], "ords": [[]], "scores": [[]], "plan": [[8, 1]]})
    postings = pd.DataFrame({"number": np.full(100, 8), "row": np.arange(100), "ord": np.arange(100), "adds": np.arange(100)})
    carried = search._add(bundle, postings, 0, 10)
    assert carried["docs"][0].tolist() == list(range(85, 100))  # 90 to 99 lead; 85 can still reach 90


def test_empty_tables(spark):
    docs, items = documents(spark, ["a b"]), spark.createDataFrame([(1, "a")], ITEMS)
    for left, right in ((docs.limit(0), items), (docs, items.limit(0)), (documents(spark, [None, "..."]), items), (docs.limit(0), items.limit(0))):
        out = search.search(left, right)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []
    assert dict(search.search(docs, items).dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_the_table_of_terms_is_of_fixed_size(spark):
    items = spark.range(1000).select(F.col("id").alias("item_id"), F.concat(F.lit("t"), "id").alias("text"))
    table = search.term_table(search.item_terms(items, "item_id", "text"))
    assert len(table) == search.TABLE_BITS // 8
    assert sum(bin(b).count("1") for b in table) <= 1000
