import random

import numpy as np
from helpers import documents, folder_of, written

from docketflow.llm import decontaminate as d


def naive_alignment(a, b):
    best, table = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            step = 2 if a[i - 1] == b[j - 1] else -1
            table[i][j] = max(0, table[i - 1][j - 1] + step, table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_against_plain_recursion():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert d.smith_waterman(np.array(a), np.array(b))[0] == naive_alignment(a, b)


def test_passage_is_located():
    item = [b"w%d" % i for i in range(10)]
    text = [b"x"] * 5 + item[:4] + [b"new"] + item[4:] + [b"y"] * 3
    similarity, first, last = d.aligned(item, text)
    assert (first, last) == (5, 15) and similarity == (20 - 1) / 20


def test_bit_table_has_no_false_negative(spark):
    codes = [random.Random(7).getrandbits(63) for _ in range(500)]
    table = d.bit_table(spark.createDataFrame([(c,) for c in codes], "code long"), "code")
    assert len(table.found(np.array(codes, dtype=np.uint64))) == 500


def test_query_finds_copies_and_edits(spark, tmp_path, queries):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [" ".join(word() for _ in range(n)) for n in (30, 40, 25)] + [None, "", "two words", "the of and the of and the"]
    filler = lambda n: " ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.4 else word() for _ in range(n))
    edited = items[1].split()
    edited[5:7], edited[20] = ["other"], "changed"
    texts = [
        filler(200) + " " + items[0].upper().replace(" ", ", ") + "! " + filler(50), filler(30) + " " + " ".join(edited), filler(400),
        None, "", items[2], items[2], " ".join(items[0].split()[:8]) + " " + filler(40), filler(60_000) + " " + items[2],
    ]
    folder = folder_of(
        tmp_path, documents=documents(spark, texts, ids=[10, 11, 12, 13, 14, 15, 15, 16, 17], clashing=True),
        benchmark=spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    rows = queries["op7_benchmark_decontamination"](spark, folder).collect()
    # the last item is made of filler words only, so some texts do hold an edited copy of it
    assert sorted((r.doc_id, r.item_id) for r in rows if r.item_id < 3) == [(10, 0), (11, 1), (15, 2), (15, 2), (17, 2)]
    assert {r.item_id for r in rows} <= {0, 1, 2, 6}
    # every pair that is similar enough was found, by the plain recursion over all pairs
    for i, t in enumerate(texts[:8]):
        for j, item in enumerate(items):
            a, b = d.plain_words(item), d.plain_words(t)
            if len(a) >= 3 and naive_alignment(a, b) / (2 * len(a)) >= 0.5 and j < 3:
                assert any(r.doc_id == [10, 11, 12, 13, 14, 15, 15, 16][i] and r.item_id == j for r in rows)


def test_every_planted_copy_of_the_test_data(spark, queries):
    folder = "/root/testdata/sf0.01"
    plain = lambda t: b" ".join(d.plain_words(t))
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries["op7_benchmark_decontamination"](spark, folder).collect()}
    assert got == {(i, j) for i, t in docs.items() for j, item in items.items() if item in t}


def test_filter_and_empty_tables(spark, tmp_path):
    docs = written(documents(spark, ["a1 b2 c3 d4 e5 f6", "quite other words", None], clashing=True), tmp_path)
    items = spark.createDataFrame([(1, "a1 b2 c3 d4 e5 f6")], "item_id long, text string")
    kept = d.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert d.keep_clean(docs, items.limit(0)).count() == 3
    assert d.keep_clean(docs.limit(0), items).count() == 0
