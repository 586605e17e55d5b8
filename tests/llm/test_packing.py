import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, folder_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketflow.llm import packing

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(path, texts):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("width", range(1, 33))
def test_every_width_gives_the_ids_back(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        data = packing.pack(ids, width)
        assert len(data) == -(-n * width // 8)
        assert np.array_equal(packing.unpack(data, width, n), ids)
        bits = [int(x) >> b & 1 for x in ids for b in range(width)]  # the format, bit by bit
        assert all(data[i // 8] >> i % 8 & 1 == b for i, b in enumerate(bits))


def test_width_of_a_vocabulary():
    assert [packing.width_of(n) for n in (1, 2, 3, 256, 257, 50_257, 1 << 16, (1 << 16) + 1)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_encoding_by_parts_equals_the_library():
    rng = random.Random(2)
    texts = ["", " ", "  a", "a  b", "\n\n x \n", "it's  don't'll 's", "a b  c", "x\x1c y \x1f z", "日本 語 テスト", "<|endoftext|> a<|endoftext|>",
             "é  è\r\n ö", "½ ² x² ⅷ", "a\x85 b", "🙂 🙂🙂 a", "\ttab\tb \tc", "a 　b", None, "x" * 30_000, "\x00 \x00a", "﻿a ​b"]
    texts += ["".join(rng.choice(" \n\t'sabé½²7.,!  \x1c 　日🙂Ll") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for path in (BYTES, public_tokenizers.path("word_bpe_49k.json")):
        encoder = packing.Encoder(packing.Vocabulary(path), "<u4")
        assert packing.Vocabulary(path).by_words == (path == BYTES)
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(texts)] == library_ids(path, texts)


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 3)
    encoder = packing.Encoder(packing.Vocabulary(BYTES), "<u2")
    texts = ["a b c d e, f. g", "g f e d c b a", "b b b"] * 3
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in encoder.encode(texts)] == library_ids(BYTES, texts)
    assert max(len(encoder.parts), len(encoder.pieces)) <= 3


def expected(rows):
    out, at = [], 0
    for key, ids in rows:
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_query_against_the_library(spark, tmp_path, queries):
    rng = random.Random(4)
    texts = [None, "", "a", " \n ", "same text", "same text", "été " * 40_000, *(" ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(rng.randint(1, 400))) for _ in range(60))]
    ids = [2**60 + 1, -5, *rng.sample(range(10**6), len(texts) - 2)]
    rows = sorted(zip(ids, library_ids(BYTES, texts)))
    folder = folder_of(tmp_path, documents=documents(spark, texts, ids=ids, clashing=True).repartition(5))
    found = queries["op13_packed_ids"](spark, folder).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == expected([(k, [*x, 2]) for k, x in rows])


def test_null_and_repeated_keys_and_no_rows(spark, tmp_path, queries):
    texts = ["x y", "z", None, "z", "longer text here"] * 30
    ids = [None, 7, 7, 7, None] * 30
    folder = folder_of(tmp_path, documents=documents(spark, texts, ids=ids))
    found = sorted(queries["op13_packed_ids"](spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None] * 60 + [7] * 90  # nulls first
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    want = {zlib.crc32(np.array([*i, 2], dtype="<u4").tobytes()) for i in library_ids(BYTES, texts)}
    assert {r.ids_crc32 for r in found} == want
    empty = folder_of(tmp_path / "empty", documents=documents(spark, ["a"]).limit(0))
    assert queries["op13_packed_ids"](spark, empty).collect() == []


def test_blocks_files_and_random_access(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["word", "été", "x,", "I"]) for _ in range(rng.randint(0, 3000))) for _ in range(40)]
    vocabulary = packing.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    docs = documents(spark, texts).repartition(3)
    files = packing.write_packed(docs, vocabulary, f"{tmp_path}/packed", end_id=49_407)
    whole = np.concatenate([[*i, 49_407] for i in library_ids(vocabulary.path, texts)])
    assert np.array_equal(packing.read_ids(spark, files, 0, len(whole)), whole)
    for a, b in [(0, 0), (1, 2), (8191, 8193), (12_345, 12_399), (len(whole) - 3, len(whole) + 9)]:
        assert np.array_equal(packing.read_ids(spark, files, a, b), whole[a:b])
    row = files.orderBy(F.desc("n_ids")).first()
    reader = packing.Reader(row.path)
    assert reader.width == 16 and len(reader.blocks) == -(-row.n_ids // packing.BLOCK) + 1
    keys = reader.index[0]
    for number in (0, reader.n_docs - 1):
        assert reader.document(number).tolist() == [*library_ids(vocabulary.path, [texts[keys[number]]])[0], 49_407]


def test_files_are_closed_and_an_attempt_that_is_not_listed_is_not_read(spark, tmp_path):
    writer = packing.Writer(f"{tmp_path}/ids-000000-9-000000.bin", 5)
    parts = [(None, np.arange(20_000) % 32), (3, np.zeros(0, dtype=np.uint32)), (4, np.arange(9) % 32)]
    for key, ids in parts:
        writer.add(key, ids.astype(np.uint32))
    assert writer.close() == (f"{tmp_path}/ids-000000-9-000000.bin", 20_009, 3)
    packing.Writer(f"{tmp_path}/ids-000000-8-000000.bin", 5)  # an attempt that was lost on its way
    files = spark.createDataFrame([(f"{tmp_path}/ids-000000-9-000000.bin", 100)], "path string, first_id long")
    found = sorted(packing.documents_of(files).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found] == [
        (k, 100 + a, n, d) for k, a, n, d in expected([(k, i.tolist()) for k, i in parts])]
