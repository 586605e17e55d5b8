import collections
import zlib

from helpers import documents, folder_of
from pyspark.sql import functions as F

from docketflow.llm import sharding

TEXTS = ["alpha", None, "", "été", "x" * 200_000, "alpha", "alpha"] + [f"text {i}" for i in range(60)]


def test_query_laws(spark, tmp_path, queries):
    ids = [5, 6, 7, 8, 9, 9, None, *range(100, 160)]
    folder = folder_of(tmp_path, documents=documents(spark, TEXTS, ids=ids, clashing=True))
    rows = queries["op1_sharding"](spark, folder).collect()
    raw = [(t or "").encode() for t in TEXTS]
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == collections.Counter(
        (i, len(b) + 1, zlib.crc32(b)) for i, b in zip(ids, raw))
    shards = collections.Counter(r.shard for r in rows)
    assert max(shards.values()) - min(shards.values()) <= 1 and set(shards) <= set(range(8))
    for s, n in shards.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    again = queries["op1_sharding"](spark, folder).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_many_buckets_and_copies(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 1).otherwise(F.col("id")).alias("k"), F.lit(10).alias("size"), F.col("id").alias("slot"))
    out = sharding.shard_records(rows, ["k"], "size", shards=3, bucket_rows=100).collect()
    assert sorted(r.slot for r in out if r.shard == 1) == list(range(1000))
    hot = collections.Counter(r.shard for r in out if r.k == 1)
    assert all(280 < n < 390 for n in hot.values())


def test_empty_table(spark):
    assert sharding.shard_records(documents(spark, []), ["doc_id"], "n_chars").count() == 0


def test_fisher_yates_is_uniform(spark):
    got = spark.range(4800).select(sharding.fisher_yates(F.array(*map(F.lit, range(4))), F.xxhash64("id")).alias("p")).collect()
    seen = collections.Counter(tuple(r.p) for r in got)
    assert len(seen) == 24 and all(130 < n < 280 for n in seen.values())


def test_written_shards(spark, tmp_path):
    out = sharding.shard_records(documents(spark, TEXTS), ["doc_id"], "n_chars", shards=4)
    sharding.write_shards(out, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(repr, back.select(*out.columns).collect())) == sorted(map(repr, out.collect()))


def test_query_shards_whole_documents(spark, tmp_path, queries, monkeypatch):
    """Every document is in the shard files with all its columns, where the query says it is."""
    paths, write = [], sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda df, path, *names: (paths.append(path), write(df, path, *names)))
    docs = documents(spark, TEXTS)
    rows = queries["op1_sharding"](spark, folder_of(tmp_path, documents=docs)).collect()
    back = {r.doc_id: r for r in spark.read.parquet(paths[0]).collect()}
    assert sorted(map(repr, spark.read.parquet(paths[0]).select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    assert all((back[r.doc_id].shard, back[r.doc_id].slot) == (r.shard, r.slot) for r in rows)


def test_buckets_of_long_texts(spark, tmp_path):
    """Records of 100 kB in buckets bounded by bytes, written in several files a shard."""
    text = F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), F.lit(20_000))
    records = spark.range(300).select("id", text.alias("text")).withColumn("size", sharding.text_size(F.col("text")))
    out = sharding.stored_shards(sharding.shard_records(records, ["id"], "size", shards=3, bucket_bytes=1 << 20))
    want = {(r.id, r.text) for r in records.collect()}
    rows = out.collect()
    assert {(r.id, r.text) for r in rows} == want and len(rows) == 300
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(3) for i in range(100)]
    assert sharding.stored_shards(sharding.shard_records(records.limit(0), ["id"], "size")).count() == 0


def test_many_buckets_are_joined_without_a_broadcast_and_give_the_same(spark, monkeypatch):
    records = spark.range(500).select("id", F.lit(9).cast("long").alias("size"))
    few = sharding.shard_records(records, ["id"], "size", bucket_rows=16)
    monkeypatch.setattr(sharding, "MOST_BROADCAST", 3)
    many = sharding.shard_records(records, ["id"], "size", bucket_rows=16)
    assert "rightHint=(strategy=broadcast)" in few._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
