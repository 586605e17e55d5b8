"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters records by a seeded hash into buckets small enough for memory;
pass two permutes each bucket by Fisher-Yates and writes it.  Read in bucket order,
the buckets are one random order of all records, which is dealt to the shards in
turn: record ``p`` goes to shard ``p mod shards``, slot ``p div shards``.  Shard sizes
therefore differ by one row at most, and slots have no gaps.

* A key, source or text held by a third of all rows does not matter: the hash covers
  the key and a row number, so equal records scatter like any others.
* The draws of Fisher-Yates are hashes of seed, bucket and step.  Nothing depends on
  the order in which rows arrive, so a task that runs again gives the same bucket.
* The same seed over the same files and split settings gives the same order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.operators.skew import running_total
from docketflow.session import cut, ensure_checkpoint_dir

#: Records of a bucket at most, on average.  Each swap copies the bucket's references, so cost per row grows with it.
BUCKET_ROWS = 2048
#: Buckets whose first places are broadcast, 16 bytes each; those of more are joined by a shuffle.
MOST_BROADCAST = 1 << 20
#: Bytes of a bucket at most, on average.
BUCKET_BYTES = 64 << 20


def _below(bound: Column, *parts: Column) -> Column:
    """A draw from 0 to ``bound``, both included, decided by ``parts``."""
    return F.pmod(F.xxhash64(*parts), bound + 1).cast("int")


def fisher_yates(items: Column, seed: Column) -> Column:
    """``items`` permuted: from the last place down, each place swaps with one drawn from those up to it."""

    def swap(a: Column, i: Column) -> Column:
        # places count from 0: j is drawn from 0 to i
        j = _below(i, seed, i)
        kept = F.concat(
            F.slice(a, F.lit(1), j), F.array(a[i]), F.slice(a, j + 2, i - j - 1),
            F.array(a[j]), F.slice(a, i + 2, F.size(a) - i - 1),
        )
        return F.when(i == j, a).otherwise(kept)

    steps = F.when(F.size(items) > 1, F.sequence(F.size(items) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, items, swap)


def scatter_and_shuffle(
    records: DataFrame, key: list[str], size: str, seed: int, bucket_rows: int = BUCKET_ROWS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Buckets of records in random order: ``bucket``, ``n`` and ``items`` (the records), written once.

    ``size`` names a column with the bytes a record takes.  Null keys and sizes are
    allowed; an empty table gives no bucket.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    weight = F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0))
    staged = cut(records.select(
        record.alias("rec"), weight.alias("weight"), F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in key]).alias("h"),
        F.monotonically_increasing_id().alias("row"),
    ), "scatter", "zstd")
    rows, weight_sum = staged.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    buckets = max(1, -(-rows // bucket_rows), -(-int(weight_sum) // bucket_bytes))
    bucket = F.pmod(F.xxhash64("h", "row"), F.lit(buckets))
    # sorting by row number first makes the permutation independent of arrival
    gathered = (
        staged.select(bucket.alias("bucket"), F.struct("row", "rec").alias("item"))
        .groupBy("bucket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    # places are permuted and each record is fetched once: a swap of records would copy their texts
    places = fisher_yates(F.sequence(F.lit(0), F.size("items") - 1), F.xxhash64(F.lit(seed), F.col("bucket")))
    return cut(gathered.select("bucket", F.size("items").alias("n"), F.transform(places, lambda i: F.col("items")[i]["rec"]).alias("items")), "buckets", "zstd")


def shard_records(
    records: DataFrame, key: list[str], size: str, shards: int = 8, seed: int = 17, shard: str = "shard",
    slot: str = "slot", bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Every record with its ``shard`` (0 to ``shards`` - 1) and ``slot``; other columns keep their names.

    Ties, repeated rows and null columns: each row is dealt on its own.  The two new
    columns take the place of records' own of the same names.  An empty table gives no row.
    """
    records = records.drop(*{shard, slot} - {*key, size})
    done = scatter_and_shuffle(records, key, size, seed, bucket_rows, bucket_bytes)
    counts = done.select("bucket", "n", F.lit(0).alias("all"))
    ahead = running_total(counts, ["all"], "bucket", {"first": F.col("n")}).select("bucket", "first")
    # a number for each bucket goes to the tasks while that is small, so that the records are not shuffled again
    few = done.count() <= MOST_BROADCAST
    placed = done.join(F.broadcast(ahead) if few else ahead, "bucket").select("first", F.posexplode("items").alias("at", "rec"))
    position = (F.col("first") + F.col("at")).cast("long")
    return placed.select(
        "rec.*", F.pmod(position, F.lit(shards)).cast("int").alias(shard),
        F.floor(position / F.lit(shards)).cast("long").alias(slot),
    )


def write_shards(sharded: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder for each shard, rows in slot order within a file.

    Every task writes the slots that its buckets have in each shard, so shards of any size
    are written by many tasks and records are not shuffled again.
    """
    sharded.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path, compression="zstd")


def stored_shards(sharded: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``sharded`` written by ``write_shards`` into the checkpoint folder and read from its files."""
    spark = sharded.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/docketflow/shards-{uuid.uuid4().hex}"
    write_shards(sharded, path, shard, slot)
    return spark.read.schema(sharded.schema).parquet(path).select(*[F.col(f"`{c}`") for c in sharded.columns])


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus one; null has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast(T.LongType())
