"""Live views on the append-only event log and incremental intake."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from docketflow.operators.events import lifecycle_rank, state_of_rank
from docketflow.sources.files import duplicates, file_digests


def read_event_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000
) -> DataFrame:
    """New files of the event log, a bounded number per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def activity_counts(events: DataFrame, window: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events per round, action and time window; late events are taken up to ``late``."""
    span = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    return (
        events.withWatermark("created_at", late)
        .groupBy(span.alias("w"), "round_id", "action")
        .agg(F.count("*").alias("events"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "round_id", "action", "events")
    )


def current_status(events: DataFrame) -> DataFrame:
    """State of every assignment so far (update or complete mode).

    States only move forward, so the state is a maximum and does not depend on
    the order in which events arrive; the key (time, id) breaks ties of the last
    event.  The state per key is one small row.
    """
    rank = lifecycle_rank(F.col("action"))
    rows = events.filter((F.col("entity_type") == "assignment") & (rank > 0))
    return rows.groupBy(F.col("entity_id").alias("assignment_id")).agg(
        state_of_rank(F.max(rank)).alias("status"),
        F.max_by("action", F.struct("created_at", "id")).alias("last_action"),
        F.max("created_at").alias("updated_at"),
    )


def submission_status(events: DataFrame) -> DataFrame:
    """Latest processing event of every submission (update or complete mode)."""
    rows = events.filter(F.startswith(F.col("action"), F.lit("submission.")) & F.col("submission_id").isNotNull())
    return rows.groupBy("submission_id").agg(
        F.max_by("action", F.struct("created_at", "id")).alias("last_action"),
        F.max("created_at").alias("updated_at"),
    )


def reviewer_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Working sessions of an actor: events with pauses below ``gap``."""
    return (
        events.withWatermark("created_at", late)
        .groupBy(F.session_window("created_at", gap).alias("s"), "actor_id")
        .agg(F.count("*").alias("events"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
        .select(
            "actor_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events",
            ((F.unix_micros("last_at") - F.unix_micros("first_at")) / 6e7).alias("active_minutes"),
        )
    )


def review_durations(events: DataFrame) -> DataFrame:
    """Minutes from the first opening to the first submission (update or complete mode).

    However long a review takes, two times per assignment are all that is
    remembered, and both are minima, so the order of arrival does not matter.
    """
    first = {"opened_at": "review.opened", "submitted_at": "evaluation.submitted"}
    times = events.filter(F.col("action").isin(*first.values())).groupBy(F.col("entity_id").alias("assignment_id")).agg(
        *[F.min(F.when(F.col("action") == action, F.col("created_at"))).alias(name) for name, action in first.items()]
    )
    minutes = (F.unix_micros("submitted_at") - F.unix_micros("opened_at")) / 6e7
    return times.filter("opened_at is not null and submitted_at is not null").withColumn("review_minutes", minutes)


def read_upload_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Newly arrived files with their content."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return (
        spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
    )


DIGEST_COLUMNS = "submission_id bigint, round_id bigint, path string, size_bytes bigint, sha256 string, bucket int, batch bigint"


def mark_arrivals(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """``fresh`` digests with duplicate_of: the first equal content of the round, earlier digests included.

    Of the known ones only those whose content arrives again take part.
    """
    again = known.join(fresh.select("round_id", "sha256").distinct(), ["round_id", "sha256"], "left_semi")
    both = fresh.withColumn("_new", F.lit(True)).unionByName(again.withColumn("_new", F.lit(False)))
    return duplicates(both).filter("_new").drop("_new", "_n")


def intake_batches(
    uploads: DataFrame, store_path: str, checkpoint: str, describe: Callable[[DataFrame], DataFrame], buckets: int = 256
) -> DataStreamWriter:
    """Digest new files and mark those whose content the round already holds.

    ``describe`` adds submission_id and round_id to a batch.  A batch reads its
    files once: their digests go to ``store_path``/digests in folders by a bucket
    of the digest, and from there they are compared with the earlier digests of
    the same buckets only.  Marked rows go to ``store_path``/marks.  Both are
    stored under the batch's number, so a repeated batch replaces itself.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = ["submission_id", "round_id", "path", "size_bytes", "sha256"]
        bucket = F.pmod(F.xxhash64("sha256"), F.lit(buckets)).cast("int")
        file_digests(describe(batch)).select(*columns).withColumn("bucket", bucket).withColumn(
            "batch", F.lit(number).cast("bigint")
        ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(
            f"{store_path}/digests")
        stored = spark.read.schema(DIGEST_COLUMNS).parquet(f"{store_path}/digests")
        fresh = stored.filter(F.col("batch") == number)
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        known = stored.filter(F.col("bucket").isin(touched) & (F.col("batch") < number))
        mark_arrivals(fresh.select(*columns), known.select(*columns)).write.mode("overwrite").parquet(
            f"{store_path}/marks/batch={number}")

    return uploads.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
