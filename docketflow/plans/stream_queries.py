"""Streams with state over the audit log, run to their end and read back.

The log arrives out of order, in parts dealt by a hash, and some of it twice.  A run takes what
has arrived, the next one goes on from its checkpoint with an event that closes the time.
The results are those of the batch rules, stated by the same SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.plans.catalog import Catalog
from docketflow.plans.plug_queries import CATALOG as PLUG
from docketflow.plans.review_entities import entity
from docketflow.plans.review_queries import CATALOG as REVIEW
from docketflow.session import ensure_checkpoint_dir
from docketflow.streaming import stateful

CATALOG = Catalog()
_COLUMNS = ["id", "action", "entity_type", "entity_id", "created_at"]
_PARTS, _DELAY, _CLOSE = 3, "4000 days", 9000
_CLOSING = -1  # the assignment of the closing event


def _run_to_its_end(spark: SparkSession, log: DataFrame, view: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an append-mode view of the log has sent when the log is closed."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/docketflow/stream-{uuid.uuid4().hex}"
    rows = log.select(*_COLUMNS)
    part = F.pmod(F.xxhash64("id"), F.lit(_PARTS))
    for number in range(_PARTS):
        again = F.pmod(F.xxhash64("id", F.lit(number)), F.lit(20)) == 0
        rows.filter((part == number) | again).write.mode("append").parquet(f"{path}/log")
    closing = rows.agg(F.max("created_at").alias("last")).filter("last is not null").select(
        F.lit(-1).cast("long").alias("id"), F.lit("assignment.created").alias("action"), F.lit("assignment").alias("entity_type"),
        F.lit(_CLOSING).cast("long").alias("entity_id"), (F.col("last") + F.expr(f"INTERVAL {_CLOSE} days")).alias("created_at"))
    before = spark.conf.get(stateful.STATE_STORE[0], None)
    spark.conf.set(*stateful.STATE_STORE)
    try:
        for more in (None, closing):
            if more is not None:
                more.write.mode("append").parquet(f"{path}/log")
            sent = view(spark.readStream.schema(rows.schema).parquet(f"{path}/log"))
            sent.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(
                availableNow=True).start(f"{path}/sent").awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(stateful.STATE_STORE[0])
        else:
            spark.conf.set(stateful.STATE_STORE[0], before)
    return spark.read.schema(sent.schema).parquet(f"{path}/sent").filter(F.col("assignment_id") != _CLOSING)


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    return _run_to_its_end(
        spark, entity(spark, folder, "audit"), lambda events: stateful.guarded_lifecycle(events, _DELAY, keep_days=_CLOSE, forget_days=_CLOSE))


@CATALOG.query("str2_guarded_violations", REVIEW.sql["aud6_lifecycle_violations"])
def guarded_violations(spark, folder):
    return _decisions(spark, folder).filter("reason is not null").select("assignment_id", "event_id", "action", "reason")


@CATALOG.query("str2_guarded_states", REVIEW.sql["aud6_assignment_states"])
def guarded_states(spark, folder):
    rows = stateful.states_of(_decisions(spark, folder))
    return rows.select("assignment_id", "status", *[F.unix_micros(c).alias(c) for c in ("opened_at", "submitted_at", "completed_at")])


@CATALOG.query("str3_joined_reviews", PLUG.sql["str3_review_durations"])
def joined_reviews(spark, folder):
    log = entity(spark, folder, "audit")
    joined = _run_to_its_end(spark, log, lambda events: stateful.joined_reviews(events, _DELAY, "4000 days"))
    rows = stateful.review_minutes(joined, log.limit(0))
    return rows.select("assignment_id", *[F.unix_micros(c).alias(c) for c in ("opened_at", "submitted_at")], "review_minutes")
