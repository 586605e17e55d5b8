"""Streams whose state ends: the guarded life cycle, reviews that are never submitted, first uploads.

``live`` holds the views that grow with their keys; here a watermark says when a key's time is
over.  Events that come after it are not lost: ``late_events`` keeps them in a table of their
own, which the reading views take in again.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from docketflow import fixed_values as V
from docketflow.operators.events import LIFECYCLE
from docketflow.sources.files import file_digests
from docketflow.streaming.live import review_durations

#: The state store that stateful processors need; a session setting.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

DECISIONS = "assignment_id long, event_id long, action string, created_at timestamp, status string, reason string"
_STATES = ["assigned", "in_progress", "submitted", "completed"]
_RANK = {action: _STATES.index(state) + 1 for action, state in LIFECYCLE}
_FINISH = ("evaluation.kept", "evaluation.revised")
EXPIRED = "state.expired"
#: Events in a row of the state.
_RUN = 10_000


def _micros(at: datetime) -> int:
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    gone = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (gone.days * 86_400 + gone.seconds) * 1_000_000 + gone.microseconds


def _runs(events: dict[tuple[int, int], str]) -> list[tuple[list, list, list]]:
    """Events as rows of the state: each holds many, since rows are pickled one by one."""
    rows = [(*event, action) for event, action in events.items()]
    return [tuple(map(list, zip(*rows[i : i + _RUN]))) for i in range(0, len(rows), _RUN)]


class LifecycleGuard(StatefulProcessor):
    """Judges the events of one assignment in the order in which they happened.

    An event waits until the watermark has passed it, so that earlier ones that come later
    are judged before it; an event that comes twice is judged once.  Events that come together
    are added in one call and wait for one timer, that of the earliest, since each call goes
    from Python to the state store.  What is remembered beside waiting events is one row: how far the assignment is and which steps were taken.  It goes
    ``keep_ms`` after the finish, or ``forget_ms`` after the last event of a review that was
    never finished, which is reported as ``state.expired``.
    """

    def __init__(self, keep_ms: int, forget_ms: int) -> None:
        self.keep_ms, self.forget_ms = keep_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "rank int, submitted boolean, revealed boolean, finished boolean, last long")
        self.waiting = handle.getListState("waiting", "at array<long>, id array<long>, action array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        came = {(_micros(row.created_at), row.id): row.action for row in rows}
        if came:
            self.waiting.appendList(_runs(came))
            self.handle.registerTimer(min(came)[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waiting = {(at, id_): action for run in self.waiting.get() for at, id_, action in zip(*run)}
        due = sorted((at, id_, action) for (at, id_), action in waiting.items() if at // 1000 < now)
        seen = self.seen.get()
        rank, submitted, revealed, finished, last = seen or (0, False, False, False, 0)
        for at, id_, action in due:
            del waiting[at, id_]
            reason = refusal(action, submitted, revealed, finished)
            rank, last = max(rank, _RANK.get(action, 0)), max(last, at)
            submitted, revealed = submitted or action == "evaluation.submitted", revealed or action == "ai.revealed"
            finished = finished or action in _FINISH
            yield self._row(key, id_, action, at, rank, reason)
        if due:
            self.seen.update((rank, submitted, revealed, finished, last))
            self.handle.registerTimer(last // 1000 + 1 + (self.keep_ms if finished else self.forget_ms))
            if waiting:
                self.waiting.put(_runs(waiting))
                self.handle.registerTimer(min(waiting)[0] // 1000 + 1)
            else:
                self.waiting.clear()
        elif seen and now > last // 1000 + (self.keep_ms if finished else self.forget_ms) and not waiting:
            self.seen.clear()
            if not finished:
                yield self._row(key, None, EXPIRED, last, rank, None)

    @staticmethod
    def _row(key, id_, action: str, at: int, rank: int, reason: str | None) -> Row:  # noqa: ANN001
        when = datetime.fromtimestamp(at // 1_000_000, timezone.utc).replace(microsecond=at % 1_000_000)
        return Row(assignment_id=key[0], event_id=id_, action=action, created_at=when, status=_STATES[rank - 1] if rank else None, reason=reason)

    def close(self) -> None:
        pass


def refusal(action: str, submitted: bool, revealed: bool, finished: bool) -> str | None:
    """Why the guards refuse an event, given the steps before it."""
    if action == "evaluation.submitted" and submitted:
        return "Evaluation already submitted."
    if action == "ai.revealed" and not submitted:
        return "Submit your own evaluation before viewing the AI assessment."
    if action in _FINISH:
        errors = V.FINALIZE_ERRORS
        return errors["no_evaluation"] if not submitted else errors["no_reveal"] if not revealed else errors["done"] if finished else None
    return V.FINALIZE_ERRORS["done"] if action == "finding.responded" and finished else None


def guarded_lifecycle(events: DataFrame, late: str = "1 hour", keep_days: int = 30, forget_days: int = 365) -> DataFrame:
    """A row for each event of an assignment, once the watermark has passed it: state after it, and why it is refused (append mode).

    The session needs the state store ``STATE_STORE``.
    """
    day = 86_400_000
    rows = events.filter((F.col("entity_type") == "assignment") & F.col("entity_id").isNotNull()).select(
        F.col("entity_id").alias("assignment_id"), "id", "action", "created_at")
    judged = [*_RANK, "ai.revealed", "finding.responded"]
    return rows.filter(F.col("action").isin(judged)).withWatermark("created_at", late).groupBy("assignment_id").transformWithState(
        LifecycleGuard(keep_days * day, forget_days * day), DECISIONS, "Append", "EventTime")


def states_of(decisions: DataFrame) -> DataFrame:
    """Status and first times of every assignment from the rows of ``guarded_lifecycle``."""
    def first_at(*names: str):  # noqa: ANN202
        return F.min(F.when(F.col("action").isin(*names), F.col("created_at")))

    rank = F.array_position(F.array(*map(F.lit, _STATES)), F.col("status"))
    return decisions.filter((F.col("action") != EXPIRED) & F.col("status").isNotNull()).groupBy("assignment_id").agg(
        F.element_at(F.array(*map(F.lit, _STATES)), F.max(rank).cast("int")).alias("status"),
        F.coalesce(first_at("review.opened"), first_at("evaluation.submitted")).alias("opened_at"),
        first_at("evaluation.submitted").alias("submitted_at"), first_at(*_FINISH).alias("completed_at"))


def joined_reviews(events: DataFrame, late: str = "1 hour", limit: str = "30 days") -> DataFrame:
    """``assignment_id``, ``opened_at``, ``submitted_at``: openings with the submissions within ``limit`` of them (append mode).

    An opening without one is sent once, with a null, when the limit has passed; then both
    sides' rows of that time are forgotten.  Every event of the log moves the time of both
    sides on, so they are told apart above the watermark, by a condition that reads the time:
    any other would be moved below it.
    """
    timed = events.withWatermark("created_at", late)

    def of(action: str, name: str) -> DataFrame:
        return timed.filter(F.when(F.col("action") == action, F.col("created_at")).isNotNull()).select(
            F.col("entity_id").alias(f"{name}_of"), F.col("created_at").alias(f"{name}_at"))

    span = F.expr(f"INTERVAL {limit}")
    pairs = of("review.opened", "opened").join(
        of("evaluation.submitted", "submitted"),
        (F.col("opened_of") == F.col("submitted_of")) & (F.col("submitted_at") >= F.col("opened_at") - span)
        & (F.col("submitted_at") <= F.col("opened_at") + span), "leftOuter")
    return pairs.select(F.col("opened_of").alias("assignment_id"), "opened_at", "submitted_at")


def review_minutes(joined: DataFrame, late: DataFrame) -> DataFrame:
    """Minutes from the first opening to the first submission, from the rows of the join and the events kept as late.

    A late event may meet rows that the join has sent without it, so both are read as events again.
    """
    times = [("review.opened", "opened_at"), ("evaluation.submitted", "submitted_at")]
    again = [joined.filter(F.col(at).isNotNull()).select(F.col("assignment_id").alias("entity_id"), F.lit(action).alias("action"), F.col(at).alias("created_at"))
             for action, at in times]
    return review_durations(again[0].unionByName(again[1]).unionByName(late.select("entity_id", "action", "created_at")))


def late_events(events: DataFrame, store_path: str, checkpoint: str, late_seconds: int = 3600) -> DataStreamWriter:
    """Keep the events that a watermark of ``late_seconds`` passes over, in ``store_path``/late.

    An event is late if it is older than the newest one of all earlier batches by more than
    that.  Read with one file a batch: batches of more files pass the same events on later,
    so whatever another query of the log leaves out is here.  A repeated batch replaces itself.
    """
    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = None
        if number:
            seen = spark.read.parquet(f"{store_path}/clock/batch={number - 1}").first()["newest"]
        newest = batch.agg(F.max("created_at").alias("newest")).select(F.greatest("newest", F.lit(seen).cast("timestamp")).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{store_path}/clock/batch={number}")
        behind = F.lit(False) if seen is None else F.unix_micros("created_at") < F.unix_micros(F.lit(seen)) - late_seconds * 1_000_000
        batch.filter(behind).write.mode("overwrite").parquet(f"{store_path}/late/batch={number}")

    return events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def read_late(spark: SparkSession, store_path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{store_path}/late")


def first_uploads(uploads: DataFrame, late: str = "1 day") -> DataFrame:
    """Digests of uploads without those whose content their round got within ``late`` before (append mode).

    ``uploads`` has round_id, content and modificationTime.  Unlike ``live.intake_batches``, which
    marks repeated content for ever, this forgets a digest when the watermark has passed it.
    """
    return file_digests(uploads).withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["round_id", "sha256"])
