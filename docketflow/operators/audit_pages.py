"""Deep pages of the audit log from order statistics, without sorting what comes before them.

Beside the log, which has a folder for each day, an index counts events by round, submission,
action and hour.  Like the log it is only appended to, and its counts are summed when read.
A page finds the hours it lies in from running totals, newest first, and reads their days
alone; an hour with very many events is counted by second first.  A cursor (the last row of a
page) gives the next page without an offset.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.operators.events import append_events, matching
from docketflow.operators.skew import running_total

HOUR = 3_600_000_000
#: Rows behind which an hour is counted by second instead of sorted from its start.
FINE = 10_000


def _slot(width: int) -> Column:
    """Number of the span of ``width`` microseconds an event falls in."""
    return F.floor(F.unix_micros("created_at") / width).cast("bigint")


def hour_counts(events: DataFrame) -> DataFrame:
    """Events by round, submission, action, day and hour (``slot``, from 1970)."""
    return events.groupBy("round_id", "submission_id", "action", F.to_date("created_at").alias("day"), _slot(HOUR).alias("slot")).agg(
        F.count("*").alias("n"))


def append_with_index(events: DataFrame, log_path: str, index_path: str) -> None:
    """Append events to the log and their counts to its index; ``events`` is a written table."""
    append_events(events, log_path)
    hour_counts(events).write.mode("append").partitionBy("day").parquet(index_path)


def _spans(counts: DataFrame, first: int, last: int) -> list:
    """Of ``slot`` with count ``n`` those that hold places ``first`` to ``last``, newest first, with the places before them.

    Every span holds at least one place, so there are no more than places.
    """
    total = running_total(counts.withColumn("newest", -F.col("slot")), [], "newest", {"before": F.col("n")})
    held = total.filter((F.col("before") < last) & (F.col("before") + F.col("n") > first))
    return held.select("slot", "n", "before").orderBy("before").collect()


def _within(events: DataFrame, slots: list[int], width: int) -> DataFrame:
    """Events of some spans; only the folders of their days are read."""
    days = sorted({datetime.fromtimestamp(s * width // 1_000_000, timezone.utc).date() for s in slots})
    day = F.col("day") if "day" in events.columns else F.to_date("created_at")
    return events.filter(day.isin(days)).filter(_slot(width).isin(slots))


def deep_page(
    events: DataFrame, index: DataFrame, round_id: int, submission_id: int | None = None, action: str | None = None,
    limit: int = 100, offset: int = 0,
) -> DataFrame:
    """The page that ``events.audit_page`` gives, read from the hours it lies in."""
    if not 1 <= limit <= V.AUDIT_PAGE_LIMIT or offset < 0:
        raise ValueError(f"limit must be 1..{V.AUDIT_PAGE_LIMIT} and offset not negative")
    rows = matching(events, round_id, submission_id, action)
    counts = matching(index, round_id, submission_id, action).groupBy("slot").agg(F.sum("n").alias("n"))
    spans = _spans(counts, offset, offset + limit)
    if not spans:
        return rows.limit(0)
    rows, before = _within(rows, [s.slot for s in spans], HOUR), spans[0].before
    if offset - before > FINE:
        width = 1_000_000
        spans = _spans(rows.groupBy(_slot(width).alias("slot")).agg(F.count("*").alias("n")), offset - before, offset - before + limit)
        rows, before = _within(rows, [s.slot for s in spans], width), before + spans[0].before
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset - before).limit(limit)


def next_page(
    events: DataFrame, index: DataFrame, round_id: int, after: tuple[int, int] | None, submission_id: int | None = None,
    action: str | None = None, limit: int = 100,
) -> DataFrame:
    """The ``limit`` events behind a cursor (microseconds of ``created_at`` and ``id`` of the last row seen); the newest without one."""
    rows, counts = (matching(x, round_id, submission_id, action) for x in (events, index))
    seen = 0
    if after is not None:
        at, hour = F.timestamp_micros(F.lit(after[0])), after[0] // HOUR
        rows = rows.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < after[1])))
        counts = counts.filter(F.col("slot") <= hour)
        # The cursor's own hour may hold rows before it, so as many places more are looked at.
        seen = counts.filter(F.col("slot") == hour).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    spans = _spans(counts.groupBy("slot").agg(F.sum("n").alias("n")), 0, seen + limit)
    if not spans:
        return rows.limit(0)
    return _within(rows, [s.slot for s in spans], HOUR).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
