"""Display formatting of values and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions.text import lookup

_NONE = "—"


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def relative_time(then: Column, now: Column) -> Column:
    """Both in epoch seconds; older than a week is shown as a UTC date."""
    age = now - then
    return (
        F.when(then.isNull(), _NONE)
        .when(age < 60, "just now")
        .when(age < 3600, F.concat(F.floor(age / 60).cast("string"), F.lit(" min ago")))
        .when(age < 86400, F.concat(F.floor(age / 3600).cast("string"), F.lit(" h ago")))
        .when(age < 7 * 86400, F.concat(F.floor(age / 86400).cast("string"), F.lit(" d ago")))
        .otherwise(F.date_format(F.timestamp_seconds(then), "MMM d, HH:mm"))
    )


def minutes(value: Column) -> Column:
    return (
        F.when(value.isNull(), _NONE)
        .when(value < 1, "<1 min")
        .when(value < 60, F.concat(half_up(value).cast("string"), F.lit(" min")))
        .otherwise(
            F.concat(
                F.floor(value / 60).cast("string"), F.lit(" h "),
                half_up(value % 60).cast("string"), F.lit(" min"),
            )
        )
    )


def score(value: Column) -> Column:
    shown = F.regexp_replace(F.format_string("%.1f", value), r"\.0$", "")
    return F.when(value.isNull(), _NONE).otherwise(shown)


def byte_size(value: Column) -> Column:
    return (
        F.when(value < 1024, F.concat(value.cast("string"), F.lit(" B")))
        .when(value < 1024 * 1024, F.concat(half_up(value / 1024).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", value / 1024 / 1024), F.lit(" MB")))
    )


def signed(value: Column) -> Column:
    tenth = half_up(value * 10) / 10
    return (
        F.when(tenth > 0, F.concat(F.lit("+"), score(tenth)))
        .when(tenth < 0, F.concat(F.lit("−"), score(-tenth)))
        .otherwise("0")
    )


def integrity_label(status: Column) -> Column:
    return lookup(status, V.INTEGRITY_LABELS)


def assignment_label(status: Column) -> Column:
    return lookup(status, V.ASSIGNMENT_LABELS)


def severity_label(severity: Column) -> Column:
    return lookup(severity, V.SEVERITY_LABELS)


def verify_type_label(kind: Column) -> Column:
    return lookup(kind, V.VERIFY_TYPE_LABELS)


def recommendation_label(value: Column) -> Column:
    return lookup(value, V.RECOMMENDATION_LABELS)


def direction_label(value: Column) -> Column:
    return lookup(value, V.DIRECTION_LABELS)


def stage_label(value: Column) -> Column:
    return lookup(value, V.STAGE_LABELS)


def action_label(action: Column) -> Column:
    return lookup(action, V.ACTION_LABELS, action)
