"""Rounding and colour arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int = 1) -> Column:
    """Round the exact binary value, ties to even.

    ``bround`` works on the shortest decimal form, so a value such as 62.45
    (stored slightly above the tie) would be taken for a tie.  A value that
    prints as a tie is therefore compared with that tie: ``value * steps``
    is summed from exact power-of-two parts, and each partial difference is
    exact because the operands are within a factor of two of each other.
    """
    parts = {1: (16.0, 4.0), 2: (128.0, 64.0, 8.0)}[digits]
    steps = sum(parts)
    x = value.cast("double")
    tie = F.rint(x * steps)
    odd = F.abs(tie % 2) == 1
    near = F.abs(x * steps - tie) <= F.abs(tie) * 1e-14
    error = x * parts[0] - tie
    for p in parts[1:]:
        error = error + x * p
    usual = F.bround(x, digits)
    return (
        F.when(odd & near & (error > 0), (tie + 1) / steps)
        .when(odd & near & (error < 0), (tie - 1) / steps)
        .otherwise(usual)
    )


def one_decimal(value: Column) -> Column:
    """Text with one decimal; ties of the exact value go to the even digit."""
    return F.format_string("%.1f", round_half_even(value))


def exact_mean(value: Column) -> Column:
    """Mean whose sum does not depend on the order of the rows.

    Each double below 2**40 is split into two integers (steps of 2**-20 and of
    2**-56); integer sums are exact, so a retried or re-partitioned job cannot
    flip a later rounding.
    """
    scaled = value * float(2**20)
    whole = F.floor(scaled)
    rest = F.rint((scaled - whole) * float(2**36)).cast("bigint")
    total = F.sum(whole) / float(2**20) + F.sum(rest) / float(2**56)
    return total / F.count(value)


def channel(value: Column) -> Column:
    return F.when(value <= 0.03928, value / 12.92).otherwise(F.pow((value + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * channel(r) + 0.7152 * channel(g) + 0.0722 * channel(b)


def contrast_ratio(fg: tuple[Column, Column, Column], bg: tuple[Column, Column, Column]) -> Column:
    """Null when a colour is unknown (``greatest`` and ``least`` would skip the null)."""
    one, two = luminance(*fg), luminance(*bg)
    ratio = (F.greatest(one, two) + 0.05) / (F.least(one, two) + 0.05)
    return F.when(one.isNotNull() & two.isNotNull(), ratio)


def hex_channel(hex_rgb: Column, index: int) -> Column:
    """Channel 0, 1 or 2 of an RRGGBB string on 0..1."""
    return F.conv(F.substring(hex_rgb, 1 + 2 * index, 2), 16, 10).cast("double") / 255
