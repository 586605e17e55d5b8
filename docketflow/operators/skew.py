"""Grouped operations that survive a group holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block, then blocks of a block of the next level; above the last a few rows are left.
LEVELS = (1 << 12, 1 << 20, 1 << 20)
SALTS = 64


def running_total(
    df: DataFrame, keys: list[str], position: str, values: dict[str, Column], levels: tuple[int, ...] = LEVELS
) -> DataFrame:
    """Add, for each entry of ``values``, its sum over earlier positions of the same group.

    ``position`` is a 64-bit integer that is unique within a group.  A plain
    window over the group would sort all of it in one task.  Instead positions
    are cut into blocks: block totals are pre-aggregated, their prefix sums are
    the same task one level up, and the window inside a block sees at most as
    many rows as the level allows.  That holds however sparse the positions
    are: with positions far apart a block holds few rows, and the levels above
    bring them together.
    """
    names = list(values)
    block, above = levels[0], levels[1:]
    staged = df.withColumn("_block", F.floor(F.col(position) / block)).withColumns(
        {f"_v_{n}": v.cast("bigint") for n, v in values.items()}
    )
    unbounded = Window.unboundedPreceding
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(unbounded, -1)
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(unbounded, -1)
    zero = F.lit(0)
    totals = staged.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    if above:
        upper = totals.withColumnRenamed("_block", "_at")
        offsets = running_total(upper, keys, "_at", {f"_b_{n}": F.col(f"_t_{n}") for n in names}, above).select(
            *keys, F.col("_at").alias("_block"), *[f"_b_{n}" for n in names])
    else:
        offsets = totals.select(
            *keys, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(across), zero).alias(f"_b_{n}") for n in names]
        )
    return (
        staged.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), zero) for n in names})
        .join(offsets, [*keys, "_block"])
        .withColumns({n: F.col(f"_b_{n}") + F.col(f"_i_{n}") for n in names})
        .drop("_block", *[f"{p}{n}" for n in names for p in ("_v_", "_i_", "_b_")])
    )


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, numbered in ``rn``.

    ``row_number() <= n`` with a small constant is planned with a group limit
    before the shuffle, so every map task sends at most ``n`` rows of a group.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n)


def first_per_group_salted(
    df: DataFrame, keys: list[str], order: list[Column], limit: str, spread_by: list[str], salts: int = SALTS
) -> DataFrame:
    """As ``first_per_group`` with the limit in a column.

    No group limit can be planned for a column, so the cut is made twice: first
    within salted parts of a group, then over what they leave (at most ``salts``
    times the limit).
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(part))
        .filter(F.col("_rn") <= F.col(limit))
        .withColumn("rn", F.row_number().over(whole))
        .filter(F.col("rn") <= F.col(limit))
        .drop("_salt", "_rn")
    )
