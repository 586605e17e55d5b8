"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.col("b").alias("n"), F.col("a").alias("s"))
    least = down.groupBy("n").agg(F.min("s").alias("m"))
    tied = down.join(least, "n")
    return tied.select(F.col("m").alias("a"), F.col("s").alias("b")).filter("a < b").unionByName(
        least.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) for every node of edges ``a``, ``b`` of numbers.

    Rounds are written tables in the shared folder; they end when the edges are stars and
    no longer change, after about the logarithm of the longest path.  Only a count and a
    checksum reach the driver.
    """
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))))
    seen = tuple(now.agg(mark).first()[0])
    while seen[0]:
        now = cut(_small_star(_large_star(now)), "edges")
        mark_now = tuple(now.agg(mark).first()[0])
        if mark_now == seen:
            break
        seen = mark_now
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
