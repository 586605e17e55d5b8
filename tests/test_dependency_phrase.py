import random
import time

from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions import text


def test_hardware_phrase_is_the_first_match_of_the_pattern(spark):
    rng = random.Random(5)
    parts = ["sensor", "Sensors", "device", "hardware", "buoy", "drones", "bio", "low-", "-", "x", "é", "ſ", "7_", " ", "  ", " ", "\n", ".", ", "]
    rows = [("".join(rng.choices(parts, k=rng.randint(0, 9))),) for _ in range(3000)] + [(None,)]
    plain = F.lower(text.strip(F.regexp_extract("s", "(?iUd)" + V.HARDWARE_PHRASE, 0)))
    table = spark.createDataFrame(rows, "s string").select(
        "s", text.dependency_phrase("hardware", F.col("s")).alias("own"),
        F.when(plain != "", plain).otherwise(V.HARDWARE_FALLBACK).alias("plain"))
    got = table.collect()
    assert [r for r in got if r.own != r.plain] == [] and len({r.own for r in got}) > 100


def test_a_long_word_is_tried_once(spark):
    """From each of its letters it would take 2e11 steps."""
    rows = spark.createDataFrame([("x" * 600_000 + " sensor",), ("x" * 600_000,)], "s string")
    spark.range(1).count()
    began = time.monotonic()
    lengths = [len(r.own) for r in rows.select(text.dependency_phrase("hardware", F.col("s")).alias("own")).collect()]
    assert lengths == [600_007, len(V.HARDWARE_FALLBACK)] and time.monotonic() - began < 30
