import re

import pytest
from pyspark.sql import functions as F

from docketflow.functions.text import collapse_blanks, normalize, strip


@pytest.fixture(scope="module")
def texts():
    """Every character of the basic plane at the ends and inside of a text."""
    chars = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x11000)]]
    return [x for c in chars for x in (f"{c}a{c}", f" {c}a b{c} \t", f"a{c}{c}b")] + ["", " ", "\x1c \u3000"]


def test_blanks_are_those_of_python(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s"), collapse_blanks(F.col("t")).alias("c"))
    assert [r.t for r in rows.collect() if r.s != r.t.strip() or r.c != " ".join(r.t.split())] == []


def test_normalized_texts_keep_ascii_letters_digits_and_two_signs(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("low"), normalize(F.col("t")).alias("n"))
    assert [r.low for r in rows.collect() if r.n != re.sub("[^a-z0-9%$]+", " ", r.low).strip(" ")] == []
