"""SimHash fingerprints and near-duplicate classes by multi-index hashing.

A fingerprint links to another if at most three of 64 bits differ.  With two segments
of 32 bits, at least one segment of a linked pair differs in one bit or none.  So each
fingerprint is stored under its two segments, and asks for the 33 values of each small
Hamming ball; what it finds is verified on all 64 bits.  Work grows with the number of
different fingerprints; equal ones, however many, are one before the search.

Nulls, empty texts and white space give fingerprint zero, which links like any other.
Repeated rows and equal texts share their class.  An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.llm.common import chunks, words_of
from docketflow.llm.components import components
from docketflow.session import cut

HASH_SEED = 42
SEGMENTS, SEGMENT_BITS = 2, 32
RADIUS = 1  # of a ball within a segment: floor(3 links / 2 segments)


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 of each run of ``size`` words; of the whole sequence if it is shorter; none for no words."""
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, HASH_SEED)]
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))[: len(words) - size + 1].tolist()
    ends = np.concatenate((gaps, [len(joined)]))[size - 1 :].tolist()
    return [digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends)]


def majority_bits(hashes: list[int] | np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[start : start + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, size: int = 3) -> Column:
    """The SimHash of a text as a signed 64-bit number."""

    @F.pandas_udf(T.LongType())
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([majority_bits(shingle_hashes(words_of(t), size)) for t in batch], dtype="int64")

    return simhash(text)


def segment(fp: Column, number: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * number).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _segment_bits_apart(a: Column, b: Column, number: int) -> Column:
    return F.bit_count(segment(a.bitwiseXOR(b), number))


def _slot(number: int, value: Column) -> Column:
    """One key for a segment's number and value."""
    return F.lit(number << SEGMENT_BITS).bitwiseOR(value)


def linked_fingerprints(prints: DataFrame, fp: str = "fp", most: int = 3) -> DataFrame:
    """Pairs ``a`` < ``b`` of different fingerprints with at most ``most`` differing bits, each once."""
    if most // SEGMENTS > RADIUS:
        raise ValueError("the balls of radius one hold links of up to three bits")
    distinct = prints.select(F.col(fp).alias("fp")).distinct()
    flips = F.array(F.lit(0), *[F.lit(1 << i) for i in range(SEGMENT_BITS)]).cast("array<bigint>")

    def ball(number: int) -> Column:
        centre = segment(F.col("fp"), number)
        return F.transform(flips, lambda m: _slot(number, centre.bitwiseXOR(m)))

    stored = distinct.select(F.col("fp").alias("b"), F.explode(F.array(*[_slot(s, segment(F.col("fp"), s)) for s in range(SEGMENTS)])).alias("slot"))
    asked = distinct.select(F.col("fp").alias("a"), F.explode(F.flatten(F.array(*[ball(s) for s in range(SEGMENTS)]))).alias("slot"))
    a, b = F.col("a"), F.col("b")
    first = F.col("asked.slot") < F.lit(1 << SEGMENT_BITS)
    once = first | (_segment_bits_apart(a, b, 0) > RADIUS)
    return asked.alias("asked").join(
        stored.alias("stored"),
        (F.col("asked.slot") == F.col("stored.slot")) & (a < b) & (F.bit_count(a.bitwiseXOR(b)) <= most) & once,
    ).select("a", "b")


def near_duplicate_classes(rows: DataFrame, key: str, fp: str = "fp", most: int = 3) -> DataFrame:
    """``fp`` and ``component``: for every fingerprint the smallest key reachable over links.

    ``rows`` has one row per document and is read twice; pass a written table.
    """
    prints = cut(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(F.col(key)).alias("least")), "prints")
    roots = components(linked_fingerprints(prints, "fp", most))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return cut(rooted.join(least, "root").select("fp", "component"), "classes")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, most: int = 3) -> DataFrame:
    """One row for each row of ``docs``: key, ``fingerprint`` (hex) and ``component_id``."""
    prints = cut(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), size).alias("fp")), "simhash")
    classes = near_duplicate_classes(prints, "key", "fp", most)
    return prints.join(classes, "fp").select(
        F.col("key").alias(key), fingerprint_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, most: int = 3) -> DataFrame:
    """``docs`` without near duplicates: of each class the row with the smallest key stays.

    Null keys come last; of rows with the same key the first read stays.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    numbered = docs.select(record.alias("rec"), F.monotonically_increasing_id().alias("row"))
    prints = cut(numbered.select("row", F.col(f"rec.`{key}`").alias("key"), fingerprint(F.col(f"rec.`{text}`"), size).alias("fp")), "simhash")
    classes = near_duplicate_classes(prints.withColumn("row_key", F.col("row")), "row_key", "fp", most)
    ranked = F.struct(F.col("key").isNull().alias("last"), F.col("key"), F.col("row"))
    kept = prints.join(classes, "fp").groupBy("component").agg(F.min(ranked).alias("first")).select(F.col("first.row").alias("row"))
    return numbered.join(kept, "row", "left_semi").select("rec.*")
