"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts handled together by one vectorised step, so that memory in a worker does not follow the batch size.
CHUNK_BYTES = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lowered, split at space, tab and line ends (ASCII only); null is empty."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES, rows: int = 1024) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and ``limit`` characters; one longer text is a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and (size + n > limit or i - start >= rows):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def fold_of(key: Column, parts: int) -> Column:
    """Remainder of the CRC-32 of a key written as text; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def key_text(key: str) -> Column:
    """A key on its way through pandas, where whole numbers beside a null would become doubles."""
    return F.col(f"`{key}`").cast("string")


def with_row(df: DataFrame, name: str) -> DataFrame:
    """A number for each row, so that repeated keys and repeated rows stay apart."""
    return df.withColumn(name, F.monotonically_increasing_id())


def hashed_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of the ``total`` rows of ``df``, at most that many, chosen by a hash of a unique number.

    Rows are thinned where they are read, so what tasks send on does not grow with their number.
    """
    share = min(1.0, 2 * rows / max(1, total))
    mark = F.xxhash64(F.lit(29), F.col(key))
    return df.filter(F.pmod(mark, F.lit(1 << 31)) < int(share * (1 << 31))).orderBy(mark, key).limit(rows)


def splitmix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64, the source of reproducible draws."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))
