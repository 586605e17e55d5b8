"""Nearest neighbours by a permutation index.

A vector is represented by its ``POSTED`` nearest pivots in order.  Each block of vectors
keeps an inverted file: for each pivot the vectors that post it, with its place in their
order.  A query walks the files of its ``ASKED`` nearest pivots and sums the footrule
distance, counting a pivot that a vector does not post as if it stood last.  The best
``SHARE`` of a block by footrule (``LEAST`` rows at least, ties included) is then ranked
again by the exact Euclidean distance on the original vectors.

The pivots come from at most ``SAMPLE`` different vectors, chosen far from one another, so
that a vector held by a third of all rows gives one pivot.  Every row is indexed.  Blocks
are dealt by a hash of the row, so they are even whatever the vectors are; query sets meet
the blocks in groups of at most ``QUERY_GROUP``, and a block returns ``k`` rows a query.

Vectors that are null, empty, all zero or hold a null or non-finite component take no part,
nor do those whose length differs from the most common one.  Ties go to the smaller id.
A repeated id is a row of its own: only the query's own row is left out.  Rows without an
id can neither be named nor found and take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.llm.common import hashed_sample
from docketflow.operators.skew import first_per_group
from docketflow.session import cut

SAMPLE, PIVOTS, POSTED, ASKED = 2048, 256, 96, 48
SHARE, LEAST = 0.12, 500
BLOCK_ROWS, QUERY_GROUP = 4096, 8192


def usable(vector: Column) -> Column:
    """Finite in every component and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def far_apart(vectors: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different vectors, each the farthest from those before it."""
    if not len(vectors):
        return vectors
    chosen, nearest = [0], ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
    return vectors[chosen]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest pivots of each vector, nearest first, ties to the smaller number."""
    gaps = (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.argsort(gaps, axis=1, kind="stable")[:, :count]


class InvertedFiles:
    """Posting lists of one block of vectors."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, posted: int) -> None:
        self.size, self.posted = len(vectors), min(posted, len(pivots))
        orders = nearest_pivots(vectors, pivots, self.posted)
        by_pivot = np.argsort(orders, axis=None, kind="stable")
        self.vector, self.place = by_pivot // self.posted, (by_pivot % self.posted).astype(np.int32)
        self.ends = np.cumsum(np.bincount(orders.ravel(), minlength=len(pivots)))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of every vector of the block to a query's order of pivots."""
        last = self.posted
        total = np.full(self.size, int((last - np.minimum(np.arange(len(order)), last)).sum()), dtype=np.int32)
        for at, pivot in enumerate(order.tolist()):
            files = slice(self.ends[pivot - 1] if pivot else 0, self.ends[pivot])
            total[self.vector[files]] += np.abs(self.place[files] - at) - abs(last - min(at, last))
        return total


def search_block(
    rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray,
    pivots: np.ndarray, k: int,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its best ``k`` of the block: place of the query, ids and distances."""
    files = InvertedFiles(vectors, pivots, POSTED)
    orders = nearest_pivots(queries, pivots, min(ASKED, files.posted))
    wanted = min(len(rows), max(LEAST, int(np.ceil(SHARE * len(rows)))) + 1)  # one more, for the query itself
    for i, order in enumerate(orders):
        total = files.footrule(order)
        near = np.flatnonzero(total <= np.partition(total, wanted - 1)[wanted - 1])
        near = near[rows[near] != query_rows[i]]
        distance = np.sqrt(((vectors[near] - queries[i]) ** 2).sum(axis=1))
        best = np.lexsort((ids[near], distance))[:k]
        yield i, ids[near[best]], distance[best]


def nearest(
    table: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows found for each query row: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    own = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    clean = own.filter(usable(F.col("vector")))
    sizes = clean.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1)
    width = (sizes.first() or [0])[0]
    rows = cut(clean.filter(F.size("vector") == width).withColumn("row", F.monotonically_increasing_id()), "vectors")
    size, asking = rows.agg(F.count("*"), F.count_if(F.coalesce("asks", F.lit(False)))).first()
    blocks, groups = max(1, -(-size // BLOCK_ROWS)), max(1, -(-asking // QUERY_GROUP))

    sample = hashed_sample(rows.select("row", "id", "vector"), "row", SAMPLE, size).dropDuplicates(["vector"])
    found = sorted(sample.collect(), key=lambda r: (r["id"] is None, r["id"] or 0, r["vector"]))
    pivots = far_apart(np.array([r["vector"] for r in found], dtype=float).reshape(len(found), width), PIVOTS)

    schema = T.StructType([
        T.StructField("query_row", T.LongType()), T.StructField("query_id", T.LongType()),
        T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType()),
    ])

    def search(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return pd.DataFrame({f.name: [] for f in schema})
        pieces = []
        held, asked = held.sort_values("row"), asked.sort_values("row")
        ids = held["id"].to_numpy()
        for i, near, score in search_block(
            held["row"].to_numpy(), ids, np.array(held["vector"].tolist(), dtype=float), asked["row"].to_numpy(),
            np.array(asked["vector"].tolist(), dtype=float), pivots, k,
        ):
            pieces.append(pd.DataFrame({
                "query_row": asked["row"].iloc[i], "query_id": asked["id"].iloc[i], "vec_id": near, "score": score}))
        return pd.concat(pieces)

    keyed = rows.filter("id is not null")
    held = keyed.select("row", "id", "vector", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"),
                        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    asked = keyed.filter("asks").select("row", "id", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
                                        F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("part"))
    best = held.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(search, schema)
    return first_per_group(best, ["query_row"], [F.col("score"), F.col("vec_id")], k).select(
        "query_id", F.col("rn").cast("int").alias("rank"), "vec_id", "score")
