"""Ranked lexical search by pipelined term partitioning.

The terms of the items are owned by ``OWNERS`` stages, rarest first, so each owner holds the
postings of one band of document frequency.  An item's bundle carries a sparse accumulator,
document and score, from owner to owner: each stage is a cogroup of bundles and postings that
adds the integer contributions of the owner's terms.  After the last stage the best of each
bundle are joined and the final ones selected.

Documents are dealt to blocks of about ``BLOCK_DOCS`` and items to groups of at most
``GROUP_ITEMS``; a bundle belongs to one item and one block, so neither a task nor an
accumulator grows with the corpus, whatever share of the documents holds a term.  The items
are a stated set of queries against all documents, in blocks.

What a bundle carries on is cut exactly.  Contributions are never negative, so the tenth best
score so far in a block only rises; a document that cannot reach it with the most that the
owners to come can add (times a term occurs in the item, its weight, and its contribution at
its largest count in the shortest text) is in no result and is left behind.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, only
A-Z lowered.  Null and empty texts have none: such documents match nothing and are not counted
in N, such items have no rows.  Repeated rows are documents (or items) of their own; of equal
scores the smaller key comes first, null keys last.  Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketflow.session import cut

OWNERS = 4
#: Documents a block holds on average, items a group holds at most, and rows an item gets.
BLOCK_DOCS, GROUP_ITEMS, BEST = 8192, 256, 10
#: Bits of the table that tells tasks which terms no item has: 2 MiB at every number of items.
TABLE_BITS = 1 << 24

_TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_LAST = (1 << 63) - 1


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall(text.translate(_LOWER)) if text else []


def _bit(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "replace")) % TABLE_BITS


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item`` (a number for each row), ``item_key``, ``term`` and how often it occurs (``times``)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, t, n) for i, k, x in zip(*(c.to_pylist() for c in batch.columns)) for t, n in Counter(terms_of(x)).items()]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()))],
                names=["item", "item_key", "term", "times"])

    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{key}`").cast("long").alias("item_key"), F.col(f"`{text}`").alias("text"))
    return numbered.mapInArrow(counted, "item long, item_key long, term string, times long")


def term_table(terms: DataFrame) -> bytes:
    """A table of ``TABLE_BITS`` bits with those of all terms set, gathered by bit numbers."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_bit(t) for t in batch.column(0).to_pylist()], type=pa.int64())], names=["bit"])

    words = terms.select("term").mapInArrow(bits, "bit long").groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("held"))
    table = np.zeros(TABLE_BITS // 64, dtype=np.int64)
    found = words.toPandas()  # at most a row for each 64 bits of the table
    table[found["word"].to_numpy(dtype=np.int64)] = found["held"].to_numpy(dtype=np.int64)
    return table.tobytes()


def bags(docs: DataFrame, table: bytes, key: str, text: str) -> DataFrame:
    """``row``, ``key``, number of terms (``n``) and, of the terms that ``table`` allows, ``terms`` with their counts (``tf``)."""
    held = docs.sparkSession.sparkContext.broadcast(table)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, dtype=np.int64)
        known: dict[str, bool] = {}
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for x in batch.column(2).to_pylist():
                found = terms_of(x)
                counts = Counter(found)
                if len(known) > 1 << 19:
                    known.clear()
                for t in counts:
                    if t not in known:
                        bit = _bit(t)
                        known[t] = bool(int(bits[bit >> 6]) >> (bit & 63) & 1)
                kept = [t for t in counts if known[t]]
                sizes.append(len(found))
                terms.append(kept)
                tfs.append([counts[t] for t in kept])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes, type=pa.int64()),
                pa.array(terms, type=pa.list_(pa.string())), pa.array(tfs, type=pa.list_(pa.int64())),
            ], names=["row", "key", "n", "terms", "tf"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(counted, "row long, key long, n long, terms array<string>, tf array<long>")


def occurrences(stored: DataFrame) -> DataFrame:
    """``row``, ``key``, ``n``, ``term`` and its count in the document."""
    return stored.select("row", "key", "n", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("row", "key", "n", "x.terms", "x.tf").withColumnRenamed("terms", "term")


def weight_of(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1)))


def div(a: Column, b: Column) -> Column:
    """Whole quotient of 64-bit integers."""
    return F.call_function("div", a, b)


def owned_terms(stored: DataFrame, items: DataFrame, n_docs: int) -> DataFrame:
    """``term``, its number, weight ``w``, owner and the most one occurrence in an item can add."""
    wanted = items.select("term").distinct()
    counted = occurrences(stored).join(wanted, "term").groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("most"))
    share = F.col("df") / F.lit(float(n_docs))
    owner = F.when(share >= 1 / 4, 3).when(share >= 1 / 32, 2).when(share >= 1 / 512, 1).otherwise(0)
    weight = weight_of(F.col("df"), n_docs)
    # m is 25 at least.
    return counted.select("term", F.monotonically_increasing_id().alias("number"), weight.alias("w"), owner.alias("owner"),
                          (weight * div(F.lit(1_000_000_000) * F.col("most"), 1000 * F.col("most") + 8 * 25)).alias("bound"))


def _add(bundles: pd.DataFrame, postings: pd.DataFrame, owner: int, best: int) -> pd.DataFrame:
    """The bundles of one block and group after an owner's stage."""
    numbers = postings["number"].to_numpy(dtype=np.int64)
    order = np.argsort(numbers, kind="stable")
    numbers, docs, keys = numbers[order], postings["row"].to_numpy(dtype=np.int64)[order], postings["ord"].to_numpy(dtype=np.int64)[order]
    adds = postings["adds"].to_numpy(dtype=np.int64)[order]
    carried = [np.asarray(x, dtype=np.int64) for x in bundles["docs"]]
    rows, first = np.unique(np.concatenate([docs, *carried]), return_index=True)
    ords = np.concatenate([keys, *[np.asarray(x, dtype=np.int64) for x in bundles["ords"]]])[first]
    places = np.searchsorted(rows, docs)
    out = []
    for plan, rest, held, scores in zip(bundles["plan"], bundles["rest"], carried, bundles["scores"]):
        total = np.zeros(len(rows), dtype=np.int64)
        total[np.searchsorted(rows, held)] = np.asarray(scores, dtype=np.int64)
        for number, times in zip(plan[0::2], plan[1::2]):
            a, b = np.searchsorted(numbers, [number, number + 1])
            total[places[a:b]] += times * adds[a:b]  # a document holds a term once
        kept = np.flatnonzero(total)
        if len(kept) > best:
            tenth = np.partition(total[kept], len(kept) - best)[len(kept) - best]
            kept = kept[total[kept] + int(rest[owner]) >= tenth]
        if owner == OWNERS - 1 and len(kept) > best:
            kept = kept[np.lexsort((rows[kept], ords[kept], -total[kept]))[:best]]
        out.append((rows[kept], ords[kept], total[kept]))
    done = bundles[["item", "block", "part", "rest"]].copy()
    done["docs"], done["ords"], done["scores"] = ([x[i] for x in out] for i in range(3))
    return done


_BUNDLE = "item long, block long, part long, rest array<long>, docs array<long>, ords array<long>, scores array<long>"


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           best: int = BEST) -> DataFrame:
    """For each row of ``items`` its ``best`` documents of score above 0: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    asked = cut(item_terms(items, item_key, item_text), "items")
    stored = cut(bags(docs, term_table(asked), key, text), "bags", "zstd")
    n_docs, total = stored.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return _ranked(_none(docs), best)
    terms = cut(owned_terms(stored, asked, n_docs), "terms")
    blocks = -(-n_docs // BLOCK_DOCS)
    plans = cut(_plans(asked, terms), "plans")
    m = F.lit(25).cast("long") + div(F.lit(75).cast("long") * F.col("n") * F.lit(n_docs).cast("long"), F.lit(total).cast("long"))
    adds = F.col("w") * div(F.lit(1_000_000_000).cast("long") * F.col("tf"), 1000 * F.col("tf") + 8 * m)
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    wanted = cut(plans.select("part", F.explode("numbers").alias("number")).distinct(), "wanted")
    bundles = plans.select(
        "item", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "part", "rest",
        *[F.array().cast("array<long>").alias(c) for c in ("docs", "ords", "scores")])
    for owner in range(OWNERS):
        mine = terms.filter(F.col("owner") == owner).join(wanted, "number").select("part", "term", "number", "w")
        postings = occurrences(stored).join(mine, "term").filter("w > 0").select(
            block.alias("block"), "part", "number", "row", F.coalesce("key", F.lit(_LAST)).alias("ord"), adds.alias("adds"))
        planned = bundles.join(plans.select("item", F.col("plans")[owner].alias("plan")), "item")
        bundles = planned.groupBy("block", "part").cogroup(postings.groupBy("block", "part")).applyInPandas(_stage(owner, best), _BUNDLE)
    found = bundles.select("item", F.explode(F.arrays_zip("docs", "scores")).alias("x")).select(
        "item", F.col("x.docs").alias("row"), F.col("x.scores").alias("score"))
    # Keys stay out of pandas, which would turn those beside a null into doubles.
    keys = asked.select("item", "item_key").distinct()
    return _ranked(cut(found, "found").join(stored.select("row", "key"), "row").join(keys, "item"), best)


def _stage(owner: int, best: int):  # noqa: ANN202
    def added(bundles: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        return _add(bundles, postings, owner, best)

    return added


def _plans(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each item: its part, its terms' numbers, by owner a list of number and times in turn, and what later owners can add."""
    size = F.lit(GROUP_ITEMS).cast("long")
    whole = asked.join(terms, "term")
    per_owner = [F.flatten(F.sort_array(F.collect_list(F.when(F.col("owner") == o, F.array("number", "times"))))) for o in range(OWNERS)]
    later = [F.coalesce(F.sum(F.when(F.col("owner") > o, F.col("times") * F.col("bound"))), F.lit(0)).cast("long") for o in range(OWNERS)]
    grouped = whole.groupBy("item").agg(
        F.array(*per_owner).alias("plans"), F.array(*later).alias("rest"), F.collect_list("number").alias("numbers"))
    # Items are numbered by partition and place in it, so whole quotients are parts of consecutive items.
    return grouped.withColumn("part", F.floor(F.col("item") / size).cast("long"))


def _none(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], "item long, item_key long, row long, score long, key long")


def _ranked(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select(
        F.col("item_key").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("key").alias("doc_id"), "score")
