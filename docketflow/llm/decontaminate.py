"""Benchmark items found in training texts: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lowered.  Every run of three words of an item is a
possible seed.  From the counts of the items' words over the whole corpus comes the number
of places where a seed would stand by chance; an item's seeds are the rarer half of its runs
and all that chance would not give once, so that each item keeps seeds however often it was
copied.  Texts that hold a seed meet the items of that seed, and each such pair is aligned
word by word over the whole text: a match earns 2, a mismatch or a gap costs 1.  The
similarity is the best local score over that of a full match of the item.

Texts are filtered by a bit table whose size follows the items up to ``MAX_BITS``; beyond
that it lets more texts through, and the join on seeds stays exact.  Texts with the same
seeds are looked up once, so a passage held by a third of all texts costs one lookup.

Null and empty texts hold nothing.  Items of fewer than three words have no seed and match
nothing.  Repeated rows and items are matched on their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.llm.common import chunks, splitmix
from docketflow.session import cut

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, 1
SIMILARITY = 0.5
CHANCE = 1.0
BITS_PER_ENTRY, MIN_BITS, MAX_BITS, BLOCK_BITS = 256, 1 << 16, 1 << 25, 1 << 16

_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Letters and digits of a text as lowered words; punctuation separates."""
    return text.lower().encode("utf-8", "replace").translate(_KEEP).split() if text else []


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))


def gram_codes(codes: np.ndarray) -> np.ndarray:
    """A code for each run of three words; none for fewer words."""
    if len(codes) < GRAM:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = sum(splitmix(codes[i : len(codes) - GRAM + 1 + i] + np.uint64((i + 1) << 40)) for i in range(GRAM))
        return splitmix(total)


class BitTable:
    """A Bloom filter with three probes."""

    def __init__(self, entries: int) -> None:
        self.size = min(MAX_BITS, max(MIN_BITS, 1 << max(0, entries * BITS_PER_ENTRY - 1).bit_length()))
        self.bits = np.zeros(self.size, dtype=bool)
        self.mask = np.uint64(self.size - 1)

    def probes(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        mixed = splitmix(codes)
        yield mixed & self.mask
        yield (mixed >> np.uint64(20)) & self.mask
        yield (mixed >> np.uint64(37)) & self.mask

    def add(self, codes: np.ndarray) -> BitTable:
        for at in self.probes(codes):
            self.bits[at] = True
        return self

    def found(self, codes: np.ndarray) -> np.ndarray:
        """Places of the codes that may be entries."""
        at = np.arange(len(codes))
        for shift in (0, 20, 37):
            at = at[self.bits[(splitmix(codes[at]) >> np.uint64(shift)) & self.mask]]
        return at


def bit_table(codes: DataFrame, code: str) -> BitTable:
    """A table of the distinct codes of ``codes``, built from its set positions.

    The positions are made and packed by Spark; what reaches the driver is one string of
    bits for each block of positions, ``MAX_BITS`` bits in all at most.
    """
    entries = codes.select(code).distinct().count()
    table = BitTable(entries)

    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch[code].to_numpy(dtype=np.int64).view(np.uint64)
            yield pd.DataFrame({"at": np.unique(np.concatenate(list(table.probes(own)))).astype(np.int64)})

    def packed(block: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BLOCK_BITS, dtype=bool)
        bits[block["at"].to_numpy() % BLOCK_BITS] = True
        return pd.DataFrame({"block": block["block"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    set_bits = codes.select(code).mapInPandas(positions, "at long").distinct()
    blocks = set_bits.withColumn("block", F.floor(F.col("at") / BLOCK_BITS)).groupBy("block").applyInPandas(packed, "block long, bits binary")
    for block, bits in blocks.collect():
        table.bits[block * BLOCK_BITS : (block + 1) * BLOCK_BITS] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
    return table


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local score of two sequences of codes and the place in ``text`` where it ends.

    One step for each symbol of ``item`` over all of ``text``; gaps along the text are a
    running maximum.
    """
    if not len(item) or not len(text):
        return 0, -1
    slope = np.arange(len(text) + 1, dtype=np.int32) * GAP
    row = np.zeros(len(text) + 1, dtype=np.int32)
    best, end = 0, -1
    for symbol in item:
        step = np.where(text == symbol, MATCH, MISMATCH)
        new = np.maximum(row - GAP, 0)
        np.maximum(new[1:], row[:-1] + step, out=new[1:])
        row = np.maximum.accumulate(new + slope) - slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at - 1
    return best, end


def aligned(item: list[bytes], text: list[bytes]) -> tuple[float, int, int]:
    """Similarity, and first and last word of the passage in ``text``."""
    number: dict[bytes, int] = {}
    a = np.array([number.setdefault(w, len(number)) for w in item], dtype=np.int64)
    b = np.array([number.get(w, -1) for w in text], dtype=np.int64)
    # the recursion steps along its first argument, so the shorter sequence goes there
    if len(a) <= len(b):
        score, end = smith_waterman(a, b)
        back, start = smith_waterman(a[::-1], b[: end + 1][::-1])
        first = end - start if back else -1
    else:
        score, _ = smith_waterman(b, a)
        first, end = 0, len(b) - 1
    return score / (MATCH * max(1, len(a))), first, end


_SEEDS = "item long, at long, gram long, first long, second long, third long"


def item_grams(items: DataFrame, item: str, text: str) -> DataFrame:
    """Every run of three words of every item: its place, its code and the codes of its words."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, words in zip(batch[item], map(plain_words, batch[text])):
                codes = word_codes(words)
                n = max(0, len(codes) - GRAM + 1)
                yield pd.DataFrame({
                    "item": np.full(n, row), "at": np.arange(n), "gram": gram_codes(codes).view(np.int64),
                    **{name: codes[i : n + i].astype(np.int64) for i, name in enumerate(("first", "second", "third"))},
                })

    return items.select(item, text).mapInPandas(runs, _SEEDS)


def word_counts(docs: DataFrame, text: str, table: BitTable) -> DataFrame:
    """``word`` (code) and ``n`` over all of ``docs`` for words of the table; code -1 counts all words."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[text].tolist()
            for a, b in chunks(texts):
                codes = word_codes([w for t in texts[a:b] for w in plain_words(t)])
                values, n = np.unique(codes[table.found(codes)], return_counts=True)
                yield pd.DataFrame({"word": np.append(values.astype(np.int64), -1), "n": np.append(n, len(codes))})

    return docs.select(text).mapInPandas(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rare_seeds(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """The runs that serve as seeds, by how often chance would give them."""
    total = counts.filter("word = -1").agg(F.max("n")).first()[0] or 0
    n = max(1, total)
    chances = grams
    for name in ("first", "second", "third"):
        own = counts.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
        chances = chances.join(own, name, "left")
    share = [F.coalesce(F.col(f"n_{w}"), F.lit(0)) / F.lit(float(n)) for w in ("first", "second", "third")]
    expected = share[0] * share[1] * share[2] * F.lit(float(n))
    kept = chances.withColumn("expected", expected)
    middle = kept.groupBy("item").agg(F.expr("percentile(expected, 0.5)").alias("middle"))
    return kept.join(middle, "item").filter((F.col("expected") <= F.col("middle")) | (F.col("expected") <= CHANCE)).select("item", "gram").distinct()


def contaminated(
    docs: DataFrame, items: DataFrame, row: str, text: str = "text", item: str = "item_id", similarity: float = SIMILARITY,
) -> DataFrame:
    """Pairs of a document row and an item whose similarity is at least ``similarity``.

    ``row`` names a column that tells rows of ``docs`` apart.  Returns it with ``item_id``,
    ``similarity`` and the passage's ``first_word`` and ``last_word``.
    """
    numbered = cut(items.select(F.col(item).alias("item_id"), F.col(text).alias("item_text"), F.monotonically_increasing_id().alias("item")), "items")
    grams = cut(item_grams(numbered, "item", "item_text"), "grams")
    words = grams.select(F.explode(F.array("first", "second", "third")).alias("word"))
    counts = cut(word_counts(docs, text, bit_table(words, "word")), "counts")
    seeds = cut(rare_seeds(grams, counts), "seeds")
    table = bit_table(seeds, "gram")

    def holding(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                own = [word_codes(plain_words(t)) for t in texts[a:b]]
                hits = []
                for codes in own:
                    all_grams = gram_codes(codes)
                    hits.append(np.unique(all_grams[table.found(all_grams)]).view(np.int64))
                keep = [i for i, h in enumerate(hits) if len(h)]
                if keep:
                    yield pd.DataFrame({
                        "row": batch["row"].iloc[a:b].iloc[keep], "text": [texts[a + i] for i in keep], "seeds": [hits[i] for i in keep]})

    held = cut(docs.select(F.col(row).cast("long").alias("row"), F.col(text).alias("text")).mapInPandas(
        holding, "row long, text string, seeds array<long>").withColumn("set", F.xxhash64("seeds")), "held")
    # texts with the same seeds are one set; sets meet items, then texts meet the items of their set
    sets = held.select("set", "seeds").dropDuplicates(["set"]).select("set", F.explode("seeds").alias("gram"))
    of_set = sets.join(seeds, "gram").select("set", "item").distinct()
    pairs = held.select("row", "set", "text").join(of_set, "set").join(numbered, "item").select("row", "text", "item_id", "item_text")

    item_type = items.schema[item].dataType.simpleString()

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [aligned(plain_words(i), plain_words(t)) for i, t in zip(batch["item_text"], batch["text"])]
            keep = np.array([s >= similarity for s, _, _ in found], dtype=bool)
            some = batch[keep]
            yield pd.DataFrame({
                "row": some["row"], "item_id": some["item_id"], "similarity": [f[0] for f, k in zip(found, keep) if k],
                "first_word": [f[1] for f, k in zip(found, keep) if k], "last_word": [f[2] for f, k in zip(found, keep) if k],
            })

    return cut(pairs.mapInPandas(scored, f"row long, item_id {item_type}, similarity double, first_word long, last_word long"), "leaks").withColumnRenamed("row", row)


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id`` and ``item_id`` of every leak in ``docs`` (a written table), with its similarity and passage."""
    own = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = contaminated(own, items, "row", similarity=similarity)
    return found.join(own.select("row", "doc_id"), "row").select("doc_id", "item_id", "similarity", "first_word", "last_word")


def keep_clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (a written table) without the rows that hold a benchmark item."""
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    numbered = docs.select(record.alias("rec"), F.monotonically_increasing_id().alias("row"))
    found = contaminated(numbered.select("row", F.col("rec.text").alias("text")), items, "row", similarity=similarity)
    return numbered.join(found.select("row").distinct(), "row", "left_anti").select("rec.*")
