"""Spelling variants of a corpus's words, found by Bloom-guided neighbourhoods.

Two words are near if they differ by exactly one inserted, deleted or replaced character.
The words of each length have a blocked Bloom filter of their own (lengths from ``LAST_LENGTH``
on share one); the filters are broadcast.  Tasks generate the edits of each word as hashes, of
each pair from one side only: deletions from the longer word, replacements from the word with
the smaller character.  An edit is written out only if the filter of its length holds its hash,
and only these rows are shuffled, to an exact join with the vocabulary, which removes what the
filters wrongly let through.

The filters have ``WORD_BITS`` bits a word but no more than ``MOST_BITS`` together: a larger
vocabulary is dealt by hash to slices, one after another with filters of their own, and all
words probe each slice.  So what is broadcast is bounded, false positives stay as rare at every
size, and no edit is left out.

A word's form is its near word of largest count, if that is at least ``TIMES`` its own (of
equal counts the first in code-point order).  Counts grow along forms, so following them
ends; the last one is the root, found by doubling the steps.

Null texts have no words, a null key counts as the empty text in a run's hash.  Repeated rows
count as often as they stand there.  Words may be of any length.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.llm.common import splitmix
from docketflow.session import cut

#: Least characters and occurrences of a word, and how much more frequent its form is.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Of the hashes of runs, one of so many marks a run that loses a character.
ONE_OF = 31
WORD_BITS, MOST_BITS = 24, 1 << 29
LAST_LENGTH = 64
LANES = 8  # of 64 bits in a filter's block; a word sets one bit in each
#: Hashes worked on at once.
AT_ONCE = 1 << 21

#: The letters of a run.
LETTERS = "A-Za-zÀ-ÿ"
_GREAT, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_LANE_FACTORS = splitmix(np.arange(101, 101 + LANES, dtype=np.uint64)) | np.uint64(1)
_LENGTH_MARK = np.uint64(0xD6E8FEB86659FD93)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n``: the words of at least ``LEAST_COUNT`` occurrences over all texts."""
    run = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"([{LETTERS}]{{{LEAST_LENGTH},}})"), 1))
    runs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), run.alias("run")).select(
        "key", F.translate("run", _GREAT, _SMALL).alias("run"))
    marked = runs.withColumn("mark", F.crc32(F.concat_ws(":", "key", "run").cast("binary"))).withColumn(
        "at", F.pmod(F.col("mark"), F.length("run").cast("long")).cast("int"))
    shorter = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    words = marked.select(F.when(F.col("mark") % ONE_OF == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Codes:
    """Words of one length as rows of code points, with the hashes of their beginnings.

    A word's hash is the sum of its characters' marks times powers of an odd number, modulo
    2^64, so that of an edited word follows from its parts.
    """

    def __init__(self, words: list[str], length: int) -> None:
        joined = "".join(words).encode("utf-32-le", "surrogatepass")
        self.points = np.frombuffer(joined, dtype="<u4").reshape(len(words), length)
        with np.errstate(over="ignore"):
            self.powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(length, _BASE, dtype=np.uint64))))
            terms = _marks(self.points) * self.powers[:length]
            self.upto = np.concatenate((np.zeros((len(words), 1), dtype=np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)), axis=1)

    @property
    def whole(self) -> np.ndarray:
        return self.upto[:, -1]


def _marks(points: np.ndarray) -> np.ndarray:
    return splitmix(points.astype(np.uint64) + np.uint64(1 << 32))


def finished(hashes: np.ndarray, length: int) -> np.ndarray:
    """Well-mixed hashes of words of ``length``."""
    with np.errstate(over="ignore"):
        return splitmix(hashes ^ (np.uint64(length) * _LENGTH_MARK))


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for length in np.unique(sizes).tolist():
        yield length, np.flatnonzero(sizes == length)


def shard_of(length: int) -> int:
    return min(length, LAST_LENGTH) - LEAST_LENGTH


def lanes_of(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The bit a hash sets in a lane of its block, as a number with that bit."""
    with np.errstate(over="ignore"):
        return np.uint64(1) << ((hashes * _LANE_FACTORS[lane]) >> np.uint64(58))


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


class Filters:
    """The filters of one slice of the vocabulary: by shard a first block and a number of blocks."""

    def __init__(self, counts: dict[int, int], number: int, slices: int) -> None:
        """``counts``: words of the whole vocabulary by shard."""
        self.number, self.slices = number, slices
        shards = max(counts, default=0) + 2
        sizes = [-(-counts.get(s, 0) * WORD_BITS // slices // (64 * LANES)) for s in range(shards)]
        self.sizes = np.array(sizes, dtype=np.int64)
        self.first = np.cumsum([0, *sizes])[:-1]
        self.table = np.zeros((0, LANES), dtype=np.uint64)

    @property
    def blocks(self) -> int:
        return int(self.sizes.sum())

    def place(self, hashes: np.ndarray, shard: int) -> np.ndarray:
        return self.first[shard] + _block(hashes, int(self.sizes[shard]))

    def here(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes belong to this slice."""
        return (hashes & np.uint64(0xFFFF)) * np.uint64(self.slices) >> np.uint64(16) == self.number

    def hold(self, hashes: np.ndarray, shard: int) -> np.ndarray:
        """The places of those hashes that may be those of words of the shard."""
        if not 0 <= shard < len(self.sizes) or not self.sizes[shard]:
            return np.zeros(0, dtype=np.int64)
        left = np.flatnonzero(self.here(hashes)) if self.slices > 1 else np.arange(len(hashes))
        for lane in range(LANES):
            some = hashes[left]
            bits = lanes_of(some, lane)
            left = left[self.table[self.place(some, shard), lane] & bits != 0]
        return left


def build(words: DataFrame, filters: Filters) -> Filters:
    """Fill the filters from ``word``: bits are joined by block in Spark, and the blocks brought together."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            blocks, hashes = [], []
            for length, places in _by_length(found):
                some = finished(Codes([found[i] for i in places], length).whole, length)
                some = some[filters.here(some)]
                blocks.append(filters.place(some, shard_of(length)))
                hashes.append(some)
            blocks, hashes = np.concatenate([np.zeros(0, dtype=np.int64), *blocks]), np.concatenate([np.zeros(0, dtype=np.uint64), *hashes])
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks), *[pa.array(lanes_of(hashes, i).view(np.int64)) for i in range(LANES)]],
                names=["block", *[f"lane{i}" for i in range(LANES)]])

    schema = ", ".join(["block long", *[f"lane{i} long" for i in range(LANES)]])
    joined = words.select("word").mapInArrow(bits, schema).groupBy("block").agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])
    rows = joined.toArrow()  # at most MOST_BITS / 512 rows
    filters.table = np.zeros((filters.blocks, LANES), dtype=np.uint64)
    at = rows.column("block").to_numpy()
    for i in range(LANES):
        filters.table[at, i] = rows.column(f"lane{i}").to_numpy().view(np.uint64)
    return filters


def edits_found(words: list[str], length: int, alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[str, str]]:
    """Words of one length with the edits of theirs that the filters let through, each once."""
    step = max(1, AT_ONCE // (length * (len(alphabet) + 1)))
    for a in range(0, len(words), step):
        some = words[a : a + step]
        codes = Codes(some, length)
        # One word may be too long to have all its places edited at once.
        span = max(1, AT_ONCE // (len(some) * (len(alphabet) + 1)))
        for first in range(0, length, span):
            places = np.arange(first, min(first + span, length))
            yield from _deleted(some, codes, length, places, filters)
            yield from _replaced(some, codes, length, places, alphabet, filters)


def _deleted(words: list[str], codes: Codes, length: int, places: np.ndarray, filters: Filters) -> Iterator[tuple[str, str]]:
    if length <= LEAST_LENGTH:
        return
    with np.errstate(over="ignore"):
        hashes = codes.upto[:, places] + (codes.whole[:, None] - codes.upto[:, places + 1]) * _BACK
    # Of equal neighbours the first goes: any of them leaves the same word.
    again = (places > 0) & (codes.points[:, places] == codes.points[:, places - 1])
    row, col = np.nonzero(~again)
    kept = filters.hold(finished(hashes[row, col], length - 1), shard_of(length - 1))
    for i, p in zip(row[kept].tolist(), places[col[kept]].tolist()):
        yield words[i], words[i][:p] + words[i][p + 1 :]


def _replaced(words: list[str], codes: Codes, length: int, places: np.ndarray, alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[str, str]]:
    marks = _marks(alphabet)
    old = codes.points[:, places]
    greater = alphabet > old[:, :, None]
    row, col, new = np.nonzero(greater)
    with np.errstate(over="ignore"):
        base = codes.whole[:, None] - _marks(old) * codes.powers[places]
        hashes = base[row, col] + marks[new] * codes.powers[places[col]]
    kept = filters.hold(finished(hashes, length), shard_of(length))
    for i, p, c in zip(row[kept].tolist(), places[col[kept]].tolist(), alphabet[new[kept]].tolist()):
        yield words[i], f"{words[i][:p]}{chr(c)}{words[i][p + 1 :]}"


def candidates(words: DataFrame, filters: Filters, alphabet: np.ndarray) -> DataFrame:
    """``a``, its count ``n_a``, and an edit ``b`` of it that may be a word of the filters' slice."""
    shared = words.sparkSession.sparkContext.broadcast(filters)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            count_of = dict(zip(found, counts))
            for length, places in _by_length(found):
                a, b = [], []
                for word, edit in edits_found([found[i] for i in places], length, alphabet, shared.value):
                    a.append(word)
                    b.append(edit)
                    if len(a) >= 1 << 16:
                        yield _rows(a, b, count_of)
                        a, b = [], []
                yield _rows(a, b, count_of)

    return words.select("word", "n").mapInArrow(probed, "a string, n_a long, b string")


def _rows(a: list[str], b: list[str], count_of: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a, type=pa.string()), pa.array([count_of[w] for w in a], type=pa.int64()), pa.array(b, type=pa.string())], names=["a", "n_a", "b"])


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of near words with their counts ``n_a``, ``n_b``, each pair once; ``words`` is a written table."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).filter("c != ''").distinct().collect()  # the letters of runs: 90 at most
    alphabet = np.sort(np.array([ord(r.c) for r in letters], dtype=np.uint32))
    shard = F.least(F.length("word"), F.lit(LAST_LENGTH)) - LEAST_LENGTH
    counts = {r.shard: r.n for r in words.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}
    slices = max(1, -(-sum(counts.values()) * WORD_BITS // MOST_BITS))
    found = None
    for number in range(slices):
        filters = build(words, Filters(counts, number, slices))
        some = candidates(words, filters, alphabet)
        found = some if found is None else found.unionByName(some)
    known = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    return found.join(known, "b")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last form reached, of every row of ``word``, ``root`` (its form); the steps double each round."""
    now = cut(forms, "forms")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word."""
    words = cut(vocabulary(docs, key, text), "words", "zstd")
    pairs = cut(near_pairs(words), "near", "zstd")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), first.alias("first"))
    formed = -F.col("first.less") >= TIMES * F.col("n")
    stated = cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("first.near")).alias("form"), F.when(formed, -F.col("first.less")).alias("form_n")), "stated")
    last = roots(stated.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return stated.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
