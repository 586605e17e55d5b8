"""Quality scores by a factorisation machine.

Inputs of a row are the shares of its hashed words, statistics of its structure and its
stated length.  The score is the logistic of

    bias + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)

where the last term is all pairwise interactions of rank ``FACTORS``, in linear time.

The machine is fitted on at most ``SAMPLE_ROWS`` labelled rows, the first in the order of
a hash of their id, with their whole texts; scores read every row and whole texts.
Null texts count as empty, a null length as the text's own.  Rows with a null label are
not learned from; repeated ids count as they come.  Without labelled rows every score is
one half; with one class only, the score still follows that class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.llm.common import chunks, fold_of, with_row, words_of

#: Labelled rows that a fit reads at most; bounds what reaches the driver.
SAMPLE_ROWS = 4000
WORD_BUCKETS = 2048
FACTORS = 8
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 256, 0.02, 1e-4, 7

_MARKS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@~^", b"|", b"!", b"\n", b".,"]
STATISTICS = 14


def statistics_and_words(texts: list[str | None], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Structure statistics (a row of ``STATISTICS`` numbers) and the shares of hashed words, both per text."""
    n = len(texts)
    stats = np.zeros((n, STATISTICS))
    hashed, counts, repeats = [], np.zeros(n, dtype=np.int64), np.zeros(n)
    crc = zlib.crc32
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "replace") if text else b""
        words = words_of(text)
        codes = np.fromiter(map(crc, words), dtype=np.int64, count=len(words))
        hashed.append(codes % WORD_BUCKETS)
        counts[i] = len(words)
        repeats[i] = float((codes[1:] == codes[:-1]).mean()) if len(words) > 1 else 0.0
        size = max(1, len(raw))
        stats[i, :7] = [(len(raw) - len(raw.translate(None, mark))) / size for mark in _MARKS]
        stats[i, 7] = np.log1p(len(raw))
        stats[i, 8] = np.log1p(lengths[i]) if lengths[i] >= 0 else np.log1p(len(text or ""))
    owner = np.repeat(np.arange(n), counts)
    flat = np.concatenate(hashed) if hashed else np.zeros(0, dtype=np.int64)
    words = np.bincount(owner * WORD_BUCKETS + flat, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
    total = np.maximum(counts, 1)
    shares = (words / total[:, None]).astype(np.float32)
    stats[:, 9] = np.log1p(counts)
    stats[:, 10] = np.expm1(stats[:, 7]) / total
    stats[:, 11] = shares.max(axis=1, initial=0.0)
    stats[:, 12] = (words > 0).sum(axis=1) / np.minimum(total, WORD_BUCKETS)
    stats[:, 13] = repeats
    return stats, shares


@dataclass
class Machine:
    """A fitted machine; its size does not depend on the data."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    word_scale: float = 8.0

    def inputs(self, stats: np.ndarray, shares: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -6, 6).astype(np.float32)
        return np.hstack([scaled / 2, np.sqrt(shares) * self.word_scale / 8])

    def logits(self, x: np.ndarray) -> np.ndarray:
        summed = x @ self.factors
        return self.bias + x @ self.weights + 0.5 * (summed**2 - (x * x) @ (self.factors**2)).sum(axis=1)

    def score(self, texts: list[str | None], lengths: np.ndarray) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in chunks(texts):
            out[a:b] = self.logits(self.inputs(*statistics_and_words(texts[a:b], lengths[a:b])))
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(stats: np.ndarray, shares: np.ndarray, labels: np.ndarray) -> Machine:
    """Adam on the logistic loss over mini-batches; the same rows give the same machine."""
    width = STATISTICS + WORD_BUCKETS
    rng = np.random.default_rng(SEED)
    spread = stats.std(axis=0) if len(stats) else np.ones(STATISTICS)
    machine = Machine(
        0.0, np.zeros(width, dtype=np.float32), rng.normal(0, 0.05, (width, FACTORS)).astype(np.float32),
        stats.mean(axis=0) if len(stats) else np.zeros(STATISTICS), np.where(spread > 1e-9, spread, 1.0),
    )
    if not len(labels):
        machine.factors[:] = 0
        return machine
    x, y = machine.inputs(stats, shares), labels.astype(np.float32)
    rate_of_ones = (y.sum() + 0.5) / (len(y) + 1)
    machine.bias = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    slots = [np.array([machine.bias], dtype=np.float32), machine.weights, machine.factors]
    first, second, step = [np.zeros_like(s) for s in slots], [np.zeros_like(s) for s in slots], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for start in range(0, len(y), BATCH):
            rows = order[start : start + BATCH]
            xb, step = x[rows], step + 1
            machine.bias = float(slots[0][0])
            error = (1 / (1 + np.exp(-np.clip(machine.logits(xb), -40, 40))) - y[rows]) / len(rows)
            summed = xb @ machine.factors
            grads = [
                np.array([error.sum()], dtype=np.float32),
                xb.T @ error + DECAY * machine.weights,
                xb.T @ (error[:, None] * summed) - ((xb * xb).T @ error)[:, None] * machine.factors + DECAY * machine.factors,
            ]
            for s, g, m, v in zip(slots, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                s -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    machine.bias = float(slots[0][0])
    return machine


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars",
          label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine fitted on a sample of the labelled rows of ``docs`` (pass only rows it may learn from)."""
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).filter("key is not null and label in (0, 1)")
    order = [F.xxhash64("key"), F.col("key"), F.col("label")]
    chosen = known.distinct().orderBy(*order).limit(sample_rows)
    size = F.col(length).cast("double") if length in docs.columns else F.lit(None).cast("double")
    rows = with_row(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), size.alias("size")), "row")

    schema = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("label", T.IntegerType()),
        T.StructField("stats", T.ArrayType(T.DoubleType())), T.StructField("at", T.ArrayType(T.IntegerType())),
        T.StructField("share", T.ArrayType(T.FloatType())),
    ])

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, sizes = batch["text"].tolist(), batch["size"].fillna(-1).to_numpy(dtype=float)
            for a, b in chunks(texts, rows=256):
                stats, shares = statistics_and_words(texts[a:b], sizes[a:b])
                at = [np.flatnonzero(r) for r in shares]
                yield pd.DataFrame({
                    "key": batch["key"].iloc[a:b], "label": batch["label"].iloc[a:b], "stats": list(stats),
                    "at": [i.astype(np.int32) for i in at], "share": [r[i] for r, i in zip(shares, at)],
                })

    # the chosen ids are at most sample_rows, so they may be sent to every task
    # an id may have many rows: one is taken for each chosen label
    firsts = rows.select("row", "key").join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min("row").alias("row")).select("row", "label")
    measured_rows = rows.join(F.broadcast(firsts), "row").select(
        "key", F.col("label").cast("int").alias("label"), "text", "size").mapInPandas(measured, schema)
    found = measured_rows.orderBy(*order).limit(sample_rows).collect()
    stats = np.array([r["stats"] for r in found], dtype=float).reshape(len(found), STATISTICS)
    shares = np.zeros((len(found), WORD_BUCKETS), dtype=np.float32)
    for i, r in enumerate(found):
        shares[i, r["at"]] = r["share"]
    return fit(stats, shares, np.array([r["label"] for r in found], dtype=np.float32))


def score(machine: Machine, text: Column, length: Column) -> Column:
    """The score of each row, from 0 to 1."""

    @F.pandas_udf(T.DoubleType())
    def quality(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sizes in batches:
            yield pd.Series(machine.score(texts.tolist(), sizes.fillna(-1).to_numpy(dtype=float)))

    return quality(text, length.cast("double"))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """One row per document: ``held_out`` rows (fold 0) are never learned from."""
    rows = docs.select("doc_id", "text", "n_chars", (fold_of(F.col("doc_id"), folds) == 0).alias("held_out"))
    machine = learn(rows.filter("not held_out"), labels.filter(fold_of(F.col("doc_id"), folds) != 0))
    return rows.select("doc_id", "held_out", score(machine, F.col("text"), F.col("n_chars")).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; the machine learns from their labelled rows."""
    machine = learn(docs, labels)
    length = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.filter(score(machine, F.col("text"), length) >= threshold)
