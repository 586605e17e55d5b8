"""A hidden Markov language model, trained on a whole corpus and scored exactly.

Tokens are a text's words (A-Z lowered, split at ASCII white space) and one end.  Words fall
into ``CLASSES`` classes by their first and last letters; the end has a class of its own.
Latent states move from token to token and emit classes; a class emits its words by their
counts, with a share for words never seen:

    P(word | state) = emit[state, class] * (c + 0.1) / (C + 0.1 * (V + 1))

with the word's count c, and the class's count C and number of words V.  So the model's
tables have a fixed size, while every word's own count, however many words there are, enters
its score through a join.  Baum-Welch counts are gathered over all learning rows, summed
across partitions, for ``PASSES`` passes; the first guess comes from a mixture over at most
``FIRST_ROWS`` of them.  The scaled forward recursion gives a text's exact likelihood.

Texts are read once.  They are written as blocks of about ``BLOCK_CHARS`` characters: each
row's words as places in its block's vocabulary, the classes, and the vocabulary with its
counts.  Counts over the corpus meet each block's vocabulary again, not each occurrence.

Null and empty texts are one end token.  Repeated rows count as they come.  With nothing to
learn from, every word is unknown and states are alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketflow.llm.chains import Chains
from docketflow.llm.common import fold_of, hashed_sample, key_text, words_of
from docketflow.session import cut

CLASSES, END = 4096, 0
STATES, PASSES, FIRST_ROWS, FIRST_ROUNDS, SEED = 8, 3, 400, 25, 5
BLOCK_CHARS, CHUNK_TOKENS = 8_000_000, 1_000_000
ADD = 0.1  # to every count, as in the base score

_STAGED = (
    "block long, row long, key string, held boolean, places binary, classes binary, words array<string>, counts array<long>"
)


def word_class(word: bytes) -> int:
    return 1 + zlib.crc32(word[:2] + b" " + word[-3:]) % (CLASSES - 1)


def stage(docs: DataFrame, key: str, text: str, held: str) -> DataFrame:
    """Blocks, written once: a row for each document, and one for each block with its vocabulary.

    A block's vocabulary counts the words of its learning rows; others are listed with zero.
    """

    def flush(block: int, rows: list[tuple], texts: list[list[bytes]]) -> pd.DataFrame:
        flat = [w for words in texts for w in words]
        vocabulary = list(dict.fromkeys(flat))
        index = dict(zip(vocabulary, range(len(vocabulary))))
        places = np.fromiter(map(index.__getitem__, flat), dtype="<i4", count=len(flat))
        of_class = np.fromiter(map(word_class, vocabulary), dtype="<u2", count=len(vocabulary))
        lengths = np.array([len(words) for words in texts])
        learns = np.repeat([not r[2] for r in rows], lengths)
        counts = np.bincount(places[learns], minlength=len(vocabulary))
        ends = np.cumsum(lengths)
        end = np.array([END], dtype="<u2").tobytes()
        own = [places[b - n : b] for b, n in zip(ends, lengths)]
        return pd.DataFrame({
            "block": [block] * (len(rows) + 1), "row": pd.array([r[0] for r in rows] + [None], dtype="Int64"), "key": [r[1] for r in rows] + [None],
            "held": [r[2] for r in rows] + [None], "places": [p.tobytes() for p in own] + [None],
            "classes": [of_class[p].tobytes() + end for p in own] + [None],
            "words": [None] * len(rows) + [[w.decode("utf-8", "replace") for w in vocabulary]],
            "counts": [None] * len(rows) + [counts.tolist()],
        })

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 24
        rows, texts, size = [], [], 0
        for batch in batches:
            for row, k, h, t in zip(batch["row"], batch["key"], batch["held"], batch["text"]):
                rows.append((row, k, bool(h)))
                texts.append(words_of(t))
                size += len(t or "")
                if size >= BLOCK_CHARS or len(rows) >= 1 << 16:
                    yield flush(number, rows, texts)
                    rows, texts, size, number = [], [], 0, number + 1
        if rows:
            yield flush(number, rows, texts)

    own = docs.select(F.monotonically_increasing_id().alias("row"), key_text(key).alias("key"), F.col(held).alias("held"), F.col(text).alias("text"))
    return cut(own.mapInPandas(blocks, _STAGED), "blocks", "zstd")


def vocabulary_counts(staged: DataFrame) -> DataFrame:
    """Each block's words (as places) with their class, own count and count over the corpus, written once.

    ``first`` marks one row of each different word.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, words, counts in zip(batch["block"], batch["words"], batch["counts"]):
                for a in range(0, len(words), 1 << 16):
                    part = list(words[a : a + (1 << 16)])
                    yield pd.DataFrame({
                        "block": block, "place": np.arange(a, a + len(part), dtype=np.int32), "word": part,
                        "class": np.array([word_class(w.encode("utf-8", "replace")) for w in part], dtype=np.int32), "n": counts[a : a + len(part)],
                    })

    rows = staged.filter("words is not null").select("block", "words", "counts").mapInPandas(
        listed, "block long, place int, word string, class int, n long")
    same = Window.partitionBy("word")
    return cut(rows.select(
        "block", "place", "class", "n", F.sum("n").over(same).alias("c"),
        (F.row_number().over(same.orderBy("block")) == 1).alias("first"),
    ), "vocabulary", "zstd")


@dataclass
class Totals:
    """What the scores need of the corpus as a whole."""

    tokens: int  # N: all learning tokens, ends included
    words: int  # V: different ones, the end included if there is any
    ends: int
    class_log: np.ndarray  # log10 of C + 0.1 (V + 1) by class


def totals(staged: DataFrame, vocabulary: DataFrame) -> Totals:
    ends = staged.filter("row is not null and not held").count()
    rows = vocabulary.groupBy("class").agg(F.sum("n").alias("n"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("v")).collect()
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rows:
        n[r["class"]], v[r["class"]] = r["n"], r["v"]
    return Totals(int(n.sum()) + ends, int(v.sum()) + (ends > 0), ends, np.log10(n + ADD * (v + 1)))


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states


def _normal(a: np.ndarray, axis: int) -> np.ndarray:
    return a / a.sum(axis=axis, keepdims=True)


def first_model(texts: list[np.ndarray], states: int = STATES) -> Model:
    """A mixture of class distributions over some texts, made into states that tend to stay."""
    rng = np.random.default_rng(SEED)
    counts = np.zeros((len(texts), CLASSES))
    for i, t in enumerate(texts):
        counts[i] = np.bincount(t, minlength=CLASSES)
    overall = counts.sum(axis=0) + ADD
    share = rng.dirichlet(np.ones(states), len(texts)) if len(texts) else np.zeros((0, states))
    if len(texts):  # texts far from one another start the states
        profile = np.sqrt(_normal(counts + 1e-9, 1))
        chosen = [int(counts.sum(axis=1).argmax())]
        while len(chosen) < min(states, len(texts)):
            chosen.append(int((profile @ profile[chosen].T).max(axis=1).argmin()))
        nearest = (profile @ profile[chosen].T).argmax(axis=1)
        share = 0.1 / states + 0.9 * np.eye(states)[nearest]
    for _ in range(FIRST_ROUNDS if len(texts) else 0):
        emit = _normal(share.T @ counts + 0.5 * overall / overall.sum() * 100, 1)
        logs = counts @ np.log(emit).T + np.log(share.mean(axis=0) + 1e-6)
        logs /= 1 + counts.sum(axis=1, keepdims=True) / 50  # keeps long texts from deciding alone
        share = _normal(np.exp(logs - logs.max(axis=1, keepdims=True)), 1)
    emit = _normal(share.T @ counts + 0.5 * overall / overall.sum() * 100, 1).T
    return Model(np.full(states, 1 / states), _normal(np.full((states, states), 0.05 / states) + 0.95 * np.eye(states), 1), emit)


def _chunks(texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Places of texts handled together, longest first: a recursion takes as many steps as its longest text has."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    start, size = 0, 0
    for i, n in enumerate(lengths[order].tolist()):
        if i > start and size + n > CHUNK_TOKENS:
            yield order[start:i]
            start, size = i, 0
        size += n
    if len(order):
        yield order[start:]


def expected_counts(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of starts, moves and emissions over some texts of classes."""
    states = len(model.start)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states))
    e, m = model.emit.astype(np.float32), model.move.astype(np.float32)
    for places in _chunks(texts):
        part = [texts[i] for i in places]
        chain, symbols = Chains(np.array([len(t) for t in part])), np.concatenate(part).astype(np.int64)
        _, kept = chain.forward(e, symbols, model.start.astype(np.float32), m)
        move += chain.smooth(m, kept, moves=True)
        start += kept[: len(part)].sum(axis=0)  # the first step holds every text
        posterior = chain.in_order(kept)
        for k in range(states):
            emit[:, k] += np.bincount(symbols, weights=posterior[:, k], minlength=CLASSES)
    return start, move, emit


def classes_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2")


def baum_welch(learning: DataFrame, model: Model) -> Model:
    """One pass over all rows of ``learning`` (their ``classes``): counts by partition, summed by Spark."""
    states = len(model.start)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            found = expected_counts(model, [classes_of(c) for c in batch["classes"]])
            total = found if total is None else tuple(a + b for a, b in zip(total, found))
        if total is not None:
            flat = np.concatenate([a.ravel() for a in total])
            at = np.flatnonzero(flat > 1e-9)
            yield pd.DataFrame({"at": at, "n": flat[at]})

    rows = learning.select("classes").mapInPandas(counted, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(states + states * states + CLASSES * states)
    flat[rows["at"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    start, move, emit = np.split(flat, [states, states + states * states])
    emit = emit.reshape(CLASSES, states)
    overall = emit.sum(axis=1, keepdims=True) + ADD
    return Model(
        _normal(start + 0.5, 0), _normal(move.reshape(states, states) + 0.5, 1),
        _normal(emit + 10 * overall / overall.sum(), 0),
    )


def train(staged: DataFrame, texts: int, passes: int = PASSES, states: int = STATES) -> Model:
    """States learned from all learning rows of written blocks; ``texts`` is their number."""
    learning = staged.filter("row is not null and not held")
    some = hashed_sample(learning.select("row", "classes"), "row", FIRST_ROWS, texts).collect()
    model = first_model([classes_of(r["classes"]) for r in some], states)
    for _ in range(passes if some else 0):
        model = baum_welch(learning, model)
    return model


def state_scores(rows: DataFrame, model: Model) -> DataFrame:
    """``row`` and ``states``: log10 likelihood of the row's classes by the forward recursion."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [classes_of(c) for c in batch["classes"]]
            logs = np.zeros(len(texts))
            for places in _chunks(texts):
                part = [texts[i] for i in places]
                chain = Chains(np.array([len(t) for t in part]))
                logs[places] = chain.forward(model.emit, np.concatenate(part).astype(np.int64), model.start, model.move)[0]
            yield pd.DataFrame({"row": batch["row"], "states": logs / np.log(10)})

    return rows.select("row", "classes").mapInPandas(scored, "row long, states double")


def word_scores(staged: DataFrame, vocabulary: DataFrame, known: Totals) -> DataFrame:
    """For each row its tokens, known tokens, base score and the words' part of the model's score."""
    schema = "row long, key string, held boolean, n_tokens long, n_known long, base double, words double"
    all_log = np.log10(known.tokens + ADD * (known.words + 1))

    def scored(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        size = int(words["place"].max()) + 1 if len(words) else 0
        log, minus, seen = np.zeros(size), np.zeros(size), np.zeros(size)
        at, c = words["place"].to_numpy(), words["c"].to_numpy(dtype=float)
        log[at], minus[at], seen[at] = np.log10(c + ADD), known.class_log[words["class"].to_numpy()], c > 0
        values = np.stack([log - all_log, log - minus, seen], axis=1)
        own = [np.frombuffer(p, dtype="<i4") for p in texts["places"]]
        lengths = np.array([len(p) for p in own], dtype=np.int64)
        flat = np.concatenate(own) if own else np.zeros(0, dtype=np.int32)
        sums = np.zeros((len(own), 3))
        full = np.flatnonzero(lengths)
        if len(full):
            starts = (np.cumsum(lengths) - lengths)[full]
            for i in range(3):
                sums[full, i] = np.add.reduceat(values[flat, i], starts)
        return pd.DataFrame({
            "row": texts["row"], "key": texts["key"], "held": texts["held"], "n_tokens": lengths + 1,
            "n_known": sums[:, 2].astype(np.int64) + (known.ends > 0), "base": sums[:, 0] + np.log10(known.ends + ADD) - all_log,
            "words": sums[:, 1],
        })

    texts = staged.filter("row is not null").select("block", "row", "key", "held", "places")
    return texts.groupBy("block").cogroup(vocabulary.select("block", "place", "class", "c").groupBy("block")).applyInPandas(scored, schema)


def score_texts(docs: DataFrame, key: str, text: str, held: str) -> DataFrame:
    """Scores of every row of ``docs``; rows where ``held`` is true are not learned from."""
    staged = stage(docs, key, text, held)
    vocabulary = vocabulary_counts(staged)
    known = totals(staged, vocabulary)
    model = train(staged, known.ends)
    states = state_scores(staged.filter("row is not null"), model)
    return word_scores(staged, vocabulary, known).join(states, "row").select(
        F.col("key").cast("long").alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known",
        F.lit(known.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("words") + F.col("states")).alias("score"))


def score_documents(docs: DataFrame, folds: int = 10) -> DataFrame:
    """One row per document; those of fold 0 are held out."""
    held = fold_of(F.col("doc_id"), folds) == 0
    return score_texts(docs.select("doc_id", "text", held.alias("held")), "doc_id", "text", "held")
