"""Language of a text by a linear-chain conditional random field over its words.

A word's weights are the mean of its letter bigrams and trigrams (word ends included), its
first and last letters (affixes) and its entry in a lexicon learned from the same sample.
Transitions between the languages of neighbouring words are learned with them, on windows
of words in which texts of different languages meet, so that code-switched text can change
its label.  Forward-backward gives each word's chance of each language; the text gets the
language with the largest mean chance, ties to the first in alphabetical order.

The field is fitted on a bounded sample: ``SAMPLE_ROWS`` rows of each language in the order
of a hash of their id and row number, and of each text ``SAMPLE_WINDOWS`` windows of ``WINDOW``
words spread over the whole text; ``SAMPLE_TOTAL`` windows at most, shared among the languages.  Labels are predicted from whole texts.

A null text, and one without letters, is ``und`` with score 0.  Rows with a null language or
id are not learned from.  If nothing can be learned every text is ``und``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.llm.chains import Chains
from docketflow.llm.common import chunks, fold_of, key_text, with_row
from docketflow.operators.skew import first_per_group

SAMPLE_ROWS, SAMPLE_WINDOWS, WINDOW, SAMPLE_TOTAL = 300, 12, 48, 20_000
GRAMS = 1 << 14
GRAM_WEIGHT = 6.0
SWITCHED = 0.3  # of the windows in which another text takes over midway
ROUNDS, RATE, DECAY, SEED = 60, 0.15, 1e-4, 11
LEXICON_COUNT, LEXICON_SHARE = 3, 0.9
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


class WordGrams:
    """Hashed letter groups of a list of different words, as flat arrays."""

    def __init__(self, vocabulary: list[str]) -> None:
        raw = np.frombuffer((" " + " ".join(vocabulary) + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.int64)
        gaps = np.flatnonzero(raw == 32)  # one before each word and one at the end
        first, last = gaps[:-1], gaps[1:]
        owner = np.searchsorted(gaps, np.arange(len(raw)), side="right") - 1
        two = (raw[:-1] * 257 + raw[1:]) * 31 % GRAMS
        three = ((raw[:-2] * 257 + raw[1:-1]) * 257 + raw[2:]) * 61 % GRAMS
        inside = raw[1:-1] != 32  # a trigram may start or end with a word end, but not hold one inside
        at2, at3 = np.arange(len(two)), np.flatnonzero(inside)
        word2 = owner[at2]
        # pairs are counted to the word of their first letter or the word end before it
        codes = np.concatenate([two, three[at3]])
        words_of_codes = np.concatenate([word2, owner[at3]])
        by_word = np.argsort(words_of_codes, kind="stable")
        self.codes, self.owner = codes[by_word], words_of_codes[by_word]
        self.size = len(vocabulary)
        self.starts = np.searchsorted(self.owner, np.arange(self.size))
        self.share = GRAM_WEIGHT / np.bincount(self.owner, minlength=self.size)
        take = lambda at: raw[np.clip(at, 0, len(raw) - 1)]
        head, tail = np.full(self.size, 7), np.full(self.size, 11)
        for step in range(1, 5):  # up to four bytes from either end, within the word
            ahead, behind = first + step, last - step
            head = np.where(ahead < last, head * 257 + take(ahead), head)
            tail = np.where(behind > first, tail * 263 + take(behind), tail)
        self.affixes = np.stack([head * 17 % GRAMS, tail * 19 % GRAMS], axis=1)


@dataclass
class Field:
    """A fitted field; its size is bounded by the sample."""

    languages: list[str]
    grams: np.ndarray
    affixes: np.ndarray
    listed: np.ndarray  # weights of the lexicon's entry; the last row is for words it lacks
    lexicon: dict[str, int]
    move: np.ndarray

    def entries(self, vocabulary: list[str]) -> np.ndarray:
        return np.fromiter((self.lexicon.get(w, len(self.languages)) for w in vocabulary), dtype=np.int64, count=len(vocabulary))

    def weights(self, grams: WordGrams, entries: np.ndarray) -> np.ndarray:
        """Log weights of words x languages."""
        pooled = np.add.reduceat(self.grams[grams.codes], grams.starts, axis=0) * grams.share[:, None]
        return pooled + self.affixes[grams.affixes].sum(axis=1) + self.listed[entries]

    def chances(self, texts: list[list[str]]) -> np.ndarray:
        """Mean chance of each language over the words of each text; zeros for a text without words."""
        flat, chain, posterior = self.word_chances(texts)
        counts = np.array([len(t) for t in texts])
        return chain.sums(posterior) / np.maximum(counts, 1)[:, None] if len(flat) else np.zeros((len(texts), len(self.languages)))

    def word_chances(self, texts: list[list[str]]) -> tuple[list[str], Chains, np.ndarray]:
        """All words end to end, their chain and each word's chance of each language."""
        flat = [w for t in texts for w in t]
        chain = Chains(np.array([len(t) for t in texts], dtype=np.int64))
        if not flat:
            return flat, chain, np.zeros((0, len(self.languages)))
        vocabulary = list(dict.fromkeys(flat))
        index = dict(zip(vocabulary, range(len(vocabulary))))
        symbols = np.fromiter(map(index.__getitem__, flat), dtype=np.int64, count=len(flat))
        logs = self.weights(WordGrams(vocabulary), self.entries(vocabulary))
        emit, move = np.exp(logs - logs.max(axis=1, keepdims=True)) + 1e-12, np.exp(self.move)
        start = np.full(len(self.languages), 1 / len(self.languages))
        _, kept = chain.forward(emit, symbols, start, move)
        chain.smooth(move, kept)
        return flat, chain, chain.in_order(kept)


def stitched(windows: list[tuple[str, list[str]]], rng: np.random.Generator) -> list[list[tuple[str, str]]]:
    """Sequences of (word, language): each window, some cut midway and carried on by another one."""
    out = []
    for language, own in windows:
        cut_at = int(rng.integers(1, len(own))) if len(own) > 1 and rng.random() < SWITCHED else len(own)
        pairs = [(w, language) for w in own[:cut_at]]
        if cut_at < len(own):
            other, more = windows[int(rng.integers(len(windows)))]
            pairs += [(w, other) for w in more[cut_at:]]
        out.append(pairs)
    return out


def fit(windows: list[tuple[str, list[str]]]) -> Field | None:
    """Adam on the conditional log-likelihood of whole sequences; the same windows give the same field."""
    windows = [w for w in windows if w[1]]
    if not windows:
        return None
    languages = sorted({language for language, _ in windows})
    number, size = {name: i for i, name in enumerate(languages)}, len(languages)
    counts: dict[str, Counter] = defaultdict(Counter)
    for language, own in windows:
        for w in own:
            counts[w][number[language]] += 1
    lexicon = {}
    for w, c in counts.items():
        best, n = c.most_common(1)[0]
        if c.total() >= LEXICON_COUNT and n >= LEXICON_SHARE * c.total():
            lexicon[w] = best
    sequences = stitched(windows, np.random.default_rng(SEED))
    vocabulary = sorted(counts)
    index = dict(zip(vocabulary, range(len(vocabulary))))
    symbols = np.array([index[w] for s in sequences for w, _ in s])
    truth = np.array([number[language] for s in sequences for _, language in s])
    lengths = np.array([len(s) for s in sequences])
    chain, grams = Chains(lengths), WordGrams(vocabulary)
    field = Field(languages, np.zeros((GRAMS, size)), np.zeros((GRAMS, size)), np.zeros((size + 1, size)), lexicon, np.zeros((size, size)))
    entries = field.entries(vocabulary)
    follows = np.ones(len(symbols), dtype=bool)
    follows[np.cumsum(lengths) - lengths] = False
    pairs = np.flatnonzero(follows)
    seen_moves = np.bincount(truth[pairs - 1] * size + truth[pairs], minlength=size * size).reshape(size, size)
    total = len(symbols)
    slots = [field.grams, field.affixes, field.listed, field.move]
    first, second = [np.zeros_like(s) for s in slots], [np.zeros_like(s) for s in slots]
    for step in range(1, ROUNDS + 1):
        logs = field.weights(grams, entries)
        emit, move = np.exp(logs - logs.max(axis=1, keepdims=True)) + 1e-12, np.exp(field.move)
        _, kept = chain.forward(emit, symbols, np.full(size, 1 / size), move)
        expected = chain.smooth(move, kept, moves=True)
        posterior = chain.in_order(kept)
        posterior[np.arange(total), truth] -= 1
        by_word = np.stack([np.bincount(symbols, weights=posterior[:, i], minlength=len(vocabulary)) for i in range(size)], axis=1) / total
        spread = by_word * grams.share[:, None]
        grads = [
            np.stack([np.bincount(grams.codes, weights=spread[grams.owner, i], minlength=GRAMS) for i in range(size)], axis=1),
            np.stack([np.bincount(grams.affixes.ravel(), weights=np.repeat(by_word[:, i], 2), minlength=GRAMS) for i in range(size)], axis=1),
            np.stack([np.bincount(entries, weights=by_word[:, i], minlength=size + 1) for i in range(size)], axis=1),
            (expected - seen_moves) / total,
        ]
        for s, g, m, v in zip(slots, grads, first, second):
            g = g + DECAY * s
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            s -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return field


_WINDOWS = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("key", T.LongType()), T.StructField("lang", T.StringType()),
    T.StructField("at", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())),
])


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Field | None:
    """A field fitted on a bounded sample of the rows of ``docs`` with a language."""
    rows = with_row(docs.select(F.col(key).cast("long").alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")), "row")
    rows = rows.filter("lang is not null and key is not null")
    order = [F.xxhash64("key", "row"), F.col("row")]
    # at most SAMPLE_TOTAL rows, whatever the table and however many languages or rows of one id: small enough for every task
    chosen = first_per_group(rows.select("row", "key", "lang"), ["lang"], order, sample_rows).orderBy(
        "rn", *order).limit(SAMPLE_TOTAL).select("row")

    def cut_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, k, language, t in zip(batch["row"], batch["key"], batch["lang"], batch["text"]):
                own = words(t)
                places = range(0, len(own), WINDOW)
                step = max(1, -(-len(places) // SAMPLE_WINDOWS))
                taken = places[::step]
                if taken:
                    yield pd.DataFrame({
                        "row": [row] * len(taken), "key": [k] * len(taken), "lang": [language] * len(taken), "at": list(taken),
                        "turn": range(len(taken)),
                        "words": [own[a : a + WINDOW] for a in taken],
                    })

    windows = rows.join(F.broadcast(chosen), "row", "left_semi").select("row", "key", "lang", "text").mapInPandas(cut_windows, _WINDOWS)
    # languages take turns, so each has its share and what one leaves goes to the others; first windows of texts come first
    shared = first_per_group(windows, ["lang"], [F.col("turn"), *order], SAMPLE_TOTAL).orderBy("rn", "lang").limit(SAMPLE_TOTAL)
    found = shared.orderBy(*order, "at").collect()
    return fit([(r["lang"], r["words"]) for r in found])


def predict(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` for each row, from its whole text."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for a, b in chunks(texts) if field else ():
                chance = field.chances([words(t) for t in texts[a:b]])
                best = chance.argmax(axis=1)
                for i in range(b - a):
                    if chance[i, best[i]] > 0 and has_letter(texts[a + i]):
                        names[a + i], scores[a + i] = field.languages[best[i]], min(1.0, chance[i, best[i]])
            yield pd.DataFrame({key: batch["key"], "lang_pred": names, "score": scores})

    rows = docs.select(key_text(key).alias("key"), F.col(text).alias("text")).mapInPandas(labelled, schema)
    return rows.withColumn(key, F.col(key).cast(docs.schema[key].dataType))


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """One row per document; those whose fold is ``held_out`` are never learned from."""
    own = docs.select("doc_id", "text", "lang")
    fold = fold_of(F.col("doc_id"), folds)
    field = learn(own.filter(fold != held_out))
    return predict(own, field).select("doc_id", (fold == held_out).alias("held_out"), "lang_pred", "score")
