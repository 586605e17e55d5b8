"""Sampled segmentation of texts into the pieces of a public SentencePiece vocabulary.

Every way to write a text as pieces is a path through a lattice of positions.  A piece of
rank r (its order in the vocabulary) weighs (r + 1) ** -SHARPNESS, a byte as little as the
last piece; a path weighs the product of its pieces.  Forward filtering sums the weight of
all paths up to each position, backward sampling walks from the end and draws each last
piece in proportion, so whole segmentations are drawn by their weight.

No piece of the vocabulary goes on past a word's end, so the lattice of a text falls into
those of its words (with the spaces before them), and a word met again is not filtered again.  The draw of a step is a hash of the row's key, the word's number in the text
and the step: the same key and text give the same pieces in any batch, order or cluster.

Encoding puts one space before the text, as the vocabulary expects, and writes as bytes
what has no piece, line ends included; decoding is exact for every text.  A null or empty
text has no pieces and decodes to the empty text.  Repeated rows get the same pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.llm.common import chunks, key_text, splitmix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARPNESS = 1.0
SEED = 23
WORD = re.compile(r" *[^ \n]+| +|\n")
STEP_BITS = 20  # of a draw's number: steps of one word
#: Characters of text, new words and nodes of known words that a worker holds at once.
TEXTS_AT_ONCE, WORDS_AT_ONCE, MOST_NODES = 1_000_000, 20_000, 2_000_000


@dataclass
class Pieces:
    """A vocabulary as plain lists, small enough to travel with a task."""

    texts: list[bytes]  # by id; bytes of text a piece stands for
    bytes_from: int  # id of byte 0
    first: int  # id of the piece of rank 0

    def __getstate__(self) -> dict:
        """What is derived below stays where it was made."""
        return {"texts": self.texts, "bytes_from": self.bytes_from, "first": self.first}

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        """Reads the vocabulary on the driver; executors need no file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        byte_ids = [i for i in range(size) if model.is_byte(i)]
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary lacks bytes to fall back on")
        texts = [b""] * size
        for i in range(size):
            if model.is_byte(i):
                texts[i] = bytes([i - byte_ids[0]])
            elif not (model.is_control(i) or model.is_unknown(i)):
                texts[i] = model.id_to_piece(i).replace("▁", " ").encode()
        if any(re.search(rb"[^ ] |\n", t) for t in texts[byte_ids[-1] + 1 :]):
            raise ValueError("a piece goes on past a word's end")
        return cls(texts, byte_ids[0], byte_ids[-1] + 1)

    @cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray]:
        """Next node by node and byte (0: none), and the piece that ends at a node (-1: none)."""
        number: dict[bytes, int] = {b"": 0}
        ends = {}
        for i in range(self.first, len(self.texts)):
            t = self.texts[i]
            for k in range(1, len(t) + 1):
                number.setdefault(t[:k], len(number))
            ends[number[t]] = i
        step = np.zeros((len(number), 256), dtype=np.int32)
        for prefix, node in number.items():
            if prefix:
                step[number[prefix[:-1]], prefix[-1]] = node
        piece = np.full(len(number), -1, dtype=np.int32)
        piece[list(ends)] = list(ends.values())
        return step, piece

    @cached_property
    def weights(self) -> np.ndarray:
        """Log weight by id."""
        rank = np.arange(len(self.texts)) - self.first
        rank[: self.first] = rank[-1] + 1
        return -SHARPNESS * np.log(rank + 1.0)


class Lattices:
    """Lattices of different words, filtered forward when a word is first met.

    Nodes are byte positions; ``first[node]`` to ``first[node + 1]`` are the edges that end
    at a node, ``back`` is the length of an edge and ``upto`` the chance of it or a shorter
    one.  Words met again are looked up; beyond ``MOST_NODES`` all are forgotten, so memory
    is bounded.  What a word's lattice holds does not depend on other words.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.begin, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.first, self.back = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
        self.piece, self.upto = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word in ``begin`` and ``size``; new ones are added."""
        if len(self.first) > MOST_NODES:
            self.forget()
        index = self.index
        new = [w for w in dict.fromkeys(words) if w not in index]
        for a in range(0, len(new), WORDS_AT_ONCE):
            self._add(new[a : a + WORDS_AT_ONCE])
        return np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))

    def _add(self, words: list[str]) -> None:
        coded = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        begin = np.cumsum(sizes + 1) - (sizes + 1)  # a word has a node more than bytes
        first, back, piece, source = self._edges(np.frombuffer(b"".join(coded), dtype=np.uint8), sizes)
        upto = self._filter(first, source, self.pieces.weights[piece], begin, sizes)
        nodes, edges = len(self.first) - 1, len(self.piece)
        self.index.update(zip(words, range(len(self.begin), len(self.begin) + len(words))))
        self.begin, self.size = np.append(self.begin, begin + nodes), np.append(self.size, sizes)
        self.first = np.append(self.first, first[1:] + edges)
        self.back, self.piece, self.upto = np.append(self.back, back), np.append(self.piece, piece), np.append(self.upto, upto)

    def _edges(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges by the node they end at, shorter ones first: ends of each node's edges, lengths, pieces, nodes they start from."""
        step, ends_in = self.pieces.trie
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        limit = np.cumsum(sizes)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)  # first bytes of characters
        char_end = np.append(starts[1:], len(raw))
        single = np.zeros(len(starts), dtype=bool)
        nodes = len(raw) + len(sizes)
        # one group of edges for each length, so that no two edges of a group end at the same node
        groups: list[tuple[np.ndarray, int, np.ndarray]] = []
        alive, state, depth = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int32), 0
        while len(alive):
            inside = starts[alive] + depth < limit[word[starts[alive]]]
            alive, state = alive[inside], state[inside]
            state = step[state, raw[starts[alive] + depth]]
            going = np.flatnonzero(state)
            alive, state = alive[going], state[going]
            depth += 1
            found = ends_in[state]
            hit = np.flatnonzero(found >= 0)
            own = alive[hit]
            groups.append((starts[own], depth, found[hit]))
            single[own[starts[own] + depth == char_end[own]]] = True
        lone = np.flatnonzero(~single)
        spread = char_end[lone] - starts[lone]
        byte_at = np.repeat(starts[lone], spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
        groups.insert(0, (byte_at, 1, self.pieces.bytes_from + raw[byte_at].astype(np.int32)))
        counts = np.zeros(nodes + 1, dtype=np.int32)
        for at, length, _ in groups:
            counts[at + word[at] + length + 1] += 1
        first = np.cumsum(counts, dtype=np.int64)
        fill = first[:-1].copy()
        back, piece = np.empty(first[-1], dtype=np.uint8), np.empty(first[-1], dtype=np.int32)
        source = np.empty(first[-1], dtype=np.int32)
        for at, length, ids in groups:
            start = at + word[at]
            slot = fill[start + length]
            fill[start + length] += 1
            back[slot], piece[slot], source[slot] = length, ids, start
        return first, back, piece, source

    @staticmethod
    def _filter(first: np.ndarray, source: np.ndarray, weight: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Forward sums, for all nodes of equal distance from their words' starts together; cumulated chances of edges."""
        nodes = len(first) - 1
        total = np.zeros(nodes)
        distance = np.arange(nodes) - np.repeat(begin, sizes + 1)
        filled = np.flatnonzero(first[1:] > first[:-1])
        by_distance = filled[np.argsort(distance[filled], kind="stable")]
        upto = np.empty(len(source), dtype=np.float32)
        for group in np.split(by_distance, np.flatnonzero(np.diff(distance[by_distance])) + 1):
            if not len(group):
                continue
            counts = first[group + 1] - first[group]
            offsets = np.cumsum(counts) - counts
            edges = np.repeat(first[group] - offsets, counts) + np.arange(counts.sum())
            value = total[source[edges]] + weight[edges]
            top = np.maximum.reduceat(value, offsets)
            part = np.exp(value - np.repeat(top, counts))
            summed = np.add.reduceat(part, offsets)
            total[group] = top + np.log(summed)
            part /= np.repeat(summed, counts)
            left, at = np.flatnonzero(counts > 1), offsets
            for nth in range(1, int(counts.max())):  # sums of one node's edges only, so they do not depend on others
                left = left[counts[left] > nth]
                part[at[left] + nth] += part[at[left] + nth - 1]
            upto[edges] = part
        return upto

    def sample(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each occurrence (its word's place and its draws' seed), end to end, and how many each has."""
        start = self.begin[words]
        node = start + self.size[words]
        active = np.flatnonzero(node > start)
        counts, taken = np.zeros(len(words), dtype=np.int64), []
        number = 0
        while len(active):
            here = node[active]
            edge, last = self.first[here], self.first[here + 1] - 1
            many = np.flatnonzero(last > edge)
            draw = (splitmix(seeds[active[many]] + np.uint64(number)) >> np.uint64(11)) * 2.0**-53
            low, top = edge[many], last[many]
            open_ = np.flatnonzero(self.upto[low] <= draw)
            while len(open_):
                low[open_] += 1
                open_ = open_[low[open_] < top[open_]]
                open_ = open_[self.upto[low[open_]] <= draw[open_]]
            edge[many] = low
            taken.append((active.astype(np.int32), self.piece[edge]))
            counts[active] += 1
            node[active] = here - self.back[edge]
            active = active[node[active] > start[active]]
            number += 1
        ends = np.cumsum(counts)
        out = np.empty(int(counts.sum()), dtype=np.int32)
        for number, (where, ids) in enumerate(taken):  # the walk goes backwards
            out[ends[where] - 1 - number] = ids
        return out, counts


def segment(texts: list[str | None], keys: np.ndarray, lattices: Lattices) -> list[np.ndarray]:
    """Piece ids of each text, drawn by its key (uint64)."""
    found = [WORD.findall(" " + t) if t else [] for t in texts]
    flat = [w for words in found for w in words]
    lengths = np.array([len(words) for words in found], dtype=np.int64)
    del found
    if not flat:
        return [np.zeros(0, dtype=np.int32)] * len(texts)
    places = lattices.places(flat)
    starts = np.cumsum(lengths) - lengths
    number = np.arange(len(flat)) - np.repeat(starts, lengths)
    del flat
    with np.errstate(over="ignore"):
        seeds = splitmix(np.repeat(splitmix(keys), lengths) + (number.astype(np.uint64) << np.uint64(STEP_BITS)))
    ids, counts = lattices.sample(places, seeds)
    ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([starts, [len(places)]])]
    return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


def joined(ids: np.ndarray | list[int] | None, pieces: Pieces) -> str:
    """The text that the pieces stand for, without the space put before it."""
    if ids is None or not len(ids):
        return ""
    return b"".join(map(pieces.texts.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _segments(texts: list[str | None], keys: np.ndarray, lattices: Lattices) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    drawn = keys.astype(np.int64).view(np.uint64)
    for a, b in chunks(texts, TEXTS_AT_ONCE):
        yield a, b, segment(texts[a:b], drawn[a:b], lattices)


def _drawn(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def encode(text: Column, key: Column, pieces: Pieces, seed: int = SEED) -> Column:
    """Sampled piece ids of a text; ``key`` decides the draws."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        lattices = Lattices(pieces)
        for texts, keys in batches:
            yield pd.Series([ids for _, _, part in _segments(texts.tolist(), keys.to_numpy(), lattices) for ids in part], dtype=object)

    return encoded(text, _drawn(key, seed))


def with_pieces(docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """``docs`` with ``piece_ids`` as by ``encode``, their number ``n_pieces`` and ``lossless``, whether they decode to the text.

    Rows pass as Arrow columns and leave in runs of about ``TEXTS_AT_ONCE`` characters, so memory does
    not follow the batch size.  Columns of these names that ``docs`` has are replaced.
    """
    added = T.StructType([
        T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType())])
    own = [f for f in docs.schema.fields if f.name not in added.names]
    place = [f.name for f in own].index(text)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(pieces)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b, found in _segments(texts, batch.column(len(own)).to_numpy(), lattices):
                sizes = np.array([len(i) for i in found], dtype=np.int64)
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
                same = pa.array([joined(i, pieces) == (t or "") for i, t in zip(found, texts[a:b])], type=pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], ids, pa.array(sizes), same], names=[f.name for f in own] + added.names)

    rows = docs.select(*[F.col(f"`{f.name}`") for f in own], _drawn(F.col(f"`{key}`"), seed))
    return rows.mapInArrow(encoded, T.StructType(own + added.fields))


def decode(ids: Column, pieces: Pieces) -> Column:
    """The text of piece ids; null and empty lists give the empty text."""

    @F.pandas_udf(T.StringType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([joined(i, pieces) for i in batch], dtype=object)

    return decoded(ids)


def encode_documents(docs: DataFrame, path: str = MODEL, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``piece_ids``, ``n_pieces`` and whether decoding gives the text back (``lossless``)."""
    pieces = Pieces.load(path)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices = Lattices(pieces)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b, ids in _segments(texts, batch["drawn"].to_numpy(), lattices):
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b], "piece_ids": ids, "n_pieces": [len(i) for i in ids],
                    "lossless": [joined(i, pieces) == (t or "") for i, t in zip(ids, texts[a:b])],
                })

    rows = docs.select(key_text("doc_id").alias("doc_id"), "text", _drawn(F.col("doc_id"), seed).alias("drawn"))
    return rows.mapInPandas(encoded, "doc_id string, piece_ids array<int>, n_pieces long, lossless boolean").withColumn("doc_id", F.col("doc_id").cast("long"))
