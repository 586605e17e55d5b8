"""Token ids in files of fixed-width bit fields, readable by block and by document.

Every id takes the fewest bits that hold the largest id of its vocabulary (16 for 50,257
ids).  Bits run from the low end of each byte, so eight ids fill ``width`` whole bytes and
numpy packs and unpacks a column of eight at a time.

A file holds the ids of consecutive documents without gaps:

* payload: blocks of ``BLOCK`` ids, the last one as long as needed (to a whole byte);
* block offsets: ``n_blocks + 1`` unsigned 64-bit numbers, where each block starts in the file;
* document index: ``n_docs`` keys (signed 64-bit), ``n_docs`` bytes (1: the key is null), and
  ``n_docs + 1`` unsigned 64-bit numbers, the place of each document's first id in the file;
* trailer: ``TRAILER``, a fixed record at the end.

Documents are written in ascending order of their key over all files.  Nulls come first;
documents with one key are ordered by a hash of their text, then as they are read, so a key
that holds a large share of the rows is dealt to many tasks.  A null text is empty, and the end id alone stands for an
empty text.  Repeated rows are kept.  No rows give no files.

Tasks write under a name of their own attempt, and the list of files is a table that Spark
commits: files of lost or repeated attempts are in no list and are not read.  The folder may
be any that ``pyarrow.fs`` opens and all executors share.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm.common import chunks
from docketflow.operators.skew import running_total
from docketflow.session import cut, ensure_checkpoint_dir

MAGIC = b"IDBITS01"
BLOCK = 8192
#: A file is closed at the first document end beyond so many ids or documents.
FILE_IDS, FILE_DOCS = 1 << 25, 1 << 20
#: Parts and pieces of texts whose ids a worker remembers at most; beyond that it starts anew.
MOST_WORDS = 1_000_000
END_ID = 2
TRAILER = np.dtype([
    ("n_ids", "<u8"), ("n_docs", "<u8"), ("n_blocks", "<u8"), ("blocks_at", "<u8"), ("docs_at", "<u8"),
    ("block", "<u4"), ("width", "<u4"), ("magic", "S8"),
])
FILES = "part long, number long, path string, n_ids long, n_docs long"


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as fields of ``width`` bits, to a whole byte."""
    eights = np.zeros((-(-len(ids) // 8), 8), dtype=np.uint64)
    eights.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(eights), width), dtype=np.uint8)
    for k in range(8):
        for byte in range(k * width // 8, ((k + 1) * width - 1) // 8 + 1):
            shift = k * width - 8 * byte
            part = eights[:, k] << np.uint64(shift) if shift >= 0 else eights[:, k] >> np.uint64(-shift)
            out[:, byte] |= part.astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * width // 8)]


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed ``data``."""
    rows = -(-n // 8)
    raw = np.zeros(rows * width, dtype=np.uint8)
    given = np.frombuffer(data, dtype=np.uint8)[: rows * width]
    raw[: len(given)] = given
    raw = raw.reshape(rows, width)
    out = np.zeros((rows, 8), dtype=np.uint64)
    for k in range(8):
        for byte in range(k * width // 8, ((k + 1) * width - 1) // 8 + 1):
            shift = k * width - 8 * byte
            part = raw[:, byte].astype(np.uint64)
            out[:, k] |= part >> np.uint64(shift) if shift >= 0 else part << np.uint64(-shift)
    return (out.reshape(-1)[:n] & np.uint64((1 << width) - 1)).astype(np.uint32)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(uri))


class Writer:
    """One file under way; ids are packed as blocks fill, so memory holds a block and the index."""

    def __init__(self, uri: str, width: int) -> None:
        store, path = _store(uri)
        self.uri, self.width, self.out = uri, width, store.open_output_stream(path)
        self.keys: list[int | None] = []
        self.starts, self.blocks, self.n_ids, self.at = [0], [0], 0, 0
        self.rest = np.zeros(0, dtype=np.uint32)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        for a in range(0, len(ids), 64 * BLOCK):
            self.rest = np.concatenate((self.rest, ids[a : a + 64 * BLOCK]))
            whole = len(self.rest) // BLOCK * BLOCK
            if whole:
                self._put(self.rest[:whole])
                self.rest = self.rest[whole:]

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.out.write(data)
        step = BLOCK * self.width // 8
        self.blocks += [min(self.at + i, self.at + len(data)) for i in range(step, len(data) + step, step)]
        self.at += len(data)

    def close(self) -> tuple[str, int, int]:
        if len(self.rest):
            self._put(self.rest)
        docs_at = self.at + 8 * len(self.blocks)
        none = np.array([k is None for k in self.keys], dtype=np.uint8)
        keys = np.array([0 if k is None else k for k in self.keys], dtype="<i8")
        for part in (np.array(self.blocks, dtype="<u8"), keys, none, np.array(self.starts, dtype="<u8")):
            self.out.write(part.tobytes())
        self.out.write(np.array(
            [(self.n_ids, len(self.keys), len(self.blocks) - 1, self.at, docs_at, BLOCK, self.width, MAGIC)], dtype=TRAILER).tobytes())
        self.out.close()
        return self.uri, self.n_ids, len(self.keys)


class Reader:
    """One file: the index is read at once, ids by the blocks that hold them."""

    def __init__(self, uri: str) -> None:
        store, path = _store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.trailer = np.frombuffer(self._read(size - TRAILER.itemsize, TRAILER.itemsize), dtype=TRAILER)[0]
        if self.trailer["magic"] != MAGIC:
            raise ValueError(f"no file of packed ids: {uri}")
        self.width, self.block = int(self.trailer["width"]), int(self.trailer["block"])
        self.n_ids, self.n_docs = int(self.trailer["n_ids"]), int(self.trailer["n_docs"])

    def _read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at) if size else b""

    @cached_property
    def blocks(self) -> np.ndarray:
        return np.frombuffer(self._read(int(self.trailer["blocks_at"]), 8 * (int(self.trailer["n_blocks"]) + 1)), dtype="<u8")

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, which of them are null, and the first id of each document with the end of the last."""
        n, at = self.n_docs, int(self.trailer["docs_at"])
        return (np.frombuffer(self._read(at, 8 * n), dtype="<i8"), np.frombuffer(self._read(at + 8 * n, n), dtype=np.uint8) == 1,
                np.frombuffer(self._read(at + 9 * n, 8 * (n + 1)), dtype="<u8").astype(np.int64))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from the blocks they lie in."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        at, end = int(self.blocks[first]), int(self.blocks[last + 1])
        return unpack(self._read(at, end - at), self.width, min((last + 1) * self.block, self.n_ids) - first * self.block)[
            start - first * self.block : stop - first * self.block]

    def document(self, number: int) -> np.ndarray:
        starts = self.index[2]
        return self.ids(int(starts[number]), int(starts[number + 1]))

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary file of the ``tokenizers`` library.

    Marks of special tokens that stand in a text are ordinary text, unless ``marks`` is set.
    """

    path: str
    marks: bool = False

    @cached_property
    def tokenizer(self):  # noqa: ANN201
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(self.path)
        loaded.encode_special_tokens = not self.marks
        loaded.no_truncation()
        loaded.no_padding()
        return loaded

    @cached_property
    def merge(self):  # noqa: ANN201
        """The merges of the library on one piece, whose bytes are shown as letters."""
        return self.tokenizer.model.tokenize

    @cached_property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size()

    @cached_property
    def by_words(self) -> bool:
        """Whether a token never spans a space before a word, so that the parts between may be encoded apart.

        It holds for byte-level vocabularies with the usual pattern, which starts a piece at
        each space that a visible character follows.
        """
        form = json.loads(self.tokenizer.to_str())
        split = form["pre_tokenizer"] or {}
        return (not self.marks and form["normalizer"] is None and form["model"]["type"] == "BPE" and split.get("type") == "ByteLevel"
                and split.get("use_regex", True) and not split.get("add_prefix_space", True) and not form["model"].get("dropout"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


#: Fixed value: the pattern by which byte-level vocabularies cut a text into the pieces that are merged apart;
#: and the characters that all engines' patterns put in the same class.
PLAIN = re.compile("[!-~À-ɏ\\n]+")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Fixed rule: byte-level vocabularies show each byte as a letter, printable Latin-1 as itself and the rest from U+0100 on.
_ITSELF = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _ITSELF)}
#: Letters on which all engines' patterns agree, and signs that the pattern keeps together behind a word.
LAST_LETTER, SIGNS = "ɏ", ".,;:!?"
#: Spaces that may belong to the white space before them.
OPEN_SPACE = re.compile(" (?![!-~À-ɏ])")


def word_parts(text: str) -> list[str]:
    """A text cut before each space that an ASCII letter, digit or sign follows, or a letter from U+00C0 to U+024F.

    The space belongs to the part it starts and is left out of all parts but the first.
    """
    parts = text.split(" ")
    if not OPEN_SPACE.search(text):
        return parts
    out = parts[:1]
    for part in parts[1:]:
        if part and ("!" <= part[0] <= "~" or "À" <= part[0] <= LAST_LETTER):
            out.append(part)
        else:
            out[-1] += " " + part
    return out


class Remembered(dict):
    """Ids of strings as bytes, worked out by ``encode`` when a string is first met; at most ``MOST_WORDS`` are kept."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, string: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        found = self[string] = self.encode(string)
        return found


class Encoder:
    """Ids of texts as bytes of little-endian numbers; parts and pieces of texts that occurred before are looked up."""

    def __init__(self, vocabulary: Vocabulary, kind: str) -> None:
        self.vocabulary, self.kind, self.code = vocabulary, kind, "H" if kind == "<u2" else "I"
        self.parts, self.pieces = Remembered(self._part), Remembered(self._piece)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        whole = [t or "" for t in texts]
        if not self.vocabulary.by_words:
            return list(map(self._direct, self.vocabulary.encode(whole)))
        parted = [word_parts(t) for t in whole]
        heads = map(self._direct, self.vocabulary.encode([parts[0] for parts in parted]))
        part = self.parts.__getitem__
        return [b"".join((head, *map(part, parts[1:]))) for head, parts in zip(heads, parted)]

    def _direct(self, ids: list[int]) -> bytes:
        return (array(self.code, ids) if sys.byteorder == "little" else np.array(ids, dtype=self.kind)).tobytes()

    def _part(self, part: str) -> bytes:
        """A part with the space before it; white space that is not plain keeps the part whole."""
        word = part.rstrip(SIGNS)
        if word.isalpha() and (word.isascii() or max(word) <= LAST_LETTER):
            return self.pieces[" " + word] + self.pieces[part[len(word) :]] if len(word) < len(part) else self.pieces[" " + word]
        if PLAIN.fullmatch(part):
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(" " + part)))
        return self._direct(self.vocabulary.encode([" " + part])[0])

    def _piece(self, piece: str) -> bytes:
        return self._direct([t.id for t in self.vocabulary.merge(piece.encode().decode("latin-1").translate(SHOWN))])


@lru_cache(maxsize=1)
def encoder_of(vocabulary: Vocabulary, kind: str) -> Encoder:
    """The encoder of a worker, which goes on knowing what earlier tasks met."""
    return Encoder(vocabulary, kind)


def kind_of(vocabulary: Vocabulary, end_id: int | None) -> str:
    """Whole-byte numbers that hold every id, for the way to the files."""
    return "<u2" if highest_of(vocabulary, end_id) <= 1 << 16 else "<u4"


def highest_of(vocabulary: Vocabulary, end_id: int | None) -> int:
    return max(vocabulary.size, (end_id or 0) + 1)


def _written(folder: str, vocabulary: Vocabulary, end_id: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind, width = kind_of(vocabulary, end_id), width_of(highest_of(vocabulary, end_id))
    end = np.array([] if end_id is None else [end_id], dtype=kind).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encoder = TaskContext.get(), encoder_of(vocabulary, kind)
        part, done, writer = context.partitionId(), [], None
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                for key, ids in zip(keys[a:b], encoder.encode(texts[a:b])):
                    if writer is None:
                        writer = Writer(f"{folder}/ids-{part:06d}-{context.taskAttemptId()}-{len(done):06d}.bin", width)
                    writer.add(key, np.frombuffer(ids + end, dtype=kind).astype(np.uint32))
                    if writer.n_ids >= FILE_IDS or len(writer.keys) >= FILE_DOCS:
                        done.append(writer.close())
                        writer = None
        if writer is not None:
            done.append(writer.close())
        rows = [{"part": part, "number": i, "path": uri, "n_ids": n, "n_docs": d} for i, (uri, n, d) in enumerate(done)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("part", pa.int64()), ("number", pa.int64()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    return write


def _made(folder: str) -> None:
    store, path = _store(folder)
    store.create_dir(path, recursive=True)


def write_packed(
    docs: DataFrame, vocabulary: Vocabulary, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID
) -> DataFrame:
    """Files of packed ids in ``folder`` (one of its own in the shared folder if none is given), and their list.

    The list has ``path``, ``n_ids``, ``n_docs``, ``position`` (ascending in the order of the
    documents) and ``first_id``, the ids in all files before.  Texts are dealt out by ranges
    of keys, and a task encodes what it writes.
    """
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/docketflow/ids-{uuid.uuid4().hex}"
    _made(folder)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    files = cut(dealt.mapInArrow(_written(folder, vocabulary, end_id), FILES), "files")
    placed = files.withColumn("position", F.shiftleft("part", 24) + F.col("number")).drop("part", "number")
    return cut(running_total(placed, [], "position", {"first_id": F.col("n_ids")}), "files")


def documents_of(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, read back from its file.

    Each task reads files one after the other, and of a file ids by runs of blocks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _read_file(uri, first)

    some = max(1, min(files.count(), 1 << 16))
    return files.select("path", "first_id").repartition(some).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_file(uri: str, first: int) -> Iterator[pa.RecordBatch]:
    file = Reader(uri)
    keys, none, starts = file.index
    digests, doc, digest = np.zeros(file.n_docs, dtype=np.int64), 0, 0
    for a in range(0, file.n_ids, 64 * file.block):
        ids = file.ids(a, a + 64 * file.block).astype("<u4")
        at = a
        while doc < file.n_docs and at <= a + len(ids):
            stop = min(int(starts[doc + 1]), a + len(ids))
            digest = zlib.crc32(ids[at - a : stop - a].data, digest)
            if stop < starts[doc + 1]:
                break
            digests[doc], digest, doc, at = digest, 0, doc + 1, stop
    file.close()
    for a in range(0, file.n_docs, 1 << 16):
        b = min(a + (1 << 16), file.n_docs)
        yield pa.RecordBatch.from_arrays([
            pa.array(keys[a:b], mask=none[a:b]), pa.array(starts[a:b] + first), pa.array(starts[a + 1 : b + 1] - starts[a:b]), pa.array(digests[a:b]),
        ], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, files: DataFrame, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` over all files, to the driver: only the files and blocks that hold them are read."""
    held = files.filter((F.col("first_id") < stop) & (F.col("first_id") + F.col("n_ids") > start)).orderBy("position")
    parts = []
    for row in held.select("path", "first_id").collect():
        file = Reader(row.path)
        parts.append(file.ids(start - row.first_id, stop - row.first_id))
        file.close()
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
