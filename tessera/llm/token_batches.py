"""Texts as batches of word indices, and questions that batches put to the whole corpus.

A batch holds the words of some thousands of documents: its distinct words
once, and an index for each word.  It is stored in buckets by its number, so
that joining replies to batches moves the replies alone.

An operator that has to know something about each word, pair of words or window
of the corpus lets each batch put together its distinct keys (a hot key is then
one entry a batch, however often it occurs), deals them by ranges of their hash
to tasks that see all entries of a key, and joins the replies back.  Keys are
64-bit hashes in order; replies follow that order, so they need no keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, documents

#: Words after which a batch is closed; a longer document is a batch of its own.
BATCH_WORDS = 300_000

#: Rows of texts that go to a worker at once.
TEXT_ROWS = 1000

SCHEMA = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("words", pa.binary()), ("index", pa.binary())])
SQL = "batch long, doc_ids array<long>, sizes binary, words binary, index binary"


def pack(values: np.ndarray) -> bytes:
    """Compressed, byte by byte of the values, since the high ones differ little."""
    flat = np.ascontiguousarray(values)
    planes = flat.view(np.uint8).reshape(-1, flat.itemsize).T
    return flat.dtype.str.encode().ljust(4) + zstandard.compress(planes.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    kind = np.dtype(packed[:4].decode().strip())
    planes = np.frombuffer(zstandard.decompress(packed[4:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Batch:
    """One stored batch: ``words`` (distinct), ``index`` of each word of all documents in turn, ``starts`` of the documents."""

    def __init__(self, row: dict):
        self.number, self.doc_ids = row["batch"], row["doc_ids"]
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        self.words = zstandard.decompress(row["words"]).split()
        self.index = unpack(row["index"])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    @property
    def doc(self) -> np.ndarray:
        """The document of each word, as its place in the batch."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def hashes(self) -> np.ndarray:
        """64 bits for each distinct word."""
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))


def split(column: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and the words of all, between ASCII white space; null has none."""
    texts = pc.fill_null(column, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, size = parts.flatten(), np.diff(parts.offsets.to_numpy()).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty word
    of = np.repeat(np.arange(len(size)), size)[full.to_numpy(zero_copy_only=False)]
    return np.bincount(of, minlength=len(size)), words.filter(full).cast(pa.binary())


def build(docs: DataFrame, scratch: Scratch, lower: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Batches of the words between white space of docs, A-Z in lower case if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, sizes, held, many = TaskContext.get().partitionId() << 32, [], [], [], 0

        def close():
            coded = pa.chunked_array(held, pa.binary()).combine_chunks().dictionary_encode()
            coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
            index, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            order = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")  # frequent words have small numbers
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words))
            named = b" ".join([words[i] for i in order.tolist()])
            return batch(SCHEMA, [number], [ids], [pack(np.concatenate(sizes).astype(np.int32))], [zstandard.compress(named, 1)], [pack(rank[index])])

        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                size, words = split(b.column(1), lower)
                ids += b.column(0).to_pylist()
                sizes.append(size)
                held.append(words)
                many += len(words)
                if many >= BATCH_WORDS:
                    yield close()
                    number, ids, sizes, held, many = number + 1, [], [], [], 0
        if ids:
            yield close()

    return scratch.bucketed(documents(docs, id_col, text_col).mapInArrow(run, SQL), "batches", "batch", TEXT_ROWS)


def edges(parts: int) -> np.ndarray:
    """First hash of each of so many equal ranges."""
    return np.array([-(-(i << 64) // parts) for i in range(parts)], np.uint64)


def deal(number: int, keys: np.ndarray, parts: int, *values: np.ndarray) -> Iterator[tuple[int, int, list[bytes]]]:
    """(part, batch, packed columns) of keys in order and of values beside them."""
    at = np.append(np.searchsorted(keys, edges(parts)), len(keys))
    for part in np.flatnonzero(np.diff(at)).tolist():
        own = slice(at[part], at[part + 1])
        yield part, number, [pack(v[own]) for v in (keys, *values)]


QUESTIONS = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("columns", pa.list_(pa.binary()))])
QUESTIONS_SQL = "part int, batch long, columns array<binary>"


def ask(batches: DataFrame, questions: Callable[[dict], Iterator[tuple[int, int, list[bytes]]]]) -> DataFrame:
    """The questions of each batch; the rows may have more columns than a batch, such as replies."""

    def run(rows):
        for b in rows:
            for i in range(b.num_rows):
                found = list(questions(b.slice(i, 1).to_pylist()[0]))
                if found:
                    yield batch(QUESTIONS, *[list(x) for x in zip(*found, strict=True)])

    return batches.mapInArrow(run, QUESTIONS_SQL)


def answer(questions: DataFrame, reply: Callable[[list[list[np.ndarray]], int], list[list[np.ndarray]]]) -> DataFrame:
    """(batch, part, columns): for each part, from the columns of all its batches and its number, columns for each of them.

    A part has a bounded number of entries if ``parts`` follows the corpus, as
    ``parts_for`` has it.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = reply([[unpack(c) for c in r["columns"]] for r in rows], rows[0]["part"])
        return pa.Table.from_batches([batch(QUESTIONS, [r["part"] for r in rows], [r["batch"] for r in rows], [[pack(c) for c in x] for x in out])])

    return questions.groupBy("part").applyInArrow(run, QUESTIONS_SQL)


def joined(batches: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """batches with their replies as array<struct<part, columns>>; null if a batch asked nothing."""
    own = replies.groupBy("batch").agg(F.collect_list(F.struct("part", "columns")).alias(name))
    return batches.join(own, "batch", "left")


def gathered(replies: list[dict] | None, column: int) -> np.ndarray:
    """One column of a batch's replies, in the order of the keys that it asked about."""
    rows = sorted(replies or [], key=lambda r: r["part"])
    return np.concatenate([unpack(r["columns"][column]) for r in rows]) if rows else np.zeros(0, np.int64)


def parts_for(words: int, entries: int = 2_000_000) -> int:
    return max(1, -(-words // entries))


def mixed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def sequence_hash(values: np.ndarray, at: np.ndarray | slice, length: int, factor: int) -> np.ndarray:
    """Hash of ``length`` consecutive values from each of the places."""
    out = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            own = values[at.start + j : at.stop + j] if isinstance(at, slice) else values[at + j]
            out = out * np.uint64(factor) + own
    return mixed(out)


def total_words(batches: DataFrame) -> int:
    """Words of all batches."""
    schema = pa.schema([("n", pa.int64())])

    def run(rows):
        for b in rows:
            yield batch(schema, [int(unpack(x).sum()) for x in b.column(0).to_pylist()])

    return batches.select("sizes").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
