"""Token ids on disk: one concatenated id array, document boundaries in Elias-Fano code.

File format.  A folder with two Parquet tables.

``segments``: one row per run of consecutive documents, in ascending document
order by (part, seg):

* ``part`` int, ``seg`` int: the place in the order;
* ``part_offset`` long: ids of the same part before this segment;
* ``doc_ids`` array<long>: the segment's documents;
* ``n_ids`` long, ``width`` int: how many ids, bytes of each (2 if every id fits, else 4);
* ``ids`` binary: the ids, little-endian and unsigned, end ids included;
* ``low_bits`` int, ``low`` binary, ``high`` binary, ``samples`` binary: the
  ends of the documents, in Elias-Fano code.

``parts``: ``part`` int, ``n_docs`` long, ``n_ids`` long, ``base`` long; the ids
before a part.  It has one row for each partition of the writing job.

A boundary takes about 2 + log2(ids / documents) bits, and a select sample of
32 bits for every 128 documents; no 64-bit offset is stored per document.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, text_key, tokenizer_path

#: Ids after which a segment is closed; a longer document has a segment of its own.
SEGMENT_IDS = 1 << 20
#: Characters that go through the library at once; a longer text goes alone.
BATCH_CHARS = 1 << 20
#: Parts up to which their offsets are broadcast (24 bytes each); beyond, they are joined by a shuffle.
MOST_BROADCAST = 1_000_000

SEGMENTS = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("part_offset", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
SEGMENTS_SQL = "part int, seg int, part_offset long, doc_ids array<long>, n_ids long, width int, ids binary, low_bits int, low binary, high binary, samples binary"


class EliasFano:
    """A non-decreasing sequence below 2^32, in 2 + log2(last / n) bits an entry, with select."""

    EVERY = 128

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, int(np.log2(last / n))) if last > n > 0 else 0
        low = np.packbits((values[:, None] >> np.arange(bits)) & 1, bitorder="little") if bits else np.zeros(0, np.uint8)
        ones = (values >> bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, low.astype(np.uint8).tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[:: cls.EVERY].astype("<u4").tobytes())

    def parts(self) -> tuple[int, bytes, bytes, bytes]:
        return self.low_bits, self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= ((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << b
        return out

    def select(self, i: int) -> int:
        """Entry i: from the sample before it, bytes are skipped by their number of ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // self.EVERY]), i % self.EVERY
        byte = at >> 3
        have = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := have.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            have = int(self.high[byte])
        for _ in range(left):
            have &= have - 1
        one = 8 * byte + (have & -have).bit_length() - 1
        return ((one - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) | self._low(np.arange(self.n))


#: White space of the library's pattern (Unicode's White_Space).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BEFORE_SPACE = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")
#: Kinds of bytes in UTF-8: white space, ASCII letters, other ASCII, bytes of other characters, and of these the first ones of white space.
_WHITE, _LETTER, _OTHER, _FAR, _MAYBE = range(5)
_FAR_WHITE = [chr(c).encode() for c in range(0x80, 0x3001) if re.match(f"[{_SPACE}]", chr(c))]
_KINDS = bytes(_MAYBE if c in {x[0] for x in _FAR_WHITE} else _FAR if c > 127 else _WHITE if re.match(f"[{_SPACE}]", chr(c)) else _LETTER if chr(c).isalpha() else _OTHER for c in range(256))


def _cuts(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Where pieces of the texts that start there begin: at each start, where white space begins, and after an ASCII letter before any other ASCII character."""
    kind = np.frombuffer(bytearray(data.translate(_KINDS)), np.uint8)
    for at in np.flatnonzero(kind == _MAYBE).tolist():
        n = 2 if data[at] < 0xE0 else 3
        if data[at : at + n] in _FAR_WHITE:
            kind[at : at + n] = _WHITE
    white = kind == _WHITE
    cut = np.zeros(len(kind), bool)
    cut[1:] = white[1:] & ~white[:-1] | (kind[1:] == _OTHER) & (kind[:-1] == _LETTER)
    cut[starts[starts < len(kind)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts by the tokenizers library, end id appended.

    The library first cuts a text by a pattern of contractions, letters,
    numbers, others (each with one blank before it, if there is one) and white
    space, and works on what it has cut.  Nothing in that pattern goes on from a
    character that isn't white space to one that is, or from a letter to a
    character that is no letter, and nothing looks back.  So the ids of a text
    are those of its pieces (_cuts), each of which goes through the library once
    and is remembered; Arrow tells which pieces of a lot are equal.  A text with the string of a special token, which becomes its id
    as the library has it by default, and any text of a tokenizer with another
    pattern, goes through the library in one piece.
    """

    #: Pieces that are remembered, twice as many at most, and bytes of one.
    KNOWN, LONGEST = 400_000, 40

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.code = {2: "H", 4: "I"}[self.width]
        self.end = np.array([end_id], self.kind).tobytes()
        how = json.loads(self.tokenizer.to_str())
        pattern = {k: v for k, v in (how["pre_tokenizer"] or {}).items() if k != "trim_offsets"}
        self.in_pieces = pattern == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and how["model"]["type"] == "BPE" and not how["model"].get("dropout") and not any(how[k] for k in ("normalizer", "truncation", "padding"))
        self.special = [x["content"] for x in how["added_tokens"]]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens by their pieces; pieces of which there are too many are forgotten, those not seen for longest first."""
        raw = [x.encode() for x in texts]
        data, starts = b"".join(raw), np.cumsum([0, *map(len, raw)])
        begins = _cuts(data, starts)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)]).dictionary_encode()
        of = self._of(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = pieces.indices.to_numpy()
        # the ids of all pieces in a row: place k of a piece is place k of its ids among those of the different pieces
        ids, n = np.frombuffer(b"".join(of), self.kind), np.array([len(x) for x in of], np.int64) // self.width
        size = n[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = ids[np.repeat((np.cumsum(n) - n)[which] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        at = (self.width * ends[np.searchsorted(begins, starts)]).tolist()
        return [out[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]

    def _of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces."""
        found = list(map(self.known.get, pieces))
        missing = [p for p, i in zip(pieces, found, strict=True) if i is None]
        got = {p: self.older[p] for p in missing if p in self.older}
        new = [p for p in missing if p not in got]
        got |= zip(new, self._ids([p.decode() for p in new]), strict=True)
        if len(self.known) + len(got) > self.KNOWN:
            self.known, self.older = {}, self.known
        self.known |= got if max(map(len, got), default=0) <= self.LONGEST else {p: i for p, i in got.items() if len(p) <= self.LONGEST}
        return [got[p] if i is None else i for p, i in zip(pieces, found, strict=True)]

    def _long(self, text: str) -> bytes:
        """Ids of a long text, some of its pieces at a time."""
        out, at = [], 0
        while at < len(text):
            end = _BEFORE_SPACE.search(text, at + BATCH_CHARS)
            to = end.end() if end else len(text)
            out += self._joined([text[at:to]])
            at = to
        return b"".join(out)

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [not self.in_pieces or any(s in x for s in self.special) for x in texts]
        by_library = iter(self._ids([x for x, w in zip(texts, whole, strict=True) if w]))
        by_pieces = iter(self._joined([x for x, w in zip(texts, whole, strict=True) if not w and len(x) <= BATCH_CHARS]))
        return [(next(by_library) if w else next(by_pieces) if len(x) <= BATCH_CHARS else self._long(x)) + self.end for x, w in zip(texts, whole, strict=True)]


#: A worker's encoder serves its later tasks too.
_encoders: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end_id: int) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if (path, end_id) not in _encoders:
        _encoders.clear()
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _lots(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Some rows of (id, text) at a time, BATCH_CHARS together, or one longer text."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64))])
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(size, size[at] + BATCH_CHARS, side="right")) - 1)
        yield b.slice(at, to - at)
        at = to


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, segment_ids: int = SEGMENT_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes the texts of docs and writes them below path in ascending order of the id.

    The rows are dealt by ranges of (id, hash of the text), so neither a hot id
    nor a hot text meets in one task.  A null or empty text is the end id
    alone.  A null id comes before all others.  Repeated rows are each written;
    rows with one id follow one another in the order of their texts' hashes.
    An empty table gives empty files.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), encoder_of(tokenizer, end_id)
        ids, seqs, size, seg, offset = [], [], 0, 0, 0

        def close():
            ends = np.cumsum([len(x) // encoder.width for x in seqs])
            return batch(SEGMENTS, [part], [seg], [offset], [ids], [int(ends[-1])], [encoder.width], [b"".join(seqs)], *([x] for x in EliasFano.encode(ends).parts()))

        for b in batches:
            for some in _lots(b):
                for one, seq in zip(some.column(0).to_pylist(), encoder([x or "" for x in some.column(1).to_pylist()]), strict=True):
                    ids.append(one)
                    seqs.append(seq)
                    size += len(seq) // encoder.width
                    if size >= segment_ids:
                        yield close()
                        ids, seqs, size, seg, offset = [], [], 0, seg + 1, offset + size
        if ids:
            yield close()

    rows = documents(docs, id_col, text_col).withColumn("key", text_key(F.col("text")))
    rows = rows.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "text")
    rows.mapInArrow(encode, SEGMENTS_SQL).write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/segments")
    # one row for each partition of the job above
    parts = spark.read.schema(SEGMENTS_SQL).parquet(f"{path}/segments").groupBy("part").agg(F.sum(F.size("doc_ids")).cast("long").alias("n_docs"), F.sum("n_ids").alias("n_ids")).orderBy("part").collect()
    base, table = 0, []
    for p in parts:
        table.append((p.part, p.n_docs, p.n_ids, base))
        base += p.n_ids
    spark.createDataFrame(table, "part int, n_docs long, n_ids long, base long").coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.uint32()))])


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The stored segments with ``base``, the ids before each segment in the whole array."""
    parts = spark.read.parquet(f"{path}/parts").select("part", "base")
    if parts.count() <= MOST_BROADCAST:
        parts = F.broadcast(parts)
    return spark.read.schema(SEGMENTS_SQL).parquet(f"{path}/segments").join(parts, "part").withColumn("base", F.col("base") + F.col("part_offset"))


def _documents(b: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray, int]]:
    for r in b.to_pylist():
        ends = EliasFano(len(r["doc_ids"]), r["low_bits"], r["low"], r["high"], r["samples"]).all()
        yield r["doc_ids"], np.concatenate([[0], ends]), np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4"), r["base"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start long, n_tokens long, ids array<long>) of every stored document.

    A null or empty text has the end id alone; repeated rows have a row each;
    files of an empty table give no rows.
    """

    def decode(batches):
        for b in batches:
            for ids, ends, tokens, base in _documents(b):
                for at in range(0, len(ids), 512):
                    e = ends[at : at + 513]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 512], pa.int64()), pa.array(base + e[:-1]), pa.array(np.diff(e)), pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), pa.array(tokens[e[0] : e[-1]].astype(np.int64)))], names=["doc_id", "start", "n_tokens", "ids"])

    return segments(spark, path).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids array<long>")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, from the files alone.

    A null or empty text has the end id alone; repeated rows have a row each;
    files of an empty table give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        for b in batches:
            for ids, ends, tokens, base in _documents(b):
                raw = memoryview(tokens.tobytes())
                yield batch(schema, ids, base + ends[:-1], np.diff(ends), [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])

    return segments(spark, path).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_range(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of the whole array, as a training reader fetches them; reads only their segments.

    What is beyond the array has no ids, so files of an empty table give none.
    """
    rows = segments(spark, path).where((F.col("base") < stop) & (F.col("base") + F.col("n_ids") > start)).orderBy("base").select("base", "n_ids", "width", "ids").collect()
    got = [np.frombuffer(r.ids, f"<u{r.width}").astype(np.uint32)[max(0, start - r.base) : max(0, stop - r.base)] for r in rows]
    return np.concatenate(got) if got else np.zeros(0, np.uint32)


def document(spark: SparkSession, path: str, number: int) -> tuple[int | None, int, np.ndarray]:
    """(doc_id, start, ids) of the document of this number, from 0 in stored order; only its segment is read.

    Its place in the segment's ids is selected from the coded boundaries, the
    others of which aren't decoded.  A number that isn't there is an IndexError.
    """
    stored = spark.read.schema(SEGMENTS_SQL).parquet(f"{path}/segments")
    left = number
    for part in spark.read.parquet(f"{path}/parts").orderBy("part").toLocalIterator():
        if 0 <= left < part.n_docs:
            break
        left -= part.n_docs
    else:
        raise IndexError(number)
    own = stored.where(F.col("part") == part.part)
    for seg, size in own.select("seg", F.size("doc_ids")).orderBy("seg").toLocalIterator():
        if left < size:
            break
        left -= size
    r = own.where(F.col("seg") == seg).first()
    ends = EliasFano(size, r.low_bits, r.low, r.high, r.samples)
    a, z = ends.select(left - 1) if left else 0, ends.select(left)
    return r.doc_ids[left], part.base + r.part_offset + a, np.frombuffer(r.ids, f"<u{r.width}")[a:z].astype(np.uint32)
