"""Fill-in-middle: texts cut at two boundaries of units, the middle moved to the end.

A unit starts where a predicate of two adjacent characters holds (of bytes, in
UTF-8: all that is looked for is ASCII, or tells a character's first byte), and
at the text's begin.  A long text is cut into chunks that overlap by one byte,
so a chunk tells its starts alone:

* tasks count the starts of each chunk, in parallel;
* prefix sums of the counts give the number of units, so both cut ranks, and
  the chunk that owns each;
* only owning chunks are scanned again, for the place of the start.

A text of one chunk goes the same way without leaving its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batch, documents, texts

#: Bytes of a chunk; a text of more is spread over tasks.
CHUNK_BYTES = 1 << 16
#: Rows that are held together as lists.
ROWS = 500
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _space(b: np.ndarray) -> np.ndarray:
    return (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))


#: Whether a unit starts at a byte, by the one before and itself.  A word has the white space that follows it.
UNITS = {
    "line": lambda before, at: before == 0x0A,
    "word": lambda before, at: _space(before) & ~_space(at),
    "char": lambda before, at: (at & 0xC0) != 0x80,
}


def starts(data: bytes, first: bool, unit: str) -> np.ndarray:
    """Which bytes of a chunk start a unit; unless it is its text's first, its own bytes have the byte before them in front."""
    b = np.frombuffer(data, np.uint8)
    held = UNITS[unit](b[:-1], b[1:])
    return np.concatenate([np.ones(min(1, len(b)), bool), held]) if first else held


def chunks(text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """Number and bytes of each chunk, with one byte before all but the first."""
    for k, at in enumerate(range(0, len(text), size)):
        yield k, text[max(0, at - 1) : at + size]


def ranks(n: int, h1: int, h2: int) -> tuple[int, int]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b)


def arranged(text: bytes, form: str, a: int, b: int) -> bytes:
    """The text in its new order, cut at bytes a and b."""
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if form == "plain":
        return text
    return s + text[b:] + p + text[:a] + m + text[a:b] if form == "spm" else p + text[:a] + s + text[b:] + m + text[a:b]


def _chars(b: np.ndarray) -> int:
    return int(np.count_nonzero((b & 0xC0) != 0x80))


OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
OUT_SQL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _row(text: bytes, form: str, a: int, b: int) -> tuple[int | None, int | None, bytes]:
    if form == "plain":
        return None, None, text
    whole = np.frombuffer(text, np.uint8)
    return _chars(whole[:a]), _chars(whole[a:b]), arranged(text, form, a, b)


def _finish(ids: pa.Array, n: list, form: list, rows: list[tuple]) -> pa.RecordBatch:
    prefix, middle, output = zip(*rows, strict=True)
    return batch(OUT, ids, n, form, list(prefix), list(middle), pa.array(output, pa.binary()).cast(pa.string()))


def _short(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text, form, h1, h2: texts of one chunk each."""
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                counts, rows, forms = [], [], b.column(2).to_pylist()
                for text, form, h1, h2 in zip(texts(b.column(1)), forms, b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    held = starts(text, True, unit)
                    n = int(np.count_nonzero(held))
                    cuts = (0, 0)
                    if form != "plain":
                        places = np.append(np.flatnonzero(held), len(text))
                        cuts = tuple(int(places[r]) for r in ranks(n, h1, h2))
                    counts.append(n)
                    rows.append(_row(text, form, *cuts))
                yield _finish(b.column(0), counts, forms, rows)

    return run


def _cut(size: int):
    schema = pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for k, data in chunks(b.column(1)[i].as_buffer().to_pybytes(), size):
                    yield batch(schema, [b.column(0)[i].as_py()], [k], [data])

    return run


def _count(unit: str):
    schema = pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("key", pa.int64()), ("units", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = [int(np.count_nonzero(starts(data, k == 0, unit))) for k, data in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield batch(schema, b.column(0), b.column(1), b.column(2), units)

    return run


def _rescan(unit: str, size: int):
    schema = pa.schema([("row", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """row, chunk, data, and the rank in the chunk of each cut that it owns."""
        for b in batches:
            out = []
            for k, data, *rank in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                places = np.flatnonzero(starts(data, k == 0, unit)) + k * size
                out.append([None if r is None else int(places[r]) for r in rank])
            yield batch(schema, b.column(0), [x[0] for x in out], [x[1] for x in out])

    return run


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, form, n, a, b; a missing place is the text's end."""
    for b in batches:
        for i in range(b.num_rows):
            ids, text, form, n, *cuts = (c[i].as_py() for c in b.columns)
            text = text.encode()
            yield _finish(pa.array([ids], pa.int64()), [n], [form], [_row(text, form, *(len(text) if c is None else c for c in cuts))])


def _spread(scratch: Scratch, rows: DataFrame, unit: str, size: int) -> DataFrame:
    """Texts of several chunks.  Only chunks move, once; counts, ranks and places are a few numbers each."""
    long_ = scratch.bucketed(rows.withColumn("row", F.monotonically_increasing_id()), "long", "row")
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = long_.select("row", "text").mapInArrow(_cut(size), "row long, chunk int, data binary").select("row", "chunk", F.xxhash64("row", "chunk").alias("key"), "data")
    stored = scratch.bucketed(cut.repartition(parts, "key"), "chunks", "key", rows=64)
    counted = scratch.save(stored.select("row", "chunk", "key", "data").mapInArrow(_count(unit), "row long, chunk int, key long, units long"), "counts")
    least, most = F.least(F.expr("h1 % (n + 1)"), F.expr("h2 % (n + 1)")), F.greatest(F.expr("h1 % (n + 1)"), F.expr("h2 % (n + 1)"))
    wanted = counted.groupBy("row").agg(F.sum("units").alias("n")).join(long_.select("row", "h1", "h2"), "row").select("row", "n", least.alias("r1"), most.alias("r2"))
    before = F.coalesce(F.sum("units").over(Window.partitionBy("row").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    owned = lambda r: F.when((F.col(r) >= F.col("before")) & (F.col(r) < F.col("before") + F.col("units")), F.col(r) - F.col("before"))
    asked = counted.withColumn("before", before).join(wanted, "row").select("key", "row", "chunk", owned("r1").alias("q1"), owned("r2").alias("q2")).where("q1 IS NOT NULL OR q2 IS NOT NULL")
    found = stored.join(asked, ["key", "row", "chunk"]).select("row", "chunk", "data", "q1", "q2").mapInArrow(_rescan(unit, size), "row long, a long, b long").groupBy("row").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return long_.join(wanted, "row").join(found, "row", "left").select("doc_id", "text", "form", "n", "a", "b").mapInArrow(_long, OUT_SQL)


def transform(docs: DataFrame, unit: str = "line", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id long, n long, form string, prefix_chars, middle_chars long, output string.

    ``n`` units are cut at two ranks that the sha256 of "seed:id" tells, so
    reruns agree and equal ids are cut alike.  ``form`` is plain, psm or spm;
    ``output`` is the text itself, or prefix, suffix and middle behind their
    marks.  Texts that are null (they count as empty), empty, or hold a mark
    stay plain, with null lengths; so do those that fim_percent leaves out.  A
    null id counts as the id "".  Rows are cut alone: repeated rows and ties
    play no part, and other columns aren't read.  An empty table gives no
    rows.  Texts of several chunks pass through tables in the shared folder.
    """
    if unit not in UNITS:
        raise ValueError(f"a unit is one of {', '.join(UNITS)}")
    flat = documents(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    plain = (F.col("text") == "") | (number(2) % 100 >= fim_percent)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain |= F.contains("text", F.lit(mark))
    form = F.when(plain, "plain").when(number(3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = flat.select("doc_id", "text", form.alias("form"), number(0).alias("h1"), number(1).alias("h2"))
    many = F.octet_length("text") > chunk_bytes
    short = rows.where(~many).mapInArrow(_short(unit), OUT_SQL)
    return short.unionByName(_spread(Scratch(docs.sparkSession, "fim"), rows.where(many), unit, chunk_bytes))


def restored(output: Column, form: Column) -> Column:
    """The text that transform had, from its output and form: a mark can't stand in it, nor across a mark's edge."""
    first, second = F.when(form == "spm", SUFFIX).otherwise(PREFIX), F.when(form == "spm", PREFIX).otherwise(SUFFIX)
    after = lambda text, part, mark: F.substr(text, F.char_length(part) + F.char_length(mark) + 1)
    body = F.substr(output, F.char_length(first) + 1)
    one = F.when(form == "spm", F.substring_index(body, PREFIX, 1)).otherwise(F.substring_index(body, SUFFIX, 1))
    rest = after(body, one, second)
    two = F.substring_index(rest, MIDDLE, 1)
    middle = after(rest, two, F.lit(MIDDLE))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))
