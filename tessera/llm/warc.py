"""WARC archives in Zstandard: one frame a record, a dictionary in the leading skippable frame.

An archive is a file of at most about ARCHIVE_BYTES: a skippable frame with the
dictionary, then the frames of its records.  Rows of Spark's text sink are
whole archives, one a file, so any file system that Spark knows will do, a
task that is tried again leaves nothing behind, and its line end, which is an
empty skippable frame, is passed over by every reader.  Spark names the files
part-*.txt; ``named`` gives them the usual ending.

Equal payloads are stored once, as a response; other records revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch, pick, texts

#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: Payloads of fewer bytes are all stored.
LEAST_BYTES = 100
#: The dictionary is trained on the first SAMPLE_BYTES of SAMPLES payloads, taken by a hash.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 500, 8192, 1 << 16
#: A record of more decoded bytes is an error of its own: a row's value can't hold it.
MOST_RECORD_BYTES = 1 << 30
#: Decoded bytes of payload after which rows go on.
BATCH_BYTES = 8 << 20

#: Fixed values of the formats.
FRAME, DICTIONARY, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, 0x184D2A50
EMPTY_FRAME = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class Bad(ValueError):
    """What is wrong with a frame or record."""


# --- frames


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame at a place ends, by the lengths of its blocks."""
    try:
        end = at + zstandard.frame_header_size(data[at : at + 18])
        checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
    except zstandard.ZstdError as e:
        raise Bad(f"frame header: {e}") from None
    last = False
    while not last:
        head = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        if end + 3 > len(data) or kind == 3:
            raise Bad("frame cut off" if kind != 3 else "frame with a reserved block")
        end += 3 + (1 if kind == 1 else size)
    end += 4 * checksum
    if end > len(data):
        raise Bad("frame cut off")
    return end


def frames(data: bytes) -> Iterator[tuple[int, int, bool, str | None]]:
    """(begin, end, whether skippable, what is wrong) of each; after what is no frame it goes on at the next magic number."""
    at = 0
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        end, wrong, skip = 0, None, magic & ~15 == SKIPPABLE
        try:
            if skip:
                end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
                if end > len(data) or at + 8 > len(data):
                    raise Bad("skippable frame cut off")
            elif magic == FRAME:
                end = frame_end(data, at)
            else:
                raise Bad("no frame")
        except Bad as e:
            after = data.find(struct.pack("<I", FRAME), at + 1)
            end, wrong, skip = after if after > 0 else len(data), str(e), False
        yield at, end, skip, wrong
        at = end


def dictionary_of(data: bytes) -> zstandard.ZstdCompressionDict | None:
    """What the leading skippable frame holds, itself compressed or not."""
    if int.from_bytes(data[:4], "little") != DICTIONARY:
        return None
    held = data[8 : 8 + int.from_bytes(data[4:8], "little")]
    if int.from_bytes(held[:4], "little") == FRAME:
        held = zstandard.ZstdDecompressor().decompress(held, max_output_size=MOST_RECORD_BYTES)
    return zstandard.ZstdCompressionDict(held)


def decoded(data: bytes, decompressor: zstandard.ZstdDecompressor, dict_id: int) -> bytes:
    """The bytes of one frame."""
    about = zstandard.get_frame_parameters(data)
    if about.dict_id not in (0, dict_id):
        raise Bad(f"frame needs dictionary {about.dict_id}")
    known = about.content_size != zstandard.CONTENTSIZE_UNKNOWN
    if known and about.content_size > MOST_RECORD_BYTES:
        raise Bad("record too long")
    try:
        if known:
            return decompressor.decompress(data)
        out, reader = b"", decompressor.stream_reader(data)
        out = reader.read(MOST_RECORD_BYTES + 1)
    except zstandard.ZstdError as e:
        raise Bad(f"frame: {e}") from None
    if len(out) > MOST_RECORD_BYTES:
        raise Bad("record too long")
    return out


# --- records


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields, by their names in small letters, and block of one record; Bad unless the frame is exactly one."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not blank or version not in VERSIONS:
        raise Bad("no record header")
    fields: dict[str, str] = {}
    last = ""
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:  # a folded line
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        last = name.strip().lower()
        if not colon or not last:
            raise Bad("header line without a name")
        if last in fields and last in MANDATORY:
            raise Bad(f"{last} twice")
        fields[last] = value.strip()
    for name in MANDATORY:
        if not fields.get(name):
            raise Bad(f"no {name}")
    length = fields["content-length"]
    if not (length.isascii() and length.isdigit()):
        raise Bad("content-length is no number")
    if len(rest) != int(length) + 4:
        raise Bad(f"content-length {length}, but {max(0, len(rest) - 4)} bytes")
    if not rest.endswith(b"\r\n\r\n"):
        raise Bad("no end of record")
    return fields, rest[:-4]


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, body


def matches(label: str, content: bytes) -> bool | None:
    """Whether a digest field tells these bytes; None if it names a function that isn't known."""
    name, _, value = label.partition(":")
    if name.lower() not in ("sha1", "sha256", "md5"):
        return None
    digest = hashlib.new(name.lower(), content).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


# --- writing


def _safe(text: str) -> str:
    """A header's value: what would end the line or hide in it is percent-encoded."""
    return "".join(c if c > "\x20" and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _archives(dictionary: bytes, date: str, level: int, archive_bytes: int):
    schema = pa.schema([("value", pa.binary())])

    def record_id(page, row) -> str:
        return f"<{uuid.uuid5(NAMESPACE, f'{page}/{row}').urn}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """page_id, url, html, digest, row, first_page, first_row to archives."""
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=True, write_content_size=True)
        lead = struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary if dictionary else b""
        parts, size = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                for page, url, html, digest, row, first_page, first_row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), *(b.column(i).to_pylist() for i in range(3, 7)), strict=True):
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
                    again = first_row is not None and first_row != row
                    block = http if again else http + html
                    fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(page, row)), ("WARC-Date", date), ("WARC-Target-URI", _safe(url) if url else f"urn:page:{page}"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
                    fields += [("Page-ID", str(page))] if page is not None else []
                    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first_page, first_row))] if again else []
                    parts.append(compressor.compress(record(fields, block)))
                    size += len(parts[-1])
                    if size >= archive_bytes:
                        yield batch(schema, [b"".join([lead, *parts])])
                        parts, size = [], 0
        if parts:
            yield batch(schema, [b"".join([lead, *parts])])

    return run


def train(sample: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of so many bytes at most; none where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(size, [x for x in sample if x]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = "2024-01-01T00:00:00Z", level: int = 3, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """A record for each row of pages, in archives below path.

    Of rows with equal html of at least least_bytes bytes of UTF-8, that with
    the least id is a response, and the others are revisits without the
    payload; ties go to one of them, a null id counts last.  All other rows
    are responses.  Null html is an empty payload; rows without a url have one
    made of the id.  Other columns aren't read.  An empty table gives no
    archive.  Equal means an equal SHA-256.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "warc")
    flat = pick(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = scratch.save(flat.withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html").cast("long"), "row": F.monotonically_increasing_id()}), "rows", compression="zstd")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row"))
    copies = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = scratch.save(copies.select(F.col("digest").alias("key"), F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row")), "firsts")
    # rows that can't have a copy get keys of their own, not one for all
    key: Column = F.when(F.col("bytes") >= least_bytes, F.col("digest")).otherwise(F.concat(F.lit("row "), F.col("row").cast("string")))
    sample = [bytes(r.x) for r in rows.select(F.substring(F.encode("html", "UTF-8"), 1, SAMPLE_BYTES).alias("x"), F.xxhash64("row").alias("h")).orderBy("h").limit(SAMPLES).collect()]
    told = rows.withColumn("key", key).join(firsts, "key", "left").select("page_id", "url", "html", "digest", "row", "first_page", "first_row")
    out = told.mapInArrow(_archives(train(sample), date, level, archive_bytes), "value binary").select(F.col("value").cast("string"))
    out.write.mode("overwrite").option("maxRecordsPerFile", 1).option("lineSep", EMPTY_FRAME).option("compression", "none").text(path)
    scratch.drop()


def named(spark: SparkSession, path: str, ending: str = ".warc.zst") -> int:
    """Gives the files of a folder that write made the usual ending, one after another; how many."""
    jvm, n = spark._jvm, 0
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in system.listStatus(folder):
        name = f.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            n += bool(system.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name[:-4] + ending)))
    return n


# --- reading

RECORDS = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())])
RECORDS_SQL = "archive string, at long, type string, record_id string, refers_to_id string, target_uri string, date string, page_id long, fields map<string,string>, payload binary, payload_bytes long, payload_digest string, error string"


def _number(x: str | None) -> int | None:
    return int(x) if x and x.removeprefix("-").isdigit() and x.isascii() and len(x) < 19 else None


def _told(fields: dict[str, str], block: bytes) -> list:
    """type ... payload_digest of a sound record."""
    kind, payload, length, digest = fields["warc-type"].lower(), block, None, fields.get("warc-payload-digest", "")
    http = fields.get("content-type", "").replace(" ", "").startswith("application/http")
    head, body = _http(block) if http else ({}, block)
    if (label := fields.get("warc-block-digest")) and matches(label, block) is False:
        raise Bad("block digest differs")
    if kind == "revisit":
        payload, length = None, _number(head.get("content-length"))
        digest = digest.partition(":")[2] if digest.lower().startswith("sha256:") else None
    else:
        if digest and matches(digest, body) is False:
            raise Bad("payload digest differs")
        if http and (n := _number(head.get("content-length"))) is not None and n != len(body):
            raise Bad(f"HTTP content-length {n}, but {len(body)} bytes")
        payload, length, digest = body, len(body), hashlib.sha256(body).hexdigest()
    return [kind, fields["warc-record-id"], fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields["warc-date"], _number(fields.get("page-id")), list(fields.items()), payload, length, digest, None]


def records_of(data: bytes) -> Iterator[list]:
    """at ... error of each record of an archive; of an unsound one only at and error."""
    dict_id, decompressor, wrong = 0, zstandard.ZstdDecompressor(), None
    try:
        if held := dictionary_of(data):
            dict_id, decompressor = held.dict_id(), zstandard.ZstdDecompressor(dict_data=held)
    except zstandard.ZstdError as e:
        wrong = f"dictionary: {e}"
    for at, end, skip, bad in frames(data):
        if skip and not (at == 0 and wrong):
            continue
        try:
            if skip or bad:
                raise Bad(bad or wrong)
            yield [at, *_told(*parsed(decoded(data[at:end], decompressor, dict_id)))]
        except Bad as e:
            yield [at, *[None] * 10, str(e)]


def _read(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, rows, size = b.column(0)[i].as_py(), [], 0
                for r in records_of(b.column(1)[i].as_py()):
                    size += len(r[8] or b"")
                    r[8] = r[8] if keep else None
                    rows.append([name, *r])
                    if size >= BATCH_BYTES or len(rows) >= 2000:
                        yield batch(RECORDS, *map(list, zip(*rows, strict=True)))
                        rows, size = [], 0
                if rows:
                    yield batch(RECORDS, *map(list, zip(*rows, strict=True)))

    return run


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row for each record of the archives below path; columns as RECORDS_SQL has them.

    ``at`` is the frame's place in its file, ``payload`` what follows the HTTP
    header, null for revisits (and everywhere without payload).
    payload_bytes and payload_digest are of the payload itself, for revisits as
    declared.  Version, mandatory fields, lengths, ends, dictionary ids, frame
    checksums and digests are looked at; what fails is a row of ``error`` and
    place, and reading goes on at the next frame.  A folder without records
    gives no rows.  An archive is one row of Spark's binary files, so below
    2 GB.
    """
    files = spark.read.format("binaryFile").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(_read(payload), RECORDS_SQL)


def sound(records: DataFrame) -> DataFrame:
    """The records; one with an error ends the job."""
    told = F.concat(F.col("archive"), F.lit(" at "), F.col("at"), F.lit(": "), F.col("error"))
    return records.withColumn("at", F.when(F.col("error").isNull(), F.col("at")).otherwise(F.raise_error(told).cast("long")))


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the response's page_id) of responses and revisits.

    A revisit has bytes of the response that it refers to; where that isn't
    there, or has another digest, the job ends with an error.  Other types of
    records are passed over.
    """
    kept = records.where(F.col("type").isin("response", "revisit"))
    # a response asks for nothing: a key of its own keeps responses apart
    asks = kept.withColumn("wanted", F.coalesce(F.when(F.col("type") == "revisit", F.col("refers_to_id")), F.concat(F.lit("none "), F.col("record_id"))))
    there = kept.where("type = 'response'").select(F.col("record_id").alias("wanted"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("there_bytes"), F.col("payload_digest").alias("there_digest"))
    again = F.col("type") == "revisit"
    fault = F.raise_error(F.concat(F.lit("no response with this payload for the revisit "), F.col("record_id"))).cast("string")
    digest = F.when(~again | (F.col("payload_digest") == F.col("there_digest")), F.col("payload_digest")).otherwise(fault)
    return asks.join(there, "wanted", "left").select("page_id", F.when(again, F.col("there_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
