"""WARC archives: exact round trips, files made by hand, and unsound ones."""

import base64
import hashlib
import os
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import warc

from .helpers import rows_of

LONG = "<p>" + "some words of a page " * 9 + "</p>"
ROWS = [(5, "http://a/ b\n", LONG), (2, None, LONG), (9, "http://c", LONG), (1, "http://d", None), (3, "http://e", ""), (4, "http://é", "short"), (6, "x", "short"), (7, "y", "é" * 50), (8, "z", "é" * 50), (10, "w", "é" * 49), (11, "v", "é" * 49), (None, "n", LONG), (None, "n", "only null " * 20), (None, "m", "only null " * 20), (12, "r", "repeated row " * 20), (12, "r", "repeated row " * 20), (13, "q", "\0\r\n\r\n€😀" * 30)]
NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, `row` int, `KEY` string").repartition(3)


def plain(rows, least=100):
    out, seen = [], {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (html or "").encode()
        again = len(b) >= least and b in seen
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", seen[b] if again else None))
        seen.setdefault(b, i)
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,archive_bytes", [(100, 1 << 20), (0, 300), (10**9, 1)])
def test_round_trip(spark, tmp_path, least, archive_bytes):
    path = f"file://{tmp_path}/out"
    warc.write(table(spark, ROWS), path, least_bytes=least, archive_bytes=archive_bytes)
    records = warc.sound(warc.read(spark, path))
    assert rows_of(warc.resolved(records), *NAMES) == plain(ROWS, least)
    kept = sorted((bytes(r.payload) for r in records.where("type = 'response'").collect()))
    every = sorted((html or "").encode() for _, _, html in ROWS)
    stored = [b for i, b in enumerate(every) if least > len(b) or i == 0 or every[i - 1] != b]
    assert kept == stored
    assert {r.target_uri for r in records.collect()} >= {"http://a/%20b%0A", "urn:page:2", "http://é"}
    files = [f for f in os.listdir(tmp_path / "out") if f.startswith("part-")]
    assert len(files) == len(ROWS) if archive_bytes == 1 else files
    assert warc.named(spark, path) == len(files) and all(f.endswith(".warc.zst") for f in os.listdir(tmp_path / "out") if f.startswith("part-"))
    assert rows_of(warc.resolved(warc.sound(warc.read(spark, path))), *NAMES) == plain(ROWS, least)


def test_trained_dictionary_leads_and_each_record_is_a_frame(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html><head><title>page {i * 7919 % 1000}</title></head><body>" + " ".join(f"word{(i * j) % 61}" for j in range(60 + i % 9)) + "</body></html>") for i in range(400)]
    path = f"file://{tmp_path}/out"
    warc.write(table(spark, rows), path)
    assert rows_of(warc.resolved(warc.sound(warc.read(spark, path))), *NAMES) == plain(rows)
    n = 0
    for f in (tmp_path / "out").glob("part-*"):
        data = f.read_bytes()
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY
        held = warc.dictionary_of(data)
        assert held.dict_id()
        spans = list(warc.frames(data))
        assert all(not wrong for *_, wrong in spans)
        n += sum(not skip for _, _, skip, _ in spans)
        for at, end, skip, _ in spans:
            if not skip:
                assert zstandard.get_frame_parameters(data[at:end]).dict_id == held.dict_id()
                fields, block = warc.parsed(zstandard.ZstdDecompressor(dict_data=held).decompress(data[at:end]))
                assert int(fields["content-length"]) == len(block)
    assert n == len(rows)


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    warc.write(table(spark, []), path)
    assert warc.resolved(warc.sound(warc.read(spark, path))).count() == 0


def by_hand(fields, block, end=b"\r\n\r\n", version="WARC/1.0"):
    return f"{version}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + end


def head(n, kind="resource", **more):
    return [("WARC-Type", kind), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("Content-Length", n), *more.items()]


FAULTS = [
    (by_hand(head(3), b"abcd"), "content-length 3, but 4 bytes"),
    (by_hand(head("x"), b"abcd"), "content-length is no number"),
    (by_hand(head(4), b"abcd", version="WARC/9"), "no record header"),
    (by_hand(head(4)[1:], b"abcd"), "no warc-type"),
    (by_hand([*head(4), ("warc-type", "resource")], b"abcd"), "warc-type twice"),
    (by_hand(head(4), b"abcd", end=b"\r\n\n\n"), "no end of record"),
    (by_hand([*head(4), ("no colon", "")], b"abcd").replace(b"no colon: ", b"no colon"), "header line without a name"),
    (by_hand([*head(4), ("WARC-Block-Digest", "sha256:" + "0" * 64)], b"abcd"), "block digest differs"),
    (by_hand([*head(4), ("WARC-Payload-Digest", "sha1:AAAA")], b"abcd"), "payload digest differs"),
    (b"plain", "no record header"),
]


def test_unsound_records_are_told_and_passed_over():
    c = zstandard.ZstdCompressor(write_checksum=True)
    good = c.compress(by_hand([*head(4), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(b"abcd").digest()).decode()), ("Folded", "a\r\n b")], b"abcd"))
    data = good + b"".join(c.compress(x) + good for x, _ in FAULTS)
    got = list(warc.records_of(data))
    assert [r[-1] for r in got[1::2]] == [why for _, why in FAULTS]
    assert all(r[-1] is None and r[7] and bytes(r[8]) == b"abcd" for r in got[::2])
    assert dict(got[0][7])["folded"] == "a b"


def test_broken_frames():
    c = zstandard.ZstdCompressor(write_checksum=True)
    good = c.compress(by_hand(head(400), bytes(range(200)) * 2))
    flipped = bytearray(good)
    flipped[len(good) // 2] ^= 255
    for broken in (bytes(flipped), b"junk", good[:-9], struct.pack("<II", warc.SKIPPABLE, 10**6)):
        got = list(warc.records_of(good + broken + good))
        assert got[0][-1] is None and any(r[-1] for r in got)
        if broken != good[:-9]:
            assert got[-1][-1] is None
    other = zstandard.train_dictionary(2000, [os.urandom(20) + b"some words and more words %d" % i for i in range(2000)])
    needs = zstandard.ZstdCompressor(dict_data=other).compress(by_hand(head(4), b"abcd"))
    assert [r[-1] for r in warc.records_of(needs)] == [f"frame needs dictionary {other.dict_id()}"]
    held = zstandard.ZstdCompressor().compress(other.as_bytes())  # a dictionary that is itself compressed
    assert [r[-1] for r in warc.records_of(struct.pack("<II", warc.DICTIONARY, len(held)) + held + needs)] == [None]
    unsized = zstandard.ZstdCompressor(write_content_size=False).compress(by_hand(head(4), b"abcd"))
    assert [r[-1] for r in warc.records_of(unsized)] == [None]


def test_errors_end_the_job(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(zstandard.ZstdCompressor().compress(by_hand(head(3), b"abcd")))
    records = warc.read(spark, f"file://{tmp_path}")
    assert [r.error for r in records.collect()] == ["content-length 3, but 4 bytes"]
    with pytest.raises(Exception, match="content-length 3"):
        warc.sound(records).collect()


def test_revisit_of_nothing_ends_the_job(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    warc.write(table(spark, ROWS), path)
    records = warc.read(spark, path)
    with pytest.raises(Exception, match="no response"):
        warc.resolved(records.where((F.col("type") == "revisit") | (F.col("payload_bytes") < 100))).collect()
