import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import token_files as tf

from .helpers import MESSY, empty, messy, rows_of


@given(st.lists(st.integers(0, 5000), max_size=600))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(gaps):
    ends = np.cumsum(gaps)
    coded = tf.EliasFano.encode(ends)
    again = tf.EliasFano(len(ends), *coded.parts())
    assert again.all().tolist() == ends.tolist()
    assert [again.select(i) for i in range(len(ends))] == ends.tolist()


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(100, 2000, 20_000))
    size = sum(len(x) for x in tf.EliasFano.encode(ends).parts()[1:])
    assert 8 * size / len(ends) < 2.5 + np.log2(ends[-1] / len(ends)) + 32 / tf.EliasFano.EVERY


def reference(texts, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tf.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
PARTS = ["a", "Bc", "é", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'", "'s", "12", "<|endoftext|>", "中", "\xa0", " \xa0 \xa0 ", "\x0b. \xa0 \xa0\n\\", "\xaa-\xa9", "😀", "&&&", "don't", "\r\n", "the", "İ", "\u0301", *SPACES]


def test_encoder_equals_the_library_on_odd_texts():
    rng = random.Random(5)
    fuzz = ["a \xa0 \xa0 b", "price \xa0 \xa0 10", "a <|endoftext|> b", *SPACES, *("".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(3000))]
    encoder = tf.Encoder(tf.tokenizer_path(), 2)
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder(fuzz)] == reference(fuzz)
    assert 50256 in np.frombuffer(encoder(["a <|endoftext|> b"])[0], encoder.kind)


@pytest.mark.parametrize("known,batch", [(400_000, 1 << 20), (30, 12)])
def test_pieces_have_the_ids_of_whole_texts_and_are_encoded_once(monkeypatch, known, batch):
    """Texts of odd words and white space, long ones cut, few pieces remembered: equal to the library; a repeated word doesn't go through it again."""
    rng = random.Random(6)
    odd = [*PARTS, *"\x1c\x1d\x1e\x1f\x00\x7f\u180e\u200b\ufeff\x85", *"'.,;:!?-_()[]{}@`^|~/\\\"", "'ll", "'LL", "l'", "café", "ÉTÉ", "Ⅷ", "²", "½", "ｱ", "日本", "क्षि", "привет", "123", "a1b2", "x_y"]
    monkeypatch.setattr(tf.Encoder, "KNOWN", known)
    monkeypatch.setattr(tf, "BATCH_CHARS", batch)
    encoder = tf.Encoder(tf.tokenizer_path(), 2)
    assert encoder.in_pieces
    for _ in range(40):
        texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(150)]
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder(texts)] == reference(texts)
        assert len(encoder.known) <= known + 10_000
    encoder, through = tf.Encoder(tf.tokenizer_path(), 2), []
    ids = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: through.extend(texts) or ids(texts))
    for text in ("one two, one", "one, one two", "two one,"):
        encoder([text] * 3)
    assert sorted(through) == sorted(["one", " two", ",", " one", "two"])


def test_equal_pieces_of_a_lot_are_looked_up_once():
    """However often a piece is in a lot, it is one question to what is remembered; ids stay those of the library, by white space of all kinds."""

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    texts = ["one two, " * 1000, "", "one\xa0 two\u3000\x85one,é two«\u2028 two\u200b one " * 500, "", "two"]
    encoder = tf.Encoder(tf.tokenizer_path(), 2)
    encoder.known = Counted()
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder(texts)] == reference(texts)
    assert Counted.asked < 20


def test_lots_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(tf, "BATCH_CHARS", 10)
    b = pa.record_batch({"i": pa.array(range(6)), "x": pa.array(["abc", None, "", "x" * 50, "defghij", "k"])})
    lots = [x.column(0).to_pylist() for x in tf._lots(b)]
    assert lots == [[0, 1, 2], [3], [4, 5]]


def test_files_hold_every_document(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tf.write(messy(spark), path, segment_ids=2000)
    got = sorted(tf.read(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == len(MESSY)
    assert [r.doc_id for r in got] == sorted((r[0] for r in MESSY), key=lambda i: (i is not None, i or 0))
    want = sorted(zip(map(repr, (r[0] for r in MESSY)), reference([r[1] for r in MESSY]), strict=True))
    assert sorted((repr(r.doc_id), r.ids) for r in got) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += len(r.ids)
    crc = {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in tf.digest(spark, path).collect()} == crc
    whole = [i for r in got for i in r.ids]
    assert tf.token_range(spark, path, 3, 2500).tolist() == whole[3:2500]
    for n, r in enumerate(got):
        doc, start, ids = tf.document(spark, path, n)
        assert (doc, start, ids.tolist()) == (r.doc_id, r.start, r.ids)
    with pytest.raises(IndexError):
        tf.document(spark, path, len(got))


def test_empty_table(spark, tmp_path):
    tf.write(empty(spark), f"file://{tmp_path}/t")
    assert rows_of(tf.digest(spark, f"file://{tmp_path}/t"), "doc_id") == []
    assert len(tf.token_range(spark, f"file://{tmp_path}/t", 0, 10)) == 0
