"""Fill-in-middle against regular expressions and an exact round trip."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import fim

from .helpers import LONG, MESSY, empty, messy, rows_of, table

SHAPE = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"^[\x20\t-\r]+|[^\x20\t-\r]+[\x20\t-\r]*"}
NAMES = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


def plain(i, text, unit="line", percent=100, spm=50):
    text = text or ""
    units = re.findall(SHAPE[unit], text)
    assert "".join(units) == text
    d = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["", "\n", "\n\n\n", "a", "a\n", "a\nb", "ä\r\nß\n\n中文\n😀 x\n", "has <P> in it\n", "<S", "<\nS>\n<", "<S\n<M\n<P", "x" * 200 + "\n" + "y" * 300, LONG, "\n".join(LONG.split()), "\n" * 1000, "é" * 500, None]


@pytest.mark.parametrize("unit", ["line", "word", "char"])
@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 16])
def test_equal_to_regular_expressions(spark, unit, chunk):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3) if chunk > 1 or len(t or "") < 40]
    got = fim.transform(table(spark, rows), unit=unit, chunk_bytes=chunk)
    assert rows_of(got, *NAMES) == sorted((plain(i, t, unit) for i, t in rows), key=repr)
    back = got.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text"))
    assert rows_of(back, "doc_id", "text") == sorted(((i, t or "") for i, t in rows), key=repr)


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_messy_rows(spark, chunk):
    got = fim.transform(messy(spark), chunk_bytes=chunk)
    assert rows_of(got, *NAMES) == sorted((plain(m[0], m[1]) for m in MESSY), key=repr)
    assert fim.transform(empty(spark), chunk_bytes=chunk).count() == 0


def test_rates_and_unknown_unit(spark):
    rows = [(i, "a\nb\nc\n") for i in range(300)]
    got = fim.transform(table(spark, rows), fim_percent=60, spm_percent=20)
    assert rows_of(got, *NAMES) == sorted((plain(i, t, percent=60, spm=20) for i, t in rows), key=repr)
    with pytest.raises(ValueError):
        fim.transform(table(spark, rows), unit="page")


@settings(max_examples=200, deadline=None)
@given(st.text("a\n é\t", max_size=60), st.integers(1, 9), st.sampled_from(["line", "word", "char"]))
def test_chunks_tell_their_starts_alone(text, size, unit):
    data, want, at = text.encode(), [], 0
    for piece in re.findall(SHAPE[unit], text):
        want.append(at)
        at += len(piece.encode())
    got = [int(p) + k * size for k, part in fim.chunks(data, size) for p in fim.starts(part, k == 0, unit).nonzero()[0]]
    assert got == want
