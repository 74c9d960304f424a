import random

import numpy as np
import pyarrow as pa

from tessera.llm import token_batches as tb
from tessera.llm.common import Scratch

from .helpers import MESSY, empty, messy

SPACES = " \t\n\x0b\x0c\r"


def test_words_are_those_between_ascii_white_space():
    rng = random.Random(1)
    parts = ["a", "Bc", "É", "\xa0", "\x1c", "\x85", "\u2028", "İ", "", *SPACES, "  ", "\n\n"]
    texts = [None, "", " ", "x ", " x", *("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000))]
    for lower in (False, True):
        size, words = tb.split(pa.array(texts, pa.string()).slice(1), lower)
        want = [((t or "").encode().lower() if lower else (t or "").encode()).split() for t in texts[1:]]
        assert size.tolist() == list(map(len, want)) and words.to_pylist() == [w for x in want for w in x]


def test_batches_hold_all_words(spark, monkeypatch):
    monkeypatch.setattr(tb, "BATCH_WORDS", 100)
    rows = tb.build(messy(spark), Scratch(spark, "test"), True).collect()
    got = []
    for r in rows:
        b = tb.Batch(r.asDict())
        for d, (a, z) in enumerate(zip(b.starts[:-1], b.starts[1:], strict=True)):
            got.append((b.doc_ids[d], [b.words[k] for k in b.index[a:z]]))
    assert sorted(map(repr, got)) == sorted(map(repr, ((i, (t or "").encode().lower().split()) for i, t, *_ in MESSY)))
    assert tb.build(empty(spark), Scratch(spark, "test"), True).count() == 0


def test_pack_round_trip():
    for kind in (np.int32, np.uint64, np.float32, np.int64, np.uint8):
        for n in (0, 1, 1000):
            x = np.random.default_rng(n).integers(0, 100, n).astype(kind)
            assert np.array_equal(tb.unpack(tb.pack(x)), x) and tb.unpack(tb.pack(x)).dtype == x.dtype
