"""Quality classifier: a generalised additive model with pairwise interactions.

The score is the logistic of a sum of lookups: one table for each feature of
the text, and one small table for each of the pairs of features that explain
most of what the features alone leave.  Tables are learned by cyclic boosting:
round after round, each feature in turn gets one shallow tree on its bins,
shrunk, added to its table.  Scoring bins a batch of texts and adds up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, documents, pick, texts

#: Labelled rows to learn from, at most; those with the least hashes, whatever the size of the table.
MOST_ROWS = 20_000
BINS, PAIR_BINS, LEAVES = 64, 8, 4
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 8
RATE, RIDGE = 0.15, 2.0
ACCEPT = 0.7

_SYMBOLS, _UPPER, _DIGITS, _STOPS = b"#*$%&|<>", bytes(range(0x41, 0x5B)), b"0123456789", b".,;:?"
_HIGH = bytes(range(0x80, 0x100))
FEATURES = ("words", "word_bytes", "longest", "distinct_words", "repeats", "symbols", "bars", "shouts", "upper", "digits", "stops", "high", "lines", "dup_lines", "single", "packed")


def features(text: bytes) -> list[float]:
    words = text.split()
    n, size = len(words), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    few = max(1, n)
    return [
        np.log1p(n),
        sum(map(len, words)) / few,
        max(map(len, words), default=0),
        len(set(words)) / few,
        sum(map(eq, words, words[1:])) / few,
        (size - len(text.translate(None, _SYMBOLS))) / few if text else 0.0,
        text.count(b"|") / few,
        text.count(b"!") / few,
        (len(text) - len(text.translate(None, _UPPER))) / size,
        (len(text) - len(text.translate(None, _DIGITS))) / size,
        (len(text) - len(text.translate(None, _STOPS))) / few,
        (len(text) - len(text.translate(None, _HIGH))) / size,
        len(lines) / few,
        1 - len(set(lines)) / max(1, len(lines)),
        text.count(b" a ") / few,
        len(zlib.compress(text, 1)) / size,
    ]


def feature_table(column: pa.Array) -> np.ndarray:
    return np.array([features(x) for x in texts(column)], float).reshape(-1, len(FEATURES))


class Model:
    """Lookup tables; ``trained`` is false if there was nothing to learn from, and every score is 0.5."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.trained = len(y) > 0
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if self.trained else np.zeros(0) for f in range(len(FEATURES))]
        self.coarse = [e[np.unique(np.linspace(0, len(e) - 1, PAIR_BINS - 1).astype(int))] if len(e) else e for e in self.edges]
        self.tables = [np.zeros(BINS) for _ in FEATURES]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if self.trained:
            self._learn(x, y)

    def _learn(self, x: np.ndarray, y: np.ndarray) -> None:
        bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        total = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f, b in enumerate(bins):
                step = RATE * _tree(*_sums(total, y, b, BINS))
                self.tables[f] += step
                total += step[b]
        small = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.coarse)]
        cells = {(a, b): small[a] * PAIR_BINS + small[b] for a, b in combinations(range(len(FEATURES)), 2)}
        gain = {p: _quadrants(*(s.reshape(PAIR_BINS, PAIR_BINS) for s in _sums(total, y, c, PAIR_BINS**2)))[0] for p, c in cells.items()}
        self.pairs = sorted(sorted(gain, key=lambda p: (-gain[p], p))[:PAIRS])
        self.pair_tables = [np.zeros(PAIR_BINS**2) for _ in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for k, p in enumerate(self.pairs):
                step = RATE * _quadrants(*(s.reshape(PAIR_BINS, PAIR_BINS) for s in _sums(total, y, cells[p], PAIR_BINS**2)))[1].ravel()
                self.pair_tables[k] += step
                total += step[cells[p]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), 0.5)
        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        small = {f: np.searchsorted(self.coarse[f], x[:, f], side="right") for f in {f for p in self.pairs for f in p}}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[small[a] * PAIR_BINS + small[b]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _sums(total: np.ndarray, y: np.ndarray, bins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss in each bin."""
    p = 1 / (1 + np.exp(-total))
    return np.bincount(bins, y - p, n), np.bincount(bins, p * (1 - p), n)


def _worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree with up to LEAVES leaves: the best cut of any leaf, again and again."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-9, None, 0)
        for k, (a, z) in enumerate(leaves):
            if z - a > 1:
                m = np.arange(a + 1, z)
                won = _worth(cg[m] - cg[a], ch[m] - ch[a]) + _worth(cg[z] - cg[m], ch[z] - ch[m]) - _worth(cg[z] - cg[a], ch[z] - ch[a])
                if won.max() > best[0]:
                    best = (won.max(), k, int(m[won.argmax()]))
        if best[1] is None:
            break
        a, z = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], z)]
    out = np.zeros(len(g))
    for a, z in leaves:
        out[a:z] = (cg[z] - cg[a]) / (ch[z] - ch[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts each of two features once."""
    cg, ch = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    cuts = [(a, b) for a in range(1, len(g)) for b in range(1, len(g))]
    a, b = np.array(cuts).T
    blocks = [(cg[a, b], ch[a, b]), (cg[a, -1] - cg[a, b], ch[a, -1] - ch[a, b]), (cg[-1, b] - cg[a, b], ch[-1, b] - ch[a, b]), (cg[-1, -1] - cg[a, -1] - cg[-1, b] + cg[a, b], ch[-1, -1] - ch[a, -1] - ch[-1, b] + ch[a, b])]
    won = sum(_worth(x, y) for x, y in blocks)
    k = int(won.argmax())
    values = [float(x[k] / (y[k] + RIDGE)) for x, y in blocks]
    out = np.empty_like(g)
    (a0, b0) = cuts[k]
    out[:a0, :b0], out[:a0, b0:], out[a0:, :b0], out[a0:, b0:] = values
    return float(won[k]), out


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id is learned from if it is labelled."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learns from at most MOST_ROWS labelled rows outside the held-out fold; null labels are passed over."""
    known = pick(labels, label_id=label_id_col, y=label_col).select(F.col("label_id").cast("long"), F.col("y").cast("int"))
    known = known.where(F.col("y").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    order = F.xxhash64("label_id", "y")
    known = known.orderBy(order, "label_id", "y").limit(MOST_ROWS)
    rows = documents(docs, id_col, text_col).join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("y", "text", "doc_id")
    schema = pa.schema([("y", pa.int32()), ("key", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                yield batch(schema, b.column(0), b.column(2), list(feature_table(b.column(1))))

    # repeated documents can't make it more
    got = rows.mapInArrow(run, "y int, key long, x array<double>").orderBy(F.xxhash64("key", "y", "x"), "key").limit(MOST_ROWS).collect()
    return Model(np.array([r.x for r in got], float).reshape(-1, len(FEATURES)), np.array([r.y for r in got], float))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """One row for each row of docs: doc_id, held_out boolean, score double, predicted int.

    Only the text goes into a score; null counts as empty.  Without labels each
    score is 0.5.  Rows are scored alone, so repeated rows and ties play no
    part; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, **columns))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                yield batch(schema, b.column(0), model.value.score(feature_table(b.column(1))))

    out = documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """docs, all columns, without the rows that are rejected; an untrained model rejects none.

    Null texts count as empty.  Rows are judged alone, so repeated rows and ties
    play no part; an empty table stays empty.
    """
    names = docs.columns
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, **columns))
    if not model.value.trained or text_col not in names:
        return docs
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                yield b.filter(pa.array(model.value.score(feature_table(b.column(text_at))) >= ACCEPT))

    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return flat.mapInArrow(run, flat.schema).toDF(*names)
