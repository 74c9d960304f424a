"""Language-model scores by a hierarchical Pitman-Yor model of words.

Each context, the word before, is a restaurant of a Pitman-Yor process; all
restaurants share one parent, whose own parent is uniform over the known words
and one unknown.  Training words are customers: where one opens a table in its
restaurant, a customer goes to the parent.  Gibbs sweeps redraw the seating of
all restaurants and of the parent in turn; after the first sweeps, predictive
probabilities are averaged over the sweeps.

A sweep draws blocks whose parts are independent, so it needs no order.  Given
the customers that it was sent, the parent is seated and its distribution G is
drawn.  Given G, restaurants are independent, and a restaurant with T tables
gets an auxiliary u ~ Gamma(strength / discount + T), given which its dishes
are: t tables of c customers have the weight S(c, t) (discount u G)^t, with the
generalised Stirling numbers S.  So the seatings themselves are summed out.
Small counts are drawn from all their weights, large ones by Metropolis steps
on the same weights, whose Stirling numbers are contour integrals.  What of the
parent no table holds is spread over the words evenly, at its mean.

Restaurants are dealt out by context.  A very frequent context is spread by its
dishes over several tasks; they share its u and its number of tables, which go
through the parent's tasks from sweep to sweep.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_batches as tb
from .common import Scratch, batch

DISCOUNT, STRENGTH = 0.8, 1.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 10.0
#: Sweeps that are forgotten, and sweeps that are averaged.
BURN_IN, SWEEPS = 2, 3
#: Counts whose number of tables is drawn from a table of all its weights; of more, by Metropolis steps.
EXACT = 256
#: Metropolis steps of a sweep, and their lengths as parts of the spread.
MOVES = (2.4, 0.5, 2.4, 6.0, 1.0, 2.4)
#: Training words, about, whose pairs are one part of the restaurants, and of the words that one part of the parent seats.
PART_PAIRS, PART_WORDS = 500_000, 6_000_000
#: Parts that batches ask at once, so that questions are fewer while rows stay narrow.
GROUP = 2
#: Weights of tables held at once.
CELLS = 1 << 18
#: Stand for the end of a text and for its beginning.
END, BEGIN = np.uint64(0x7F4A7C159E3779B9), np.uint64(0x165667B19E3779F9)

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logs of the generalised Stirling numbers: seatings of c customers at t tables, each table of s weighing (1 - d) ... (s - 1 - d)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    with np.errstate(divide="ignore"):
        for c in range(most):
            t = np.arange(c + 2)
            old = out[c, : c + 2] + np.log(np.maximum(0.0, c - discount * t))
            out[c + 1, : c + 2] = np.logaddexp(old, np.concatenate([[-np.inf], out[c, : c + 1]]))
    return out


def _log_rest(z: np.ndarray) -> np.ndarray:
    """log(1 - e^z) of z < 0, where e^z is small and where it is near 1."""
    with np.errstate(divide="ignore"):
        return np.where(z < -0.7, np.log1p(-np.exp(z)), np.log(-np.expm1(z)))


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """z < 0 where t d e^z (1 - e^z)^(d - 1) = c (1 - (1 - e^z)^d), by halving."""
    low, high = np.full(len(c), -4.0), np.full(len(c), 40.0)  # of -log(-z)
    for _ in range(36):
        mid = (low + high) / 2
        z = -np.exp(-mid)
        rest = _log_rest(z)
        small = t * d * np.exp(z + (d - 1) * rest) < -c * np.expm1(d * rest)
        low, high = np.where(small, mid, low), np.where(small, high, mid)
    return z


def _on_circle(c: np.ndarray, t: np.ndarray, z0: np.ndarray, d: float) -> np.ndarray:
    phase = lambda z: t * np.log(-np.expm1(d * np.log1p(-np.exp(z)))) - c * z
    k = np.arange(129)
    top = phase(z0.astype(complex)).real
    f = np.exp(phase(z0 + 1j * np.pi * k / 128) - top).real * np.where((k > 0) & (k < 128), 1.0, 0.5)
    return top[:, 0] + np.log(f.sum(axis=1) / 128)


def _on_parabola(c: np.ndarray, t: np.ndarray, z0: np.ndarray, d: float) -> np.ndarray:
    phase = lambda z: t * np.log(-np.expm1(d * np.log(-np.expm1(z)))) - c * z
    s = np.arange(90) * 0.07
    scale = np.sqrt(-c * z0)
    top = phase(z0.astype(complex)).real
    along = 1 + 1j * s / scale
    f = (np.exp(phase(z0 * along**2) - top) * along).real * np.where(s > 0, 2.0, 1.0)
    return top[:, 0] + np.log(f.sum(axis=1) * 0.07 / np.pi) + np.log(-z0 / scale)[:, 0]


def log_stirling_of(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same numbers without their table, up to a factor that t doesn't change: t^-1! d^-t [x^c] f^t, f = 1 - (1 - x)^d.

    The coefficient is an integral around zero through the saddle point of its
    integrand: on a circle, or, where the saddle is near the branch point at 1,
    on a parabola around the cut.  Sums over either converge like a power of
    the number of points, so errors of a weight are about 10^-5 at most.
    """
    c, t = np.asarray(c, float), np.asarray(t, float)
    out = np.full(len(c), -np.inf)
    inside = (t >= 1) & (t < c)
    z0 = np.zeros(len(c))
    z0[inside] = _saddle(c[inside], t[inside], d)
    for way, on in ((_on_circle, inside & (z0 < -0.3)), (_on_parabola, inside & (z0 >= -0.3))):
        rows = np.flatnonzero(on)
        for at in range(0, len(rows), 1000):
            own = rows[at : at + 1000]
            out[own] = way(c[own, None], t[own, None], z0[own, None], d)
    out[t == c] = c[t == c] * np.log(d)
    return out - _lgamma(np.maximum(t, 0) + 1).astype(float) - t * np.log(d)


def tables(rng: np.random.Generator, counts: np.ndarray, log_x: np.ndarray, now: np.ndarray, discount: float, stirling: np.ndarray) -> np.ndarray:
    """Tables of each dish, drawn with weight S(count, t) e^(t log_x); of large counts, Metropolis steps from ``now`` (0: from the mode)."""
    out = np.minimum(counts, 1).astype(np.int64)
    most, low = len(stirling) - 1, 2
    while low <= most:  # counts that share the width of a table of weights
        high = min(most, low if low <= 4 else 2 * low - 1)
        of, t = np.flatnonzero((counts >= low) & (counts <= high)), np.arange(1, high + 1)
        for at in range(0, len(of), max(1, CELLS // high)):
            rows = of[at : at + max(1, CELLS // high)]
            weight = log_x[rows, None] * t + stirling[counts[rows], 1 : high + 1]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[rows] = 1 + (weight < rng.random((len(rows), 1)) * weight[:, -1:]).sum(axis=1)
        low = high + 1
    rows = np.flatnonzero(counts > most)
    if len(rows):
        out[rows] = _metropolis(rng, counts[rows].astype(float), log_x[rows], now[rows], discount)
    return out


def _metropolis(rng: np.random.Generator, c: np.ndarray, log_x: np.ndarray, now: np.ndarray, d: float) -> np.ndarray:
    # with e^log_x / d tables expected at x = 1: the mode has t = lam f(x) and c = lam x f'(x)
    lam, low, high = np.exp(np.minimum(log_x, 600.0)) / d, np.full(len(c), -7.0), np.full(len(c), 40.0)
    for _ in range(36):
        mid = (low + high) / 2
        z = -np.exp(-mid)
        small = lam * d * np.exp(z + (d - 1) * _log_rest(z)) < c
        low, high = np.where(small, mid, low), np.where(small, high, mid)
    rest = -np.expm1(z)
    mode = lam * -np.expm1(d * _log_rest(z))
    square = lam * d * np.exp(z) * rest ** (d - 2) * (rest + (1 - d) * np.exp(z))
    spread = np.sqrt(np.maximum(0.25, mode - c * c / np.maximum(square, 1e-300)))
    t = np.where(now > 0, np.minimum(now, c), np.clip(np.rint(mode), 1, c))
    weight = lambda t: log_x * t + log_stirling_of(c, t, d)
    have = weight(t)
    for length in MOVES:
        step = np.rint(rng.normal(size=len(c)) * spread * length)
        to = t + np.where(step == 0, np.where(rng.random(len(c)) < 0.5, 1, -1), step)
        new = np.full(len(c), -np.inf)
        inside = (to >= 1) & (to <= c)
        if inside.any():
            new[inside] = log_x[inside] * to[inside] + log_stirling_of(c[inside], to[inside], d)
        go = np.log(rng.random(len(c))) < new - have
        t, have = np.where(go, to, t), np.where(go, new, have)
    return t.astype(np.int64)


class _Tokens:
    """A batch with the ends of texts: ``token`` and ``context`` index ``keys``, the distinct hashes in order."""

    def __init__(self, row: dict):
        self.b = b = tb.Batch(row)
        n, docs = len(b.words), len(b.sizes)
        hashes = np.concatenate([tb.mixed(b.hashes()), [END, BEGIN]])
        self.order = np.argsort(hashes, kind="stable")
        rank = np.empty(n + 2, np.int64)
        rank[self.order] = np.arange(n + 2)
        self.keys, self.end, self.begin = hashes[self.order], int(rank[n]), int(rank[n + 1])
        self.doc = np.repeat(np.arange(docs), b.sizes + 1)
        self.starts = b.starts[:-1] + np.arange(docs)
        self.token = np.full(len(self.doc), self.end)
        self.token[np.arange(len(b.index)) + b.doc] = rank[b.index]
        self.context = np.roll(self.token, 1)
        self.context[self.starts] = self.begin
        self.held_out = np.array([i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in b.doc_ids], bool)
        self.train = ~self.held_out[self.doc]

    def counts(self) -> np.ndarray:
        return np.bincount(self.token[self.train], minlength=len(self.keys))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context, token) in order, as context, token, training count, and the pair of each token."""
        code, inverse = np.unique(self.context * np.int64(len(self.keys)) + self.token, return_inverse=True)
        return (code // len(self.keys)).astype(np.int32), (code % len(self.keys)).astype(np.int32), np.bincount(inverse[self.train], minlength=len(code)), inverse

    def context_counts(self, seen: np.ndarray) -> np.ndarray:
        """Customers of each context: as often as its word is there; a text begins as often as it ends; nothing follows an end."""
        out = seen.copy()
        out[self.begin], out[self.end] = seen[self.end], 0
        return out


def _word_counts(word_parts: int):
    """Count of each word, and its number: its rank in its part, times the number of parts, and the part."""

    def reply(columns: list[list[np.ndarray]], part: int) -> list[list[np.ndarray]]:
        own, inverse = np.unique(np.concatenate([c[0] for c in columns]), return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, inverse, np.concatenate([c[1] for c in columns]).astype(np.int64))
        stats = np.array([(total > 0).sum(), total.sum(), len(own)], np.int64)
        cuts = np.cumsum([len(c[0]) for c in columns])[:-1]
        return [[x, (y * word_parts + part).astype(np.uint64), stats] for x, y in zip(np.split(total[inverse], cuts), np.split(inverse, cuts), strict=True)]

    return reply


def _totals(seen: DataFrame) -> tuple[int, int, int]:
    """Known words, training tokens, and most words of a part: sums over what each part says of itself."""
    schema = pa.schema([("known", pa.int64()), ("total", pa.int64()), ("most", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            told = [tb.unpack(c[0]) for c in b.column(0).to_pylist()]
            yield batch(schema, *([int(x[k]) for x in told] for k in range(3)))

    one = seen.groupBy("part").agg(F.min(F.array(F.col("columns")[2])).alias("stats")).select("stats")
    r = one.mapInArrow(run, "known long, total long, most long").agg(F.sum("known"), F.sum("total"), F.max("most")).first()
    return tuple(int(x or 0) for x in r)


def _part_of(context: np.ndarray, token: np.ndarray, counts: np.ndarray, hot: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each pair of word numbers, and over how many parts its context is spread."""
    spread = np.minimum(parts, 1 + counts // max(1, hot)).astype(np.int64)
    home, step = tb.mixed(context + np.uint64(1)) % np.uint64(parts), tb.mixed(token + np.uint64(1)) % spread.astype(np.uint64)
    return ((home + step) % np.uint64(parts)).astype(np.int32), spread


def _order(part: np.ndarray, context: np.ndarray, token: np.ndarray, parts: int) -> np.ndarray:
    """By part, then by the numbers of the pair."""
    by_pair = np.argsort(context << np.uint64(32) | token)  # pairs differ
    part = part[by_pair]
    return by_pair[np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")]


ROWS = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("columns", pa.list_(pa.binary())), ("stats", pa.list_(pa.float64()))])
ROWS_SQL = "part int, batch long, columns array<binary>, stats array<double>"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return batch(ROWS, *[list(x) for x in zip(*found, strict=True)]) if found else pa.RecordBatch.from_pylist([], ROWS)


def _by_word_part(numbers: np.ndarray, word_parts: int) -> np.ndarray:
    """The order of word numbers by part and rank."""
    return np.lexsort((numbers, numbers % np.uint64(word_parts)))


class _Restaurants:
    """The contexts of one part: pairs in order, each with its word as a place in ``words``.

    Pairs of one customer have one table in any case, so only the others,
    ``busy``, and their words take part in sweeps.
    """

    def __init__(self, columns: list[bytes], word_parts: int):
        self.contexts, sizes, self.customers, self.spread, self.words, self.word, self.count = (tb.unpack(c) for c in columns)
        self.contexts, self.words, self.word_parts = self.contexts.astype(np.uint64), self.words.astype(np.uint64), word_parts
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.busy = np.flatnonzero(self.count > 1)
        self.busy_words, self.busy_word = np.unique(self.word[self.busy], return_inverse=True)
        hot = np.flatnonzero(self.spread > 1)
        self.hot = hot[_by_word_part(self.contexts[hot], word_parts)]

    def _parts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the numbers of each part of the words begin; they are in the order of _by_word_part."""
        return np.searchsorted(numbers % np.uint64(self.word_parts), np.arange(self.word_parts + 1)), (numbers // np.uint64(self.word_parts)).astype(np.uint32)

    def everywhere(self, t: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Tables of each context, given tables of the busy pairs and, of spread contexts, those of all parts."""
        out = np.bincount(self.of, np.minimum(self.count, 1), len(self.contexts)).astype(np.int64)
        out += np.bincount(self.of[self.busy], t - 1, len(self.contexts)).astype(np.int64)
        if len(hot):
            out[self.hot] = hot
        return out

    def ask(self, part: int, t: np.ndarray, first: bool, last: bool) -> Iterator[tuple[int, int, list[bytes], None]]:
        """To each part of the words: ranks of busy words and their tables, and those of spread contexts; at first and last all ranks."""
        sums = np.bincount(self.busy_word, t, len(self.busy_words)).astype(np.int64)
        own = self.everywhere(t, np.zeros(0, np.int64))[self.hot]
        base = np.bincount(self.word, (self.count == 1).astype(float), len(self.words)).astype(np.int64)
        (at, rank), (hot_at, hot_rank), (all_at, all_rank) = (self._parts(x) for x in (self.words[self.busy_words], self.contexts[self.hot], self.words))
        for p in range(self.word_parts):
            some, hot, every = (slice(x[p], x[p + 1]) for x in (at, hot_at, all_at))
            if every.stop > every.start or hot.stop > hot.start:
                columns = [rank[some], sums[some], hot_rank[hot], own[hot], *([all_rank[every]] if first or last else []), *([base[every]] if first else [])]
                yield p, part, [tb.pack(x) for x in columns], None


def _told(replies: list[dict] | None) -> list[np.ndarray]:
    """Columns that the parts of the words replied, in the order of the words."""
    rows = sorted(replies or [], key=lambda r: r["batch"])
    return [np.concatenate([tb.unpack(r["columns"][k]) for r in rows]) for k in range(len(rows[0]["columns"]))] if rows else []


def _open(word_parts: int):
    """For each part of a group: a row of its restaurants (batch -1), and for each batch which pairs it asked about."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asked = [[tb.unpack(c) for c in r["columns"]] for r in rows]
        group, batches, found = rows[0]["part"], [r["batch"] for r in rows], []
        del rows
        hot = np.unique(np.stack([np.concatenate([c[k].astype(np.int64) for c in asked]) for k in (2, 3)]), axis=1)
        for k in range(GROUP):
            found += one_part(group * GROUP + k, batches, [list(_of_part(c, k)) for c in asked], hot)
        return pa.Table.from_batches([_rows(found)])

    def one_part(part: int, batches: list[int], asked: list[list[np.ndarray]], hot: np.ndarray) -> Iterator[tuple]:
        # columns: contexts, pairs of each, parts of each; word of each pair, training count
        pair = np.concatenate([np.repeat(c[0], c[1]) << np.uint64(32) | c[3] for c in asked])
        if not len(pair):
            return
        pair, inverse = np.unique(pair, return_inverse=True)
        count, at = np.zeros(len(pair), np.int64), 0
        for one, c in zip(batches, asked, strict=True):
            own = inverse[at : at + len(c[3])]
            count[own] += c[4]  # a batch asks about a pair once
            if len(own):
                yield part, one, [tb.pack(np.diff(own, prepend=0).astype(np.int32))], None  # a batch's pairs come in the same order
            at += len(own)
        contexts, first, sizes = np.unique(pair >> np.uint64(32), return_index=True, return_counts=True)
        customers, spread = np.add.reduceat(count, first), np.ones(len(contexts), np.int32)
        for c in asked:
            spread[np.searchsorted(contexts, c[0])] = c[2]
        if hot.shape[1]:  # of a spread context, the customers of all parts
            place = np.minimum(np.searchsorted(contexts, hot[0].astype(np.uint64)), len(contexts) - 1)
            here = contexts[place] == hot[0].astype(np.uint64)
            customers[place[here]] = hot[1][here]
        words, word = np.unique(pair & np.uint64(0xFFFFFFFF), return_inverse=True)
        order = _by_word_part(words, word_parts)
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words))
        kept = (contexts.astype(np.uint32), sizes.astype(np.int32), customers, spread, words[order].astype(np.uint32), place[word], count)
        yield part, -1, [tb.pack(x) for x in kept], None

    return run


def _of_part(columns: list[np.ndarray], k: int) -> Iterator[np.ndarray]:
    """The columns of the k-th part of a group; the first two say how many contexts and pairs each part has, the next two are of the group."""
    heads, pairs = (np.concatenate([[0], np.cumsum(c)]) for c in columns[:2])
    for c in columns[4:7]:
        yield c[heads[k] : heads[k + 1]]
    for c in columns[7:]:
        yield c[pairs[k] : pairs[k + 1]]


def _sweep(sweep: int, seed: int, word_parts: int, known: int, roots: list[dict]):
    """One sweep over a part's restaurants, given what the parent drew after the one before.

    Sweep 0 seats each dish at one table.  The state has the tables of the busy
    pairs and, of each sweep that is averaged, these and the totals of spread
    contexts.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stirling = log_stirling(DISCOUNT, EXACT)
        for some in rows:
            for i in range(some.num_rows):
                row = some.slice(i, 1).to_pylist()[0]
                part, own, kept = row["part"], _Restaurants(row["columns"], word_parts), []
                t = np.ones(len(own.busy), np.int64)
                if sweep:
                    t, *kept = (tb.unpack(c) for c in row["state"])
                    drawn, hot = _told(row["replies"])
                    if sweep > BURN_IN + 1:
                        kept += [t, hot]
                    everywhere, root = own.everywhere(t, hot), roots[-1]
                    rng = np.random.default_rng([seed, sweep, part])
                    u = rng.gamma(STRENGTH / DISCOUNT + everywhere)
                    for k in own.hot.tolist():  # all parts of a context draw the same
                        u[k] = np.random.default_rng([seed, sweep, 1 << 32, int(own.contexts[k])]).gamma(STRENGTH / DISCOUNT + everywhere[k])
                    drawn = np.log((drawn + root["rest"] / (known + 1.0)) / (root["drawn"] + root["rest"]))
                    log_x = np.log(DISCOUNT * u)[own.of[own.busy]] + drawn[own.busy_word]
                    t = tables(rng, own.count[own.busy], log_x, t if sweep > 1 else np.zeros(len(t)), DISCOUNT, stirling)
                yield _rows([(part, -1, [tb.pack(x) for x in (t, *kept)], None), *own.ask(part, t, sweep == 0, sweep == BURN_IN + SWEEPS)])

    return run


def _predict(word_parts: int, known: int, roots: list[dict]):
    """Probabilities of a part's pairs, averaged over the sweeps after the first, for each batch that asked."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows:
            for i in range(some.num_rows):
                row = some.slice(i, 1).to_pylist()[0]
                own, (t, *kept) = _Restaurants(row["columns"], word_parts), [tb.unpack(c) for c in row["state"]]
                hot, *told = _told(row["replies"])
                kept += [t, hot]
                total = np.zeros(len(own.word))
                for k in range(SWEEPS):
                    customers, seated, root = told[2 * k], told[2 * k + 1], roots[BURN_IN + 1 + k]
                    parent = (customers - ROOT_DISCOUNT * seated + (ROOT_STRENGTH + ROOT_DISCOUNT * root["tables"]) / (known + 1.0)) / (ROOT_STRENGTH + root["customers"])
                    of_pair = np.minimum(own.count, 1)
                    of_pair[own.busy] = kept[2 * k]
                    open_ = STRENGTH + DISCOUNT * own.everywhere(kept[2 * k], kept[2 * k + 1])
                    total += own.count - DISCOUNT * of_pair + open_[own.of] * parent[own.word]
                total = (total / (SWEEPS * (STRENGTH + own.customers[own.of]))).astype(np.float32)
                for asked in row["asked"]:
                    yield _rows([(row["part"], asked["batch"], [tb.pack(total[np.cumsum(tb.unpack(asked["columns"][0]))])], None)])

    return run


def _seat_root(sweep: int, seed: int, known: int, u: float):
    """For one part of the words: seats the customers that the restaurants sent, and tells each of them what is drawn.

    After the last sweep it tells the customers and tables of all words instead,
    for each sweep that is averaged.  Its own state is the row of part -1:
    ranks, customers from pairs of one, tables, and those of averaged sweeps.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
        word_part = rows[0]["part"]
        before = [tb.unpack(c) for r in rows if r["batch"] < 0 for c in r["columns"]]
        parts = [r["batch"] for r in rows if r["batch"] >= 0]
        sent = [[tb.unpack(c) for c in r["columns"]] for r in rows if r["batch"] >= 0]
        del rows
        if before:
            ranks, base, now, *kept = before
        else:
            ranks, inverse = np.unique(np.concatenate([c[4] for c in sent]), return_inverse=True)
            base, kept = np.zeros(len(ranks), np.int64), []
            np.add.at(base, inverse, np.concatenate([c[5] for c in sent]))
            now = np.zeros(len(ranks), np.int64)
        customers = base.copy()
        place = [np.searchsorted(ranks, c[0]) for c in sent]
        for own, c in zip(place, sent, strict=True):
            customers[own] += c[1]  # a part has a word once
        hot, hot_inverse = np.unique(np.concatenate([c[2] for c in sent]), return_inverse=True)
        everywhere = np.zeros(len(hot), np.int64)
        np.add.at(everywhere, hot_inverse, np.concatenate([c[3] for c in sent]))
        rng = np.random.default_rng([seed, sweep, 1 << 33, word_part])
        log_x = np.full(len(ranks), math.log(ROOT_DISCOUNT * u / (known + 1.0)))
        t = tables(rng, customers, log_x, np.minimum(now, customers), ROOT_DISCOUNT, log_stirling(ROOT_DISCOUNT, EXACT))
        left = customers - ROOT_DISCOUNT * t
        drawn = np.where(left > 0, rng.gamma(np.maximum(left, 1e-9)), 0.0)
        if sweep > BURN_IN:
            kept += [customers, t]
        found = [(word_part, -1, [tb.pack(x) for x in (ranks, base, t, *kept)], [float(customers.sum()), float(t.sum()), float(drawn.sum())])]
        hot_at = 0
        for part, own, c in zip(parts, place, sent, strict=True):
            more = everywhere[hot_inverse[hot_at : hot_at + len(c[2])]]
            hot_at += len(c[2])
            if sweep < BURN_IN + SWEEPS:
                columns = [drawn[own].astype(np.float32), more]
            else:
                every = np.searchsorted(ranks, c[4])
                columns = [more, *[x[every] for x in kept]]
            found.append((part, word_part, [tb.pack(x) for x in columns], None))
        return pa.Table.from_batches([_rows(found)])

    return run


def score(docs: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out boolean, n_tokens, n_known, train_tokens long, base_score, score double.

    Texts learn and are scored by their words, A-Z in lower case, and one end.
    Rows whose crc32(doc_id as text) mod 7 is 2 are scored only; null ids are
    learned from.  A null or empty text is an end alone.  Repeated rows count as
    often as they are there.  If nothing is learned from, each token has the
    same probability as the one unknown word, 1.  An empty table gives no rows.
    Reruns agree.  There is room for 2^32 distinct words; more are an error.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    batches = tb.build(docs, scratch, True, id_col, text_col)
    size = tb.total_words(batches)
    word_parts, parts = tb.parts_for(size, PART_WORDS), tb.parts_for(size, PART_PAIRS)

    def words(row):
        t = _Tokens(row)
        return tb.deal(t.b.number, t.keys, word_parts, t.counts().astype(np.int32))

    seen = scratch.save_wide(tb.answer(tb.ask(batches, words), _word_counts(word_parts)), "seen")
    scratch.tidy()
    known, total, most = _totals(seen)
    if most * word_parts >= 1 << 32:
        raise ValueError("more distinct words than numbers for them")
    hot = max(1000, total // (4 * parts))
    rows = tb.joined(batches, seen, "seen")

    def pairs(row):
        t = _Tokens(row)
        every, number = tb.gathered(row["seen"], 0), tb.gathered(row["seen"], 1)
        customers = t.context_counts(every)
        context, token, count, _ = t.pairs()
        part, spread = _part_of(number[context], number[token], customers[context], hot, parts)
        order = _order(part, number[context], number[token], parts)
        part, context, token, count, spread = (x[order] for x in (part, context, token, count, spread))
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (context[1:] != context[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(part))).astype(np.int32)
        every_part = np.arange(parts + GROUP)
        pair_at, head_at = np.searchsorted(part, every_part), np.searchsorted(part[head], every_part)
        for g in np.unique(part // GROUP).tolist():
            a, z = (x[[g * GROUP, (g + 1) * GROUP]] for x in (pair_at, head_at))
            heads, pairs_ = head[z[0] : z[1]], slice(a[0], a[1])
            shares = [np.diff(x[g * GROUP : (g + 1) * GROUP + 1]).astype(np.int32) for x in (head_at, pair_at)]
            wide = context[heads[spread[heads] > 1]]
            yield g, t.b.number, [tb.pack(x) for x in (*shares, number[wide], customers[wide], number[context[heads]], size[z[0] : z[1]], spread[heads].astype(np.int32), number[token[pairs_]], count[pairs_].astype(np.int32))]

    opened = tb.ask(rows, pairs).groupBy("part").applyInArrow(_open(word_parts), ROWS_SQL)
    static = scratch.bucketed(opened, "restaurants", "part")
    del opened
    scratch.tidy()
    restaurants = static.where("batch = -1").select("part", "columns")
    state, replies, roots, root_tables = None, None, [], float(known)
    rng = np.random.default_rng([seed, 1 << 34])

    def with_replies() -> DataFrame:
        own = restaurants.join(state.where("batch = -1").select("part", F.col("columns").alias("state")), "part")
        told = replies.where("batch >= 0").groupBy("part").agg(F.collect_list(F.struct("batch", "columns")).alias("replies"))
        return own.join(told, "part", "left")

    for sweep in range(BURN_IN + SWEEPS + 1):
        new = scratch.bucketed((with_replies() if sweep else restaurants).mapInArrow(_sweep(sweep, seed, word_parts, known, roots[-1:]), ROWS_SQL), f"swept{sweep}", "part")
        to_root = new.where("batch >= 0")
        if sweep:
            to_root = to_root.unionByName(replies.where("batch = -1"))
        u = rng.gamma(ROOT_STRENGTH / ROOT_DISCOUNT + root_tables)
        told = scratch.save_wide(to_root.groupBy("part").applyInArrow(_seat_root(sweep, seed, known, u), ROWS_SQL), f"root{sweep}")
        sums = told.where("batch = -1").agg(*[F.sum(F.col("stats")[k]) for k in range(3)]).first()
        customers, root_tables, drawn = (float(x or 0.0) for x in sums)
        roots.append({"customers": customers, "tables": root_tables, "drawn": drawn, "rest": rng.gamma(ROOT_STRENGTH + ROOT_DISCOUNT * root_tables)})
        if sweep:
            scratch.drop(f"swept{sweep - 1}")
            scratch.drop(f"root{sweep - 1}")
        state, replies = new, told
        del new, told, to_root
        scratch.tidy()
    asked = static.where("batch >= 0").groupBy("part").agg(F.collect_list(F.struct("batch", "columns")).alias("asked"))
    predicted = scratch.save_wide(with_replies().join(asked, "part").mapInArrow(_predict(word_parts, known, roots), ROWS_SQL).select("part", "batch", "columns"), "predicted")
    for name in ("restaurants", f"swept{BURN_IN + SWEEPS}", f"root{BURN_IN + SWEEPS}"):
        scratch.drop(name)
    scratch.tidy()
    rows = tb.joined(tb.joined(batches, seen, "seen"), predicted, "predicted")
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows:
            for i in range(some.num_rows):
                row = some.slice(i, 1).to_pylist()[0]
                t = _Tokens(row)
                every, number = tb.gathered(row["seen"], 0), tb.gathered(row["seen"], 1)
                customers = t.context_counts(every)
                context, token, _, pair = t.pairs()
                part, _ = _part_of(number[context], number[token], customers[context], hot, parts)
                order = _order(part, number[context], number[token], parts)
                at = np.searchsorted(part[order], np.arange(parts + 1))
                p = np.zeros(len(context))
                for r in row["predicted"]:
                    p[order[at[r["part"]] : at[r["part"] + 1]]] = tb.unpack(r["columns"][0])
                base = np.log10((every[t.token] + 1.0) / (total + known + 1.0))
                yield batch(schema, t.b.doc_ids, t.held_out, t.b.sizes + 1, np.add.reduceat((every[t.token] > 0).astype(np.int64), t.starts), np.full(len(t.starts), total), np.add.reduceat(base, t.starts), np.add.reduceat(np.log10(p)[pair], t.starts))

    out = scratch.save_wide(rows.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores", rows=1)
    for name in ("batches", "seen", "predicted"):
        scratch.drop(name)
    return out
