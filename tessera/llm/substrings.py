"""Substring dedup by seed and extend.

Anchors are word k-grams picked by winnowing: of the k-grams in any window of
the threshold's length, the one with the least hash, so equal windows have
equal anchors at equal places.  Occurrences of an anchor meet if several
documents have it, each with the words around it and its document's id.  All
occurrences of an anchor are extended at once, word by word, to the right and to
the left: where words differ, the group parts, and an occurrence that is alone
is extended no further.  A window is an extension to both sides; of those that
reach it together, the least id is its first document.  Windows that an earlier
document has too are merged into maximal repeats, and those go.

No pair of documents is ever formed, so a passage of many documents costs as
much as its occurrences, and a batch sends occurrences with equal surroundings
once.  An anchor of more occurrences than a task should hold is extended where
it stands: each of its windows goes to the task that the window's own hash
names, which knows the window's least id, so the anchor is spread over all
tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import token_batches as tb
from .common import Scratch, batch

#: Words of a repeat, at least, and of an anchor.
LEAST = 13
ANCHOR = 7
#: Words, about, whose anchors one task extends.
PART_WORDS = 1_000_000
#: Occurrences of an anchor that one task extends.
HOT = 200_000
_NULL_ID = -(2**63)
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _order(doc_ids: list[int | None]) -> np.ndarray:
    """Ids to compare by; null comes before all others."""
    return np.array([_NULL_ID if i is None else i for i in doc_ids], np.int64)


def _groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group of equal (a, b), and the first row of each group in the order given."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


class _Seeds:
    """Of a batch: ``at``, the places where a window starts, ``of``, each one's anchor, and ``place``, where the anchors stand."""

    def __init__(self, row: dict, least: int, anchor: int):
        self.b = b = tb.Batch(row)
        self.least, self.anchor, self.side = least, anchor, least - anchor
        self.hashes = tb.mixed(b.hashes() + np.uint64(1))
        values = self.hashes[b.index]
        room = np.maximum(0, b.sizes - least + 1)
        self.at = np.arange(int(room.sum())) + np.repeat(b.starts[:-1] - np.cumsum(room) + room, room)
        n = max(0, len(values) - anchor + 1)
        low = tb.sequence_hash(values, slice(0, n), anchor, _FACTORS[0]) if n else np.zeros(0, np.uint64)
        gram, where, have = low, np.arange(n), 1
        while have < self.side + 1 and len(low):  # the first place of the least hash among the next side + 1
            step = min(have, self.side + 1 - have)
            later = low[step:] < low[: len(low) - step]
            low, where = np.where(later, low[step:], low[: len(low) - step]), np.where(later, where[step:], where[: len(where) - step])
            have += step
        self.place, self.of = np.unique(where[self.at], return_inverse=True) if len(self.at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.doc = np.searchsorted(b.starts, self.place, side="right") - 1
        self.key = gram[self.place] if len(self.place) else np.zeros(0, np.uint64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors in order, and twice their occurrences in the batch, one more if several of its documents have them."""
        order = np.argsort(self.key, kind="stable")  # documents stay in order
        key, first, count = np.unique(self.key[order], return_index=True, return_counts=True)
        doc = self.doc[order]
        return key, 2 * count + (doc[first] != doc[first + count - 1])

    def around(self, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Words to the right of anchors and, from there on, to the left, outwards; -1 beyond the text."""
        b = self.b
        steps = np.arange(self.side)
        at = np.concatenate([place[:, None] + self.anchor + steps, place[:, None] - 1 - steps], axis=1)
        inside = (at >= b.starts[doc, None]) & (at < b.starts[doc + 1, None])
        return np.where(inside, b.index[np.clip(at, 0, max(0, len(b.index) - 1))], -1)

    def occurrences(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the anchors that other documents have: which, the number of the surroundings of each, and of each
        surroundings in the order of the anchor the anchor, the least id, the words around it, and if the anchor is hot."""
        keys, _ = self.keys()
        on = np.flatnonzero(shared[np.searchsorted(keys, self.key)] > 0) if len(keys) else np.zeros(0, np.int64)
        words = self.around(self.place[on], self.doc[on])
        a = self.key[on]
        with np.errstate(over="ignore"):
            second = a.copy()
            for j in range(words.shape[1]):
                second = tb.mixed(second * np.uint64(_FACTORS[1]) + words[:, j].astype(np.uint64))
        number, first = _groups(a, second)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, number, _order(self.b.doc_ids)[self.doc[on]])
        hot = shared[np.searchsorted(keys, a[first])] > 1 if len(keys) else np.zeros(0, bool)
        return on, number, a[first], least, words[first], hot

    def windows(self, key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of surroundings: the row and the words to the left of each window that its text has, and two hashes of it, by the first of them."""
        side, rows, lefts, first, second = self.side, [], [], [], []
        hashes = np.where(words >= 0, self.hashes[words], np.uint64(0)) if len(self.hashes) else np.zeros(words.shape, np.uint64)
        for k in range(side + 1):
            own = np.concatenate([np.arange(side, side + k), np.arange(side - k)]).astype(int)
            on = np.flatnonzero((words[:, own] >= 0).all(axis=1))
            h = [tb.mixed(key[on] + np.uint64(k + 1)), tb.mixed(key[on] ^ np.uint64(_FACTORS[1] - k))]
            with np.errstate(over="ignore"):
                for c in own.tolist():
                    h = [tb.mixed(x * np.uint64(f) + hashes[on, c]) for x, f in zip(h, _FACTORS, strict=True)]
            rows.append(on)
            lefts.append(np.full(len(on), k))
            first.append(h[0])
            second.append(h[1])
        rows, lefts, first, second = (np.concatenate(x) for x in (rows, lefts, first, second))
        order = np.lexsort((second, first))
        return rows[order], lefts[order], first[order], second[order]


def _extended(start: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Groups of equal extensions by 0, 1, ... words from groups ``start``; -1 where an occurrence is alone."""
    size = np.bincount(start)
    now = np.where(size[start] > 1, start, -1)
    out, active = [now], np.flatnonzero(now >= 0)
    for j in range(words.shape[1]):
        active = active[words[active, j] >= 0]
        code = now[active].astype(np.int64) * (int(words.max(initial=0)) + 1) + words[active, j]
        _, group, size = np.unique(code, return_inverse=True, return_counts=True)
        more = size[group] > 1
        now = np.full(len(start), -1, np.int64)
        now[active[more]] = group[more]
        active = active[more]
        out.append(now)
    return out


def extend(anchors: np.ndarray, ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Bits of each occurrence: bit l if the window that begins l words before its anchor is in a document of a smaller id.

    ``words``: to the right and then to the left of each anchor, as many each as
    a window has beside its anchor; -1 beyond a text.
    """
    side = words.shape[1] // 2
    _, start = np.unique(anchors, return_inverse=True)
    right, left = _extended(start, words[:, :side]), _extended(start, words[:, side:])
    out = np.zeros(len(anchors), np.uint32)
    for k in range(side + 1):
        on = np.flatnonzero((left[k] >= 0) & (right[side - k] >= 0))
        if len(on):
            group, _ = _groups(left[k][on], right[side - k][on])
            least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, ids[on])
            out[on] |= (least[group] < ids[on]).astype(np.uint32) << np.uint32(k)
    return out


def _which_are_shared(columns: list[list[np.ndarray]], part: int, hot: int = HOT) -> list[list[np.ndarray]]:
    """0 for an anchor of one document, 1 for one of several, 2 where it stands in more than ``hot`` places."""
    keys, told = np.concatenate([c[0] for c in columns]), np.concatenate([c[1] for c in columns]).astype(np.int64)
    own, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    shared = count > 1
    np.logical_or.at(shared, inverse, (told & 1) > 0)
    places = np.zeros(len(own), np.int64)
    np.add.at(places, inverse, told >> 1)
    answer = shared.astype(np.uint8) + (shared & (places > hot)).astype(np.uint8)
    cuts = np.cumsum([len(c[0]) for c in columns])[:-1]
    return [[x] for x in np.split(answer[inverse], cuts)]


def _least_ids(columns: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """columns: two hashes of each window of hot anchors, and the least id of a batch; the least of all."""
    group, _ = _groups(np.concatenate([c[0] for c in columns]), np.concatenate([c[1] for c in columns]))
    ids = np.concatenate([c[2] for c in columns])
    least = np.full(int(group.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    return [[x] for x in np.split(least[group], np.cumsum([len(c[0]) for c in columns])[:-1])]


def _extend_all(columns: list[list[np.ndarray]], part: int) -> list[list[np.ndarray]]:
    """columns: anchors, ids, the message's distinct words as hashes, and of each occurrence the words around it as places in those."""
    every, sizes = np.unique(np.concatenate([c[2] for c in columns])), [len(c[0]) for c in columns]
    words = []
    for c in columns:
        place = np.append(np.searchsorted(every, c[2]), -1)  # -1 stays -1
        words.append(place[c[3].astype(np.int64)].reshape(len(c[0]), -1))
    bits = extend(np.concatenate([c[0] for c in columns]), np.concatenate([c[1] for c in columns]), np.concatenate(words))
    return [[x] for x in np.split(bits, np.cumsum(sizes)[:-1])]


def _once(first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows in order: the first of each, the number of each one's, and the least id of each."""
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    number, at = np.cumsum(new) - 1, np.flatnonzero(new)
    return at, number, np.minimum.reduceat(ids, at) if len(at) else ids


def dedup(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed long, kept_sha256 string, spans array<struct<start,end>>.

    Words go that a window of ``least`` words covers whose words also start in a
    document of a smaller id.  Spans are the maximal repeats, in words, ends
    exclusive.  Null and empty texts have no words.  Rows with one id, repeated
    rows among them, take nothing from each other.  A null id is smaller than
    all others.  An empty table gives no rows.
    """
    if not 0 < anchor <= least <= anchor + 31:
        raise ValueError("an anchor has to be shorter than a window by 31 words at most")
    scratch = Scratch(docs.sparkSession, "substrings")
    batches = tb.build(docs, scratch, False, id_col, text_col)
    parts = tb.parts_for(tb.total_words(batches), PART_WORDS)

    def seeds(row):
        s = _Seeds(row, least, anchor)
        keys, several = s.keys()
        return tb.deal(s.b.number, keys, parts, several.astype(np.int64))

    shared = scratch.save_wide(tb.answer(tb.ask(batches, seeds), lambda columns, part: _which_are_shared(columns, part, hot)), "shared")
    scratch.tidy()
    rows = tb.joined(batches, shared, "shared")

    def occurrences(row):
        s = _Seeds(row, least, anchor)
        _, _, key, ids, words, is_hot = s.occurrences(tb.gathered(row["shared"], 0))
        if is_hot.any():  # parts of their own, behind the others
            at, _, first, second = s.windows(key[is_hot], words[is_hot])
            one, _, low = _once(first, second, ids[is_hot][at])
            for part, number, packed in tb.deal(s.b.number, first[one], parts, second[one], low):
                yield part + parts, number, packed
        key, ids, words = key[~is_hot], ids[~is_hot], words[~is_hot]
        at = np.append(np.searchsorted(key, tb.edges(parts)), len(key))
        for part in np.flatnonzero(np.diff(at)).tolist():
            own = slice(at[part], at[part + 1])
            used, place = np.unique(words[own], return_inverse=True)
            beyond = int(used[0] < 0)
            place = place.ravel() - beyond
            yield part, s.b.number, [tb.pack(x) for x in (key[own], ids[own], s.hashes[used[beyond:]], place.astype(np.int32))]

    def extended(columns: list[list[np.ndarray]], part: int) -> list[list[np.ndarray]]:
        return _extend_all(columns, part) if part < parts else _least_ids(columns)

    told = scratch.save_wide(tb.answer(tb.ask(rows, occurrences), extended), "told")
    scratch.tidy()
    rows = tb.joined(rows, told, "told")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", span)])

    def remove(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows:
            for i in range(some.num_rows):
                row = some.slice(i, 1).to_pylist()[0]
                s = _Seeds(row, least, anchor)
                b, ids = s.b, _order(row["doc_ids"])
                on, number, key, first, words, is_hot = s.occurrences(tb.gathered(row["shared"], 0))
                bits = np.zeros(len(first), np.uint32)
                bits[~is_hot] = tb.gathered([r for r in row["told"] or [] if r["part"] < parts], 0).astype(np.uint32)
                if is_hot.any():
                    lowest = tb.gathered([r for r in row["told"] or [] if r["part"] >= parts], 0)
                    at, left, one, two = s.windows(key[is_hot], words[is_hot])
                    _, which, _ = _once(one, two, first[is_hot][at])
                    mine = np.flatnonzero(is_hot)[at]
                    np.bitwise_or.at(bits, mine, (lowest[which] < first[mine]).astype(np.uint32) << left.astype(np.uint32))
                # of windows with one anchor and equal surroundings, those of the least id here are its own
                known = np.full(len(s.place), 0, np.uint32)
                if len(on):
                    later = ids[s.doc[on]] > first[number]
                    known[on] = np.where(later, np.uint32(0xFFFFFFFF), bits[number])
                hit = s.at[(known[s.of] >> (s.place[s.of] - s.at).astype(np.uint32) & 1) > 0]
                cover = np.zeros(len(b.index) + 1, np.int32)
                cover[hit] += 1  # each place once
                cover[hit + least] -= 1
                gone = np.cumsum(cover)[:-1] > 0
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[b.starts])
                shas, spans = [], []
                for d, (a, z) in enumerate(zip(b.starts[:-1].tolist(), b.starts[1:].tolist(), strict=True)):
                    kept = b.index[a:z][~gone[a:z]] if removed[d] else b.index[a:z]
                    shas.append(hashlib.sha256(b" ".join(map(b.words.__getitem__, kept.tolist()))).hexdigest() if len(kept) else _EMPTY)
                    cuts = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:z], [0]]))).reshape(-1, 2) if removed[d] else np.zeros((0, 2), int)
                    spans.append([{"start": x, "end": y} for x, y in cuts.tolist()])
                yield batch(schema, row["doc_ids"], b.sizes, removed, shas, spans)

    out = scratch.save_wide(rows.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"), "kept", rows=1)
    for name in ("batches", "shared", "told"):
        scratch.drop(name)
    return out
