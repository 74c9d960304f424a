"""Benchmark decontamination with an FM-index of each training shard.

A shard is a run of documents of one partition.  All its words become symbols,
and its FM-index (Burrows-Wheeler transform in a wavelet matrix, with sampled
suffix positions) is a row of a stored table: a new benchmark searches the same
index.  Backward search gives each test window's rows, walking back to a sampled
position gives its places, and the places merge into removal spans.

Test items are searched in blocks of a bounded size, one job after another; only
the block of the running job is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, documents, pick, text_key, texts

WINDOW = 10
#: Words after which a shard is closed; a longer document is a shard of its own.
SHARD_WORDS = 400_000
#: Bytes of test texts in one block.
BLOCK_BYTES = 3 << 20
#: Every so many text positions, a suffix position is kept.
SAMPLE_EVERY = 8
#: Texts that go to a worker at once, and shards.
TEXT_ROWS, SHARD_ROWS = 500, 2

#: Bytes of words: digits, letters in lower case, and all of U+0080 and above.
_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class BitVector:
    """Bits with a running count for every 64 of them."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    @classmethod
    def of(cls, bits: np.ndarray) -> BitVector:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        return cls(words)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Bits of the symbols, level by level from the highest; ``zeros`` of each level."""

    def __init__(self, levels: list[BitVector], zeros: list[int]):
        self.levels, self.zeros = list(zip(range(len(levels) - 1, -1, -1), levels, strict=True)), zeros

    @classmethod
    def of(cls, values: np.ndarray, symbols: int) -> WaveletMatrix:
        levels, zeros = [], []
        for level in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bits = (values >> level & 1).astype(bool)
            levels.append(BitVector.of(bits))
            zeros.append(int(len(bits) - bits.sum()))
            values = np.concatenate([values[~bits], values[bits]])
        return cls(levels, zeros)

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i comes to lie as symbols are sorted out level by level."""
        for (level, bits), zeros in zip(self.levels, self.zeros, strict=True):
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and where it comes to lie."""
        symbol = np.zeros(len(i), np.int64)
        for (_, bits), zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits[i], bits.rank(i)
            symbol = symbol << 1 | one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Symbol 0 ends a suffix: each one differs from all others, in text order.

    Suffixes are sorted by as many symbols as fit in a word; those that are
    still alike are told apart by the ranks of what follows, over doubled
    lengths, and only they are sorted again.
    """
    n, bits = len(text), max(1, (symbols - 1).bit_length())
    step = max(1, 62 // bits)
    key, running = np.zeros(n, np.int64), np.ones(n, bool)
    padded = np.concatenate([text.astype(np.int64), np.zeros(step, np.int64)])
    for k in range(step):
        own = padded[k : k + n]
        running &= own > 0
        key = key << bits | np.where(running, own, 0)
    order = np.argsort(key, kind="stable")  # of equal suffixes with their end, the first in the text comes first
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    new |= ~running[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order
        own = order[slots]
        group, after = rank[own], rank[own + step]
        again = np.lexsort((after, group))
        own, group, after = own[again], group[again], after[again]
        order[slots] = own
        first = np.ones(len(slots), bool)
        first[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        new[slots] = first
        rank[own] = np.maximum.accumulate(np.where(first, slots, 0))
        step *= 2


class FMIndex:
    """Of symbols 1 to ``symbols`` - 1; 0 separates, and has to come last."""

    def __init__(self, counts: np.ndarray, wavelet: WaveletMatrix, kept: BitVector, samples: np.ndarray):
        self.counts, self.wavelet, self.kept, self.samples = counts, wavelet, kept, samples
        self.n, every = int(counts.sum()), np.arange(len(counts))
        self.base = np.concatenate([[0], np.cumsum(counts)[:-1]]) - wavelet.down(every, np.zeros(len(counts), np.int64))

    @classmethod
    def of(cls, text: np.ndarray, symbols: int) -> FMIndex:
        sa = suffix_array(text, symbols)
        before = text[sa - 1]
        # walking back never crosses a separator: where a run begins, the position is kept too
        kept = (sa % SAMPLE_EVERY == 0) | (before == 0)
        return cls(np.bincount(text, minlength=symbols), WaveletMatrix.of(before.astype(np.int32), symbols), BitVector.of(kept), sa[kept].astype(np.int32))

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each window; windows are padded on the right."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for at in range(windows.shape[1] - 1, -1, -1):
            on = np.flatnonzero((at < lengths) & (low < high))
            symbol = windows[on, at].astype(np.int64)
            low[on] = self.base[symbol] + self.wavelet.down(symbol, low[on])
            high[on] = self.base[symbol] + self.wavelet.down(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        out, rows, at, steps = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(at):
            here = self.kept[rows] == 1
            out[at[here]] = self.samples[self.kept.rank(rows[here])] + steps
            at, rows, steps = at[~here], rows[~here], steps + 1
            if len(at):
                symbol, down = self.wavelet.access(rows)
                rows = self.base[symbol] + down
        return out


class Shard:
    """An FM-index of documents, the symbols of its words, and where each document begins."""

    def __init__(self, place: dict[bytes, int], index: FMIndex, sizes: np.ndarray):
        self.place, self.index, self.sizes = place, index, sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)

    @classmethod
    def of(cls, docs: list[list[bytes]]) -> Shard:
        place: dict[bytes, int] = {}
        for d in docs:
            for w in d:
                if w not in place:
                    place[w] = len(place) + 1
        sizes = np.array([len(d) for d in docs], np.int64)
        ids, at = np.zeros(int((sizes + 1).sum()), np.int32), 0
        for d in docs:
            ids[at : at + len(d)] = list(map(place.__getitem__, d))
            at += len(d) + 1
        return cls(place, FMIndex.of(ids, len(place) + 1), sizes)

    def parts(self) -> list:
        i = self.index
        levels = b"".join(bits.words.tobytes() for _, bits in i.wavelet.levels)
        return [self.sizes.tolist(), zstandard.compress(b" ".join(self.place), 1), zstandard.compress(i.counts.astype("<i4").tobytes(), 1), levels, i.wavelet.zeros, i.kept.words.tobytes(), i.samples.tobytes()]

    @classmethod
    def stored(cls, sizes, words, counts, levels, zeros, kept, samples) -> Shard:
        words = zstandard.decompress(words).split()
        levels = np.frombuffer(levels, np.uint64).reshape(len(zeros), -1)
        counts = np.frombuffer(zstandard.decompress(counts), "<i4").astype(np.int64)
        index = FMIndex(counts, WaveletMatrix([BitVector(x) for x in levels], zeros), BitVector(np.frombuffer(kept, np.uint64)), np.frombuffer(samples, np.int32))
        return cls(dict(zip(words, range(1, len(words) + 1), strict=True)), index, np.array(sizes, np.int64))


class Phrases:
    """Windows of test items, as numbers of their words: arrays alone, of about 100 bytes for each word of the items while they are made."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        number: dict[bytes, int] = {}
        self.ids = sorted({i for i, _ in items}, key=lambda i: (i is not None, str(i)))
        place = {x: k for k, x in enumerate(self.ids)}
        own = [np.array([number.setdefault(w, len(number)) for w in words_of((text or "").encode())], np.int32) for _, text in items]
        size = np.array([len(x) for x in own], np.int64)
        starts = np.cumsum(size) - size
        flat = np.concatenate([*own, np.full(window, -1, np.int32)])
        many = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        of = np.repeat(np.arange(len(items)), many)
        begin = _ranges(starts, many)
        rows = np.empty((len(begin), window), np.int32)
        for k in range(window):
            rows[:, k] = np.where(k < size[of], flat[begin + k], -1)  # a shorter item is one window, padded
        _, first, inverse = np.unique(rows.view(np.dtype((np.void, 4 * window))).ravel(), return_index=True, return_inverse=True)
        self.words, self.windows = list(number), rows[first]
        self.lengths = (self.windows >= 0).sum(axis=1)
        owner = np.array([place[i] for i, _ in items], np.int64)
        pair = np.unique(inverse.ravel() * np.int64(max(1, len(self.ids))) + owner[of])
        self.items = pair % max(1, len(self.ids))
        self.first = np.searchsorted(pair // max(1, len(self.ids)), np.arange(len(first) + 1)).astype(np.int64)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one range after another."""
    return np.arange(int(count.sum())) + np.repeat(first - np.cumsum(count) + count, count)


def find(shard: Shard, phrases: Phrases) -> tuple[dict[int, list[tuple[int, int]]], dict[int, list[int]]]:
    """Of the documents that have windows: merged spans of their words, and the items, by places."""
    if not len(phrases.lengths) or not len(shard.place):
        return {}, {}
    symbol = np.array([*(shard.place.get(w, 0) for w in phrases.words), 0], np.int64)  # 0 also pads
    windows = symbol[phrases.windows]
    known = np.flatnonzero(((windows > 0) | (phrases.windows < 0)).all(axis=1))
    lengths = phrases.lengths[known]
    low, high = shard.index.search(windows[known], lengths)
    many = np.maximum(0, high - low)
    at, window = shard.index.locate(_ranges(low, many)), np.repeat(np.arange(len(known)), many)
    cover = np.zeros(shard.index.n + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + lengths[window], -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover)[:-1] > 0, [0]])))
    spans: dict[int, list[tuple[int, int]]] = {}
    owner = np.searchsorted(shard.starts, edges[::2], side="right") - 1
    for d, a, z in zip(owner.tolist(), (edges[::2] - shard.starts[owner]).tolist(), (edges[1::2] - shard.starts[owner]).tolist(), strict=True):
        spans.setdefault(d, []).append((a, z))
    doc = np.searchsorted(shard.starts, at, side="right") - 1
    pair = np.unique(doc * np.int64(len(phrases.lengths)) + known[window])
    doc, window = pair // len(phrases.lengths), pair % len(phrases.lengths)
    count = phrases.first[window + 1] - phrases.first[window]
    pair = np.unique(np.repeat(doc, count) * len(phrases.ids) + phrases.items[_ranges(phrases.first[window], count)])
    items: dict[int, list[int]] = {}
    for d, i in zip((pair // len(phrases.ids)).tolist(), (pair % len(phrases.ids)).tolist(), strict=True):
        items.setdefault(d, []).append(i)
    return spans, items


INDEX = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("counts", pa.binary()), ("levels", pa.binary()), ("zeros", pa.list_(pa.int32())), ("kept", pa.binary()), ("samples", pa.binary())])
INDEX_SQL = "shard long, doc_ids array<long>, keys array<long>, sizes array<int>, words binary, counts binary, levels binary, zeros array<int>, kept binary, samples binary"
SPANS_SQL = "array<struct<start:long,end:long>>"


def index(docs: DataFrame, scratch: Scratch, name: str = "index", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored row for each shard of docs: its documents, and the FM-index of all their words.

    Null and empty texts have no words but their place.  An empty table has no
    shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, keys, held, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for b in batches:
            for one, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), strict=True):
                ids.append(one)
                keys.append(key)
                held.append(words_of(text))
                size += len(held[-1])
                if size >= SHARD_WORDS:
                    yield batch(INDEX, [number], [ids], [keys], *([x] for x in Shard.of(held).parts()))
                    number, ids, keys, held, size = number + 1, [], [], [], 0
        if ids:
            yield batch(INDEX, [number], [ids], [keys], *([x] for x in Shard.of(held).parts()))

    rows = documents(docs, id_col, text_col).select("doc_id", text_key(F.col("text")).alias("key"), "text")
    return scratch.save_wide(rows.mapInArrow(run, INDEX_SQL), name, TEXT_ROWS, compression="uncompressed")


def hits(shards: DataFrame, bench: DataFrame, scratch: Scratch, window: int = WINDOW, name: str = "hits", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(shard, place, spans, items) of the documents that have windows of test items; spans of several blocks may overlap.

    An item is in one block.  Each block is found in one pass over the stored
    index, so a benchmark of n blocks is n passes.
    """
    items = pick(bench, item=item_col, text=text_col).select(F.col("item").cast("long"), F.col("text").cast("string"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    own, sc, out = F.pmod(F.xxhash64("item"), F.lit(n)), bench.sparkSession.sparkContext, None
    schema = pa.schema([("shard", pa.int64()), ("place", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
    for k in range(n):
        block = sc.broadcast(Phrases([(r.item, r.text) for r in (items.where(own == k) if n > 1 else items).collect()], window))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    r = b.slice(i, 1).to_pylist()[0]
                    phrases = block.value
                    spans, found = find(Shard.stored(*(r[c] for c in ("sizes", "words", "counts", "levels", "zeros", "kept", "samples"))), phrases)
                    yield batch(schema, [r["shard"]] * len(spans), list(spans), [[{"start": a, "end": z} for a, z in x] for x in spans.values()], [[str(phrases.ids[i]) for i in found[d]] for d in spans])

        some = scratch.save_wide(shards.drop("doc_ids", "keys").mapInArrow(run, f"shard long, place int, spans {SPANS_SQL}, items array<string>"), f"{name}-{k}", SHARD_ROWS)
        out = some if out is None else out.unionByName(some)
        block.destroy()
    return out


def _merged(spans: Column) -> Column:
    """Spans in order, those that meet made one."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["start"] <= last["end"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS_SQL), step)


def _found(shards: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, spans, items) of every document of the shards."""
    places = shards.select("shard", F.posexplode(F.arrays_zip("doc_ids", "keys", "sizes")).alias("place", "x"))
    places = places.select("shard", "place", F.col("x.doc_ids").alias("doc_id"), F.col("x.keys").alias("key"), F.col("x.sizes").cast("long").alias("n_words"))
    each = found.groupBy("shard", "place").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    out = places.join(each.withColumn("spans", _merged(F.col("spans"))), ["shard", "place"], "left")
    none = F.array()
    return out.select("doc_id", "key", "n_words", F.coalesce("spans", none.cast(SPANS_SQL)).alias("spans"), F.array_sort(F.array_distinct(F.coalesce("items", none.cast("array<string>")))).alias("items"))


def search(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start,end>>.

    A window is ``window`` consecutive words of an item, or all of a shorter
    item.  Spans count words, ends exclusive; they are merged.  Null and empty
    texts have no words, items without words have no windows, and items with
    one id count as one; a null item id is written None.  Rows are judged
    alone, so repeated rows and ties play no part.  Without documents there are
    no rows; without items nothing is hit.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    shards = index(docs, scratch, "index", id_col, text_col)
    rows = _found(shards, hits(shards, bench, scratch, window, "hits", item_col, item_text_col))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


_SPELLED = re.compile(rb"[0-9a-z\x80-\xff]+")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without these words and what stands between them."""
    places = [m.span() for m in _SPELLED.finditer(text.translate(_WORD))]
    out, at = [], 0
    for a, z in spans:
        out.append(text[at : places[a][0]])
        at = places[z - 1][1]
    return b"".join([*out, text[at:]])


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs, all columns, without the removal spans; documents with no word left go.

    Where a removal brings the words of another window together, that goes as
    well: what was changed is indexed and searched again until nothing is found.
    ``chars_col``, where it is there, follows the text.  Documents without a hit
    stay as they are, null and empty texts among them.  Repeated rows are each
    cleaned alike.  An empty table, or one without texts, stays as it is.
    """
    names = docs.columns
    if text_col not in names:
        return docs
    scratch, spark = Scratch(docs.sparkSession, "clean"), docs.sparkSession
    text_at, chars_at = names.index(text_col), names.index(chars_col) if chars_col in names else -1
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.col(f"c{text_at}").cast("string")
    own_id = F.col(f"c{names.index(id_col)}").cast("long") if id_col in names else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old, spans = b.column(text_at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            new = [cut(x.encode(), [(s["start"], s["end"]) for s in y]).decode() for x, y in zip(old, spans, strict=True)]
            columns = b.columns[:-1]
            columns[text_at] = pa.array(new, columns[text_at].type)
            if chars_at >= 0:
                columns[chars_at] = pa.array(list(map(len, new))).cast(columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1]).filter(pa.array([bool(words_of(x.encode())) for x in new], pa.bool_()))

    todo, out, turn = flat, None, 0
    while True:
        shards = index(todo, scratch, f"index{turn}", f"c{names.index(id_col)}" if id_col in names else "none", f"c{text_at}")
        found = hits(shards, bench, scratch, window, f"hits{turn}", item_col, item_text_col)
        bad = _found(shards, found).where(F.size("spans") > 0).select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key"), "spans")
        bad = scratch.save(bad.groupBy("bad_id", "bad_key").agg(F.first("spans").alias("spans")), f"bad{turn}")
        scratch.drop(f"index{turn}")
        mine = own_id.eqNullSafe(bad["bad_id"]) & (text_key(text) == bad["bad_key"])
        kept = todo.join(bad, mine, "left_anti") if not bad.isEmpty() else todo
        out = kept if out is None else out.unionByName(kept)
        if kept is todo:
            return out.toDF(*names)
        changed = todo.join(bad, mine).select(*flat.columns, "spans").mapInArrow(run, flat.schema)
        todo, turn = scratch.save_wide(changed, f"changed{turn}", TEXT_ROWS), turn + 1
