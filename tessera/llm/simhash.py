"""Near duplicates by SimHash fingerprints, found by the general pigeonhole principle.

If the 64 bits are split into groups with thresholds t_i whose t_i + 1 sum to
the limit + 1, two fingerprints within the limit are within t_i in some group
i.  Bits that vary together go into one group, so that the other groups tell
fingerprints apart; a dynamic program gives each group the threshold (-1: not
probed) that makes the fewest candidates as estimated from a sample.  The
sample steers only the cost: every split and every allocation finds every link.
Candidates are then verified on all bits.  Near duplicates by Jaccard similarity
are probed the same way and verified on their shingle sets; as similar texts
may have distant fingerprints, prefixes of the sets find the rest.

Only distinct fingerprints are probed, so copies cost nothing.  A bucket of too
many fingerprints is split by the bits that it doesn't share, again by the
pigeonhole principle, until all buckets are small; no link is lost and no large
bucket is gathered.  From each bucket a spanning forest of its links goes on,
never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import token_batches as tb
from .common import Scratch, batch, documents, text_key, texts

BITS = 64
#: Fingerprints from which groups and thresholds are planned.
SAMPLE = 4_000
#: Members from which a bucket is split further, for each group that it is then split by: below, comparing all is cheaper.
MOST_IN_BUCKET = 350
#: Members up to which buckets are compared many at a time.
FEW = 64
#: Cost of an emitted key, in verified pairs.
KEY_COST = 60
#: Texts of which shingles are counted, to have those of many texts last in prefixes.
HOT_SAMPLE = 10_000
#: Texts, about, from which a shingle is hot.
HOT = 30
#: Rows of texts or sets that go to a worker at once.
WIDE_ROWS = 500
#: Bits, at least, of the sketches by which pairs are ruled out before their sets are fetched.
SKETCH_BITS = 256
#: Hot shingles that are sent to all tasks, and texts whose places are.
MOST_HOT, MOST_BROADCAST = 200_000, 200_000
#: How often some nodes of a bucket are tried with all its others, and how many of them.
TURNS, HUBS = 2, 8
#: Shingles of prefixes that a batch of texts sends, and that one task sees.
BATCH_ENTRIES, PART_ENTRIES = 200_000, 250_000


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the word shingles, in turn; of fewer words, of all of them."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    flat = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[shingle - 1 :]
    return np.array([xxhash.xxh64_intdigest(flat[a:z], 42) for a, z in zip(starts.tolist(), ends.tolist(), strict=False)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """SimHash of shingle hashes; none: zero."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key long, fp long) of each row of docs; fp has the 64 bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                yield batch(schema, b.column(0), b.column(2), np.array([fingerprint(shingle_hashes(x.lower().split(), shingle)) for x in texts(b.column(1))], np.uint64).view(np.int64))

    return documents(docs, id_col, text_col).withColumn("key", text_key(F.col("text"))).mapInArrow(run, "doc_id long, key long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits; each next bit of a group is the one that correlates most with those it has."""
    x = _bits(sample).astype(float) if len(sample) else np.zeros((1, BITS))
    x -= x.mean(axis=0)
    norm = np.sqrt((x**2).sum(axis=0))
    corr = np.abs(x.T @ x) / np.maximum(np.outer(norm, norm), 1e-12)
    left, out = list(range(BITS)), []
    for g in range(m):
        width = len(left) // (m - g)
        one = max(left, key=lambda b: (corr[b, left].sum(), -b))
        got = [one]
        left.remove(one)
        while len(got) < width:
            one = max(left, key=lambda b: (corr[b, got].sum(), -b))
            got.append(one)
            left.remove(one)
        out.append(sorted(got))
    return out


def plan(sample: np.ndarray, n: int, limit: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the groups to probe, of the cheapest split into up to limit + 1 groups."""
    bits = _bits(sample)
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    best, answer = np.inf, []
    for m in range(1, limit + 2):
        split = groups(sample, m)
        cost = np.full((m, limit + 2), np.inf)
        for g, own in enumerate(split):
            cost[g, 0] = 0  # threshold -1
            packed = np.ascontiguousarray(np.packbits(np.pad(bits[:, own], ((0, 0), (0, BITS - len(own)))), axis=1, bitorder="little")).view(np.uint64).ravel()
            near = np.zeros(BITS + 1, np.int64)
            for i in range(1, len(packed)):
                near += np.bincount(np.bitwise_count(packed[:i] ^ packed[i]), minlength=BITS + 1)
            for t in range(min(limit, len(own)) + 1):
                balls = sum(_choose(len(own), d) for d in range(t + 1))
                share = max(near[: t + 1].sum() / pairs, balls / 2.0 ** len(own))
                cost[g, t + 1] = share * n * n / 2 + KEY_COST * n * (1 + len(own) / 2 if t == 1 else balls)
        total, choice = np.full((m + 1, limit + 2), np.inf), np.zeros((m + 1, limit + 2), int)
        total[0, 0] = 0
        for g in range(m):
            for have in range(limit + 2):
                for t in range(limit + 2 - have):
                    if (new := total[g, have] + cost[g, t]) < total[g + 1, have + t]:
                        total[g + 1, have + t], choice[g + 1, have + t] = new, t
        if total[m, limit + 1] < best:
            best, answer, have = total[m, limit + 1], [], limit + 1
            for g in range(m, 0, -1):
                t = int(choice[g, have])
                have -= t
                if t:
                    answer.append((split[g - 1], t - 1))
    return answer


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _mask(bits) -> np.uint64:
    return np.uint64(sum(1 << int(b) for b in bits))


def _mix(a: np.ndarray, salt: int) -> np.ndarray:
    """64-bit mixing; two buckets that fall together only add candidates, which are verified."""
    with np.errstate(over="ignore"):
        a = a ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
        a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return a ^ (a >> np.uint64(31))


KEYS = pa.schema([("bucket", pa.int64()), ("fp", pa.int64()), ("node", pa.int64()), ("probe", pa.bool_()), ("used", pa.int64())])
KEYS_SQL = "bucket long, fp long, node long, probe boolean, used long"


def _emit(chosen: list[tuple[list[int], int]]):
    """Keys of each fingerprint: its own value in each group, and as a probe those up to the threshold away.

    With a threshold of one, of two that differ the one that lacks the bit probes.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                fp, node = (whole.column(i).slice(at, 4096).to_numpy() for i in (0, 1))
                fp = fp.view(np.uint64)
                for g, (own, t) in enumerate(chosen):
                    mask = _mask(own)
                    for d in range(t + 1):
                        flips = np.array([_mask(c) for c in combinations(own, d)], np.uint64)
                        for some in np.array_split(flips, -(-len(flips) // 64)):
                            i, j = np.nonzero((fp[:, None] & some[None, :]) == 0) if t == 1 else np.indices((len(fp), len(some))).reshape(2, -1)
                            value = (fp[i] & mask) ^ some[j]
                            yield batch(KEYS, _mix(value, g + 1).view(np.int64), fp[i].view(np.int64), node[i], np.full(len(i), d > 0), np.full(len(i), mask).view(np.int64))

    return run


def _refine(limit: int):
    """Keys of crowded buckets, split by limit + 1 groups of the bits that are still unused, of which there are more than limit."""

    def run(batches):
        for b in batches:
            bucket, fp, node, probe, used = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            bucket, fp, used = bucket.view(np.uint64), fp.view(np.uint64), used.view(np.uint64)
            for mask in np.unique(used):
                at = np.flatnonzero(used == mask)
                free = [i for i in range(BITS) if not int(mask) >> i & 1]
                for j in range(min(limit + 1, len(free))):
                    own = _mask(free[j :: limit + 1])
                    value = _mix(_mix(fp[at] & own, j + 101) ^ bucket[at], j + 201)
                    yield batch(KEYS, value.view(np.int64), fp[at].view(np.int64), node[at], probe[at], np.full(len(at), mask | own).view(np.int64))

    return run


def _near(bucket: np.ndarray, fp: np.ndarray, probe: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one bucket within the limit, not both probes, and their distances.

    The arrays are in order of the bucket, in each with probes last.
    """
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    size = np.diff(edge)
    at, lag, found = np.flatnonzero(np.repeat(size <= FEW, size)), 1, []
    while len(at):
        at = at[at + lag < len(bucket)]
        at = at[(bucket[at] == bucket[at + lag]) & ~probe[at]]
        far = np.bitwise_count(fp[at] ^ fp[at + lag])
        on = far <= limit
        found.append((at[on], at[on] + lag, far[on]))
        lag += 1
    for a, n in zip(edge[:-1][size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        own = fp[a : a + n]
        rows = int(n - probe[a : a + n].sum())
        step = max(1, (1 << 21) // n)
        for i in range(0, rows, step):
            far = np.bitwise_count(own[i : min(rows, i + step), None] ^ own[None, :])
            x, y = np.nonzero(far <= limit)
            up = y > x + i
            found.append((a + i + x[up], a + y[up], far[x[up], y[up]]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


def _forest(bucket: np.ndarray, fp: np.ndarray, node: np.ndarray, probe: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a spanning forest of each bucket's links: from the nearest on, a link for each two trees that it joins."""
    a, b, far = _near(bucket, fp, probe, limit)
    label, left, right = np.arange(len(bucket)), [], []
    for d in range(limit + 1):
        on = (far == d) & (label[a] != label[b])
        x, y = a[on], b[on]
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        _, first = np.unique(low * np.int64(len(bucket) + 1) + high, return_index=True)
        left.append(node[x[first]])
        right.append(node[y[first]])
        low, high = low[first], high[first]
        while len(low):
            new = label.copy()
            np.minimum.at(new, high, low)
            np.minimum.at(new, low, new[high])
            np.minimum.at(new, high, new[low])
            new = new[new]
            same = (new == label).all()
            label = new
            if same:
                break
        if len(low):
            label = label[label]
    left, right = np.concatenate(left), np.concatenate(right)
    return left[left != right], right[left != right]


def _links(limit: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        for b in batches:
            new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last bucket may go on
            yield links(*[x[:done] for x in held])
            held = [x[done:] for x in held]
        yield links(*held)

    def links(bucket, fp, node, probe):
        a, b = _forest(bucket, fp.view(np.uint64), node, probe, limit) if len(bucket) else (node, node)
        return batch(schema, np.minimum(a, b), np.maximum(a, b))

    return run


def links(fps: DataFrame, scratch: Scratch, limit: int = 3) -> DataFrame:
    """(a, b) long: enough of the pairs of nodes within the limit to connect all that pairs connect.

    fps: a table with distinct ``node`` long and the fingerprint ``fp`` of each.
    One node of each fingerprint is probed.  A bucket with at most ``limit``
    free bits isn't split further: it holds at most the fingerprints within its
    group's threshold, times 2^limit.
    """
    equal = scratch.save(fps.groupBy("fp").agg(F.min("node").alias("a")), "equal")
    own = equal.withColumnRenamed("a", "node")
    n = own.count()
    sample = np.array([r.fp for r in own.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("fp").collect()], np.int64).view(np.uint64)
    chosen, most = plan(sample, n, limit), MOST_IN_BUCKET * (limit + 1)
    rows, small = scratch.save(own.select("fp", "node").mapInArrow(_emit(chosen), KEYS_SQL), "keys0"), None
    for level in range(1, BITS):
        crowded = scratch.save(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most).select("bucket"), f"crowded{level}")
        if crowded.isEmpty():
            small = rows if small is None else small.unionByName(rows)
            break
        cold = rows.join(crowded, "bucket", "left_anti").select(*rows.columns)
        small = cold if small is None else small.unionByName(cold)
        hot = rows.join(crowded, "bucket", "left_semi").select(*rows.columns)
        split = F.bit_count("used") < BITS - limit
        small = small.unionByName(hot.where(~split))
        rows = scratch.save(hot.where(split).mapInArrow(_refine(limit), KEYS_SQL), f"keys{level}")
    small = small.select("bucket", "fp", "node", "probe").repartition("bucket").sortWithinPartitions("bucket", "probe", "fp", "node")
    found = small.mapInArrow(_links(limit), "a long, b long")
    equal = fps.join(equal, "fp").where("node != a").select("a", F.col("node").alias("b"))
    return found.unionByName(equal).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of an edge (a, b): root is the least node of its component.

    Each round points every node at the least of its neighbours and itself,
    follows the pointers to their ends, and joins what it found into single
    nodes; edges inside a node go.  Minima are aggregated, so a node with many
    neighbours is never gathered.  Every table is written, so a lost executor
    costs at most a round.
    """
    edges = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges0")
    total, rounds = None, 0
    while not edges.isEmpty():
        rounds += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), f"up{rounds}-0")
        jump = 0
        while True:
            jump += 1
            over = up.select(F.col("node").alias("mid"), F.col("root").alias("end"))
            up2 = scratch.save(up.join(over, up["root"] == over["mid"]).select("node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")), f"up{rounds}-{jump}")
            scratch.drop(f"up{rounds}-{jump - 1}")
            moved, up = not up2.where("moved").isEmpty(), up2.select("node", "root")
            if not moved:
                break
        if total is None:
            total = up
        else:
            step = up.select(F.col("node").alias("mid"), F.col("root").alias("end"))
            new = total.join(step, total["root"] == step["mid"], "left").select("node", F.coalesce("end", "root").alias("root"))
            total = scratch.save(new, f"total{rounds}")
        to = up.select(F.col("node").alias("mid"), F.col("root").alias("end"))
        moved_a = edges.join(to, edges["a"] == to["mid"]).select(F.col("end").alias("a"), "b")
        moved_b = moved_a.join(to, moved_a["b"] == to["mid"]).select("a", F.col("end").alias("b"))
        edges = scratch.save(moved_b.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"edges{rounds}")
    return total if total is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(docs: DataFrame, limit: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, key, fingerprint string, component_id long.

    Fingerprints within ``limit`` bits are linked, and component_id is the
    least doc_id that links reach.  Texts without words, nulls among them, have
    fingerprint zero and are linked like any other.  Null ids are passed over
    where another id is in the component.  Repeated rows each have their row;
    an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, shingle, id_col, text_col), "rows")
    fps = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps")
    root = components(links(fps.withColumn("node", F.col("fp")), scratch, limit), scratch)
    named = fps.join(root, fps["fp"] == root["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = scratch.save(named, "named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def prefix(own: np.ndarray, similarity: float, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in one order of all shingles: by hash, but hot ones last and by their counts.

    Two sets of the similarity or more share one of these: what either has
    after them is too little to hold all that they have in common.
    """
    size = len(own)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        own = own[np.lexsort((own, np.where(hot[at] == own, counts[at], 0)))]
    return own[: size - int(np.ceil(similarity * size - 1e-6)) + 1]


def sketch(own: np.ndarray) -> bytes:
    """Bits that each shingle of a set flips one of, two or more for each shingle: those of two sets differ in no more bits than the sets in shingles.

    The number of bits is a power of two, and half as many are the halves'
    difference, so sketches of different lengths can be compared.
    """
    bits = max(SKETCH_BITS, 1 << (2 * len(own) - 1).bit_length()) if len(own) else SKETCH_BITS
    flips = np.bincount((own >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits(flips & 1, bitorder="little").tobytes()


class Sketches:
    """Many sketches, compared by places."""

    def __init__(self, drawn: list[bytes]):
        self.size = np.fromiter(map(len, drawn), np.int64, len(drawn))
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.size).tolist():  # sketches of this length, and of longer ones what is left at it
            own = np.flatnonzero(self.size >= size)
            place = np.full(len(drawn), -1)
            place[own] = np.arange(len(own))
            folded = np.zeros((len(own), size // 8), np.uint64)
            for k, i in enumerate(own.tolist()):
                folded[k] = np.bitwise_xor.reduce(np.frombuffer(drawn[i], np.uint64).reshape(-1, size // 8), axis=0)
            self.rows[size] = place, folded

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits the sketches of the places differ, at the length of the shorter."""
        size, out = np.minimum(self.size[a], self.size[b]), np.zeros(len(a), np.int64)
        for s, (place, rows) in self.rows.items():
            on = np.flatnonzero(size == s)
            for at in range(0, len(on), max(1, (1 << 22) // s)):
                some = on[at : at + max(1, (1 << 22) // s)]
                out[some] = np.bitwise_count(rows[place[a[some]]] ^ rows[place[b[some]]]).sum(axis=1, dtype=np.int64)
        return out


def reachable(size_a, place_a, size_b, place_b, similarity: float, least=np.minimum):
    """If two sets may be similar whose first shingle in common has these places in their orders."""
    return least(size_a - place_a, size_b - place_b) >= (size_a + size_b) * (similarity / (1 + similarity)) - 1e-6


#: Pairs (a, b) and, where ``place`` isn't null, nodes b of buckets a.
SHARED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("size", pa.int32()), ("place", pa.int32())])
SHARED_SQL = "a long, b long, size int, place int"
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
ASKED = pa.schema([("part", pa.int32()), ("columns", pa.list_(pa.binary())), ("bucket", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("place", pa.int32())])
ASKED_SQL = "part int, columns array<binary>, bucket long, node long, size int, place int"


def _whole_buckets(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[np.ndarray]]:
    """Columns of some whole buckets at a time, ``least`` rows or more; rows come in the order of the buckets."""
    parts, rows = [], 0
    for b in chain(batches, [None]):
        if b is not None and b.num_rows:
            parts.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            rows += b.num_rows
        if not parts or (b is not None and rows < least):
            continue
        held = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if not len(held[0]):
            continue
        done = len(held[0]) if b is None else int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
        if done:
            yield [x[:done] for x in held]
        parts, rows = [[x[done:] for x in held]], 0


def _shared(similarity: float):
    """Of one range of shingles, from what batches of texts sent: pairs of each bucket's first node with its others, and buckets of three or more."""

    def run(table: pa.Table) -> pa.Table:
        sent = [[tb.unpack(c) for c in r] for r in table.column("columns").to_pylist()]
        bucket, node, size, place = (np.concatenate([f(c) for c in sent]) for f in (lambda c: c[0], lambda c: c[1][c[2]], lambda c: c[3][c[2]], lambda c: c[4]))
        del sent
        order = np.lexsort((node, bucket))
        bucket, node, size, place = bucket[order], node[order].view(np.int64), size[order], place[order]
        once = np.ones(len(bucket), bool)
        once[1:] = (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])
        bucket, node, size, place = (x[once] for x in (bucket, node, size, place))
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        n = np.diff(edge)
        first, many = np.repeat(edge[:-1], n), np.repeat(n, n)
        x = np.flatnonzero((many > 1) & (first != np.arange(len(bucket))) & reachable(size, place, size[first], place[first], similarity))
        low, high = np.minimum(node[x], node[first[x]]), np.maximum(node[x], node[first[x]])
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        none = pa.nulls(int(new.sum()), pa.int32())
        rest = many > 2
        return pa.Table.from_batches([batch(SHARED, low[new], high[new], none, none), batch(SHARED, bucket[rest].view(np.int64), node[rest], size[rest], place[rest])])

    return run


def _all_pairs(similarity: float):
    """Pairs of nodes of a group that are in different components so far and may be similar, by sizes, places and sketches.

    Rows are in the order of (group, size).  ``side`` says which of two blocks
    a row is of, -1 where there is one; a guest, of the band below, isn't
    compared with guests.  A node meets those after it in the order as long as
    their sizes can be similar.
    """
    most = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, node, size, place, label, side, guest, drawn in _whole_buckets(batches, 1 << 13):
            sketches, at, lag = Sketches(drawn.tolist()), np.arange(len(group)), 1
            while len(at):
                at = at[at + lag < len(group)]
                at = at[(group[at] == group[at + lag]) & (size[at + lag] * similarity <= size[at] + 1e-6)]
                met = (label[at] != label[at + lag]) & ((side[at] < 0) | (side[at] != side[at + lag])) & ~(guest[at] & guest[at + lag])
                a = at[met & reachable(size[at], place[at], size[at + lag], place[at + lag], similarity)]
                if len(a):
                    a = a[sketches.differ(a, a + lag) <= (size[a].astype(np.int64) + size[a + lag]) * most + 1e-6]
                    x, y = node[a], node[a + lag]
                    yield batch(LINKS, np.minimum(x, y), np.maximum(x, y))
                lag += 1

    return run


#: Nodes of a block of a crowded bucket: a task compares two blocks.
BLOCK_NODES = 4096


def _grouped(left: DataFrame, similarity: float) -> DataFrame:
    """(group, node, size, place, label, side, guest): the groups whose nodes are compared pair by pair, each of two blocks at most.

    left: (bucket, node, size, place, label), narrow rows of a stored table.  A bucket of up to
    BLOCK_NODES nodes is one group.  A larger one is cut into bands of sizes
    that similar sets can have, each with the nodes of the band below as
    guests; a band is dealt into blocks by hashes, and each two of its blocks,
    and each block by itself, are a group.  So every pair that can be similar
    meets in one group, and no task holds more than two blocks.
    """
    crowded = left.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_NODES).select("bucket", F.lit(True).alias("crowded"))
    t = left.join(crowded, "bucket", "left")
    one, none = F.lit(-1).cast("int"), F.lit(False)
    small = t.where("crowded IS NULL").select(F.xxhash64("bucket", F.lit(-1), F.lit(0), F.lit(0)).alias("group"), "node", "size", "place", "label", one.alias("side"), none.alias("guest"))
    band = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / float(-np.log(similarity) * (1 + 1e-9))).cast("int")  # similar sizes are less than a band apart, whatever the rounding
    large = t.where("crowded").withColumn("own", band).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1))).withColumn("guest", F.col("band") != F.col("own"))
    blocks = large.groupBy("bucket", "band").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("blocks"), F.min("guest").alias("guests")).where("NOT guests")  # a band of guests alone has nothing to compare
    large = large.join(blocks, ["bucket", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), one).otherwise((F.col("block") > F.col("other")).cast("int"))
    group = F.xxhash64("bucket", "band", F.least("block", "other"), F.greatest("block", "other"))
    return small.unionByName(large.select(group.alias("group"), "node", "size", "place", "label", side.alias("side"), "guest"))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, probe: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, key, root, component_id long.

    Texts are linked if their sets of ``shingle`` words have a Jaccard
    similarity of ``similarity`` or more, and components are those of all such
    links.  Candidates have fingerprints within ``probe`` bits, or share a
    shingle of their prefixes, which all such texts do; each is verified on the
    sets unless its two texts are in one component by links that were.  So that
    a large group of near copies isn't compared pair by pair, a bucket first
    tries one of its nodes with all others, then, twice, eight others, and only
    what is in different components after that pair by pair.  Texts that differ in case and white space alone are
    one node, and so are repeated rows, and texts without words, nulls among
    them.  Null ids are passed over where another id is in the component.  An
    empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "near")
    most = (1 - similarity) / (1 + similarity)

    def words_of(text: bytes) -> tuple[list[bytes], int]:
        words = text.lower().split()
        return words, xxhash.xxh64_intdigest(b" ".join(words), 7)

    marked = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x in texts(b.column(1)):
                words, node = words_of(x)
                h = shingle_hashes(words, shingle)
                own = np.unique(h)
                found.append((np.uint64(node).view(np.int64), np.uint64(fingerprint(h)).view(np.int64), len(own), sketch(own)))
            if found:
                yield batch(marked, b.column(0), b.column(2), *[list(x) for x in zip(*found, strict=True)])

    source = documents(docs, id_col, text_col).withColumn("key", text_key(F.col("text")))
    rows = scratch.save_wide(source.mapInArrow(mark, "doc_id long, key long, node long, fp long, size int, sketch binary"), "rows", WIDE_ROWS)
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "key")).alias("of"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("sketch").alias("sketch"))
    nodes = scratch.save(nodes, "nodes")
    one = nodes.agg(F.count("*"), F.sum("size")).first()
    n, entries = max(1, one[0]), int((1 - similarity) * (one[1] or 0)) + 2 * one[0]

    counted = pa.schema([("shingle", pa.int64())])

    def shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in texts(b.column(0)):
                yield batch(counted, np.unique(shingle_hashes(words_of(x)[0], shingle)).view(np.int64))

    # the sample steers only the cost: any order of shingles finds every pair
    sample = source.where(F.pmod("key", F.lit(max(1, n // HOT_SAMPLE))) == 0).dropDuplicates(["key"])
    least = max(2, HOT * min(1.0, HOT_SAMPLE / n))
    hot_rows = sample.select("text").mapInArrow(shingles_of, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "shingle").limit(MOST_HOT).collect()
    hot, counts = np.array([r.shingle for r in hot_rows], np.int64).view(np.uint64), np.array([r.n for r in hot_rows], np.int64)
    counts, hot = counts[np.argsort(hot)], np.sort(hot)
    parts = tb.parts_for(entries, PART_ENTRIES)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles of prefixes: as packed questions by ranges, but those of many texts, which one task may not hold, as rows (part -1)."""

        def close(done: dict) -> Iterator[tuple]:
            node, size = np.array(list(done), np.uint64), np.array([x[0] for x in done.values()], np.int32)
            own = [x[1] for x in done.values()]
            key = np.concatenate(own)
            many = np.array([len(x) for x in own])
            of, place = np.repeat(np.arange(len(own), dtype=np.int32), many), np.concatenate([np.arange(x, dtype=np.int32) for x in many])
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                for k in np.flatnonzero(is_hot).tolist():
                    yield -1, None, (key[k].view(np.int64), node[of[k]].view(np.int64), size[of[k]], place[k])
                key, of, place = key[~is_hot], of[~is_hot], place[~is_hot]
            order = np.argsort(key)
            key, of, place = key[order], of[order], place[order]
            at = np.append(np.searchsorted(key, tb.edges(parts)), len(key))
            for p in np.flatnonzero(np.diff(at)).tolist():
                own_ = slice(at[p], at[p + 1])
                used, short = np.unique(of[own_], return_inverse=True)
                yield p, [tb.pack(x) for x in (key[own_], node[used], short.astype(np.int32), size[used], place[own_])], None

        done, held = {}, 0
        for b in chain(batches, [None]):
            for x in texts(b.column(0)) if b is not None else []:
                words, node = words_of(x)
                if words and node not in done:
                    own = np.unique(shingle_hashes(words, shingle))
                    done[node] = len(own), prefix(own, similarity, hot, counts)
                    held += len(done[node][1])
            if done and (b is None or held >= BATCH_ENTRIES):
                found = list(close(done))
                done, held = {}, 0
                if found:
                    p, c, k = zip(*found, strict=True)
                    yield batch(ASKED, list(p), list(c), *([x and int(x[i]) for x in k] for i in range(4)))

    asked = scratch.save_wide(source.select("text").mapInArrow(keys_of, ASKED_SQL), "asked", WIDE_ROWS)
    found = scratch.save_wide(asked.where("part >= 0").select("part", "columns").groupBy("part").applyInArrow(_shared(similarity), SHARED_SQL), "shared")
    scratch.tidy()
    near = lambda *names: reachable(*map(F.col, names), similarity, F.least)
    shared, stars = found.where("place IS NOT NULL").select(F.col("a").alias("bucket"), F.col("b").alias("node"), "size", "place"), found.where("place IS NULL").select("a", "b")
    if len(hot):
        crowd = scratch.save(asked.where("part = -1").select("bucket", "node", "size", "place").dropDuplicates(["bucket", "node"]), "crowd")
        first = crowd.groupBy("bucket").agg(F.min(F.struct("node", "size", "place")).alias("hub"), F.count("*").alias("n")).where("n > 1")
        crowd = crowd.join(first, "bucket")
        stars = stars.unionByName(crowd.where("node != hub.node").where(near("size", "place", "hub.size", "hub.place")).select(F.col("node").alias("a"), F.col("hub.node").alias("b")))
        shared = shared.unionByName(crowd.where("n > 2").select("bucket", "node", "size", "place"))

    row_key = lambda i, key: F.xxhash64(i, F.col(i).isNull(), key)
    sets = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(sets, b.column(0), [np.unique(shingle_hashes(words_of(x)[0], shingle)).tobytes() for x in texts(b.column(1))])

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sketches, n = Sketches(b.column(2).to_pylist() + b.column(4).to_pylist()), np.arange(b.num_rows)
                differ = sketches.differ(n, n + b.num_rows)
                size = b.column(3).to_numpy().astype(np.int64) + b.column(5).to_numpy()
                yield batch(LINKS, b.column(0), b.column(1)).filter(pa.array(differ <= size * most + 1e-6))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                on.append(common >= similarity * (len(x) + len(y) - common))
            yield batch(LINKS, b.column(0), b.column(1)).filter(pa.array(on, pa.bool_()))

    light = lambda own, x, n: nodes.select(F.col("node").alias(own), F.col("sketch").alias(x), F.col("size").alias(n))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs that are similar: first by sketches, then on the sets of the texts that are left."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.join(light("a", "x", "n"), "a").join(light("b", "y", "m"), "b").select("a", "b", "x", "n", "y", "m")
        pairs = scratch.save(pairs.mapInArrow(maybe, "a long, b long"), f"maybe-{name}")
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        need = scratch.save(nodes.join(ends, "node").select("node", row_key("of.doc_id", "of.key").alias("row")), f"need-{name}")
        if need.count() <= MOST_BROADCAST:
            need = F.broadcast(need)
        # repeated rows are thinned by the join's own key, so texts move once
        own = source.select(row_key("doc_id", "key").alias("row"), "text").join(need, "row").groupBy("row", "node").agg(F.first("text").alias("text"))
        own = scratch.save_wide(own.select("node", "text").mapInArrow(sets_of, "node long, shingles binary"), f"sets-{name}", WIDE_ROWS)
        both = pairs.join(own.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        out = scratch.save_wide(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), f"links-{name}", WIDE_ROWS)
        for table in ("maybe", "need", "sets"):
            scratch.drop(f"{table}-{name}")
        del pairs, ends, need, own, both
        scratch.tidy()
        return out

    def open_buckets(edges: DataFrame, name: str) -> DataFrame:
        """Rows of the buckets that still have two components or more, with the component of each node."""
        known = components(edges, scratch)
        now = shared.join(known, "node", "left").select(*shared.columns, F.coalesce("root", "node").alias("label"))
        mixed = now.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("bucket")
        return scratch.save(now.join(mixed, "bucket", "left_semi").select(*now.columns), f"open-{name}")

    edges = verified(links(nodes.select("node", "fp"), scratch, probe).unionByName(stars), "first")
    for turn in range(TURNS):
        now = open_buckets(edges, f"turn{turn}")  # buckets that are closed stay so
        order = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(turn), "node"), "node")
        hubs = now.withColumn("k", F.row_number().over(order)).where(F.col("k") <= HUBS).select("bucket", F.struct("node", "size", "place", "label").alias("hub"))
        tried = now.join(hubs, "bucket").where("label != hub.label").where(near("size", "place", "hub.size", "hub.place"))
        edges = edges.unionByName(verified(tried.select(F.col("node").alias("a"), F.col("hub.node").alias("b")), f"turn{turn}"))
        shared = now.select("bucket", "node", "size", "place")
    left = _grouped(open_buckets(edges, "all"), similarity).join(nodes.select("node", "sketch"), "node")  # sketches move once
    left = left.select("group", "node", "size", "place", "label", "side", "guest", "sketch").repartition("group").sortWithinPartitions("group", "size", "node")
    edges = edges.unionByName(verified(left.mapInArrow(_all_pairs(similarity), "a long, b long"), "all"))
    root = components(edges, scratch)
    named = nodes.join(root.withColumnRenamed("node", "own"), nodes["node"] == F.col("own"), "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    named = scratch.save(named, "named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("node", "root", "component_id")
    return rows.join(named, "node").select("doc_id", "key", "root", "component_id")


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, with one row of each component of near duplicates: that of the least id.

    Of rows with that id one stays, with the least hash of its text.  A
    component of null ids alone keeps one row.  Texts without words, nulls among
    them, are one component; an empty table stays empty.
    """
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own_id = flat[f"c{names.index(id_col)}"].cast("long") if id_col in names else F.lit(None).cast("long")
    text = flat[f"c{names.index(text_col)}"].cast("string") if text_col in names else F.lit(None).cast("string")
    flat = flat.withColumn("own_id", own_id).withColumn("own_key", text_key(text))
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("x"))
    first = first.select(F.col("x.doc_id").alias("doc_id"), F.col("x.key").alias("key"))
    out = flat.join(first, flat["own_id"].eqNullSafe(first["doc_id"]) & (flat["own_key"] == first["key"]), "left_semi")
    order = Window.partitionBy("own_id", "own_key").orderBy(*[F.col(f"c{i}").cast("string") for i, n in enumerate(names) if n not in (id_col, text_col)] or [F.lit(1)])
    out = out.withColumn("place", F.row_number().over(order)).where("place = 1")
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
