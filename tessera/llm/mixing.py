"""Mixing sources to target token counts, by entropy balancing; DataFrame operations only.

Each source has a target.  Document rates w minimise the relative entropy to
one copy each, sum w ln w - w, under sum w * tokens = target for each source
and w <= cap.  The convex dual has one multiplier a source, and its solution
tilts rates exponentially: w = min(cap, exp(lambda * tokens / mean tokens)).
Newton's method finds the multipliers of all sources at once, each step one
aggregation over a table of (source, tokens, documents), inside brackets so
that no step can diverge.  Rates are then rounded to whole copies, carrying
each rounding error on to the next document of a bounded block, long documents
first, so a block's total is off by about half its shortest document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, text_key

SPACE = r"\x20\x09-\x0D"
#: Documents that share a rounding error; a source has as many blocks as it needs.
BLOCK_DOCS = 256
#: Steps after which the dual is given up as an error; halving a bracket takes fewer.
MOST_STEPS = 200
TOLERANCE = 1e-7
#: Repeated rows that are told apart in one array.
WIDE = 10_000


def n_words(text: Column) -> Column:
    """Words between white space; null has none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SPACE}]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\f\r", "")).cast("long")


def running(rows: DataFrame, order: Sequence[Column], scratch: Scratch, name: str, **sums: Column) -> DataFrame:
    """rows with ``number``, their place in the order from 1 on, and running sums of what comes before each.

    Rows are sorted by ranges, summed up in each, and each range adds what the
    ranges before it hold; one short row for each range goes through one task.
    """
    totals = {f"{name}_{k}": v.cast("double") for k, v in sums.items()} | {f"{name}_n": F.lit(1.0)}
    # place: where the row stands, in the upper bits its range
    own = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(f"{name}_place", F.monotonically_increasing_id()), name)
    own = own.withColumn(f"{name}_range", F.shiftright(f"{name}_place", 33))
    ranges = own.groupBy(f"{name}_range").agg(*[F.sum(v).alias(k) for k, v in totals.items()])
    before = Window.orderBy(f"{name}_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(f"{name}_range", *[F.coalesce(F.sum(k).over(before), F.lit(0.0)).alias(f"{k}_0") for k in totals])
    inside = Window.partitionBy(f"{name}_range").orderBy(f"{name}_place").rowsBetween(Window.unboundedPreceding, -1)
    out = own.join(ranges, f"{name}_range").select(*rows.columns, *[(F.col(f"{k}_0") + F.coalesce(F.sum(v).over(inside), F.lit(0.0))).alias(k) for k, v in totals.items()])
    return out.select(*rows.columns, (F.col(f"{name}_n") + 1).cast("long").alias("number"), *[F.col(f"{name}_{k}").alias(k) for k in sums])


def targets(sources: DataFrame, scratch: Scratch, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, ...) with ``sid`` long and ``target`` double.

    Sources in code-point order, null last, have the weights in turn and share
    ``share`` of all sizes; no target is above ``cap`` times its source, and
    the excess goes to the others by weight.  With the sources in the order in
    which they reach their caps, those that do are a prefix, so running sums
    find them.
    """
    t = running(sources, [F.asc_nulls_last("source")], scratch, "by_source").withColumnRenamed("number", "sid")
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("most", cap * F.col("source_size"))
    t = running(t, [F.col("most") / F.col("weight"), F.col("sid")], scratch, "by_cap", before=F.col("most"), weight_before=F.col("weight")).drop("number")
    one = t.agg(F.sum("weight"), F.sum("source_size")).first()
    weight, total = float(one[0] or 0.0), share * float(one[1] or 0)
    t = t.withColumn("full", (total - F.col("before")) * F.col("weight") > F.col("most") * (weight - F.col("weight_before")))
    one = t.agg(F.sum(F.when(F.col("full"), F.col("most"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    level = (total - float(one[0] or 0.0)) / float(one[1] or 1.0)
    t = t.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.least("most", F.col("weight") * level)))
    return t.drop("most", "before", "weight_before", "weight").withColumn("full", F.col("target") >= cap * F.col("source_size"))


def tilt(histogram: DataFrame, goals: DataFrame, scratch: Scratch, cap: float = 2.0) -> DataFrame:
    """(sid, mean, lam) from (sid, size, n) and (sid, source_size, docs, target, full): the dual's solution.

    A step is Newton's where it stays inside the bracket, else the bracket's
    middle; at its ends, even a document of one word has rate 0 or ``cap``.
    The multipliers stay in a table, rewritten at each step; only the largest
    relative error comes to the driver.  Not to converge is an error.
    """
    mean = F.col("source_size") / F.col("docs")
    start = goals.where(~F.col("full") & (F.col("target") > 0)).select("sid", "target", mean.alias("mean"), F.lit(0.0).alias("lam"), (-745.0 * F.greatest(mean, F.lit(1.0))).alias("lo"), (F.log(F.lit(cap)) * F.greatest(mean, F.lit(1.0)) + 1).alias("hi"))
    state = scratch.save(start, "lam0")
    for step in range(1, MOST_STEPS + 1):
        c = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * c, F.log(F.lit(cap))))
        tokens = F.col("n") * F.col("size")
        free = F.col("lam") * c < F.log(F.lit(cap))
        seen = histogram.join(state, "sid").groupBy("sid").agg(*[F.first(x).alias(x) for x in ("target", "mean", "lam", "lo", "hi")], F.sum(tokens * rate).alias("got"), F.sum(F.when(free, tokens * rate * c)).alias("slope"))
        over = F.col("got") > F.col("target")
        seen = seen.withColumn("lo", F.when(over, F.col("lo")).otherwise(F.col("lam"))).withColumn("hi", F.when(over, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.col("slope")
        inside = (F.coalesce("slope", F.lit(0.0)) > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        seen = seen.withColumn("error", F.abs(F.col("got") / F.col("target") - 1))
        done = F.col("error") <= TOLERANCE
        seen = seen.withColumn("lam", F.when(done, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2))
        state = scratch.save(seen.select("sid", "target", "mean", "lam", "lo", "hi", "error"), f"lam{step}")
        scratch.drop(f"lam{step - 1}")
        if (state.agg(F.max("error")).first()[0] or 0.0) <= TOLERANCE:
            return state.select("sid", "mean", "lam")
    raise ArithmeticError(f"the dual did not converge in {MOST_STEPS} steps")


def _rounded(items: Column, cap: float) -> Column:
    """Copies of each item of an array of (size, n, rate, ...), long documents first, errors carried on."""

    def step(acc: Column, x: Column) -> Column:
        want = acc["error"] + x["n"] * x["size"] * x["rate"]
        copies = F.when(x["size"] > 0, F.round(want / x["size"])).otherwise(F.round(x["n"] * x["rate"]))
        copies = F.greatest(F.lit(0.0), F.least(copies, F.floor(x["n"] * cap).cast("double")))
        return F.struct((want - copies * x["size"]).alias("error"), F.concat(acc["copies"], F.array(copies.cast("long"))).alias("copies"))

    return F.aggregate(items, F.struct(F.lit(0.0).alias("error"), F.array().cast("array<long>").alias("copies")), step, lambda acc: acc["copies"])


def copies(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each distinct (doc_id, text, source): (doc_id, key, sid, source, size, n, source_size, target, copies).

    ``n`` is how often the row is there, ``copies`` how many of it the mix
    takes in all, at most cap * n.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    rows = rows.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text").cast("string")).alias("size"), text_key(F.col("text").cast("string")).alias("key"))
    rows = scratch.save(rows.groupBy("doc_id", "key", "source", "size").agg(F.count("*").alias("n")), "sizes")
    histogram = rows.groupBy("source", "size").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"), F.sum("rows").alias("rows"))
    goals = scratch.save(targets(sources, scratch, weights, share, cap), "goals")
    by_sid = histogram.join(goals.select("source", "sid"), histogram["source"].eqNullSafe(goals["source"])).select("sid", "size", "n")
    lam = tilt(scratch.save(by_sid, "histogram"), goals, scratch, cap)
    lam = goals.withColumnRenamed("source", "name").join(lam, "sid", "left")
    rows = rows.join(lam, rows["source"].eqNullSafe(lam["name"])).drop("name")
    tilted = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.log(F.lit(cap))))
    rows = rows.withColumn("rate", F.when(F.col("full"), F.lit(cap)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(tilted))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "key"), F.ceil(F.col("rows") / BLOCK_DOCS)))
    item = F.struct(F.col("size"), F.col("doc_id"), F.col("key"), F.col("n"), F.col("rate"))
    blocks = rows.groupBy("sid", "block").agg(F.sort_array(F.collect_list(item), False).alias("items"))
    blocks = blocks.withColumn("copies", _rounded(F.col("items"), cap)).select("sid", F.explode(F.arrays_zip("items", "copies")).alias("x"))
    out = blocks.select("sid", F.col("x.items.doc_id").alias("doc_id"), F.col("x.items.key").alias("key"), F.col("x.items.size").alias("size"), F.col("x.items.n").alias("n"), F.col("x.copies").alias("copies"))
    return out.join(goals.select("sid", "source", "source_size", "target"), "sid")


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs: the words that the mix takes of it, repeats counted.

    Null texts and texts of white space have size 0 and nothing is taken; null
    sources are one source, the last.  Repeated rows share what is taken of
    them as evenly as whole copies allow.  An empty table, or one without
    words, gives targets of 0.  Each run gives the same result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.save(copies(docs, scratch, **options), "copies")
    few = rows.where(F.col("n") <= WIDE).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    # a row that is there very often is dealt out first
    many = rows.where(F.col("n") > WIDE).withColumn("first", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(WIDE))))
    many = many.repartition("doc_id", "key", "sid", "first").withColumn("i", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + (WIDE - 1), F.col("n"))))).drop("first")
    each = few.unionByName(many)
    own = F.floor(F.col("copies") / F.col("n")) + (F.col("i") <= F.col("copies") % F.col("n")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (own * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all columns of docs.

    Of rows that agree in id, text and source, those come first whose other
    columns have the least hashes.  Null ids, texts and sources are values like
    others; texts without words are not taken.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    of = {n: flat[f"c{names.index(n)}"] if n in names else F.lit(None) for n in (id_col, text_col, source_col)}
    every = [f"c{i}" for i in range(len(names))]
    flat = flat.withColumn("id", of[id_col].cast("long")).withColumn("key", text_key(of[text_col].cast("string"))).withColumn("name", of[source_col].cast("string"))
    plan = scratch.save(copies(docs, scratch, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("copies > 0").select("doc_id", F.col("key").alias("key2"), "source", "n", "copies"), "plan")
    mine = flat["id"].eqNullSafe(plan["doc_id"]) & (flat["key"] == plan["key2"]) & flat["name"].eqNullSafe(plan["source"])
    single = flat.join(plan.where("n = 1"), mine).withColumn("own", F.col("copies"))
    out = single.select(*every, "own")
    if not plan.where("n > 1").isEmpty():
        # repeated rows are numbered in one order of all of them, so no row's repeats meet in one task
        order = [F.col(c) for c in ("doc_id", "key2", "source")]
        starts = running(plan.where("n > 1"), order, scratch, "starts", start=F.col("n"))
        groups = starts.drop("number")
        mine = flat["id"].eqNullSafe(groups["doc_id"]) & (flat["key"] == groups["key2"]) & flat["name"].eqNullSafe(groups["source"])
        again = flat.join(groups, mine).withColumn("hash", F.xxhash64(F.to_json(F.struct(*every)))).withColumn("row", F.monotonically_increasing_id())
        again = running(again, [*order, F.col("hash"), F.col("row")], scratch, "repeats")
        own = F.floor(F.col("copies") / F.col("n")) + (F.col("number") - F.col("start") <= F.col("copies") % F.col("n")).cast("long")
        out = out.unionByName(again.withColumn("own", own).where(F.col("own") > 0).select(*every, "own"))
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("own"))))
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
