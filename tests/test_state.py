"""Streams with state: newest frames, averages, expiry, late rows, restarts."""

import datetime as dt

import pytest

from tessera.streaming import frames, state

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "k string, n long, ts timestamp, value double"


def at(s):
    return DAY + dt.timedelta(seconds=s)


class Run:
    """Micro-batches of a folder, each by a query of its own that starts from the checkpoint."""

    def __init__(self, spark, folder, make):
        self.spark, self.folder, self.make, self.n = spark, folder, make, 0
        (folder / "in").mkdir()

    def step(self, *rows):
        self.n += 1
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{self.folder}/in")
        t = self.make(self.spark.readStream.schema(SCHEMA).parquet(f"file://{self.folder}/in"))
        got = []
        with state.rocks(self.spark):
            q = t.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).outputMode("update").option("checkpointLocation", f"file://{self.folder}/mark").trigger(availableNow=True).start()
            q.awaitTermination(200)
        assert q.exception() is None
        return got


def test_the_latest_frame(spark, tmp_path):
    run = Run(spark, tmp_path, lambda t: state.latest_stream(t, "k", "n", "ts", 60_000, "10 seconds"))
    got = run.step(("a", 1, at(0), 0.1), ("a", 3, at(2), 0.3), ("a", 2, at(1), 0.2), ("b", 7, at(0), 0.7), (None, 1, at(0), 0.0), ("a", None, at(0), 0.0))
    assert sorted((r.key, r.frame.n, r.frame.value, r.expired) for r in got) == [("a", 3, 0.3, False), ("b", 7, 0.7, False)]
    assert run.step(("a", 2, at(3), 0.9)) == []  # older than what is there: dropped
    got = run.step(("a", 4, at(100), 0.4))  # the watermark passes the end of b
    assert {(r.key, r.expired, r.frame.n if r.frame else None) for r in got} == {("a", False, 4), ("b", True, None)}
    got = run.step(("b", 1, at(20), 0.5), ("b", 2, at(101), 0.6))  # the first is too late, the second begins anew
    assert [(r.key, r.frame.n, r.expired) for r in got] == [("b", 2, False)]


def test_an_average_that_ends(spark, tmp_path):
    run = Run(spark, tmp_path, lambda t: state.smoothed_stream(t, "k", "n", "value", "ts", 0.3, 60_000, "10 seconds"))
    values = lambda got: {(r.key, round(r.ema, 6), r.expired) for r in got}
    assert values(run.step(("a", 2, at(1), 20.0), ("a", 1, at(0), 10.0), ("b", 1, at(0), 5.0), ("b", 2, at(0), None))) == {("a", 13.0, False), ("b", 5.0, False)}
    assert values(run.step(("a", 3, at(50), 30.0))) == {("a", 18.1, False)}  # from the checkpoint of the first query
    got = values(run.step(("c", 1, at(90), 1.0)))
    assert got == {("c", 1.0, False), ("b", 5.0, True)}
    assert values(run.step(("b", 9, at(95), 8.0))) == {("b", 8.0, False)}


def test_average_of_long_histories(spark):
    t = spark.range(5000).selectExpr("id % 2 AS k", "id AS n", "CAST((id * 7919) % 101 AS double) AS v")
    got = {r.k: r.ema for r in frames.smoothed(t, "k", "n", "v").collect()}
    for k in (0, 1):
        ema = None
        for i in range(k, 5000, 2):
            v = float(i * 7919 % 101)
            ema = v if ema is None else 0.3 * v + 0.7 * ema
        assert got[k] == pytest.approx(ema, rel=1e-12)
    assert "WindowGroupLimit" in frames.smoothed(t, "k", "n", "v")._jdf.queryExecution().executedPlan().toString()
    assert {r.ema for r in frames.smoothed(t, "k", "n", "v", 1.0).collect()} == {float(4998 * 7919 % 101), float(4999 * 7919 % 101)}
    with pytest.raises(ValueError):
        frames.smoothed(t, "k", "n", "v", 0.0)
