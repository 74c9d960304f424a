"""Streams with state of one slot a key that ends: the latest frame, and a smoothed value.

Each key's timer stands a lifetime after its last event; when the watermark
passes it, the key says so once and its state goes, so what a stream keeps is
bounded by the keys of a lifetime.  State is restored from the query's
checkpoint, and rows that come after the watermark are dropped.  These need
Spark's RocksDB state store (``rocks``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as these operators need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _millis(t) -> int:
    return int(t.timestamp() * 1000)


class _Slot(StatefulProcessor):
    """One value a key, and one timer."""

    def __init__(self, state: T.StructType, lifetime_ms: int):
        self.schema, self.lifetime = state, lifetime_ms

    def init(self, handle) -> None:
        self.handle, self.slot = handle, handle.getValueState("slot", self.schema)

    def later(self, at: int) -> None:
        """The only timer: a lifetime after the last event."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at + self.lifetime)

    def close(self) -> None:
        pass


class Latest(_Slot):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.slot.get() if self.slot.exists() else None
        best, last = None, held[-1] if held else None
        for r in rows:
            at = (r["order"], _millis(r["time"]))
            if best is None or at > (best["order"], _millis(best["time"])):
                best = r
            last = at[1] if last is None else max(last, at[1])
        newer = best is not None and (held is None or (best["order"], _millis(best["time"])) > (held[0], held[1]))
        if newer:
            self.slot.update((best["order"], _millis(best["time"]), last))
        elif held:
            self.slot.update((held[0], held[1], last))
        self.later(last)
        if newer:
            yield Row(key=key[0], frame=best["frame"], expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.slot.clear()
        yield Row(key=key[0], frame=None, expired=True)


class Smoothed(_Slot):
    def __init__(self, state: T.StructType, lifetime_ms: int, smoothing: float):
        super().__init__(state, lifetime_ms)
        self.smoothing = smoothing

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ema, last = self.slot.get() if self.slot.exists() else (None, None)
        for r in sorted(rows, key=lambda r: (r["order"], r["value"])):
            ema = r["value"] if ema is None else self.smoothing * r["value"] + (1 - self.smoothing) * ema
            last = _millis(r["time"]) if last is None else max(last, _millis(r["time"]))
        self.slot.update((ema, last))
        self.later(last)
        yield Row(key=key[0], ema=ema, expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ema = self.slot.get()[0] if self.slot.exists() else None
        self.slot.clear()
        yield Row(key=key[0], ema=ema, expired=True)


def _keyed(stream: DataFrame, key: str, time: str, watermark: str, **columns) -> DataFrame:
    """(key, time, …) of rows that have a key, a time and all of the columns."""
    t = stream.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("time"), *[c.alias(n) for n, c in columns.items()])
    return t.dropna(subset=["key", "time", *[n for n in columns if n != "frame"]]).withWatermark("time", watermark)


def latest_stream(frames: DataFrame, key: str, order: str, time: str, lifetime_ms: int = 60_000, watermark: str = "10 seconds") -> DataFrame:
    """(key, frame, expired): after each micro-batch the newest frame of each key, if it is newer than what was there; older ones are dropped.

    ``frame`` is a struct of the other columns.  The slot itself has the order
    and times alone, never a frame.  When a key had no event for a lifetime it
    gives one row without a frame, and begins anew.  Ties of the order go to
    the later time.  Rows without key, order or time count nowhere.
    """
    others = [c for c in frames.columns if c not in (key, order, time)]
    t = _keyed(frames, key, time, watermark, order=F.col(order).cast("long"), frame=F.struct(F.col(order), F.col(time), *others))
    out = T.StructType([T.StructField("key", t.schema["key"].dataType), T.StructField("frame", t.schema["frame"].dataType), T.StructField("expired", T.BooleanType())])
    state = T.StructType([T.StructField(n, T.LongType()) for n in ("order", "time", "last")])
    return t.groupBy("key").transformWithState(Latest(state, lifetime_ms), out, "Update", "EventTime")


def smoothed_stream(timings: DataFrame, key: str, order: str, value: str, time: str, smoothing: float = 0.3, lifetime_ms: int = 3_600_000, watermark: str = "10 seconds") -> DataFrame:
    """(key, ema, expired) after each micro-batch: smoothing * new + (1 - smoothing) * old, in the order of a batch's rows.

    When a key had no event for a lifetime it gives its last value once more,
    as expired, and its average begins anew.  Rows without key, order, value or
    time count nowhere.
    """
    t = _keyed(timings, key, time, watermark, order=F.col(order).cast("long"), value=F.col(value).cast("double"))
    out = T.StructType([T.StructField("key", t.schema["key"].dataType), T.StructField("ema", T.DoubleType()), T.StructField("expired", T.BooleanType())])
    state = T.StructType([T.StructField("ema", T.DoubleType()), T.StructField("last", T.LongType())])
    return t.groupBy("key").transformWithState(Smoothed(state, lifetime_ms, smoothing), out, "Update", "EventTime")
