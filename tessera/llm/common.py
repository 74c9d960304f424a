"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by exact name, as new=old; other columns, whatever their names, can't interfere.

    An old name that the table lacks gives a column of nulls.
    """
    names = df.columns
    flat = df.toDF(*[f"_{i}" for i in range(len(names))])
    return flat.select(*[(flat[f"_{names.index(old)}"] if old in names else F.lit(None)).alias(new) for new, old in columns.items()])


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of any table of documents."""
    return pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out


def text_key(text: Column) -> Column:
    """64 bits that tell the texts of rows with one id apart; null and empty differ."""
    return F.xxhash64(text, text.isNull())


@lru_cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix=f"tessera-{application}-")


@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside read wide rows few at a time, and give Python workers at most so many at once."""
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.parquet.columnarReaderBatchSize": max(16, rows)}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, str(min(int(before[k]), v) if int(before[k]) > 0 else v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Bytes of wide rows that a writer holds, about.
WIDE = {"parquet.block.size": str(8 << 20), "parquet.enable.dictionary": "false"}


class Scratch:
    """Tables in the folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local session without that setting, as in tests, gets a temporary
    folder; on a cluster, executors could not see it, so the setting has to be
    there.  Tables that a result still reads must outlive the call, so they stay until
    ``drop`` or ``clear``, or until the cluster's shared folder is emptied.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            base = _own_folder(spark.sparkContext.applicationId)
        self.spark, self.path = spark, f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex[:12]}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Writes a table and reads it again: later stages restart from it, not from its lineage."""
        df.write.options(**options).mode("overwrite").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def bucketed(self, df: DataFrame, name: str, key: str, rows: int = 4) -> DataFrame:
        """A table stored in buckets by ``key``, as many as there are shuffle partitions: joins on it move only the other side.

        Its rows are wide, so few are with a worker at once.  The catalog keeps no entry.
        """
        spark, table = self.spark, f"tessera_{uuid.uuid4().hex[:16]}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        with few_rows(spark, rows):
            df.write.format("parquet").bucketBy(buckets, key).options(path=self.at(name), compression="uncompressed", **WIDE).saveAsTable(table)
        out = spark.table(table)
        spark.sql(f"DROP TABLE {table}")  # of an outside path: the entry goes, the files stay
        return out

    def save_wide(self, df: DataFrame, name: str, rows: int = 4, **options) -> DataFrame:
        """save of a table that is made from wide rows."""
        with few_rows(self.spark, rows):
            return self.save(df, name, **WIDE | options)

    def tidy(self) -> None:
        """Shuffle files go when the driver collects what stood for their jobs; this has it do so now."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.at(name) if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)
