"""Small tables with all that may go wrong."""

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key long, `Batch` string, shard string, slot int, score double, words string, `DOC_ID_2` long"


def table(spark: SparkSession, rows) -> DataFrame:
    """Rows of (doc_id, text[, source]) with further columns, whose names clash with those that operators use inside."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1]), 7, "x", "y", 1, 0.5, None, r[0]) for r in rows]
    return spark.createDataFrame(full, COLUMNS)


LONG = " ".join(f"w{i % 977}" for i in range(30_000))
MESSY = [
    (1, "the cat sat on the mat and then the cat sat on the mat again today", "a"),
    (2, "the cat sat on the mat and then the cat sat on the mat again today", "b"),
    (3, None, "a"),
    (4, "", None),
    (5, " \t\n ", None),
    (6, "one", "b"),
    (7, "Ünïcödé wörds — 中文 text\nwith lines\n\nwith lines\n", "c"),
    (8, LONG, "a"),
    (9, LONG + " end", "c"),
    (None, "no id here but words all the same", "a"),
    (None, None, None),
    (10, "repeated row", "b"),
    (10, "repeated row", "b"),
    (10, "same id, other text", "b"),
]


def messy(spark: SparkSession) -> DataFrame:
    return table(spark, MESSY)


def empty(spark: SparkSession) -> DataFrame:
    return table(spark, [])


def rows_of(df: DataFrame, *names: str) -> list[tuple]:
    """Rows in an order that nulls and ties don't disturb."""
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
