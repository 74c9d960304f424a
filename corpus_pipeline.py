"""A corpus from raw documents to token files; each stage works on all that the one before kept.

Needs the subpackage tessera.llm, of which it counts as a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, mixing, quality, simhash, token_files
from tessera.llm.common import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Rows are judged alone, by their text, null counting as empty; repeated rows
    and ties play no part, and other columns stay as they are.  Without labels
    nothing is rejected; an empty table stays empty.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id.

    Of rows with that id the one with the least hash of its text stays, and of
    repeated rows one.  Null and empty texts are one group; a null id counts
    last.  An empty table stays empty.
    """
    return simhash.distinct(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that benchmark windows cover; those left without words go.

    Null and empty texts stay as they are, and so do all without a window.
    Repeated rows are each cleaned alike; n_chars follows the text.  Without
    benchmark items, or documents, nothing changes.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to twice.

    Null sources are one source, the last; texts without words, nulls among
    them, aren't taken.  Of repeated rows as many stay as copies are taken in
    all, in an order of their other columns' hashes.  An empty table stays
    empty.
    """
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' own account of each document; the files stay in the shared folder.

    A null or empty text is its end id; each row, repeated ones too, has its
    place, null ids first, ties by the hashes of their texts.  An empty table
    gives empty files.
    """
    path = Scratch(spark, "tokens").path
    token_files.write(docs, path)
    return token_files.digest(spark, path)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("token_files", token_stage)]
#: The classifier and the rounding of copies have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each one's result is a table in the shared folder."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
