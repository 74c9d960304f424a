"""The driver's queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fim, line_rules, mixing, pitman_yor, quality, secrets, shards, simhash, sql, substrings, token_files, warc, yinyang
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op1").path
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.digest(spark, path)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents")).drop("key")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).drop("spans")


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents")).drop("clean_text", "lost")


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(shards.digest(table(spark, sf_dir, "documents")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.digest(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op12")
    warc.write(table(spark, sf_dir, "pages"), scratch.at("archives"))
    records = scratch.save(warc.sound(warc.read(spark, scratch.at("archives"), payload=False)).drop("fields", "payload"), "records")
    return warc.resolved(records)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, text = fim.transform(table(spark, sf_dir, "documents")), fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_files, op2_decontamination, op3_secrets, op4_simhash, op5_mixing, op6_quality, op7_substrings, op8_line_rules, op9_pitman_yor, op10_shards, op11_yinyang, op12_warc, op13_fill_in_middle)}
SQL: dict[str, str] = {"op2_decontamination": sql.OP2, "op7_substrings": sql.OP7, "op8_line_rules": sql.OP8, "op11_yinyang": sql.op11(), "op12_warc": sql.OP12, "op13_fill_in_middle": sql.OP13}
