from types import SimpleNamespace

import pytest

from tessera.llm.common import Scratch, few_rows


def session(master, folder):
    return SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        Scratch(session("spark://host:7077", None), "x")
    assert Scratch(session("spark://host:7077", "hdfs://shared/"), "x").path.startswith("hdfs://shared/tessera/x-")
    assert Scratch(session("local[2]", None), "x").path.startswith("file://")


def test_bucketed_tables_leave_no_entry(spark):
    scratch, before = Scratch(spark, "test"), spark.catalog.listTables()
    t = scratch.bucketed(spark.range(100).selectExpr("id", "id % 7 AS k"), "b", "k")
    assert spark.catalog.listTables() == before and t.count() == 100
    other, setting = spark.range(7).withColumnRenamed("id", "k"), "spark.sql.autoBroadcastJoinThreshold"
    threshold = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        joined = t.join(other, "k")
        assert joined.count() == 100 and joined._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    finally:
        spark.conf.set(setting, threshold)


def test_settings_come_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), few_rows(spark, 3):
        assert spark.conf.get(name) == "3"
        1 / 0  # noqa: B018
    assert spark.conf.get(name) == before
