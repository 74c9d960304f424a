"""Suppliers whose images the verification once took wrong, against the queries' SQL."""

import math

import duckdb
from pyspark.sql import functions as F

from tessera.functions import geometry as geo
from tessera.plans import queries as dq


def differences(spark, folder, name, keys):
    values = ", ".join(f"({k})" for k in keys)
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {values}) t(s_suppkey)) TO '{folder}/supplier.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT s_suppkey::BIGINT AS s_suppkey FROM '{folder}/supplier.parquet'")
    want = con.sql(dq.SQL[name]).fetchall()
    got = [tuple(r) for r in dq.QUERIES[name](spark, str(folder)).select("s_suppkey", "same", "angle").collect()]
    assert len(want) == len(keys)
    return sorted(set(got) ^ set(want))


def test_angles_of_slightly_perspective_homographies(spark, tmp_path):
    """The numbers of their homographies turn by a degree more or less than the images do."""
    assert differences(spark, tmp_path, "verify_blob_images", [251, 655, 1226, 5027, 3]) == []


def test_matches_that_agree_by_chance_on_a_folding_homography(spark, tmp_path):
    """Thirty matches of two other scenes agree there, on one whose horizon crosses the image."""
    assert differences(spark, tmp_path, "verify_corner_images", [2169, 1, 2, 3]) == []


def test_homographies_that_fold(spark):
    turned, mirrored = [0.0, -1, 127, 1, 0, 0, 0, 0, 1], [-1.0, 0, 127, 0, 1, 0, 0, 0, 1]
    crossing = [1.0, 0, 0, 0, 1, 0, -0.01, 0, 1]
    t = spark.createDataFrame([(k, h and [float(v) for v in h]) for k, h in enumerate([turned, [-v for v in turned], mirrored, crossing, None])], "k int, h array<double>")
    got = {r.k: (r.ok, None if r.turn is None else round(math.degrees(r.turn), 6)) for r in t.select("k", geo.unfolded(F.col("h"), 128, 128).alias("ok"), geo.turn(F.col("h"), (F.lit(3.0), F.lit(4.0))).alias("turn")).collect()}
    assert [got[k][0] for k in range(5)] == [True, True, False, False, None] and got[0][1] == got[1][1] == 90
