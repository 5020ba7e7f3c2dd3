"""Branches as one file each, written and read by tasks."""

import os

from pyspark.sql import functions as F

from arborix.sources import tables


def test_a_file_for_each_branch(spark, tmp_path):
    names = ["a b", "c=d/e%f", None]
    rows = [(s, c, b, pos, pos * 2, b, c) for s in names for c in (1, 2) for b in (1, 2, 4) for pos in range(b + 2)]
    p = spark.createDataFrame(rows, "sample_id string, component int, branch int, pos int, x int, y int, z int")
    b = p.groupBy("sample_id", "component", "branch").agg(F.count("*").cast("double").alias("length")).selectExpr("*", "1L AS u", "2L AS v", "1e0 AS diameter", "0e0 AS soam", "1e0 AS clr")
    path = f"{tmp_path}/out"
    for _ in range(2):  # the second run replaces the first
        tables.export_branches(p.sample(1.0) if _ else p.withColumn("component", F.col("component") + 5), b, path)
    found = {os.path.join(d, f) for d, _, fs in os.walk(f"{path}/points") for f in fs}
    assert len(found) == 18 and all(os.path.isfile(f) for f in found)
    text = open(f"{path}/points/sample_id=a b/Component2Branch1.txt").read()
    assert text == "0 1 2\n2 1 2\n4 1 2\n"
    got = tables.read_branch_points(spark, f"{path}/points").collect()
    # branch 4 comes after a gap
    assert sorted(map(tuple, got)) == sorted((s or "__HIVE_DEFAULT_PARTITION__", c, b, pos, float(x), float(y), float(z)) for s, c, b, pos, x, y, z in rows if b < 4)
    assert spark.read.option("header", True).csv(f"{path}/length").count() == 18
