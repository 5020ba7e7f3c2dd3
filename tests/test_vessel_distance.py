"""The shaped distance map in one run over blocks is that of the steps by themselves."""

import random

import pytest
from pyspark.sql import functions as F

from arborix.operators import reslice, stats, voxels

DIMS = (30, 26, 9)


def by_steps(v, depth):
    clean = voxels.median_filter(v.withColumn("value", F.lit(1)), DIMS)
    d = voxels.plane_distance(clean, DIMS).select(*voxels.KEYS, F.coalesce("dist", F.lit(0.0)).alias("value"))
    smooth = voxels.gaussian_smooth(d, DIMS, 1.0, three_d=False)
    if depth:
        deep = smooth
        for axis, s in enumerate(depth):
            deep = voxels.convolve(deep, DIMS, axis, voxels.gaussian_weights(s))
        smooth = smooth.unionByName(deep).groupBy(*voxels.KEYS).agg(F.sum("value").alias("value"))
    most = voxels.maximum_filter(smooth, DIMS, (11, 11, 1)).withColumnRenamed("value", "most")
    return smooth.join(most, voxels.KEYS).where("most > 0").select(*voxels.KEYS, stats.skeleton_strength(F.col("value"), F.col("most"), 2.0).alias("value"))


@pytest.mark.parametrize("depth", [None, (0.8, 0.8, 2.0)])
def test_vessel_distance_by_blocks(spark, depth):
    rng = random.Random(5)
    seeds = [(rng.randrange(30), rng.randrange(26), rng.randrange(9)) for _ in range(9)]
    rows = [("a", x, y, z) for x in range(30) for y in range(26) for z in range(9) if any(abs(x - a) <= 3 and abs(y - b) <= 2 and z == c for a, b, c in seeds)]
    rows += [("full", x, y, 4) for x in range(30) for y in range(26)]  # a plane without background
    v = spark.createDataFrame(rows, "image_id string, x int, y int, z int")
    want = {tuple(r)[:4]: r.value for r in by_steps(v, depth).collect()}
    assert len(want) > 500
    for sides in ((64, 64, 32), (7, 26, 4)):
        found = reslice.vessel_distance(v, DIMS, depth=depth, sides=sides)
        got = {tuple(r)[:4]: r.value for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
