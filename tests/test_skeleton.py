"""Thinning, voxel graphs and spurs on small arrays."""

from pyspark.sql import functions as F

from arborix.operators import skeleton, voxels

DIMS = (24, 24, 6)


def frame(spark, shapes):
    rows = [(name, x, y, z, 1) for name, pts in shapes.items() for x, y, z in pts]
    return spark.createDataFrame(rows, "image_id string, x int, y int, z int, value int")


def components(df):
    return {r.image_id: r.n for r in voxels.label(df, DIMS).groupBy("image_id").agg(F.countDistinct("component").alias("n")).collect()}


def test_direction_of_one_voxel():
    # The place, in z, y, x order from 1, that each direction takes one neighbour to.
    want = [1, 23, 15, 5, 9, 25, 3, 19, 17, 21, 11, 7]
    got = []
    for d in skeleton.DIRECTIONS:
        p = (-1, -1, 0)
        for axis in d:
            p = skeleton._turn(p, axis)
        got.append((p[0] + 1) * 9 + (p[1] + 1) * 3 + p[2] + 1)
    assert got == want


# For each template, in order, foreground neighbours (a to z in z, y, x order) for which it must hold.
HOLDS = ["dp", "pv", "pqy", "dpv", "cdfpv", "adfpv", "dnpv", "fmpv", "adnpv", "clmpv", "qy", "oy", "wy", "uy"]


def test_templates(monkeypatch):
    """Each template by itself holds for its vector, and not where none or all neighbours are set; together they delete all of these."""
    import numpy as np

    places = skeleton.direction_places(0)
    bit = {n: 1 << voxels.BITS[(x, y, z)] for n, (z, y, x) in places.items()}
    codes = np.array([sum(bit[n] for n in names) for names in HOLDS] + [0, (1 << 26) - 1])
    assert skeleton.deletable(codes, 0).tolist() == [True] * 14 + [False, False]
    for k, t in enumerate(skeleton.TEMPLATES):
        monkeypatch.setattr(skeleton, "TEMPLATES", [t])
        hits = skeleton.deletable(codes, 0).tolist()
        assert hits[k] and hits[-2:] == [False, False]


def test_thinning_by_blocks_is_that_of_the_whole(spark):
    """Small blocks and one round at a time give what one large block gives."""
    import random

    random.seed(9)
    blob = {(x, y, z) for x in range(20) for y in range(20) for z in range(5) if random.random() < 0.8}
    v = frame(spark, {"blob": blob})
    import arborix.operators.skeleton as K

    some = {tuple(r) for r in K.thin(v).select(*"xyz").collect()}
    # far from the blob a line is settled at once, so its blocks do not run again
    line = {(200 + i, 50, 2) for i in range(30)}
    other = {tuple(r) for r in K.thin(frame(spark, {"blob": blob | line}), at_once=1, sides=(8, 8, 4)).select(*"xyz").collect()}
    assert line <= other
    other -= line
    assert some == other and len(some) < len(blob)


def test_thinning_keeps_objects(spark):
    square = {(x, y, 2) for x in range(4, 14) for y in range(4, 14)}
    hole = square - {(x, y, 2) for x in range(7, 11) for y in range(7, 11)}
    block = {(x, y, z) for x in range(3, 9) for y in range(3, 9) for z in range(1, 5)}
    disc = {(x, y, 3) for x in range(20) for y in range(20) if (x - 10) ** 2 + (y - 10) ** 2 <= 49}
    two = {(x, y, 2) for x in range(2, 8) for y in range(2, 8)} | {(x, y, 2) for x in range(12, 18) for y in range(12, 18)}
    v = frame(spark, {"square": square, "hole": hole, "block": block, "disc": disc, "two": two})
    before = components(v)
    thin = skeleton.thin(v)
    assert components(thin) == before == {"square": 1, "hole": 1, "block": 1, "disc": 1, "two": 2}
    n = {r.image_id: r["count"] for r in thin.groupBy("image_id").count().collect()}
    assert n["block"] < 30 and n["hole"] < len(hole) / 2


def test_branches_of_a_cross(spark):
    cross = {(i, 5, 2) for i in range(11)} | {(5, i, 2) for i in range(11)}
    line = {(i, 20, 2) for i in range(5)}
    ring = {(x, y, 1) for x in range(12, 20) for y in range(2, 10)} - {(x, y, 1) for x in range(13, 19) for y in range(3, 9)}
    v = frame(spark, {"cross": cross, "line": line, "ring": ring})
    got = {}
    for r in skeleton.branches(v, DIMS).collect():
        got.setdefault(r.image_id, []).append((r.n_edges, round(r.length, 6)))
    assert got["line"] == [(4, 4.0)] and "ring" not in got
    assert len(got["cross"]) >= 4 and sum(n for n, _ in got["cross"]) >= 20


def test_spurs(spark):
    line = {(i, 10, 2) for i in range(22)}
    spur = {(11, 10 + k, 2) for k in range(1, 4)}
    v = frame(spark, {"a": line | spur})
    left = {(r.x, r.y) for r in skeleton.prune_spurs(v, DIMS, 5).collect()}
    assert components(skeleton.prune_spurs(v, DIMS, 5)) == {"a": 1}
    assert (11, 13) not in left and {(0, 10), (21, 10)} <= left
