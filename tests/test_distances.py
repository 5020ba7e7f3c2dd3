"""Distance maps against all pairs of voxels, the distance of vessels against numpy, and long chains between matched nodes."""

import itertools
import math
import random

import numpy as np
import pytest

from arborix.operators import compare, distances, reslice

VOX = "image_id int, x int, y int, z int"


def test_envelope_is_the_least_of_all_parabolas():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 400, (40, 25)).astype(float)
    f[rng.random(f.shape) < 0.4] = np.inf
    f[:, 0] = np.inf
    f[:, 1] = 0
    i = np.arange(40)
    want = (f[None] + ((i[:, None] - i[None]) * 1.5)[..., None] ** 2).min(axis=1)
    assert np.allclose(distances.envelope(f, 1.5), want)


@pytest.mark.parametrize("pix", [(1.0, 1.0), (2.0, 3.0), (1.0, 2.0, 5.0)])
def test_distances(spark, pix):
    random.seed(2)
    dims = (70, 9, 4)
    every = list(itertools.product(*map(range, dims)))
    images = {1: {p for p in every if random.random() < 0.97}, 2: set(every), 3: {(0, 0, 0)}}
    images[1] |= {p for p in every if p[2] == 1}  # a plane without background
    got = {tuple(r)[:4]: r.dist for r in distances.distance(spark.createDataFrame([(i, *p) for i, ps in images.items() for p in ps], VOX), dims, pix).collect()}
    assert len(got) == sum(map(len, images.values()))
    for i, ps in images.items():
        back = np.array([p for p in every if p not in ps]).reshape(-1, 3)
        for p in ps:
            near = back if len(pix) == 3 else back[back[:, 2] == p[2]]
            want = None if not len(near) else math.sqrt((((near - p)[:, : len(pix)] * pix) ** 2).sum(axis=1).min())
            assert got[i, *p] == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("depth", [None, (0.8, 0.8, 5.0)])
def test_vessel_distance_by_numpy(spark, depth):
    """The whole map, with and without its term in space: planar median, distances by all pairs, Gaussian weights, share of the local maximum, strength."""
    random.seed(3)
    dims = (20, 18, 2)
    full = {p for p in itertools.product(*map(range, dims)) if (p[0] - 9) ** 2 + (p[1] - 8) ** 2 < 30 + 20 * p[2] or random.random() < 0.1}
    got = {(r.x, r.y, r.z): r.value for r in reslice.vessel_distance(spark.createDataFrame([(1, *p) for p in full], VOX), dims, depth=depth).collect()}
    mask = np.zeros(dims)
    mask[tuple(np.array(sorted(full)).T)] = 1
    wide = np.pad(mask, [(1, 1), (1, 1), (0, 0)], mode="symmetric")
    clean = np.median(np.lib.stride_tricks.sliding_window_view(wide, (3, 3), axis=(0, 1)), axis=(3, 4)) > 0
    dist = np.zeros(dims)
    for x, y, z in np.argwhere(clean):
        back = np.argwhere(~clean[:, :, z])
        dist[x, y, z] = np.sqrt(((back - (x, y)) ** 2).sum(axis=1).min())

    def smooth(values, axis, sigma):
        n = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
        return np.apply_along_axis(lambda line: np.convolve(np.pad(line, n, mode="edge"), w / w.sum(), "valid"), axis, values)

    for axis in (0, 1):
        dist = smooth(dist, axis, 1.0)
    if depth:
        deep = dist
        for axis, sigma in enumerate(depth):
            deep = smooth(deep, axis, sigma)
        dist = dist + deep
    wide = np.pad(dist, [(5, 5), (5, 5), (0, 0)])
    most = np.lib.stride_tricks.sliding_window_view(wide, (11, 11), axis=(0, 1)).max(axis=(3, 4))
    share = np.divide(dist, most, out=np.zeros(dims), where=most > 0)
    from pyspark.sql import functions as F

    from arborix.operators.stats import skeleton_strength

    rows = spark.createDataFrame([(*map(int, p), float(dist[tuple(p)]), float(most[tuple(p)])) for p in np.argwhere((most > 0) & (share > 0))], "x int, y int, z int, d double, m double")
    want = {(r.x, r.y, r.z): r.s for r in rows.select(*"xyz", skeleton_strength(F.col("d"), F.col("m"), 2.0).alias("s")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_long_chains_between_matched_nodes(spark):
    """A chain of 1,000 inner nodes, a detour that is longer, a cycle without any matched node, and a bound that is too low."""
    chain = [("s", i, i + 1, 1.0) for i in range(1001)]
    detour = [("s", 0, 5000, 600.0), ("s", 5000, 1001, 600.0), ("s", 5000, 5001, 1.0)]
    cycle = [("s", 9000 + i, 9000 + (i + 1) % 7, 1.0) for i in range(7)]
    edges = spark.createDataFrame(chain + detour + cycle, "sample_id string, u long, v long, length double")
    matched = spark.createDataFrame([("s", 0), ("s", 1001)], "sample_id string, node long")
    assert [tuple(r) for r in compare.matched_paths(edges, matched).collect()] == [("s", 0, 1001, 1001.0)]
    branched = spark.createDataFrame([e for i in range(6) for e in (("s", i, i + 1, 1.0), ("s", i, 100 + i, 1.0))], "sample_id string, u long, v long, length double")
    ends = spark.createDataFrame([("s", 0), ("s", 6)], "sample_id string, node long")
    assert [tuple(r) for r in compare.matched_paths(branched, ends).collect()] == [("s", 0, 6, 6.0)]
    with pytest.raises(RuntimeError):
        compare.matched_paths(branched, ends, max_rounds=2)
