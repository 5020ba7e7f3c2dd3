"""Two-level labels, filled holes and box filters against flood filling and numpy, with blocks so small that components cross many of them."""

import itertools
import random

import numpy as np
import pytest

from arborix.operators import blocks, labels, voxels

DIMS = (13, 11, 7)


def _parts(places, offsets):
    """Sets of connected places."""
    left, out = set(places), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            p = todo.pop()
            part.add(p)
            for o in offsets:
                q = tuple(a + b for a, b in zip(p, o))
                if q in left:
                    left.discard(q)
                    todo.append(q)
        out.append(part)
    return out


def _images(spark, share):
    random.seed(11)
    everywhere = list(itertools.product(*map(range, DIMS)))
    images = {i: {p for p in everywhere if random.random() < share} for i in (1, 2)}
    return images, spark.createDataFrame([(i, *p) for i, ps in images.items() for p in ps], "image_id int, x int, y int, z int")


@pytest.mark.parametrize("sides", [(4, 3, 2), (64, 64, 32)])
@pytest.mark.parametrize("offsets", [voxels.OFFSETS26, voxels.OFFSETS6, voxels.OFFSETS4])
def test_labels(spark, sides, offsets):
    images, v = _images(spark, 0.1 if offsets == voxels.OFFSETS26 else 0.5)
    got = {(r.image_id, r.x, r.y, r.z): r.component for r in labels.label(v, DIMS, offsets, sides).collect()}
    at = lambda p: (p[0] * DIMS[1] + p[1]) * DIMS[2] + p[2]
    assert got == {(i, *p): min(map(at, part)) for i, ps in images.items() for part in _parts(ps, offsets) for p in part}


@pytest.mark.parametrize("sides", [(4, 3, 2), (64, 64, 32)])
@pytest.mark.parametrize("offsets", [voxels.OFFSETS6, voxels.OFFSETS4])
def test_holes(spark, sides, offsets):
    images, v = _images(spark, 0.6)
    got = {tuple(r) for r in labels.small_holes(v, DIMS, offsets, 9, sides).collect()}
    everywhere = set(itertools.product(*map(range, DIMS)))
    assert got == {(i, *p) for i, ps in images.items() for part in _parts(everywhere - ps, offsets) if len(part) < 9 for p in part}


def test_blocks_without_foreground_join_the_background(spark):
    v = spark.createDataFrame([("a", 0, 0, 0)], "image_id string, x int, y int, z int")
    assert labels.small_holes(v, (9, 9, 9), voxels.OFFSETS6, 729, (3, 3, 3)).count() == 728
    assert labels.small_holes(v, (9, 9, 9), voxels.OFFSETS6, 728, (3, 3, 3)).count() == 0
    assert labels.label(v.limit(0), (9, 9, 9), voxels.OFFSETS6, (3, 3, 3)).count() == 0


def test_box_filters(spark):
    images, v = _images(spark, 0.2)
    v = v.selectExpr("*", "x * 5 + y * 3 + z + 1 AS value")
    for sides in ((4, 5, 3), (64, 64, 32)):
        big = {tuple(r)[:4]: r.value for r in blocks.by_blocks(v, blocks.largest((5, 3, 7)), (2, 1, 3), DIMS, sides=sides).collect()}
        shut = {tuple(r)[:4] for r in blocks.by_blocks(v, blocks.largest((3, 3, 5), True), (2, 2, 4), DIMS, sides=sides).collect()}
        for i, ps in images.items():
            full = np.full(DIMS, -np.inf)
            for p in ps:
                full[p] = p[0] * 5 + p[1] * 3 + p[2] + 1
            view = lambda a, size, f, pad: f(np.lib.stride_tricks.sliding_window_view(np.pad(a, [(s // 2,) * 2 for s in size], constant_values=pad), size), axis=(3, 4, 5))
            want = view(full, (5, 3, 7), np.max, -np.inf)
            assert {k[1:]: n for k, n in big.items() if k[0] == i} == {tuple(map(int, p)): want[tuple(p)] for p in np.argwhere(want > -np.inf)}
            kept = view(view(full > 0, (3, 3, 5), np.max, False), (3, 3, 5), np.min, True)
            assert {k[1:] for k in shut if k[0] == i} == {tuple(map(int, p)) for p in np.argwhere(kept)}
