"""Reslicing, subsets and connectivity scores against plain brute force."""

import heapq
import itertools
import math
import random

import numpy as np
import pytest

from arborix.operators import compare, graph, reslice, stats

EDGE = "sample_id string, mask_id string, edge_id long, u long, v long, length double"


def resliced(array, matrix, out_dims, method, fill):
    """{target: value} of the rows that are due: met voxels inside, fill outside."""
    m, out = np.array(matrix), {}
    inverse = np.linalg.inv(m[:, :3])
    for t in itertools.product(*map(range, out_dims)):
        s = inverse @ (np.array(t) - m[:, 3])
        if any(v < -0.05 or v > n - 1 + 0.05 for v, n in zip(s, array.shape)):
            if fill:
                out[t] = fill
            continue
        s = np.clip(s, 0, np.array(array.shape) - 1)
        for axis in {"linear": (), "nearest": (0, 1, 2), "line": (1, 2)}[method]:
            s[axis] = math.floor(s[axis] + 0.5)
        total, met = 0.0, False
        for corner in itertools.product((0, 1), repeat=3):
            at = np.floor(s).astype(int) + corner
            w = np.prod([c * f + (1 - c) * (1 - f) for c, f in zip(corner, s - np.floor(s))])
            if w > 0 and array[tuple(at)]:
                total, met = total + w * array[tuple(at)], True
        if met:
            out[t] = total
    return out


TURN = [[0.83, -0.31, 0.07, 1.13], [0.29, 0.79, -0.11, -0.57], [0.05, 0.13, 1.21, 0.37]]
WIDE = [[2.3, 0.0, 0.0, 0.02], [0.0, -1.0, 0.0, 5.03], [0.0, 0.0, 0.45, 0.0]]


@pytest.mark.parametrize("method, matrix, fill", [("linear", TURN, 0.0), ("linear", WIDE, 7.0), ("nearest", TURN, 0.0), ("line", WIDE, 0.0)])
def test_reslice_by_brute_force(spark, method, matrix, fill):
    random.seed(11)
    dims, out_dims = (7, 6, 5), (9, 7, 6)
    array = np.zeros(dims)
    for p in itertools.product(*map(range, dims)):
        if random.random() < 0.4:
            array[p] = random.randrange(1, 200)
    rows = spark.createDataFrame([(3, *map(int, p), float(array[tuple(p)])) for p in np.argwhere(array)], "image_id int, x int, y int, z int, value double")
    got = {(r.x, r.y, r.z): r.value for r in reslice.affine_reslice(rows, dims, matrix, out_dims, method, fill).collect()}
    want = resliced(array, matrix, out_dims, method, fill)
    small = lambda d: {k: v for k, v in d.items() if abs(v) > 1e-9}
    assert small(got).keys() == small(want).keys() and all(got[k] == pytest.approx(v) for k, v in small(want).items())


def paths(edges, matched):
    """{(a, b): d}: Dijkstra from each matched node that does not go on from other matched nodes."""
    near, out = {}, {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    for a in matched:
        best, heap = {}, [(0.0, a)]
        while heap:
            d, n = heapq.heappop(heap)
            if n in best:
                continue
            best[n] = d
            if n == a or n not in matched:
                for m, w in near.get(n, []):
                    heapq.heappush(heap, (d + w, m))
        out |= {(a, b): d for b, d in best.items() if b in matched and a < b}
    return out


def test_connectivity_scores_by_brute_force(spark):
    random.seed(2)
    pairs = sorted({tuple(sorted(random.sample(range(40), 2))) for _ in range(60)})
    one = [(u, v, 1.0 + random.random()) for u, v in pairs]
    two = [(u + 100, v + 100, w * 1.1) for u, v, w in one if random.random() < 0.8]
    pairs = [(n, n + 100) for n in range(40) if random.random() < 0.5]
    table = lambda edges: spark.createDataFrame([("s", "m", i, *e) for i, e in enumerate(edges)], EDGE)
    got = compare.connectivity_scores(table(one), table(two), spark.createDataFrame([("s", *p) for p in pairs], "sample_id string, node_a long, node_b long")).collect()
    p, q = paths(one, {a for a, _ in pairs}), {(a - 100, b - 100): d for (a, b), d in paths(two, {b for _, b in pairs}).items()}
    assert p.keys() & q.keys() and p.keys() - q.keys()
    both, fn, fp = p.keys() & q.keys(), p.keys() - q.keys(), q.keys() - p.keys()
    shared = sum((p[k] + q[k]) / 2 for k in both)
    share = lambda part, whole: part / max(part + whole, 0.01)
    want = [share(len(fn), len(both)), share(len(fp), len(both)), share(sum(p[k] for k in fn), shared), share(sum(q[k] for k in fp), shared)]
    assert len(got) == 1 and list(got[0])[1:] == pytest.approx(want)


def test_random_subsets(spark):
    """Connected, of the size asked for or the whole component, the same however rows are dealt, and others with another seed."""
    random.seed(4)
    edges = [(u, random.randrange(u)) for u in range(1, 30)] + [(50, 51), (51, 52)]
    table = spark.createDataFrame([("s", "m", i, u, v, 1.0) for i, (u, v) in enumerate(edges)], EDGE)
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)

    def reach(start, within):
        seen, todo = {start}, [start]
        while todo:
            new = (near[todo.pop()] & within) - seen
            seen |= new
            todo += new
        return seen

    def subsets(df, seed):
        out = {}
        for r in graph.random_connected_subset(df, 5, 12, seed).collect():
            out.setdefault(r["repeat"], []).append(r.node)
        return out

    got = subsets(table, 0)
    assert len(got) == 12
    for nodes in got.values():
        assert len(set(nodes)) == len(nodes) == min(5, len(reach(nodes[0], set(near))))
        assert reach(nodes[0], set(nodes)) == set(nodes)
    again = subsets(table.repartition(5), 0)
    assert {k: set(v) for k, v in again.items()} == {k: set(v) for k, v in got.items()}
    assert {k: set(v) for k, v in subsets(table, 1).items()} != {k: set(v) for k, v in got.items()}


def test_extraction_of_a_bar(spark):
    """A bar of width 5 with a hole inside, and a speck: one branch along its middle, whose diameter is twice the distance of 3."""
    bar = {(x, y, z) for x in range(3, 25) for y in range(8, 13) for z in range(3, 6)} - {(12, 10, 4)}
    rows = spark.createDataFrame([("a", *p) for p in bar | {(28, 2, 2)}], "image_id string, x int, y int, z int")
    got = compare.extract(rows, (30, 20, 8)).collect()
    assert [(r.image_id, r.mean_diameter) for r in got] == [("a", 6.0)]
    assert 14 <= got[0].n_edges <= 21 and got[0].n_edges <= got[0].length


def test_least_known(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1, nan), ("a", 3, 2.0), ("a", 2, 2.0), ("a", 4, None), ("b", 1, nan), ("c", 1, None), ("d", 9, -1.0)], "s string, i int, v double")
    assert sorted(map(tuple, stats.least_known(df, "v", ["i"], ["s"]).collect())) == [("a", 2, 2.0), ("d", 9, -1.0)]
    assert [tuple(r) for r in stats.least_known(df, "v", ["s", "i"]).collect()] == [("d", 9, -1.0)]
    assert stats.least_known(df.limit(0), "v", ["s", "i"]).count() == 0
    assert stats.least_known(df.where("s = 'b'"), "v", ["s", "i"]).count() == 0
