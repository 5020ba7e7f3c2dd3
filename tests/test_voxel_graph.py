"""Voxel graphs, branches and spurs, block by block, held against brute force over whole images."""

import itertools
import math
import random

import pytest

from arborix.operators import skeleton

DIMS = (12, 11, 10)
SIDES = [(64, 64, 32), (4, 64, 32), (64, 64, 3), (4, 3, 5)]


def images():
    rng = random.Random(3)
    every = list(itertools.product(*map(range, DIMS)))
    out = {f"noise{share}": {p for p in every if rng.random() < share} for share in (0.05, 0.12, 0.4)}
    steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1), (1, 1, 0), (-1, 0, 1)]
    at, walk = (5, 5, 5), set()
    for _ in range(140):
        walk.add(at)
        at = tuple(min(max(a + b, 0), n - 1) for a, b, n in zip(at, rng.choice(steps), DIMS))
    return out | {"walk": walk, "ring": {(x, y, 1) for x in range(12) for y in range(10) if x in (0, 11) or y in (0, 9)}, "line": {(x, 5, 2) for x in range(12)}, "tree": {(x, 2, 4) for x in range(12)} | {(6, y, 4) for y in range(2, 9)} | {(6, 8 + k, 4 + k) for k in range(1, 3)}}


def index(p):
    return (p[0] * DIMS[1] + p[1]) * DIMS[2] + p[2]


def far(p, q):
    return sum((a - b) ** 2 for a, b in zip(p, q))


def graph(voxels):
    """Edges with p < q, by triangles."""
    near = {p: {q for q in itertools.product(*((c - 1, c, c + 1) for c in p)) if q != p and q in voxels} for p in voxels}
    gone = set()
    for a in voxels:
        for b, c in itertools.combinations(sorted(q for q in near[a] if q > a), 2):
            if c not in near[b] or near[a] & near[b] & near[c]:
                continue
            sides = [(a, b), (a, c), (b, c)]
            most, short = max(far(*s) for s in sides), min(far(*s) for s in sides)
            gone |= {s for s in sides if far(*s) == most} if most > short else set([s for s in sides if s[0][2] == s[1][2]][:1])
    return sorted((p, q) for p in voxels for q in near[p] if p < q and (p, q) not in gone)


def chains(edges):
    """{edge: the first edge of its chain}, and degrees."""
    degree = {}
    for p in itertools.chain(*edges):
        degree[p] = degree.get(p, 0) + 1
    at = {e: e for e in edges}
    for _ in edges:
        before = dict(at)
        least = {}
        for e, c in at.items():
            for p in e:
                if degree[p] == 2:
                    least[p] = min(least.get(p, c), c)
        at = {e: min([c, *(least[p] for p in e if p in least)]) for e, c in at.items()}
        if at == before:
            return at, degree
    return at, degree


def frame(spark, shapes):
    return spark.createDataFrame([(n, *p) for n, pts in shapes.items() for p in pts], "image_id string, x int, y int, z int")


def no_join(df):
    return "Join" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sides", SIDES)
def test_graph_and_degrees(spark, sides):
    shapes = images()
    v = frame(spark, shapes)
    edges = {n: graph(pts) for n, pts in shapes.items()}
    got = skeleton.voxel_graph(v, DIMS, sides)
    degrees = skeleton.voxel_degrees(v, DIMS, sides)
    assert no_join(got) and no_join(degrees)
    assert sorted(map(tuple, got.select("image_id", "u", "v", "length2").collect())) == sorted((n, index(p), index(q), far(p, q)) for n, es in edges.items() for p, q in es)
    want = sorted((n, index(p), d) for n, es in edges.items() for p, d in chains(es)[1].items())
    assert sorted(map(tuple, degrees.select("image_id", "node", "degree").collect())) == want == sorted(map(tuple, skeleton.graph_degrees(got).collect()))


@pytest.mark.parametrize("sides", SIDES)
def test_branches(spark, sides):
    shapes = images()
    want, number = [], 0
    for n in sorted(shapes):
        edges = graph(shapes[n])
        place = {e: number + i for i, e in enumerate(edges)}
        number += len(edges)
        chain, degree = chains(edges)
        part = {p: p for p in degree}
        for _ in part:
            for p, q in edges:
                part[p] = part[q] = min(part[p], part[q])
        ended = {part[p] for p, d in degree.items() if d == 1}
        for c in set(chain.values()):
            own = [e for e in edges if chain[e] == c]
            if part[c[0]] in ended:
                outer = [p for e in own for p in e if degree[p] != 2] or [min(p for p, _ in own)]
                want.append((n, place[c], index(min(outer)), index(max(outer)), len(own), round(sum(math.sqrt(far(*e)) for e in own), 6)))
    got = skeleton.branches(frame(spark, shapes), DIMS, sides).select("image_id", "chain", "u", "v", "n_edges", "length").collect()
    assert sorted((*r[:5], round(r[5], 6)) for r in got) == sorted(want)
    images_ = {r.image_id for r in got}
    assert {"line", "tree"} <= images_ and "ring" not in images_


@pytest.mark.parametrize("cutoff, parity, sides", [(9, False, s) for s in SIDES] + [(2, False, (4, 3, 5)), (2, True, (4, 3, 5))])
def test_spurs_over_blocks(spark, cutoff, parity, sides):
    shapes = images()
    want = set()
    for n, pts in shapes.items():
        chain, degree = chains(graph(pts))
        gone = set()
        for c in set(chain.values()):
            own = [e for e in chain if chain[e] == c]
            nodes = {p for e in own for p in e}
            if len(own) <= cutoff and [sum(degree[p] == 1 for p in nodes), sum(degree[p] > 2 for p in nodes)] == [1, 1]:
                gone |= {p for p in nodes if (degree[p] != 1 if parity else degree[p] <= 2)}
        want |= {(n, *p) for p in pts - gone}
    got = skeleton.prune_spurs(frame(spark, shapes), DIMS, cutoff, parity, sides)
    assert no_join(got)
    assert {tuple(r) for r in got.select("image_id", *"xyz").collect()} == want and len(want) < sum(map(len, shapes.values()))
