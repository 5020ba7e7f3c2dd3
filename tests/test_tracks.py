"""Tracked branches, ranks, blocks and scores against brute force on small tables."""

import itertools
import math
import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from arborix.operators import blocks, compare, graph, maps, ranks, reslice, stats, topology, tracks, voxels
from arborix.sources.fixtures import fixture

VOX = "image_id string, x int, y int, z int, value double"


def test_ranks_are_places_in_the_order(spark):
    random.seed(1)
    data = [(i, random.randrange(50), random.choice([None, 1.0, 2.0])) for i in range(500)]
    got = {r.i: r.k for r in ranks.ranked(spark.createDataFrame(data, "i int, a int, b double").repartition(7), [F.col("b").asc_nulls_last(), "a", "i"], "k").collect()}
    assert got == {d[0]: k for k, d in enumerate(sorted(data, key=lambda d: (d[2] is None, d[2] or 0, d[1], d[0])))}
    assert ranks.ranked(spark.createDataFrame([], "i int"), ["i"]).count() == 0


def test_holm_with_nulls(spark):
    tests = spark.createDataFrame([(1, 0.001), (2, 0.04), (3, 0.02), (4, None)], "t int, p_value double")
    for step, want in ((False, [True, False, False, False]), (True, [True, False, False, False])):
        assert [r.reject for r in sorted(stats.holm(tests, step_down=step, order=["t"]).collect())] == want


def test_running_median_mirrors(spark):
    for n in (1, 3, 7, 60):
        v = [((i * 37) % 11) * 1.0 for i in range(n)]
        got = {r.i: r.median for r in stats.running_median(spark.createDataFrame([("s", i, x) for i, x in enumerate(v)], "s string, i int, v double"), ["s"], "i", "v", 9).collect()}
        wide = np.pad(np.array(v), 4, mode="symmetric")
        assert got == {i: float(np.median(wide[i : i + 9])) for i in range(n)}


def test_medians_and_ridges_do_not_depend_on_blocks(spark):
    random.seed(3)
    dims = (11, 9, 6)
    data = [("a", x, y, z, float(random.randrange(1, 200))) for x in range(11) for y in range(9) for z in range(6) if random.random() < 0.6]
    v = spark.createDataFrame(data, VOX)
    dense = np.zeros(dims)
    for _, x, y, z, value in data:
        dense[x, y, z] = value
    rows = lambda df: {(r.x, r.y, r.z): r.value for r in df.collect()}
    want = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(dense, [(2, 2), (1, 1), (0, 0)], mode="symmetric"), (5, 3, 1)).reshape(*dims, -1), axis=-1)
    for sides in (blocks.SIDES, (4, 4, 3)):
        got = rows(blocks.by_blocks(v, blocks.median((5, 3, 1)), (2, 1, 0), dims, sides=sides))
        assert got == {tuple(map(int, p)): float(want[tuple(p)]) for p in np.argwhere(want)}
    one, two = (rows(blocks.by_blocks(v, blocks.ridges([1.0], 0.5, 0.5, 15.0, False, True), (6, 6, 6), dims, sides=s)) for s in (blocks.SIDES, (6, 6, 4)))
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], rel_tol=1e-9) for k in one)
    # the same by column expressions: smoothing, differences, closed-form eigenvalues
    grid = voxels.dense(voxels.gaussian_smooth(v, dims, 1.0), dims)
    h = None
    for i, a in enumerate("xyz"):
        for b in "xyz"[i:]:
            second = voxels.gradient(voxels.gradient(grid, a), b).withColumnRenamed("value", a + b)
            h = second if h is None else h.join(second, voxels.KEYS)
    e = stats.eigen3(*(F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")))
    other = rows(h.select(*voxels.KEYS, e.alias("e")).select(*voxels.KEYS, stats.vesselness(F.col("e")).alias("value")).where("value <> 0"))
    assert all(math.isclose(other.get(k, 0.0), one.get(k, 0.0), rel_tol=1e-6, abs_tol=1e-9) for k in other.keys() | one.keys())


@pytest.mark.parametrize("size", [(3, 3, 1), (5, 3, 3), (4, 1, 2), (11, 11, 5)])
@pytest.mark.parametrize("top", [2, 9, 10**6])
def test_medians_by_counts_and_by_partition(size, top):
    rng = np.random.default_rng(top)
    array = rng.integers(0, top, (13, 12, 6)).astype(float)
    reach = [n // 2 for n in size]
    wide = np.pad(array, [(r, r) for r in reach], mode="symmetric")
    boxes = np.lib.stride_tricks.sliding_window_view(wide, size)[: array.shape[0], : array.shape[1], : array.shape[2]]
    want = np.sort(boxes.reshape(*array.shape, -1), axis=-1)[..., math.prod(size) // 2]
    got = blocks.median(size)(array, [0, 0, 0], list(array.shape))
    assert got[: want.shape[0]].shape == want.shape and (got == want).all()


def test_fill_holes_in_space(spark):
    """Against flood filling; a hole at the border is filled too if it is small."""
    random.seed(5)
    dims = (8, 8, 5)
    full = {p for p in itertools.product(*map(range, dims)) if random.random() < 0.7}
    left, small = set(itertools.product(*map(range, dims))) - full, set()
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            p = todo.pop()
            part.add(p)
            for a in range(3):
                for s in (-1, 1):
                    q = tuple(v + s * (i == a) for i, v in enumerate(p))
                    if q in left:
                        left.discard(q)
                        todo.append(q)
        if len(part) < 6:
            small |= part
    v = spark.createDataFrame([("a", *p, 1.0) for p in full], VOX)
    assert {(r.x, r.y, r.z) for r in voxels.fill_holes(v, dims, 6).collect()} == full | small


def test_clean_up_of_a_cube(spark):
    """A hole and a lone voxel go; the planar median cuts the four upright edges, which closing does not bring back."""
    cube = {(x, y, z) for x in range(3, 11) for y in range(3, 11) for z in range(2, 10)}
    given = cube - {(6, 6, 5)} | {(14, 14, 1)}
    v = spark.createDataFrame([("a", *p, 200.0) for p in given], VOX)
    got = {(r.x, r.y, r.z) for r in voxels.clean_up(v, (16, 16, 12), 127, 20, hole=20).collect()}
    assert got == {p for p in cube if not (p[0] in (3, 10) and p[1] in (3, 10))}


def test_end_nodes_within_reach(spark):
    random.seed(6)
    data = [("s", i, *(random.randrange(14) for _ in range(3))) for i in range(60)]
    name = {d[1]: d[1] for d in data}
    for _ in data:
        for a, b in itertools.combinations(data, 2):
            if math.dist(a[2:], b[2:]) < 3:
                name[a[1]] = name[b[1]] = min(name[a[1]], name[b[1]])
    got = {r.end_id: r.node for r in tracks.reuse_end_nodes(spark.createDataFrame(data, "sample_id string, end_id long, x int, y int, z int")).collect()}
    assert got == name


def _merge(edges):
    """One merging step by hand: chains over touching ends of nodes with two different neighbours."""
    at = {}
    for k, e in edges.items():
        at.setdefault(e["u"], []).append((k, e["v"], e["p"]))
        at.setdefault(e["v"], []).append((k, e["u"], e["q"]))
    joints = {n: (a[0][0], a[1][0]) for n, a in at.items() if len(a) == 2 and a[0][0] != a[1][0] and a[0][1] != a[1][1] and n not in (a[0][1], a[1][1]) and math.dist(a[0][2], a[1][2]) < 4}
    chain = {k: k for k in edges}
    for _ in edges:
        for a, b in joints.values():
            chain[a] = chain[b] = min(chain[a], chain[b])
    out = {}
    for c in set(chain.values()):
        part = [k for k in edges if chain[k] == c]
        outer = sorted((n, k, p) for k in part for n, p in ((edges[k]["u"], edges[k]["p"]), (edges[k]["v"], edges[k]["q"])) if n not in joints)
        if len(part) == 1 or len(outer) != 2:
            out |= {k: edges[k] for k in part}
            continue
        length = sum(edges[k]["length"] for k in part)
        out[c] = {"u": outer[0][0], "v": outer[1][0], "p": outer[0][2], "q": outer[1][2], "length": length, "diameter": sum(edges[k]["length"] * edges[k]["diameter"] for k in part) / length}
    return out


def _prune(edges, least):
    edges = {k: e for k, e in edges.items() if e["u"] != e["v"]}
    degree = {}
    for e in edges.values():
        for n in (e["u"], e["v"]):
            degree[n] = degree.get(n, 0) + 1
    if len(degree) <= 2:
        return edges
    return {k: e for k, e in edges.items() if not (1 in (degree[e["u"]], degree[e["v"]]) and e["length"] < max(least, 2 * e["diameter"]))}


def test_three_rounds_of_merging_and_pruning(spark):
    random.seed(7)
    place = {n: tuple(random.randrange(60) for _ in range(3)) for n in range(40)}
    near = lambda p: tuple(v + random.choice((0, 1, 3)) for v in p)
    edges = {}
    for k in range(46):
        u, v = random.randrange(40), random.randrange(40)
        edges[k] = {"u": u, "v": v, "p": near(place[u]), "q": near(place[v]), "length": float(random.randrange(5, 60)), "diameter": float(random.randrange(1, 9))}
    rows = [("s", "m", k, e["u"], e["v"], e["length"], e["diameter"], 1.0, 1.0, *e["p"], *e["q"]) for k, e in edges.items()]
    df = spark.createDataFrame(rows, "sample_id string, mask_id string, edge_id long, u long, v long, length double, diameter double, soam double, clr double, x0 int, y0 int, z0 int, x1 int, y1 int, z1 int")
    for _ in range(3):
        edges = _prune(_merge(edges), 20.0)
    got = {r.edge_id: (min(r.u, r.v), max(r.u, r.v), round(r.length, 9), round(r.diameter, 9)) for r in tracks.merge_and_prune(df, 20.0).collect()}
    assert got == {k: (min(e["u"], e["v"]), max(e["u"], e["v"]), round(e["length"], 9), round(e["diameter"], 9)) for k, e in edges.items()} and got


def test_weighted_cross_entropy_forms(spark):
    random.seed(8)
    dims = (9, 8, 4)
    data = [("a", *p, float(random.random() < 0.3), random.random()) for p in itertools.product(*map(range, dims))]
    t, q = np.zeros(dims), np.zeros(dims)
    for _, x, y, z, a, b in data:
        t[x, y, z], q[x, y, z] = a, min(1 - 1e-6, max(1e-6, b))

    def mean(a, axes):
        for axis in axes:
            w = np.pad(a, [(2, 2) if k == axis else (0, 0) for k in range(3)])
            a = sum(np.take(w, range(k, k + a.shape[axis]), axis=axis) for k in range(5)) / 5
        return a

    pair = spark.createDataFrame(data, "image_id string, x int, y int, z int, truth double, pred double")
    for form in ("planes", "space", "junctions"):
        n = sum(np.pad(t, 1)[1 + a : 1 + a + dims[0], 1 + b : 1 + b + dims[1], 1 + c : 1 + c + dims[2]] for a, b, c in voxels.OFFSETS26)
        near, own = (t, t) if form != "junctions" else ((n > 2) * 1.0, n)
        for _ in range(5):
            near = mean(near, (0, 1) if form == "planes" else (0, 1, 2))
        f, total = t.sum(), t.size
        alpha = (f + 1) / (total + 2) if form == "planes" else math.sqrt((f + 1) / (total + 1))
        w = near + alpha
        if form != "planes":
            w = w + own * (1 - alpha) * w.max()
        truth = np.clip(t, 1e-6, 1 - 1e-6) if form == "planes" else t
        want = (w * -(truth * np.log(q) + (1 - truth) * np.log(1 - q))).mean()
        assert reslice.neighbour_weighted_bce(pair, dims, form).first().score == pytest.approx(want, rel=1e-9)


def test_report_is_made_of_its_parts(spark):
    p = fixture(spark, SF, "fx_points").groupBy("sample_id", "edge_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("diameter").alias("d"), F.max("pos").cast("double").alias("l"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"))
    per = p.select("sample_id", "edge_id", F.col("l").alias("value"))
    out = compare.comparison_report(p, ["d", "l"], (64, 64), radii=(10,), coherence_radii=(20,), grid_steps=(8, 8), perfusion=per)
    n = {(r.kind, r.metric): r["count"] for r in out.groupBy("kind", "metric").count().collect()}
    assert {k for k, _ in n} == {"histogram", "joint", "map_10", "coherence_20", "perfusion"} and n["map_10", "d"] == n["coherence_20", "direction"]
    one = {(r.sample_id, r.bin_a, r.bin_b): r.value for r in out.where("kind = 'map_10' AND metric = 'l'").collect()}
    assert one == {(r.sample_id, r.gx, r.gy): r.value for r in maps.metric_map(p, "l", (64, 64), 10.0, n=8).collect()}
    ends = stats.shared_ranges(p, ["l"]).first()
    h = {(r.sample_id, r.bin_a): r.value for r in out.where("kind = 'histogram' AND metric = 'l'").collect()}
    assert h == {(r.sample_id, r.bin): r.n for r in stats.histogram(p, "l", 20, ["sample_id"], ends.lo, ends.hi).collect()}


def test_topology_agreement_by_hand(spark):
    random.seed(9)
    edges = sorted({tuple(sorted(random.sample(range(12), 2))) for _ in range(22)})
    frame = lambda es: spark.createDataFrame([("s", "m", k, u, v) for k, (u, v) in enumerate(es)], "sample_id string, mask_id string, edge_id long, u long, v long")
    other = edges[::2]
    same = spark.createDataFrame([("s", i, i) for i in range(12)], "sample_id string, node_a long, node_b long")
    subsets = {}
    for r in graph.random_connected_subset(frame(edges), 4, 10).collect():
        subsets.setdefault(r["repeat"], set()).add(r.node)
    here, there = (lambda s: {(a, b) for a, b in edges if a in s and b in s}), (lambda s: {(a, b) for a, b in other if a in s and b in s})

    def alike(s):
        nodes = sorted(s)
        norm = lambda es: {tuple(sorted(e)) for e in es}
        return any(norm((dict(zip(nodes, p))[a], dict(zip(nodes, p))[b]) for a, b in here(s)) == norm(there(s)) for p in itertools.permutations(nodes))

    want = sum(map(alike, subsets.values())) / len(subsets)
    assert compare.topology_agreement(frame(edges), frame(other), same, 4).first().share == pytest.approx(want)


def test_elder_rule_on_long_chains(spark):
    """Each basin is older than the next, so the youngest are drawn along the whole chain."""
    n = 40
    saddles = spark.createDataFrame([("s", i, i + 1, 100 - i) for i in range(n)], "sample_id string, a long, b long, level int")
    got = {r.node: r.level for r in topology.elder_rule(saddles, ["sample_id"]).collect()}
    assert got == {i + 1: 100 - i for i in range(n)}


def test_shortest_paths_between_matched_nodes(spark):
    random.seed(10)
    edges = [("s", *random.sample(range(20), 2), float(random.randrange(1, 30))) for _ in range(40)]
    matched = {0, 3, 5, 8, 13}
    near = {}
    for _, u, v, w in edges:
        for a, b in ((u, v), (v, u)):
            near.setdefault(a, {})[b] = min(w, near.get(a, {}).get(b, w))
    want = {}
    for a in matched:
        dist, todo = {a: 0.0}, [a]
        while todo:
            x = todo.pop()
            if x != a and x in matched:
                continue
            for y, w in near.get(x, {}).items():
                if y != a and dist[x] + w < dist.get(y, math.inf):
                    dist[y] = dist[x] + w
                    todo.append(y)
        want |= {(a, b): d for b, d in dist.items() if b in matched and a < b}
    e = spark.createDataFrame(edges, "sample_id string, u long, v long, length double")
    m = spark.createDataFrame([("s", n) for n in matched], "sample_id string, node long")
    assert {(r.a, r.b): r.d for r in compare.matched_paths(e, m).collect() if r.a != r.b} == want
