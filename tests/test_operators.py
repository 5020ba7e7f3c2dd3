"""Unit arrays with known answers, and invariants."""

import math
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from arborix.operators import components, geometry, graph, maps, stats, topology, voxels
from arborix.sources import tables
from arborix.sources.fixtures import fixture


def test_components_on_paths_and_loops(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)] + [(random.randrange(60), random.randrange(60)) for _ in range(30)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_straight_line(spark):
    p = spark.createDataFrame([("s", 1, i, i, 0, 0, 2.0) for i in range(30)], "sample_id string, edge_id int, pos int, x int, y int, z int, diameter double")
    m = geometry.branch_metrics(p, (2.0, 2.0, 2.0)).first()
    assert m.length == pytest.approx(58) and m.clr == pytest.approx(1) and m.soam == pytest.approx(0, abs=1e-6) and (m.dx, m.dy, m.dz) == (1, 0, 0)


def test_one_point_branch_and_null_diameters(spark):
    p = spark.createDataFrame([("s", 1, 0, 3, 3, 3, None)], "sample_id string, edge_id int, pos int, x int, y int, z int, diameter double")
    m = geometry.branch_metrics(p).first()
    assert (m.length, m.chord, m.diameter, m.soam) == (1.0, 1.0, None, 0.0)


def test_ghosts_keep_betti_numbers(spark):
    e = spark.createDataFrame([("s", "m", 1, 1, 2), ("s", "m", 2, 1, 2), ("s", "m", 3, 2, 1), ("s", "m", 4, 4, 4)], "sample_id string, mask_id string, edge_id long, u long, v long")
    for c in graph.ATTRIBUTES:
        e = e.withColumn(c, F.lit(1.0))
    g = graph.with_ghosts(e)
    assert g.where("ghost").count() == 2
    assert graph.with_ghosts(e, undirected=True).where("ghost").count() == 4
    d = topology.descriptors(e).first()
    assert d.nodes_full == 4 and d.edges_full == 3  # 1, 2, a ghost, and the loop's node


def test_betti_invariant(spark):
    e = graph.pair_edges(graph.with_ghosts(fixture(spark, SF, "fx_edges")))
    for r in topology.betti_over_thresholds(e, [0.0, 100.0]).collect():
        assert r.b0 - r.b1 == r.n_nodes - r.n_edges


def _elder(vertices, edges):
    """Union-find over the filtration, edge by edge."""
    parent = {v: v for v in vertices}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bars = []
    for f, a, b in sorted((max(vertices[a], vertices[b]), a, b) for a, b in edges):
        a, b = root(a), root(b)
        if a == b:
            bars.append((1, f, None))
            continue
        old, young = sorted((a, b), key=lambda v: (vertices[v], v))
        parent[young] = old
        if f > vertices[young]:
            bars.append((0, vertices[young], f))
    return sorted(bars + [(0, vertices[v], None) for v in vertices if root(v) == v], key=str)


def test_persistence_is_the_elder_rule(spark):
    random.seed(4)
    data = []
    for edge in range(25):
        x, y = random.randrange(12), random.randrange(12)
        for pos in range(8):
            data.append(("s", edge, pos, x, y, 0, 1.0))
            x, y = x + random.choice((-1, 0, 1)), y + random.choice((-1, 0, 1))
    p = spark.createDataFrame(data, "sample_id string, edge_id int, pos int, x int, y int, z int, diameter double")
    v, e = topology.radial_filtration(p, 40)
    vertices = {tuple(r.p): r.bin for r in v.collect()}
    edges = [(tuple(r.p), tuple(r.q)) for r in e.collect()]
    got = sorted(((r.dim, r.birth, r.death) for r in topology.persistence(p, 40).collect()), key=str)
    assert got == _elder(vertices, edges)


def test_flip_twice_is_identity(spark):
    v = fixture(spark, SF, "fx_voxels")
    assert voxels.flip(voxels.flip(v, "x", 64), "x", 64).exceptAll(v).count() == 0


def test_reassembled_tiles_are_the_image(spark):
    v = fixture(spark, SF, "fx_voxels")
    back = voxels.reassemble(voxels.strided_tiles(v, (64, 64, 8), (32, 32), (16, 16)))
    assert back.select("image_id", "x", "y", "z", F.col("value").cast("int")).exceptAll(v.select("image_id", "x", "y", "z", "value")).count() == 0


def test_bad_arguments(spark):
    v = fixture(spark, SF, "fx_voxels")
    for call in (lambda: voxels.to_view(v, (64, 64, 8), "top"), lambda: voxels.clip_sides(v, (64, 64, 8), (64, 0, 0), (0, 0, 0)), lambda: tables.put_tile(v, v, (0, 0, 0), "max"), lambda: tables.read_voxels(spark, "a.tif")):
        with pytest.raises(ValueError):
            call()


def test_two_crosses_and_clique(spark):
    cross = lambda z, o: {(z, o + i, o + 2) for i in range(5)} | {(z, o + 2, o + i) for i in range(5)}
    rows = [("two_crosses", x, y, z, 1) for z, y, x in cross(0, 0) | cross(5, 5)] + [("clique", x, y, z, 1) for z, y, x in ((1, 1, 1), (2, 0, 1), (2, 1, 2))]
    v = spark.createDataFrame(rows, "image_id string, x int, y int, z int, value int")
    n = {r.image_id: r.n for r in voxels.label(v, (10, 10, 10)).groupBy("image_id").agg(F.countDistinct("component").alias("n")).collect()}
    assert n == {"two_crosses": 2, "clique": 1}
    e = {r.image_id: r["count"] for r in voxels.adjacency(v).groupBy("image_id").count().collect()}
    assert e["two_crosses"] >= 16 and e["clique"] >= 2


def test_greedy_matching_is_greedy(spark):
    random.seed(5)
    a, b = ([("s", i, *(random.randrange(40) for _ in range(3))) for i in range(25)] for _ in range(2))
    schema = "sample_id string, node_id long, x int, y int, z int"
    got = {(r.node_a, r.node_b) for r in maps.greedy_matching(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 20.0).collect()}
    pairs = sorted((math.dist(p[2:], q[2:]), p[1], q[1]) for p in a for q in b if math.dist(p[2:], q[2:]) <= 20)
    used_a, used_b, want = set(), set(), set()
    for _, i, j in pairs:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            want.add((i, j))
    assert got == want


def test_normal_tail(spark):
    for z in (0.0, 0.5, 1.96, 4.0):
        got = spark.range(1).select(stats.normal_tail(F.lit(z)).alias("p")).first().p
        assert got == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=1e-7)


def test_round_trips_of_files(spark, tmp_path):
    for c in ("Component1Branch1", "Component1Branch2", "Component1Branch4", "Component3Branch1"):
        (tmp_path / "sample").mkdir(exist_ok=True)
        (tmp_path / "sample" / f"{c}.txt").write_text("1 2 3\n4 5 6\n")
    p = tables.read_branch_points(spark, f"{tmp_path}/sample/*.txt")
    assert {(r.component, r.branch) for r in p.collect()} == {(1, 1), (1, 2)}
    bars = fixture(spark, SF, "fx_barcodes")
    tables.write_barcodes(bars, f"{tmp_path}/bars")
    assert spark.read.csv(f"{tmp_path}/bars", sep=" ").count() == bars.count()
    (tmp_path / "s1.txt").write_text("2 0 0.5 inf\n2 1 0.25 0.75\n")
    d = {(r.sample_id, r.dim, r.birth, r.death) for r in tables.read_diagram(spark, f"{tmp_path}/s1.txt").collect()}
    assert d == {("s1", 0, 0.5, None), ("s1", 1, 0.25, 0.75)}
    e = fixture(spark, SF, "fx_edges")
    tables.write_network_summary(e, f"{tmp_path}/net")
    assert tables.read_network_summary(spark, f"{tmp_path}/net").count() == e.count()
    (tmp_path / "n.swc").write_text("# id type x y z r parent\n1 1 0 0 0 1 -1\n2 1 9 0 0 1 1\n")
    assert voxels.swc_raster(tables.read_swc(spark, f"{tmp_path}/n.swc"), (10, 10, 10)).count() == 10
