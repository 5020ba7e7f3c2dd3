"""Queries on branches, networks and filtrations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import graph as N
from ..operators import topology as T
from ..operators import tracks as R
from ..sources.fixtures import PIX, ctes, fixture
from .common import query, r

EDGES, POINTS, BARS = ctes("fx_edges"), ctes("fx_points"), ctes("fx_barcodes")
XYZ = "sample_id, edge_id, pos, x, y, z, diameter"


def _edges(spark, d):
    return fixture(spark, d, "fx_edges")


def _points(spark, d):
    return fixture(spark, d, "fx_points")


# -- points of branches

_W = "PARTITION BY sample_id, edge_id ORDER BY pos"
_SCALED = "sqrt(" + " + ".join(f"pow({PIX[i]:g}e0 * ({c} - lead({c}) OVER w), 2)" for i, c in enumerate("xyz")) + ")"
_LENGTH = f"steps AS (SELECT *, {_SCALED} AS step FROM fx_points WINDOW w AS ({_W})), len AS (SELECT sample_id, edge_id, count(*) AS n_points, greatest(coalesce(sum(step), 0), 1e0) AS length, avg(diameter) AS diameter, arg_min(x, pos) AS x0, arg_min(y, pos) AS y0, arg_min(z, pos) AS z0, arg_max(x, pos) AS x1, arg_max(y, pos) AS y1, arg_max(z, pos) AS z1 FROM steps GROUP BY ALL)"
_KERNEL = G.kernel()
_SMOOTH = ", ".join(
    " + ".join(f"{w!r} * coalesce({'lag' if k < 0 else 'lead'}(s{c}, {abs(k)}) OVER w, {'first' if k < 0 else 'last'}_value(s{c}) OVER a)" for k, w in zip(range(-G.RADIUS, G.RADIUS + 1), _KERNEL)) + f" AS {c}"
    for c in "xyz"
)
_LINE = f"""sc AS (SELECT sample_id, edge_id, pos, x * {PIX[0]:g}e0 AS sx, y * {PIX[1]:g}e0 AS sy, z * {PIX[2]:g}e0 AS sz FROM fx_points),
sm AS (SELECT sample_id, edge_id, pos, count(*) OVER a AS n, {_SMOOTH} FROM sc WINDOW w AS ({_W}), a AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
line AS (SELECT * FROM sm UNION ALL
  SELECT s.sample_id, s.edge_id, -1, m.n, sx, sy, sz FROM sc s JOIN sm m USING (sample_id, edge_id, pos) WHERE pos = 0 UNION ALL
  SELECT s.sample_id, s.edge_id, m.n, m.n, sx, sy, sz FROM sc s JOIN sm m USING (sample_id, edge_id, pos) WHERE pos = m.n - 1)"""
_SOAM = _LINE + f""", vv AS (SELECT sample_id, edge_id, n, {', '.join(f'lead({c}) OVER w - {c} AS p{c}, lead({c}, 2) OVER w - lead({c}) OVER w AS q{c}' for c in 'xyz')} FROM line WINDOW w AS ({_W})),
th AS (SELECT sample_id, edge_id, n, px * qx + py * qy + pz * qz AS dot, sqrt(px * px + py * py + pz * pz) AS n1, sqrt(qx * qx + qy * qy + qz * qz) AS n2 FROM vv),
tc AS (SELECT sample_id, edge_id, n, n1, n2, CASE WHEN n1 > 0 AND n2 > 0 THEN dot / n1 / n2 END AS c FROM th),
soam AS (SELECT sample_id, edge_id, coalesce(sum(CASE WHEN n >= 5 AND n1 > 0 AND n2 > 0 THEN acos(CASE WHEN abs(c - 1) < 1e-5 THEN 1e0 WHEN abs(c + 1) < 1e-5 THEN -1e0 ELSE greatest(least(c, 1e0), -1e0) END) END), 0) AS soam FROM tc GROUP BY ALL)"""
_CHORD = "greatest(sqrt(" + " + ".join(f"pow({PIX[i]:g}e0 * ({c}0 - {c}1), 2)" for i, c in enumerate("xyz")) + "), 1e0)"
_BRANCHES = f"{_LENGTH}, {_SOAM}, br AS (SELECT sample_id, edge_id, n_points, length, diameter, {_CHORD} AS chord, soam, x0, y0, z0, x1, y1, z1 FROM len JOIN soam USING (sample_id, edge_id))"


@query("w01_branch_length", f"{POINTS}, {_LENGTH} SELECT sample_id, edge_id, n_points, {r('length')} AS length FROM len")
def w01(spark, d):
    return G.steps(_points(spark, d), PIX).groupBy(*G.KEYS).agg(F.count("*").alias("n_points"), F.round(F.greatest(F.coalesce(F.sum("step"), F.lit(0.0)), F.lit(1.0)), 6).alias("length"))


@query("w02_soam", f"{POINTS}, {_SOAM} SELECT sample_id, edge_id, round(soam, 4) AS soam FROM soam")
def w02(spark, d):
    return G.turning(_points(spark, d), PIX).select(*G.KEYS, F.round("soam", 4).alias("soam"))


@query("w03_smoothing", f"{POINTS}, {_LINE} SELECT sample_id, edge_id, CAST(pos AS INT) AS pos, {', '.join(f'{r(c)} AS {c}' for c in 'xyz')} FROM line")
def w03(spark, d):
    return G.smoothed(_points(spark, d), PIX).select(*G.KEYS, "pos", *(F.round(c, 6).alias(c) for c in "xyz"))


_UNIT = "greatest(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2) + pow(z1 - z0, 2)), 1e-5)"


@query(
    "w04_branch_metrics",
    f"""{POINTS}, {_BRANCHES} SELECT sample_id, edge_id, n_points, {r('length')} AS length, {r('diameter')} AS diameter, {r('chord')} AS chord, round(soam, 4) AS soam,
    round(soam / length, 4) AS soam_per_length, {r('chord / length')} AS clr, {r('1 - chord / length')} AS neg_clr, {r('(1 - chord / length) / chord')} AS c2l,
    {', '.join(f'{r(f"({c}1 - {c}0) / {_UNIT}")} AS d{c}' for c in 'xyz')} FROM br""",
)
def w04(spark, d):
    m = G.branch_metrics(_points(spark, d), PIX)
    return m.select(*G.KEYS, "n_points", *(F.round(c, 4 if "soam" in c else 6).alias(c) for c in m.columns if c not in ("sample_id", "edge_id", "n_points")))


@query("a11_metric_average", f"{POINTS}, {_BRANCHES} SELECT sample_id, 'clr' AS metric, {r('avg(chord / length)')} AS value FROM br GROUP BY sample_id")
def a11(spark, d):
    out = G.metric_aggregate(G.branch_metrics(_points(spark, d), PIX), "clr")
    return out.select("sample_id", "metric", F.round("value", 6).alias("value"))


@query("a11_metric_median", f"{POINTS}, {_BRANCHES} SELECT sample_id, 'length' AS metric, {r('median(length)')} AS value FROM br GROUP BY sample_id")
def a11b(spark, d):
    out = G.metric_aggregate(G.branch_metrics(_points(spark, d), PIX), "length", F.median)
    return out.select("sample_id", "metric", F.round("value", 6).alias("value"))


@query("w06_contiguous_prefix", f"{POINTS}, k AS (SELECT *, edge_id % 97 + 1 AS branch FROM fx_points), s AS (SELECT sample_id, branch, row_number() OVER (PARTITION BY sample_id ORDER BY branch) AS rn FROM (SELECT DISTINCT sample_id, branch FROM k)) SELECT k.sample_id, k.branch, count(*) AS n_points FROM k JOIN s USING (sample_id, branch) WHERE rn = branch GROUP BY ALL")
def w06(spark, d):
    p = _points(spark, d).withColumn("branch", F.col("edge_id") % 97 + 1)
    return G.contiguous_prefix(p, ["sample_id"], "branch").groupBy("sample_id", "branch").agg(F.count("*").alias("n_points"))


_SUB = "CASE WHEN n > 4 THEN least(pos // 2, CAST(floor((n - 5) / 2e0) AS BIGINT) + 1) ELSE 0 END"


@query("w09_subdivide", f"{POINTS}, c AS (SELECT *, count(*) OVER (PARTITION BY sample_id, edge_id) AS n FROM fx_points) SELECT sample_id, edge_id, pos, CAST({_SUB} AS INT) AS piece FROM c")
def w09(spark, d):
    return G.subdivide(_points(spark, d), 2).select(*G.KEYS, "pos", "piece")


@query("w12_consecutive_duplicates", f"{POINTS}, h AS (SELECT sample_id, edge_id, pos, x // 32 AS x, y // 32 AS y, z // 8 AS z FROM fx_points), l AS (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lag(z) OVER w AS lz FROM h WINDOW w AS ({_W})) SELECT sample_id, edge_id, pos, x, y, z FROM l WHERE lx IS NULL OR NOT (x = lx AND y = ly AND z = lz)")
def w12(spark, d):
    p = _points(spark, d).select(*G.KEYS, "pos", F.expr("int(x div 32)").alias("x"), F.expr("int(y div 32)").alias("y"), F.expr("int(z div 8)").alias("z"))
    return G.drop_consecutive_duplicates(p)


_CLOUD = "cl AS (SELECT sample_id, x, y, z, bool_or(e) AS branching FROM (SELECT *, pos = min(pos) OVER b OR pos = max(pos) OVER b AS e FROM fx_points WINDOW b AS (PARTITION BY sample_id, edge_id)) GROUP BY ALL)"


@query("u01_point_cloud", f"{POINTS}, {_CLOUD} SELECT sample_id, x, y, z, branching FROM cl")
def u01(spark, d):
    return G.point_cloud(_points(spark, d))


@query("u02_inner_points", f"{POINTS}, {_CLOUD} SELECT sample_id, x, y, z FROM cl WHERE NOT branching")
def u02(spark, d):
    return G.non_branching_points(_points(spark, d))


@query("j02_branches_of_point", f"{POINTS} SELECT DISTINCT sample_id, x, y, z, edge_id FROM fx_points WHERE (sample_id, x, y, z) IN (SELECT sample_id, x, y, z FROM fx_points WHERE pos = 0)")
def j02(spark, d):
    p = _points(spark, d)
    return G.branches_of_point(p, p.where("pos = 0"))


_PE = f"""pp AS (SELECT sample_id, (x * 64 + y) * 16 + z AS a, lead((x * 64 + y) * 16 + z) OVER w AS b FROM fx_points WINDOW w AS ({_W})),
pe AS (SELECT DISTINCT sample_id, least(a, b) AS p, greatest(a, b) AS q FROM pp WHERE b IS NOT NULL AND a <> b)"""


def _code(c):
    return ((F.col(f"{c}.x") * 64 + F.col(f"{c}.y")) * 16 + F.col(f"{c}.z")).alias(c)


@query("j13_point_edges", f"{POINTS}, {_PE} SELECT sample_id, p, q FROM pe")
def j13(spark, d):
    return G.point_edges(_points(spark, d)).select("sample_id", _code("p"), _code("q"))


# -- networks

_NET = """gh AS (SELECT *, row_number() OVER (PARTITION BY sample_id, mask_id, u, v ORDER BY edge_id) < count(*) OVER (PARTITION BY sample_id, mask_id, u, v) AS g FROM fx_edges),
ge AS (SELECT * FROM gh WHERE NOT g UNION ALL SELECT sample_id, mask_id, edge_id, u, -(edge_id + 1), length, diameter, soam, clr, g FROM gh WHERE g
       UNION ALL SELECT sample_id, mask_id, edge_id, -(edge_id + 1), v, length, diameter, soam, clr, g FROM gh WHERE g),
pr AS (SELECT sample_id, mask_id, least(u, v) AS u, greatest(u, v) AS v, count(*) AS n_branches, sum(length) AS length, sum(diameter) AS diameter, sum(soam) AS soam, sum(clr) AS clr
       FROM ge WHERE u <> v GROUP BY ALL),
sy AS (SELECT DISTINCT sample_id, mask_id, u AS a, v AS b FROM ge UNION SELECT DISTINCT sample_id, mask_id, v, u FROM ge),
cc(sample_id, mask_id, node, comp) AS (SELECT DISTINCT sample_id, mask_id, a, a FROM sy
       UNION SELECT s.sample_id, s.mask_id, s.b, cc.comp FROM cc JOIN sy s ON s.sample_id = cc.sample_id AND s.mask_id = cc.mask_id AND s.a = cc.node WHERE cc.comp < s.b),
nd AS (SELECT sample_id, mask_id, node, min(comp) AS component FROM cc GROUP BY ALL),
sz AS (SELECT sample_id, mask_id, component, count(*) AS n FROM nd GROUP BY ALL),
lg AS (SELECT * FROM sz QUALIFY row_number() OVER (PARTITION BY sample_id, mask_id ORDER BY n DESC, component) = 1),
lb AS (SELECT pr.*, component FROM pr JOIN nd ON nd.sample_id = pr.sample_id AND nd.mask_id = pr.mask_id AND node = u)"""


def _means(tag: str, table: str) -> str:
    return f"{tag} AS (SELECT sample_id, mask_id, count(*) AS e, " + ", ".join(f"avg(CASE WHEN {c} <> 0 THEN {c} END) AS {c}" for c in ("length", "diameter", "clr", "soam")) + f" FROM {table} GROUP BY ALL)"


_DESCRIPTORS = f"""{EDGES}, {_NET}, tp AS (SELECT lb.* FROM lb JOIN lg USING (sample_id, mask_id, component)), {_means('mf', 'lb')}, {_means('ml', 'tp')},
wn AS (SELECT sample_id, mask_id, sum(n) AS nodes, sum(CASE WHEN n > 1 THEN n END) AS linked, sum(CASE WHEN n > 1 THEN 1 END) AS comps FROM sz GROUP BY ALL)
SELECT wn.sample_id, wn.mask_id, {r('(1 - lg.n + ml.e) / ml.e', 8)} AS loops_per_edge_largest, {r('(comps - linked + mf.e) / mf.e', 8)} AS loops_per_edge_full,
  {r('1 / ml.e', 8)} AS comps_per_edge_largest, {r('comps / mf.e', 8)} AS comps_per_edge_full, lg.n AS nodes_largest, CAST(nodes AS BIGINT) AS nodes_full, ml.e AS edges_largest, mf.e AS edges_full,
  {r('mf.length', 8)} AS length_full, {r('ml.length', 8)} AS length_largest, {r('mf.diameter', 8)} AS diameter_full, {r('ml.diameter', 8)} AS diameter_largest,
  {r('mf.clr', 8)} AS clr_full, {r('ml.clr', 8)} AS clr_largest, {r('mf.soam / mf.length', 8)} AS soam_per_length_full, {r('ml.soam / mf.length', 8)} AS soam_per_length_largest
FROM wn JOIN mf USING (sample_id, mask_id) JOIN lg USING (sample_id, mask_id) JOIN ml USING (sample_id, mask_id)"""


@query("t07_descriptors", _DESCRIPTORS)
def t07(spark, d):
    out = T.descriptors(_edges(spark, d))
    return out.select(*(F.round(c, 8).alias(c) if t == "double" else c for c, t in out.dtypes))


@query("g01_components", f"{EDGES}, {_NET} SELECT sample_id, mask_id, node, component FROM nd WHERE node >= 0")
def g01(spark, d):
    return N.component_sizes(N.with_ghosts(_edges(spark, d)).select(*N.KEYS, "u", "v")).where("node >= 0")


@query("g09_ghost_nodes", f"{EDGES}, {_NET} SELECT sample_id, mask_id, edge_id, u, v, g AS ghost, {r('length')} AS length FROM ge")
def g09(spark, d):
    return N.with_ghosts(_edges(spark, d)).select(*N.KEYS, "edge_id", "u", "v", "ghost", F.round("length", 6).alias("length"))


@query("a07_pair_weights", f"{EDGES}, {_NET} SELECT sample_id, mask_id, u, v, n_branches, {r('length')} AS length, {r('diameter')} AS diameter, {r('soam')} AS soam, {r('clr')} AS clr FROM pr")
def a07(spark, d):
    p = N.pair_edges(N.with_ghosts(_edges(spark, d)))
    return p.select(*N.KEYS, "u", "v", "n_branches", *(F.round(c, 6).alias(c) for c in N.ATTRIBUTES))


@query("a06_largest_component", f"{EDGES}, {_NET} SELECT sample_id, mask_id, component, n AS n_nodes FROM lg")
def a06(spark, d):
    return N.largest_component(N.component_sizes(N.with_ghosts(_edges(spark, d)).select(*N.KEYS, "u", "v")))


@query("a03_nonzero_means", f"{EDGES}, {_NET} SELECT sample_id, mask_id, {', '.join(f'{r(f"avg(CASE WHEN {c} <> 0 THEN {c} END)")} AS {c}' for c in N.ATTRIBUTES)} FROM pr GROUP BY sample_id, mask_id")
def a03(spark, d):
    p = N.pair_edges(N.with_ghosts(_edges(spark, d)))
    return p.groupBy(*N.KEYS).agg(*(F.round(F.avg(F.when(F.col(c) != 0, F.col(c))), 6).alias(c) for c in N.ATTRIBUTES))


_STD = lambda c: r(f"sqrt(2 * (count(nullif({c}, 0)) - 1) * var_samp(nullif({c}, 0)) / (2 * count(nullif({c}, 0)) - 1))")


@query("a04_matrix_std", f"{EDGES}, {_NET} SELECT sample_id, mask_id, {', '.join(f'{_STD(c)} AS {c}' for c in N.ATTRIBUTES)} FROM pr GROUP BY sample_id, mask_id")
def a04(spark, d):
    p = N.pair_edges(N.with_ghosts(_edges(spark, d)))
    return p.groupBy(*N.KEYS).agg(*(F.round(T.matrix_std(c), 6).alias(c) for c in N.ATTRIBUTES))


@query("a05_network_counts", f"{EDGES}, {_NET} SELECT sample_id, mask_id, (SELECT count(*) FROM nd WHERE nd.sample_id = pr.sample_id AND nd.mask_id = pr.mask_id) AS n_nodes, count(*) AS n_edges, CAST(sum(n_branches) AS BIGINT) AS n_branches FROM pr GROUP BY sample_id, mask_id")
def a05(spark, d):
    e = N.with_ghosts(_edges(spark, d))
    return N.node_table(e).groupBy(*N.KEYS).agg(F.count("*").alias("n_nodes")).join(N.pair_edges(e).groupBy(*N.KEYS).agg(F.count("*").alias("n_edges"), F.sum("n_branches").alias("n_branches")), N.KEYS)


@query("a08_blood_volume", f"{EDGES} SELECT sample_id, mask_id, round(sum(pi() * pow(diameter / 2, 2) * length) * 1e-9, 12) AS volume FROM fx_edges GROUP BY ALL")
def a08(spark, d):
    return _edges(spark, d).groupBy(*N.KEYS).agg(F.round(F.sum(F.pi() * F.pow(F.col("diameter") / 2, F.lit(2)) * F.col("length")) * 1e-9, 12).alias("volume"))


@query("a09_ranges", f"{EDGES} SELECT sample_id, mask_id, {r('min(diameter)')} AS min_diameter, {r('max(diameter)')} AS max_diameter, {r('min(length)')} AS min_length, {r('max(length)')} AS max_length FROM fx_edges GROUP BY ALL")
def a09(spark, d):
    return _edges(spark, d).groupBy(*N.KEYS).agg(*(F.round(f(c), 6).alias(f"{n}_{c}") for c in ("diameter", "length") for n, f in (("min", F.min), ("max", F.max))))


@query("a22_component_extremes", f"{EDGES}, {_NET} SELECT sample_id, mask_id, max(n) AS largest, min(n) AS smallest, count(*) AS n_components FROM sz GROUP BY ALL")
def a22(spark, d):
    n = N.component_sizes(N.with_ghosts(_edges(spark, d)).select(*N.KEYS, "u", "v")).groupBy(*N.KEYS, "component").agg(F.count("*").alias("n"))
    return n.groupBy(*N.KEYS).agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), F.count("*").alias("n_components"))


@query("w11_matrix_offsets", f"{EDGES}, {_NET} SELECT sample_id, mask_id, component, n AS n_nodes, CAST(coalesce(sum(n) OVER (PARTITION BY sample_id, mask_id ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM sz")
def w11(spark, d):
    return N.matrix_offsets(N.component_sizes(N.with_ghosts(_edges(spark, d)).select(*N.KEYS, "u", "v")))


@query("x04_end_degrees", f"{EDGES} SELECT sample_id, mask_id, node, count(*) AS degree FROM (SELECT sample_id, mask_id, u AS node FROM fx_edges UNION ALL SELECT sample_id, mask_id, v FROM fx_edges) GROUP BY ALL")
def x04(spark, d):
    return N.degrees(_edges(spark, d))


_PRUNE = """pe AS (SELECT * FROM fx_edges WHERE u <> v), dg AS (SELECT sample_id, mask_id, node, count(*) AS k FROM (SELECT sample_id, mask_id, u AS node FROM pe UNION ALL SELECT sample_id, mask_id, v FROM pe) GROUP BY ALL),
nn AS (SELECT sample_id, mask_id, count(*) AS n FROM dg GROUP BY ALL)"""


@query("g07_prune_terminal", f"{EDGES}, {_PRUNE} SELECT pe.sample_id, pe.mask_id, edge_id, u, v FROM pe JOIN nn USING (sample_id, mask_id) JOIN dg a ON a.sample_id = pe.sample_id AND a.mask_id = pe.mask_id AND a.node = u JOIN dg b ON b.sample_id = pe.sample_id AND b.mask_id = pe.mask_id AND b.node = v WHERE NOT ((a.k = 1 OR b.k = 1) AND length < greatest(150e0, 2 * diameter) AND n > 2)")
def g07(spark, d):
    return N.prune_terminal(_edges(spark, d), 150.0).select(*N.KEYS, "edge_id", "u", "v")


_CHAIN = f"""{_PRUNE}, ee AS (SELECT sample_id, mask_id, edge_id, u AS node FROM pe UNION ALL SELECT sample_id, mask_id, edge_id, v FROM pe),
tt AS (SELECT ee.sample_id, ee.mask_id, min(edge_id) AS a, max(edge_id) AS b FROM ee JOIN dg USING (sample_id, mask_id, node) WHERE k = 2 GROUP BY ee.sample_id, ee.mask_id, node),
ts AS (SELECT * FROM tt UNION SELECT sample_id, mask_id, b, a FROM tt),
ch(sample_id, mask_id, edge_id, chain) AS (SELECT sample_id, mask_id, edge_id, edge_id FROM pe UNION SELECT ts.sample_id, ts.mask_id, ts.b, ch.chain FROM ch JOIN ts ON ts.sample_id = ch.sample_id AND ts.mask_id = ch.mask_id AND ts.a = ch.edge_id WHERE ch.chain < ts.b),
cm AS (SELECT sample_id, mask_id, edge_id, min(chain) AS chain FROM ch GROUP BY ALL)"""


@query("g06_merge_degree_two", f"{EDGES}, {_CHAIN} SELECT sample_id, mask_id, chain AS edge_id, {r('sum(length)')} AS length, {r('sum(soam)')} AS soam, {r('sum(diameter * length) / sum(length)')} AS diameter, count(*) AS n_merged FROM pe JOIN cm USING (sample_id, mask_id, edge_id) GROUP BY ALL")
def g06(spark, d):
    return N.merge_degree_two(_edges(spark, d)).select(*N.KEYS, "edge_id", *(F.round(c, 6).alias(c) for c in ("length", "soam", "diameter")), "n_merged")


@query("g12_induced_subgraph", f"{EDGES} SELECT sample_id, mask_id, edge_id FROM fx_edges WHERE u % 3 <> 0 AND v % 3 <> 0")
def g12(spark, d):
    e = _edges(spark, d)
    return N.induced_subgraph(e, N.node_table(e).where("node % 3 <> 0")).select(*N.KEYS, "edge_id")


@query("g18_single_component", f"{EDGES} SELECT sample_id, mask_id, edge_id, 1 AS component FROM fx_edges")
def g18(spark, d):
    return N.single_component(_edges(spark, d)).select(*N.KEYS, "edge_id", "component")


# -- tracked branches

_ENDS = f"""{POINTS}, e0 AS (SELECT sample_id, edge_id, min(pos) AS p0, max(pos) AS p1 FROM fx_points GROUP BY ALL),
en AS (SELECT sample_id, edge_id * 2 AS end_id, x, y, z FROM fx_points JOIN e0 USING (sample_id, edge_id) WHERE pos = p0 UNION ALL SELECT sample_id, edge_id * 2 + 1, x, y, z FROM fx_points JOIN e0 USING (sample_id, edge_id) WHERE pos = p1),
nr AS (SELECT a.sample_id, a.end_id AS u, b.end_id AS v FROM en a JOIN en b ON a.sample_id = b.sample_id AND a.end_id <> b.end_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) < 9),
rn(sample_id, end_id, node) AS (SELECT sample_id, end_id, end_id FROM en UNION SELECT nr.sample_id, nr.v, rn.node FROM rn JOIN nr ON nr.sample_id = rn.sample_id AND nr.u = rn.end_id WHERE rn.node < nr.v),
nn AS (SELECT sample_id, end_id, min(node) AS node FROM rn GROUP BY ALL)"""


def _branch_ends(spark, d):
    p = _points(spark, d).groupBy("sample_id", "edge_id").agg(F.min_by(F.struct(*"xyz"), "pos").alias("a"), F.max_by(F.struct(*"xyz"), "pos").alias("b"))
    e = F.array(*(F.struct((F.col("edge_id") * 2 + i).alias("end_id"), *(F.col(f"{s}.{c}").alias(c) for c in "xyz")) for i, s in enumerate("ab")))
    return p.select("sample_id", F.explode(e).alias("e")).select("sample_id", "e.*")


@query("g05_reuse_end_nodes", f"{_ENDS} SELECT sample_id, end_id, x, y, z, node FROM en JOIN nn USING (sample_id, end_id)")
def g05(spark, d):
    return R.reuse_end_nodes(_branch_ends(spark, d)).select("sample_id", "end_id", *"xyz", "node")


_PTS = f"""{POINTS}, br AS (SELECT DISTINCT sample_id, edge_id, edge_id * 2 AS u, edge_id * 2 + 1 AS v FROM fx_points), pl AS (SELECT sample_id, edge_id, 1e0 * (edge_id % 64) AS ux, 1e0 * (edge_id % 32) AS uy, 0e0 AS uz, 1e0 * (edge_id % 7) AS vx, 6e1 AS vy, 1e0 * (edge_id % 8) AS vz FROM br),
ip AS (SELECT *, row_number() OVER (PARTITION BY sample_id, edge_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY sample_id, edge_id) AS n FROM fx_points WHERE edge_id % 3 > 0),
hd AS (SELECT sample_id, edge_id, n, sqrt(pow(arg_min(x, pos) - ux, 2) + pow(arg_min(y, pos) - uy, 2) + pow(arg_min(z, pos) - uz, 2)) >= sqrt(pow(arg_max(x, pos) - ux, 2) + pow(arg_max(y, pos) - uy, 2) + pow(arg_max(z, pos) - uz, 2)) AS turn FROM ip JOIN pl USING (sample_id, edge_id) GROUP BY sample_id, edge_id, n, ux, uy, uz)"""


@query("g08_build_branches", f"{_PTS} SELECT sample_id, edge_id, CAST(CASE WHEN turn THEN ip.n - k + 1 ELSE k END AS INT) AS pos, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM ip JOIN hd USING (sample_id, edge_id) UNION ALL SELECT sample_id, edge_id, 0, ux, uy, uz FROM pl JOIN hd USING (sample_id, edge_id) UNION ALL SELECT sample_id, edge_id, CAST(n + 1 AS INT), vx, vy, vz FROM pl JOIN hd USING (sample_id, edge_id) UNION ALL SELECT sample_id, edge_id, CAST(i AS INT), {r('ux + (vx - ux) * (i / 9e0)')}, {r('uy + (vy - uy) * (i / 9e0)')}, {r('uz + (vz - uz) * (i / 9e0)')} FROM pl, range(10) t(i) WHERE edge_id % 3 = 0")
def g08(spark, d):
    p = _points(spark, d)
    b = p.select("sample_id", "edge_id").distinct().select("sample_id", "edge_id", (F.col("edge_id") * 2).alias("u"), (F.col("edge_id") * 2 + 1).alias("v"))
    k = F.col("edge_id")
    at = F.array(F.struct(F.col("u").alias("node_id"), (k % 64).alias("x"), (k % 32).alias("y"), F.lit(0).cast("long").alias("z")), F.struct(F.col("v").alias("node_id"), (k % 7).alias("x"), F.lit(60).cast("long").alias("y"), (k % 8).alias("z")))
    out = R.build_branches(b, p.where("edge_id % 3 > 0"), b.select("sample_id", F.explode(at).alias("n")).select("sample_id", "n.*"))
    return out.select("sample_id", "edge_id", "pos", *(F.round(c, 6).alias(c) for c in "xyz"))


_TOUCH = f"""{EDGES}, tk AS (SELECT *, u % 64 + edge_id % 5 AS x0, u % 32 AS y0, u % 8 AS z0, v % 64 + edge_id % 5 AS x1, v % 32 AS y1, v % 8 AS z1 FROM fx_edges),
te AS (SELECT sample_id, mask_id, edge_id, u AS node, v AS other, x0 AS x, y0 AS y, z0 AS z FROM tk UNION ALL SELECT sample_id, mask_id, edge_id, v, u, x1, y1, z1 FROM tk),
tj AS (SELECT sample_id, mask_id, node, min(edge_id) AS a, max(edge_id) AS b FROM te GROUP BY ALL HAVING count(*) = 2 AND min(edge_id) <> max(edge_id) AND min(other) <> max(other) AND bool_and(other <> node) AND sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) < 4),
ts AS (SELECT sample_id, mask_id, a, b FROM tj UNION SELECT sample_id, mask_id, b, a FROM tj),
th(sample_id, mask_id, edge_id, chain) AS (SELECT sample_id, mask_id, edge_id, edge_id FROM tk UNION SELECT ts.sample_id, ts.mask_id, ts.b, th.chain FROM th JOIN ts ON ts.sample_id = th.sample_id AND ts.mask_id = th.mask_id AND ts.a = th.edge_id WHERE th.chain < ts.b),
tm AS (SELECT sample_id, mask_id, edge_id, min(chain) AS chain FROM th GROUP BY ALL),
tt AS (SELECT sample_id, mask_id, chain, sum(length) AS length, sum(soam) AS soam, sum(diameter * length) / sum(length) AS diameter, count(*) AS n FROM tk JOIN tm USING (sample_id, mask_id, edge_id) GROUP BY ALL),
tz AS (SELECT te.sample_id, te.mask_id, chain, min(te.node) AS u, max(te.node) AS v, count(*) AS k FROM te JOIN tm USING (sample_id, mask_id, edge_id) ANTI JOIN tj USING (sample_id, mask_id, node) GROUP BY ALL)"""


def _tracked(spark, d):
    e, j = _edges(spark, d), F.col("edge_id") % 5
    return e.select("*", *((F.col(s) % m + (j if c == "x" else 0)).alias(f"{c}{i}") for i, s in enumerate("uv") for c, m in (("x", 64), ("y", 32), ("z", 8))))


@query("g06_merge_touching", f"{_TOUCH} SELECT sample_id, mask_id, chain AS edge_id, u, v, {r('length')} AS length, {r('soam')} AS soam, {r('diameter')} AS diameter FROM tt JOIN tz USING (sample_id, mask_id, chain) WHERE n > 1 AND k = 2")
def g06b(spark, d):
    e = _tracked(spark, d)
    out = R.merge_touching(e).join(e.select(*N.KEYS, "edge_id", F.col("length").alias("_l")), [*N.KEYS, "edge_id"]).where("abs(length - _l) > 1e-9")
    return out.select(*N.KEYS, "edge_id", "u", "v", *(F.round(c, 6).alias(c) for c in ("length", "soam", "diameter")))


@query("g07_three_rounds")
def g07b(spark, d):
    return R.merge_and_prune(_tracked(spark, d), 150.0)


@query("f16_append_points", f"{POINTS}, a AS (SELECT sample_id, edge_id, list({{'x': x, 'y': y, 'z': z}} ORDER BY pos) AS p FROM fx_points GROUP BY ALL), j AS (SELECT a.sample_id, a.edge_id, a.p AS a, b.p AS b FROM a JOIN a b ON a.sample_id = b.sample_id AND b.edge_id = a.edge_id + 1), d AS (SELECT *, [{', '.join(f'sqrt(pow({p}.x - {q}.x, 2) + pow({p}.y - {q}.y, 2) + pow({p}.z - {q}.z, 2))' for p, q in (('a[1]', 'b[1]'), ('a[-1]', 'b[1]'), ('a[1]', 'b[-1]'), ('a[-1]', 'b[-1]')))}] AS f FROM j), o AS (SELECT sample_id, edge_id, unnest(CASE list_position(f, list_min(f)) WHEN 1 THEN list_reverse(b) || a WHEN 2 THEN a || b WHEN 3 THEN b || a ELSE a || list_reverse(b) END) AS p, unnest(range(len(a) + len(b))) AS pos FROM d) SELECT sample_id, edge_id, CAST(pos AS INT) AS pos, p.x AS x, p.y AS y, p.z AS z FROM o")
def f16(spark, d):
    p = _points(spark, d).groupBy("sample_id", "edge_id").agg(F.array_sort(F.collect_list(F.struct("pos", *"xyz"))).alias("p"))
    p = p.withColumn("p", F.transform("p", lambda s: F.struct(*(s[c].alias(c) for c in "xyz"))))
    j = p.select("sample_id", "edge_id", F.col("p").alias("a")).join(p.select("sample_id", (F.col("edge_id") - 1).alias("edge_id"), F.col("p").alias("b")), ["sample_id", "edge_id"])
    return j.select("sample_id", "edge_id", F.posexplode(R.append_points(F.col("a"), F.col("b"))).alias("pos", "p")).select("sample_id", "edge_id", "pos", *(F.col(f"p.{c}").alias(c) for c in "xyz"))


@query("u04_compose", f"{EDGES} SELECT sample_id, mask_id, edge_id, u, v, {r('length')} AS length FROM fx_edges")
def u04(spark, d):
    e = _edges(spark, d)
    parts = [e.where(F.col("edge_id") % 2 == k).withColumn("component", F.lit(k)) for k in (0, 1)]
    return N.compose(parts[0].unionByName(parts[1])).select(*N.KEYS, "edge_id", "u", "v", F.round("length", 6).alias("length"))


_AT = lambda n: f"{n} % 64 AS x, {n} % 32 AS y, {n} % 8 AS z"


def _places(spark, d):
    return N.node_table(_edges(spark, d)).select("sample_id", F.col("node").alias("node_id"), *((F.col("node") % m).alias(c) for c, m in (("x", 64), ("y", 32), ("z", 8))))


@query("g09_ghost_points", f"{EDGES}, {_NET} SELECT sample_id, mask_id, -(edge_id + 1) AS node_id, {', '.join(r(f'(u % {m} + v % {m}) / 2e0 + 0.05e0 * sqrt(pow(u % 64 - v % 64, 2) + pow(u % 32 - v % 32, 2) + pow(u % 8 - v % 8, 2)) / sqrt(3e0)') + f' AS {c}' for c, m in (('x', 64), ('y', 32), ('z', 8)))} FROM gh WHERE g")
def g09b(spark, d):
    g = N.ghost_points(_edges(spark, d), _places(spark, d))
    return g.select(*N.KEYS, "node_id", *(F.round(c, 6).alias(c) for c in "xyz"))


@query("g11_collapsed_nodes", f"{EDGES} SELECT sample_id, least(u, v) AS node_id, CAST((u % 64 + v % 64) // 2 AS INT) AS x, CAST((u % 32 + v % 32) // 2 AS INT) AS y, CAST((u % 8 + v % 8) // 2 AS INT) AS z FROM fx_edges WHERE edge_id % 40 = 0")
def g11b(spark, d):
    return N.collapsed_nodes(_edges(spark, d).where("edge_id % 40 = 0"), _places(spark, d))


_RHO = [0.0, 50.0, 120.0, 200.0]
_BETTI = f"""{_NET}, re AS (SELECT pr.*, rho FROM pr, (SELECT unnest([{', '.join(f'{x}e0' for x in _RHO)}]) AS rho) WHERE length > rho),
rs AS (SELECT sample_id, mask_id, rho, u AS a, v AS b FROM re UNION SELECT sample_id, mask_id, rho, v, u FROM re),
rc(sample_id, mask_id, rho, node, comp) AS (SELECT DISTINCT sample_id, mask_id, rho, a, a FROM rs UNION SELECT s.sample_id, s.mask_id, s.rho, s.b, rc.comp FROM rc JOIN rs s ON s.sample_id = rc.sample_id AND s.mask_id = rc.mask_id AND s.rho = rc.rho AND s.a = rc.node WHERE rc.comp < s.b),
rn AS (SELECT sample_id, mask_id, rho, node, min(comp) AS c FROM rc GROUP BY ALL), rz AS (SELECT sample_id, mask_id, rho, c, count(*) AS n FROM rn GROUP BY ALL),
rp AS (SELECT sample_id, mask_id, rho, CAST(sum(n) AS BIGINT) AS n_nodes, count(*) AS b0, max(n) AS largest FROM rz GROUP BY ALL),
rq AS (SELECT sample_id, mask_id, rho, count(*) AS n_edges FROM re GROUP BY ALL)"""


@query("t01_betti_thresholds", f"{EDGES}, {_BETTI} SELECT sample_id, mask_id, rho, n_nodes, n_edges, b0, b0 - n_nodes + n_edges AS b1, largest FROM rp JOIN rq USING (sample_id, mask_id, rho)")
def t01(spark, d):
    return T.betti_over_thresholds(N.pair_edges(N.with_ghosts(_edges(spark, d))), _RHO)


@query("t02_betti_per_edge", f"{EDGES}, {_BETTI} SELECT sample_id, mask_id, {r('b0 / n_edges')} AS comps_per_edge, {r('(b0 - n_nodes + n_edges) / n_edges')} AS loops_per_edge FROM rp JOIN rq USING (sample_id, mask_id, rho) WHERE rho = 0")
def t02(spark, d):
    b = T.betti_over_thresholds(N.pair_edges(N.with_ghosts(_edges(spark, d))), [0.0])
    return b.select(*N.KEYS, F.round(F.col("b0") / F.col("n_edges"), 6).alias("comps_per_edge"), F.round(F.col("b1") / F.col("n_edges"), 6).alias("loops_per_edge"))


@query("s09_descriptor_pivot", f"{EDGES}, m AS (SELECT sample_id, mask_id || CAST(edge_id % 3 AS VARCHAR) AS mask_id, length FROM fx_edges), p AS (SELECT sample_id, dense_rank() OVER (ORDER BY mask_id) AS k, length FROM m) SELECT sample_id, {', '.join(f'{r(f"avg(CASE WHEN k = {k} THEN length END)", 4)} AS mask_{k}' for k in (1, 2, 3))} FROM p GROUP BY sample_id")
def s09(spark, d):
    from ..sources.tables import descriptor_pivot

    e = _edges(spark, d).withColumn("mask_id", F.concat("mask_id", (F.col("edge_id") % 3).cast("string")))
    wide = descriptor_pivot(e.groupBy(*N.KEYS).agg(F.avg("length").alias("length")), "length")
    return wide.select("sample_id", *(F.round(c, 4).alias(c) for c in wide.columns[1:]))


# -- filtrations and barcodes

_BINS = f"""{POINTS}, {_CLOUD}, ce AS (SELECT sample_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM cl GROUP BY ALL),
fa AS (SELECT cl.sample_id, (x * 64 + y) * 16 + z AS p, sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2)) AS d FROM cl JOIN ce USING (sample_id)),
vb AS (SELECT sample_id, p, d, CAST(greatest(251, ceil(d / ((max(d) OVER (PARTITION BY sample_id) + 1) / 500))) AS INT) AS bin FROM fa),
{_PE}, eb AS (SELECT pe.sample_id, pe.p, pe.q, greatest(a.bin, b.bin) AS bin FROM pe JOIN vb a ON a.sample_id = pe.sample_id AND a.p = pe.p JOIN vb b ON b.sample_id = pe.sample_id AND b.p = pe.q)"""


@query("t03_radial_vertices", f"{_BINS} SELECT sample_id, p, {r('d')} AS d, bin FROM vb")
def t03(spark, d):
    return T.radial_bins(_points(spark, d)).select("sample_id", _code("p"), F.round("d", 6).alias("d"), "bin")


@query("t03_radial_edges", f"{_BINS} SELECT sample_id, p, q, bin FROM eb")
def t03e(spark, d):
    return T.radial_filtration(_points(spark, d))[1].select("sample_id", _code("p"), _code("q"), "bin")


@query("t04_persistence")
def t04(spark, d):
    return T.persistence(_points(spark, d)).groupBy("sample_id", "dim", "birth", "death").agg(F.count("*").alias("n"))


@query("t05_betti_curves")
def t05(spark, d):
    return T.betti_curves(T.persistence(_points(spark, d)))


#: At every step, loops less components is edges less vertices that have entered: what the bars must add up to.
@query("t05_euler_curve", f"{_BINS}, ev AS (SELECT sample_id, bin, 1 AS k FROM vb UNION ALL SELECT sample_id, bin, -1 FROM eb), st AS (SELECT DISTINCT sample_id, unnest(range(1, 501)) AS step FROM vb) SELECT st.sample_id, CAST(step AS INT) AS step, CAST(coalesce(sum(k), 0) AS BIGINT) AS euler FROM st LEFT JOIN ev ON ev.sample_id = st.sample_id AND bin <= step GROUP BY ALL")
def t05e(spark, d):
    c = T.betti_curves(T.persistence(_points(spark, d)).withColumn("death", F.col("death") - 1))
    return c.groupBy("sample_id", "step").agg(F.sum(F.when(F.col("dim") == 0, F.col("betti")).otherwise(-F.col("betti"))).alias("euler"))


def _bars(spark, d):
    return fixture(spark, d, "fx_barcodes")


@query("t08_barcode_bounds", f"{BARS}, b AS (SELECT sample_id, dim, least(min(birth), min(death)) AS lo, greatest(max(birth), max(death)) AS hi, bool_or(death IS NULL) AS any_infinite FROM fx_barcodes GROUP BY ALL) SELECT sample_id, dim, {r('lo', 9)} AS lo, {r('hi', 9)} AS hi, {r('lo - (hi - lo) * 0.2e0', 9)} AS plot_lo, {r('hi + (hi - lo) * 0.2e0', 9)} AS plot_hi, any_infinite FROM b")
def t08(spark, d):
    b = T.barcode_bounds(_bars(spark, d))
    return b.select("sample_id", "dim", *(F.round(c, 9).alias(c) for c in ("lo", "hi", "plot_lo", "plot_hi")), "any_infinite")


_Q = lambda v, p: f"(list_sort(list({v}))[CAST(floor(greatest(1, least(count({v}), count({v}) * {p} + 0.5e0))) AS BIGINT)] * (1 - (greatest(1, least(count({v}), count({v}) * {p} + 0.5e0)) - floor(greatest(1, least(count({v}), count({v}) * {p} + 0.5e0))))) + coalesce(list_sort(list({v}))[CAST(floor(greatest(1, least(count({v}), count({v}) * {p} + 0.5e0))) AS BIGINT) + 1] * (greatest(1, least(count({v}), count({v}) * {p} + 0.5e0)) - floor(greatest(1, least(count({v}), count({v}) * {p} + 0.5e0)))), 0))"


@query("a18_quantiles", f"{EDGES} " + " UNION ALL ".join(f"SELECT sample_id, {p}e0 AS p, {r(_Q('length', f'{p}e0'), 8)} AS q FROM fx_edges GROUP BY sample_id" for p in (0.1, 0.25, 0.5, 0.9)))
def a18(spark, d):
    return T.quantiles(_edges(spark, d), ["sample_id"], "length", [0.1, 0.25, 0.5, 0.9]).select("sample_id", "p", F.round("q", 8).alias("q"))


def _void(death: str) -> str:
    return f"""{BARS}, tp AS (SELECT sample_id, max(dim) AS dim FROM fx_barcodes WHERE dim <= 2 GROUP BY ALL), vs AS (SELECT sample_id, dim, {death} - birth AS s FROM fx_barcodes JOIN tp USING (sample_id, dim) WHERE {death} IS NOT NULL)
SELECT sample_id, dim, count(*) AS n, {r('avg(s)')} AS mean, {r('stddev_samp(s)')} AS std, {r(_Q('s', '0.5e0'))} AS median, {r(_Q('s', '0.25e0'))} AS q25, {r(_Q('s', '0.75e0'))} AS q75 FROM vs GROUP BY ALL"""


def _void_query(spark, d, how):
    v = T.void_statistics(_bars(spark, d), how)
    return v.select("sample_id", "dim", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "median", "q25", "q75")))


@query("t06_void_statistics", _void("death"))
def t06(spark, d):
    return _void_query(spark, d, "exclude")


@query("t06_void_statistics_minus_one", _void("coalesce(death, -1e0)"))
def t06b(spark, d):
    return _void_query(spark, d, "minus_one")


@query("j03_node_index", f"{POINTS}, e AS (SELECT DISTINCT sample_id, x, y, z FROM fx_points p WHERE pos = 0 OR pos = (SELECT max(pos) FROM fx_points q WHERE q.sample_id = p.sample_id AND q.edge_id = p.edge_id)) SELECT sample_id, x, y, z, dense_rank() OVER (PARTITION BY sample_id ORDER BY x, y, z) AS node FROM e")
def j03(spark, d):
    from pyspark.sql.window import Window

    ends = G.point_cloud(_points(spark, d)).where("branching")
    return ends.select("sample_id", *"xyz", F.dense_rank().over(Window.partitionBy("sample_id").orderBy(*"xyz")).cast("long").alias("node"))


@query("a01_midrange_centre", f"{POINTS} SELECT sample_id, {', '.join(f'(max({c}) - min({c})) / 2e0 + min({c}) AS c{c}' for c in 'xyz')} FROM fx_points GROUP BY ALL")
def a01(spark, d):
    return _points(spark, d).groupBy("sample_id").agg(*(((F.max(c) - F.min(c)) / 2 + F.min(c)).alias(f"c{c}") for c in "xyz"))


@query("a02_centroid", f"{POINTS}, {_CLOUD} SELECT sample_id, {', '.join(f'{r(f"avg({c})")} AS c{c}' for c in 'xyz')} FROM cl GROUP BY ALL")
def a02(spark, d):
    return G.point_cloud(_points(spark, d)).groupBy("sample_id").agg(*(F.round(F.avg(c), 6).alias(f"c{c}") for c in "xyz"))


@query("a24_distinct_rows", f"{POINTS} SELECT DISTINCT sample_id, x, y, z FROM fx_points")
def a24(spark, d):
    return _points(spark, d).select("sample_id", *"xyz").distinct()


@query("l01_sorted_distances", f"{_BINS} SELECT sample_id, p, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY round(d, 6), p) AS INT) AS rank FROM vb")
def l01(spark, d):
    from pyspark.sql.window import Window

    v = T.radial_bins(_points(spark, d)).select("sample_id", _code("p"), F.round("d", 6).alias("d"))
    return v.select("sample_id", "p", F.row_number().over(Window.partitionBy("sample_id").orderBy("d", "p")).alias("rank"))


