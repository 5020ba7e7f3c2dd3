"""Queries on skeleton graphs, geometric transforms and vesselness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as X
from ..operators import fronts as T
from ..operators import geometry as G
from ..operators import graph as N
from ..operators import reslice as R
from ..operators import skeleton as K
from ..operators import voxels as V
from ..sources import tables as S
from ..sources.fixtures import DIMS, ctes, fixture
from .common import label_sql, query

VOX, EDGES, PAIR = ctes("fx_voxels"), ctes("fx_edges"), ctes("fx_pair")
NX, NY, NZ = DIMS
COLS = "image_id, x, y, z"


def _fg(spark, d, level=127):
    return fixture(spark, d, "fx_voxels").where(F.col("value") >= level).select(*V.KEYS)


@query("v12_thinning")
def v12(spark, d):
    return K.thin(_fg(spark, d))


_GRAPH = f"""{VOX}, fv AS (SELECT image_id, x, y, z, (CAST(x AS BIGINT) * {NY} + y) * {NZ} + z AS id FROM fx_voxels WHERE value >= 127),
o AS (SELECT a.i - 1 AS dx, b.i - 1 AS dy, c.i - 1 AS dz FROM range(3) a(i), range(3) b(i), range(3) c(i)),
ge AS (SELECT a.image_id, least(a.id, b.id) AS u, greatest(a.id, b.id) AS v, CAST(dx * dx + dy * dy + dz * dz AS INT) AS l, dz = 0 AS f FROM fv a, o JOIN fv b ON b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE (dx, dy, dz) > (0, 0, 0)),
tr AS (SELECT p.image_id, p.u AS a, p.v AS b, q.v AS c, p.l AS ab, q.l AS bc, s.l AS ac, p.f AS fab, q.f AS fbc, s.f AS fac FROM ge p JOIN ge q ON q.image_id = p.image_id AND q.u = p.v JOIN ge s ON s.image_id = p.image_id AND s.u = p.u AND s.v = q.v),
gs AS (SELECT image_id, u AS n, v AS w FROM ge UNION ALL SELECT image_id, v, u FROM ge),
mx AS (SELECT * FROM tr WHERE NOT EXISTS (SELECT 1 FROM gs x JOIN gs y ON y.image_id = x.image_id AND y.w = x.w AND y.n = tr.b JOIN gs z ON z.image_id = x.image_id AND z.w = x.w AND z.n = tr.c WHERE x.image_id = tr.image_id AND x.n = tr.a)),
go AS (SELECT image_id, a AS u, b AS v FROM mx WHERE (greatest(ab, bc, ac) > least(ab, bc, ac) AND ab = greatest(ab, bc, ac)) OR (ab = bc AND bc = ac AND fab)
  UNION SELECT image_id, a, c FROM mx WHERE (greatest(ab, bc, ac) > least(ab, bc, ac) AND ac = greatest(ab, bc, ac)) OR (ab = bc AND bc = ac AND fac AND NOT fab)
  UNION SELECT image_id, b, c FROM mx WHERE (greatest(ab, bc, ac) > least(ab, bc, ac) AND bc = greatest(ab, bc, ac)) OR (ab = bc AND bc = ac AND fbc AND NOT fab AND NOT fac)),
cl AS (SELECT image_id, u, v, l FROM ge ANTI JOIN go USING (image_id, u, v))"""


@query("g02_voxel_graph", f"{_GRAPH} SELECT image_id, u, v, l AS length2 FROM cl")
def g02(spark, d):
    return K.voxel_graph(_fg(spark, d), DIMS).select("image_id", "u", "v", "length2")


@query("g03_prune_spurs")
def g03(spark, d):
    return K.prune_spurs(_fg(spark, d), DIMS)


@query("g04_branches")
def g04(spark, d):
    return K.branches(_fg(spark, d), DIMS)


@query("g04_graph_degrees", f"{_GRAPH} SELECT image_id, node, count(*) AS degree FROM (SELECT image_id, u AS node FROM cl UNION ALL SELECT image_id, v FROM cl) GROUP BY ALL")
def g04b(spark, d):
    return K.voxel_degrees(_fg(spark, d), DIMS)


#: Fronts by recursion over steps; branches, nodes and lengths by joins.
_TRACKED = f"""{_GRAPH}, nb AS MATERIALIZED (SELECT image_id, u, v FROM ge UNION ALL SELECT image_id, v, u FROM ge),
fi AS (SELECT image_id, id FROM fv),
{label_sql("fi", "nb")},
st AS MATERIALIZED (SELECT image_id, component, min(id) AS start FROM lb JOIN (SELECT image_id, u AS id FROM nb GROUP BY ALL HAVING count(*) = 1) USING (image_id, id) GROUP BY ALL),
fr(image_id, id, step) USING KEY (image_id, id) AS (SELECT image_id, start, 0 FROM st
  UNION SELECT nb.image_id, nb.v, min(fr.step + 1) FROM fr JOIN nb ON nb.image_id = fr.image_id AND nb.u = fr.id WHERE NOT EXISTS (SELECT 1 FROM recurring.fr r WHERE r.image_id = nb.image_id AND r.id = nb.v) GROUP BY ALL),
sp AS MATERIALIZED (SELECT * FROM fr),
pa AS MATERIALIZED (SELECT c.image_id, c.id, c.step, min(p.id) AS parent FROM sp c LEFT JOIN nb ON nb.image_id = c.image_id AND nb.v = c.id LEFT JOIN sp p ON p.image_id = nb.image_id AND p.id = nb.u AND p.step + 1 = c.step GROUP BY ALL),
op AS MATERIALIZED (SELECT image_id, parent AS id, count(*) AS opens FROM pa WHERE parent IS NOT NULL GROUP BY ALL),
br(image_id, branch, id, pos) AS (SELECT pa.image_id, pa.id, pa.id, 0 FROM pa LEFT JOIN op ON op.image_id = pa.image_id AND op.id = pa.parent WHERE coalesce(op.opens, 0) <> 1
  UNION ALL SELECT pa.image_id, br.branch, pa.id, br.pos + 1 FROM br JOIN pa ON pa.image_id = br.image_id AND pa.parent = br.id JOIN op ON op.image_id = pa.image_id AND op.id = pa.parent AND op.opens = 1),
bp AS MATERIALIZED (SELECT br.*, pa.step, pa.parent, coalesce(op.opens, 0) AS opens, x, y, z FROM br JOIN pa USING (image_id, id) LEFT JOIN op USING (image_id, id) JOIN fv USING (image_id, id)),
bs AS (SELECT a.image_id, a.branch, arg_min(a.parent, a.pos) FILTER (a.pos = 0) AS parent, min(a.step) AS step, arg_max(a.id, a.pos) AS last, arg_max(a.opens, a.pos) AS opens, count(*) AS n_points,
  coalesce(sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 0) AS length FROM bp a LEFT JOIN bp b ON b.image_id = a.image_id AND b.branch = a.branch AND b.pos + 1 = a.pos GROUP BY ALL),
bc AS MATERIALIZED (SELECT bs.*, lb.component, row_number() OVER (PARTITION BY bs.image_id, lb.component ORDER BY step, branch) AS k FROM bs JOIN lb ON lb.image_id = bs.image_id AND lb.id = bs.branch),
kp AS MATERIALIZED (SELECT * FROM bc WHERE opens > 0 OR n_points > 2 OR k <= 2),
en AS MATERIALIZED (SELECT DISTINCT image_id, component, id, x, y, z FROM (SELECT image_id, component, start AS id FROM st UNION SELECT image_id, component, last FROM kp) JOIN fv USING (image_id, id)),
np AS MATERIALIZED (SELECT a.image_id, a.id AS u, b.id AS v FROM en a JOIN en b ON b.image_id = a.image_id AND b.component = a.component AND b.id <> a.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < 9),
nn(image_id, id, node) USING KEY (image_id, id) AS (SELECT image_id, id, id FROM en
  UNION SELECT np.image_id, np.v, min(nn.node) FROM nn JOIN np ON np.image_id = nn.image_id AND np.u = nn.id JOIN recurring.nn r ON r.image_id = np.image_id AND r.id = np.v WHERE nn.node < r.node GROUP BY ALL),
no AS MATERIALIZED (SELECT * FROM nn)
SELECT kp.image_id, component, branch, a.node AS u, b.node AS v, n_points, round(length, 6) AS length FROM kp JOIN no a ON a.image_id = kp.image_id AND a.id = coalesce(parent, branch) JOIN no b ON b.image_id = kp.image_id AND b.id = last"""


@query("g04_tracked", _TRACKED)
def g04t(spark, d):
    """Fronts from each component's first end."""
    return T.track(_fg(spark, d), DIMS, min_points=2).withColumn("length", F.round("length", 6))


@query("g11_collapse_branches", f"{EDGES}, k AS (SELECT * FROM fx_edges WHERE edge_id % 40 = 0), s AS (SELECT sample_id, mask_id, u AS a, v AS b FROM k UNION SELECT sample_id, mask_id, v, u FROM k), cc(sample_id, mask_id, node, c) AS (SELECT DISTINCT sample_id, mask_id, a, a FROM s UNION SELECT s.sample_id, s.mask_id, s.b, cc.c FROM cc JOIN s ON s.sample_id = cc.sample_id AND s.mask_id = cc.mask_id AND s.a = cc.node WHERE cc.c < s.b), m AS (SELECT sample_id, mask_id, node, min(c) AS c FROM cc GROUP BY ALL) SELECT e.sample_id, e.mask_id, edge_id, coalesce(a.c, u) AS u, coalesce(b.c, v) AS v FROM fx_edges e LEFT JOIN m a ON a.sample_id = e.sample_id AND a.mask_id = e.mask_id AND a.node = u LEFT JOIN m b ON b.sample_id = e.sample_id AND b.mask_id = e.mask_id AND b.node = v WHERE edge_id % 40 <> 0")
def g11(spark, d):
    e = fixture(spark, d, "fx_edges")
    return N.collapse_branches(e, e.where("edge_id % 40 = 0")).select(*N.KEYS, "edge_id", "u", "v")


@query("g13_random_subsets")
def g13(spark, d):
    return N.random_connected_subset(fixture(spark, d, "fx_edges"), 5, 3)


@query("g15_connectivity_scores")
def g15(spark, d):
    e = fixture(spark, d, "fx_edges")
    same = N.node_table(e).where("node % 4 <> 0").select("sample_id", F.col("node").alias("node_a"), F.col("node").alias("node_b"))
    return X.connectivity_scores(e, e.where("edge_id % 20 <> 0"), same)


@query("g14_matched_paths")
def g14(spark, d):
    e = fixture(spark, d, "fx_edges")
    return X.matched_paths(e, N.node_table(e).where("node % 4 <> 0"))


@query("g17_topology_agreement")
def g17(spark, d):
    """A network against itself without every tenth branch."""
    e = fixture(spark, d, "fx_edges")
    same = N.node_table(e).select("sample_id", F.col("node").alias("node_a"), F.col("node").alias("node_b"))
    return X.topology_agreement(e, e.where("edge_id % 10 <> 0"), same).select("sample_id", "share")


@query("v19_line", f"{VOX} SELECT image_id, x + 2 AS x, y + 1 AS y, z, value::DOUBLE AS value FROM fx_voxels WHERE x + 2 < {NX} AND y + 1 < {NY}")
def v19c(spark, d):
    shift = [[1.0, 0.0, 0.0, 2.0], [0.0, 1.0, 0.0, 0.8], [0.0, 0.0, 1.0, 0.2]]
    out = R.affine_reslice(fixture(spark, d, "fx_voxels"), DIMS, shift, DIMS, "line", 0)
    return out.select(*V.KEYS, F.col("value").cast("double").alias("value"))


@query("s13_obj_export", f"{ctes('fx_edges')}, n AS (SELECT sample_id, node, row_number() OVER (PARTITION BY sample_id ORDER BY node) AS k FROM (SELECT sample_id, u AS node FROM fx_edges UNION SELECT sample_id, v FROM fx_edges)) SELECT sample_id, 0 AS part, k, concat('v ', node % 64, ' ', node % 32, ' ', node % 8) AS line FROM n UNION ALL SELECT e.sample_id, 1, edge_id, concat('l ', a.k, ' ', b.k) FROM fx_edges e JOIN n a ON a.sample_id = e.sample_id AND a.node = u JOIN n b ON b.sample_id = e.sample_id AND b.node = v")
def s13(spark, d):
    e = fixture(spark, d, "fx_edges")
    nodes = N.node_table(e).select("sample_id", F.col("node").alias("node_id"), *((F.col("node") % m).alias(c) for c, m in (("x", 64), ("y", 32), ("z", 8))))
    return S.obj_lines(nodes, e)


@query("v19_nearest_shift", f"{VOX} SELECT image_id, x + 2 AS x, y AS y, z, value FROM fx_voxels WHERE x + 2 < {NX}")
def v19(spark, d):
    shift = [[1.0, 0.0, 0.0, 2.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    return R.affine_reslice(fixture(spark, d, "fx_voxels"), DIMS, shift, DIMS, "nearest", 0)


@query("v19_trilinear_half", f"{VOX}, g AS (SELECT DISTINCT image_id, CAST(a.i AS INT) AS x, y, z FROM fx_voxels, range({NX - 1}) a(i)) SELECT g.image_id, g.x, g.y, g.z, (coalesce(a.value, 0) + coalesce(b.value, 0)) / 2e0 AS value FROM g LEFT JOIN fx_voxels a USING (image_id, x, y, z) LEFT JOIN fx_voxels b ON b.image_id = g.image_id AND b.x = g.x + 1 AND b.y = g.y AND b.z = g.z WHERE a.value IS NOT NULL OR b.value IS NOT NULL")
def v19b(spark, d):
    half = [[1.0, 0.0, 0.0, -0.5], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    out = R.affine_reslice(fixture(spark, d, "fx_voxels"), DIMS, half, DIMS, "linear", 0)
    return out.select(*V.KEYS, F.round("value", 6).alias("value"))


@query("v19_border", f"{VOX}, g AS (SELECT DISTINCT image_id, CAST(a.i AS INT) AS x, y, z FROM fx_voxels, range({NX}) a(i)), s AS (SELECT g.image_id, g.x, g.y, g.z, CASE WHEN g.x = 0 THEN a.value ELSE 0.96e0 * coalesce(a.value, 0) + 0.04e0 * coalesce(b.value, 0) END AS value, a.value IS NOT NULL OR b.value IS NOT NULL AS met FROM g LEFT JOIN fx_voxels a USING (image_id, x, y, z) LEFT JOIN fx_voxels b ON b.image_id = g.image_id AND b.x = g.x - 1 AND b.y = g.y AND b.z = g.z) SELECT image_id, x, y, z, round(value, 6) AS value FROM s WHERE met")
def v19d(spark, d):
    """Shifted by less than the tolerance: the first plane's places lie beyond the border and count as on it."""
    little = [[1.0, 0.0, 0.0, 0.04], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    return R.affine_reslice(fixture(spark, d, "fx_voxels"), DIMS, little, DIMS, "linear", 0).select(*V.KEYS, F.round("value", 6).alias("value"))


@query("v23_vesselness")
def v23(spark, d):
    return R.frangi(fixture(spark, d, "fx_voxels"), DIMS)


@query("v23_vesselness_by_slice")
def v23b(spark, d):
    return R.frangi(fixture(spark, d, "fx_voxels"), DIMS, three_d=False)


@query("v05_vessel_distance")
def v05(spark, d):
    return R.vessel_distance(_fg(spark, d), DIMS)


@query("v05_vessel_distance_in_space")
def v05b(spark, d):
    return R.vessel_distance(_fg(spark, d), DIMS, depth=(0.8, 0.8, 5.0))


@query("v18_tile_calibration", "SELECT c_custkey AS image_id, CAST(arg_min(f, (abs(c_custkey::DOUBLE / f - 4), f)) AS INT) AS tile FROM (SELECT c_custkey, unnest(range(1, c_custkey + 1)) AS f FROM customer) WHERE c_custkey % f = 0 GROUP BY c_custkey")
def v18(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey >= 1")
    return c.select(F.col("c_custkey").alias("image_id"), R.calibrated_tile(F.col("c_custkey"), 4.0).alias("tile"))


@query("m11_neighbour_weighted_bce")
def m11(spark, d):
    p = fixture(spark, d, "fx_pair")
    forms = [R.neighbour_weighted_bce(p, DIMS, f).withColumn("form", F.lit(f)) for f in ("planes", "space", "junctions")]
    return forms[0].unionByName(forms[1]).unionByName(forms[2])


@query("g19_extraction")
def g19(spark, d):
    return X.extract(_fg(spark, d), DIMS)


@query("m04_comparison_report")
def m04(spark, d):
    p = fixture(spark, d, "fx_points")
    v = fixture(spark, d, "fx_voxels").withColumnRenamed("image_id", "_i")
    sampled = p.withColumn("_i", F.concat(F.lit("A"), F.split_part("sample_id", F.lit("-"), F.lit(2)))).join(v, ["_i", *"xyz"], "left").select("sample_id", "edge_id", F.coalesce("value", F.lit(0)).alias("value"))
    centres = p.groupBy("sample_id", "edge_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    b = G.branch_metrics(p, (20.0, 20.0, 20.0)).join(centres, ["sample_id", "edge_id"])
    return X.comparison_report(b, ["length", "diameter", "soam"], (NX, NY), pixel=20.0, perfusion=sampled)


