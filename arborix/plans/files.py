"""Queries that write tables out in the formats of the domain and read them back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import new_path, written
from ..operators import reslice as R
from ..operators import tracks as K
from ..operators import voxels as V
from ..sources import tables as S
from ..sources.fixtures import DIMS, ctes, fixture
from .common import query, r

VOX, POINTS, BARS, EDGES = (ctes(n) for n in ("fx_voxels", "fx_points", "fx_barcodes", "fx_edges"))
NX, NY, NZ = DIMS
COLS = "image_id, x, y, z"
#: Branches are numbered in components of 30 branches.
_NUMBERED = "np AS (SELECT sample_id, CAST(edge_id % 150 // 30 + 1 AS INT) AS component, CAST(edge_id % 30 + 1 AS INT) AS branch, pos, x, y, z FROM fx_points)"


def _numbered(spark, d):
    k = F.col("edge_id")
    return fixture(spark, d, "fx_points").select("sample_id", "edge_id", (F.floor(k % 150 / 30) + 1).cast("int").alias("component"), (k % 30 + 1).cast("int").alias("branch"), "pos", *"xyz", "diameter")


def _exported(spark, d, **how):
    """The folder of the exported branches of all samples, and their branch table."""
    p = written(_numbered(spark, d), "numbered")
    key = ["sample_id", "component", "branch"]
    b = p.groupBy(*key).agg(F.first("edge_id").alias("edge_id"), F.avg("diameter").alias("diameter"), F.count("*").cast("double").alias("length"))
    b = b.select(*key, (F.col("edge_id") % 11).alias("u"), (F.col("edge_id") % 7).alias("v"), "diameter", "length", (F.col("length") / 8).alias("soam"), (1 / F.col("length")).alias("clr"))
    path = new_path(spark, "branches")
    S.export_branches(p, b, path, **how)
    return path, b


_PREFIX = f"""{_NUMBERED}, nb AS (SELECT DISTINCT sample_id, component, branch FROM np), bn AS (SELECT *, row_number() OVER (PARTITION BY sample_id, component ORDER BY branch) AS k FROM nb), bk AS (SELECT * FROM bn WHERE k = branch),
ck AS (SELECT sample_id, component, row_number() OVER (PARTITION BY sample_id ORDER BY component) AS k FROM (SELECT DISTINCT sample_id, component FROM bk))"""


@query("s05_branch_points", f"{POINTS}, {_PREFIX} SELECT sample_id, component, branch, CAST(np.pos AS INT) AS pos, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM np JOIN bk USING (sample_id, component, branch) JOIN ck USING (sample_id, component) WHERE ck.k = component")
def s05(spark, d):
    path, _ = _exported(spark, d, summary=False)
    return S.read_branch_points(spark, f"{path}/points")


@query("s21_summary_export", f"{POINTS}, {_NUMBERED} SELECT sample_id, component, branch, arg_min(x, pos) AS x1, arg_min(y, pos) AS y1, arg_min(z, pos) AS z1, arg_max(x, pos) AS x2, arg_max(y, pos) AS y2, arg_max(z, pos) AS z2, count(*)::DOUBLE AS length, {r('count(*) / 8e0')} AS soam FROM np GROUP BY ALL")
def s21(spark, d):
    path, _ = _exported(spark, d)
    t = spark.read.option("header", True).schema("sample_id string, component int, branch int, " + ", ".join(f"{c} {'int' if i < 6 else 'double'}" for i, c in enumerate(S.SUMMARY))).csv(f"{path}/summary")
    return t.select("sample_id", "component", "branch", *S.SUMMARY[:6], "length", F.round("soam", 6).alias("soam"))


@query("s21_adjacency_export", f"{POINTS}, k AS (SELECT DISTINCT sample_id, edge_id FROM fx_points) SELECT DISTINCT sample_id, CAST(edge_id % 150 // 30 + 1 AS INT) AS component, least(edge_id % 11, edge_id % 7) AS u, greatest(edge_id % 11, edge_id % 7) AS v FROM k WHERE edge_id % 11 <> edge_id % 7")
def s21b(spark, d):
    path, _ = _exported(spark, d, adjacency=True, first_branch=2)
    return spark.read.option("header", True).schema("sample_id string, component int, u long, v long").csv(f"{path}/adjacency")


@query("s21_scalar_exports", f"{POINTS}, {_NUMBERED}, b AS (SELECT np.sample_id, component, branch, avg(diameter) AS diameter, count(*)::DOUBLE AS length FROM np JOIN (SELECT sample_id, CAST(edge_id % 150 // 30 + 1 AS INT) AS component, CAST(edge_id % 30 + 1 AS INT) AS branch, pos, diameter FROM fx_points) q USING (sample_id, component, branch, pos) GROUP BY ALL), s AS (SELECT *, length / 8e0 AS soam, 1e0 / length AS clr FROM b) SELECT sample_id, component, branch + 1 AS branch, metric, round(value, 6) AS value FROM (SELECT sample_id, component, branch, 'diameter' AS metric, diameter AS value FROM s UNION ALL SELECT sample_id, component, branch, 'length', length FROM s UNION ALL SELECT sample_id, component, branch, 'soam', soam FROM s UNION ALL SELECT sample_id, component, branch, 'clr', clr FROM s)")
def s21c(spark, d):
    """The four scalar files, with branches numbered from 2."""
    path, _ = _exported(spark, d, first_branch=2, summary=False)
    return S.read_branch_scalars(spark, path).withColumn("value", F.round("value", 6))


@query("s19_replaced_output", f"{POINTS}, {_NUMBERED} SELECT sample_id, component, branch, count(*) AS n, sum(x)::BIGINT AS x FROM np WHERE branch % 3 = 1 AND sample_id < 'p' GROUP BY ALL")
def s19(spark, d):
    """A run into a folder that holds the output of an earlier one leaves nothing of that."""
    path = new_path(spark, "replaced")
    p = _numbered(spark, d)
    for run in (p, p.where("branch % 3 = 1 AND sample_id < 'p'")):
        S.write_points(run, path)
    return spark.read.schema(p.schema).parquet(path).groupBy("sample_id", "component", "branch").agg(F.count("*").alias("n"), F.sum("x").alias("x"))


@query("s01_discover_samples", f"{VOX} SELECT image_id AS sample_id, concat('m', z) AS mask_id, 1::BIGINT AS n_files FROM fx_voxels GROUP BY ALL")
def s01(spark, d):
    path = new_path(spark, "samples")
    v = fixture(spark, d, "fx_voxels").select("image_id", F.concat(F.lit("m"), "z").alias("mask"), F.concat_ws(" ", "x", "y", "value").alias("value"))
    v.repartition("image_id", "mask").write.partitionBy("image_id", "mask").text(f"{path}/raw")
    # the source's layout is root/sample/Skeletons/mask/file
    found = S.discover_samples(spark, f"{path}/raw", pattern=r"/image_id=([^/]+)/mask=([^/]+)/")
    return found.select("sample_id", "mask_id", "n_files")


@query("s02_volume_load", f"{VOX} SELECT {COLS}, value::DOUBLE AS value FROM fx_voxels")
def s02(spark, d):
    v = fixture(spark, d, "fx_voxels").select("image_id", *"xyz", F.lit(0).alias("t"), F.lit(0).alias("channel"), F.col("value").cast("double").alias("value"))
    path = new_path(spark, "volume")
    v.where("z < 3").write.parquet(f"{path}/a.parquet")
    v.where("z = 3").write.option("header", True).csv(f"{path}/b.csv")
    v.where("z > 3").write.orc(f"{path}/c.orc")
    parts = [S.read_voxels(spark, f"{path}/{n}") for n in ("a.parquet", "b.csv", "c.orc")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*V.KEYS, "value")


@query("s08_metric_file", f"{EDGES} SELECT edge_id, length, soam FROM fx_edges")
def s08(spark, d):
    path = new_path(spark, "metrics")
    S.write_metrics(fixture(spark, d, "fx_edges"), ["edge_id", "length", "soam"], path)
    return spark.read.option("header", True).schema("edge_id long, length double, soam double").csv(path)


@query("s12_diagram", f"{BARS} SELECT sample_id, dim, birth, death FROM fx_barcodes")
def s12(spark, d):
    path = new_path(spark, "diagram")
    S.write_diagram(fixture(spark, d, "fx_barcodes"), path)
    back = S.read_diagram(spark, path)
    return back.select(F.url_decode("sample_id").alias("sample_id"), "dim", "birth", "death")


_SWC = "sw AS (SELECT concat('f', o_orderkey % 3) AS file, o_orderkey // 3 AS id, 2 AS type, (o_orderkey % 64)::DOUBLE AS x, (o_custkey % 64)::DOUBLE AS y, (o_custkey % 8)::DOUBLE AS z, 1e0 AS radius, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey // 6 END AS parent FROM orders)"


def _swc(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = ((k % 64).cast("double").alias("x"), (c % 64).cast("double").alias("y"), (c % 8).cast("double").alias("z"))
    t = o.select(F.concat(F.lit("f"), k % 3).alias("file"), F.floor(k / 3).alias("id"), F.lit(2).alias("type"), *at, F.lit(1.0).alias("radius"), F.when(k % 5 == 0, -1).otherwise(F.floor(k / 6)).alias("parent"))
    path = new_path(spark, "swc")
    S.write_swc(t, path)
    return S.read_swc(spark, path)


@query("s14_swc", f"WITH {_SWC} SELECT * FROM sw")
def s14(spark, d):
    return _swc(spark, d)


@query("j09_parents_by_file", f"WITH {_SWC} SELECT DISTINCT s.file, {', '.join(f'CAST(least(greatest(trunc(s.{c} + (p.{c} - s.{c}) * (i / 9)), 0), {n - 1}) AS INT) AS {c}' for c, n in zip('xyz', DIMS))} FROM sw s JOIN sw p ON p.file = s.file AND p.id = s.parent, range(10) t(i) WHERE s.parent > -1")
def j09(spark, d):
    return V.swc_raster(_swc(spark, d), DIMS, 10, ["file"])


@query("s22_new_volume", f"SELECT 'new' AS image_id, {NX} AS nx, {NY} AS ny, {NZ} AS nz, 1e0 AS px, 0e0 AS ox, count(*) AS n_voxels FROM ({VOX} SELECT DISTINCT x, y, z FROM fx_voxels)")
def s22(spark, d):
    n = fixture(spark, d, "fx_voxels").select(*"xyz").distinct().agg(F.count("*").alias("n_voxels"))
    vol = S.make_volume(spark, "new", DIMS).crossJoin(n)  # one row each
    return vol.select("image_id", "nx", "ny", "nz", F.col("pix_dim")[0].alias("px"), F.col("origin")[0].alias("ox"), "n_voxels")


@query("p15_pad_and_back", f"{VOX} SELECT image_id, x + 1 AS xp, y + 1 AS yp, z + 1 AS zp, x, y, z, value FROM fx_voxels")
def p15(spark, d):
    p = K.pad_one(fixture(spark, d, "fx_voxels"))
    back = K.take_off_pad(p.withColumns({f"{c}p": F.col(c) for c in "xyz"}))
    return back.select("image_id", "xp", "yp", "zp", *"xyz", "value")


@query("v21_skeleton_raster", f"{POINTS} SELECT DISTINCT sample_id, CAST(floor((x * 20e0 + 3e0) / 20e0) AS INT) AS x, CAST(floor((y * 20e0 + 3e0) / 20e0) AS INT) AS y, CAST(floor((z * 20e0 + 3e0) / 20e0) AS INT) AS z FROM fx_points")
def v21(spark, d):
    p = fixture(spark, d, "fx_points").select("sample_id", *((F.col(c) * 20.0 + 3.0).alias(c) for c in "xyz"))
    return V.skeleton_raster(p, (20.0, 20.0, 20.0))


@query("a20_overlay", f"{VOX}, fg AS (SELECT {COLS} FROM fx_voxels WHERE value >= 200), o AS (SELECT a.i - 1 AS dx, b.i - 1 AS dy, c.i - 1 AS dz FROM range(3) a(i), range(3) b(i), range(3) c(i) WHERE NOT (a.i = 1 AND b.i = 1 AND c.i = 1)), nc AS (SELECT a.image_id, a.x, a.y, a.z, count(b.x) AS n FROM fg a CROSS JOIN o LEFT JOIN fg b ON b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL) SELECT image_id, x, y, count(*) AS value, max(CASE WHEN n > 1 THEN 2 WHEN n = 1 THEN 1 ELSE 0 END) AS class FROM nc GROUP BY ALL")
def a20(spark, d):
    return V.overlay(fixture(spark, d, "fx_voxels").where("value >= 200"))


#: What whitened columns must have: no covariance, and unit variance.
@query("a25_zca_whitening", "SELECT 0e0 AS mean_a, 0e0 AS mean_b, 1e0 AS var_a, 1e0 AS var_b, 0e0 AS cov, count(*) AS n FROM lineitem")
def a25(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1e4).alias("b"))
    w = R.zca_whiten(t, ["a", "b"], 0.0)
    stats = w.agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.var_pop("a").alias("var_a"), F.var_pop("b").alias("var_b"), F.covar_pop("a", "b").alias("cov"), F.count("*").alias("n"))
    return stats.select(*(F.abs(F.round(c, 5)).alias(c) for c in stats.columns[:5]), "n")


@query("v10_clean_up")
def v10(spark, d):
    return V.clean_up(fixture(spark, d, "fx_voxels"), DIMS, 127, 20)
