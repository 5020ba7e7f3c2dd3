"""Queries on sparse volumes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import voxels as V
from ..sources import tables as S
from ..sources.fixtures import DIMS, ctes, fixture
from .common import label_sql, query, r

VOX = ctes("fx_voxels")
K = "image_id, x, y, z"
NX, NY, NZ = DIMS
_O26 = "o AS (SELECT a.i - 1 AS dx, b.i - 1 AS dy, c.i - 1 AS dz FROM range(3) a(i), range(3) b(i), range(3) c(i) WHERE NOT (a.i = 1 AND b.i = 1 AND c.i = 1))"
_FG = "fg AS (SELECT * FROM fx_voxels WHERE value >= 200)"


def _vox(spark, d):
    return fixture(spark, d, "fx_voxels")


def _fg(spark, d, level=200):
    return _vox(spark, d).where(F.col("value") >= level)


def _dbl(df, *cols, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if c in cols else c for c in df.columns))


@query("s03_tile_read", f"{VOX} SELECT image_id, x - 16 AS x, y - 8 AS y, z, value FROM fx_voxels WHERE x BETWEEN 16 AND 31 AND y BETWEEN 8 AND 23")
def s03(spark, d):
    return S.read_tile(_vox(spark, d), (16, 8), (16, 16))


@query("s03_slice_read", f"{VOX} SELECT * FROM fx_voxels WHERE z = 3")
def s03b(spark, d):
    return S.read_slice(_vox(spark, d), 3)


@query("s04_three_slices", f"{VOX} SELECT image_id, x, y, CAST(z - k AS INT) AS z, value, CAST(k AS INT) AS channel FROM fx_voxels, range(3) t(k) WHERE z - k BETWEEN 0 AND {NZ - 3}")
def s04(spark, d):
    out = S.three_slices(_vox(spark, d).withColumn("channel", F.lit(0)), NZ)
    return out.select("image_id", "x", "y", "z", "value", "channel")


@query("s06_summary_rows", f"{ctes('fx_summary10')} SELECT component, pos // 10 AS row, {', '.join(f'max(CASE WHEN pos % 10 = {i} THEN value END) AS {n}' for i, n in enumerate(S.SUMMARY))} FROM fx_summary10 GROUP BY ALL HAVING count(*) = 10")
def s06(spark, d):
    return S.summary_rows(fixture(spark, d, "fx_summary10"), ["component"])


@query("s07_network_summary", f"{ctes('fx_edges')} SELECT {r('diameter')} AS diameter, {r('length')} AS length FROM fx_edges")
def s07(spark, d):
    return _dbl(fixture(spark, d, "fx_edges").select("diameter", "length"), "diameter", "length")


@query("s10_barcode_export", f"{ctes('fx_barcodes')} SELECT sample_id, dim, birth AS start, coalesce(death, -1e0) AS \"end\" FROM fx_barcodes")
def s10(spark, d):
    return S.barcode_rows(fixture(spark, d, "fx_barcodes"))


@query("s11_off_export", f"{ctes('fx_points')}, p AS (SELECT DISTINCT sample_id, x, y, z FROM fx_points) SELECT sample_id, 2 AS part, printf('%f %f %f', x::DOUBLE, y::DOUBLE, z::DOUBLE) AS line FROM p UNION ALL SELECT DISTINCT sample_id, 0, 'OFF' FROM p UNION ALL SELECT sample_id, 1, printf('%d 0 0', count(*)) FROM p GROUP BY sample_id")
def s11(spark, d):
    return S.off_lines(fixture(spark, d, "fx_points").select("sample_id", "x", "y", "z").distinct())


@query("s16_frame_count", f"{VOX} SELECT image_id, count(DISTINCT z) AS n_frames FROM fx_voxels GROUP BY ALL")
def s16(spark, d):
    return S.frame_count(_vox(spark, d).withColumn("t", F.col("z")))


@query("s15_collapse_series", f"{VOX} SELECT x, y, z, value, CAST(dense_rank() OVER (ORDER BY image_id) - 1 AS INT) AS t FROM fx_voxels")
def s15(spark, d):
    return S.collapse_series(_vox(spark, d).withColumnRenamed("image_id", "file")).select("x", "y", "z", "value", "t")


@query("s17_load_cases", f"{VOX} SELECT a.image_id, a.x, a.y, a.z, a.value, CAST(coalesce(CASE WHEN a.value >= 127 THEN a.value END, 0) AS INT) AS mask FROM fx_voxels a WHERE substr(image_id, 1, 1) IN ('A', 'R')")
def s17(spark, d):
    v = _vox(spark, d)
    return S.load_cases(v, V.binarise(v).select("image_id", "x", "y", "z", F.lit(0).alias("value")).join(v.select("image_id", "x", "y", "z", F.col("value").alias("v")), V.KEYS).select(*V.KEYS, F.col("v").alias("value")), v.where("substr(image_id, 1, 1) IN ('A', 'R')").select("image_id").distinct()).select(*V.KEYS, "value", "mask")


_T = "SELECT image_id, x + 4 AS x, y, z + 1 AS z, value FROM fx_voxels WHERE z < 3"


@query("s20_put_tile_replace", f"{VOX}, t AS ({_T}) SELECT {K}, value FROM fx_voxels v WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.image_id = v.image_id AND t.x = v.x AND t.y = v.y AND t.z = v.z) UNION ALL SELECT {K}, value FROM t")
def s20(spark, d):
    v = _vox(spark, d)
    return S.put_tile(v, v.where("z < 3"), (4, 0, 1))


@query("s20_put_tile_add", f"{VOX}, t AS ({_T}) SELECT {K}, CAST(sum(value) AS BIGINT) AS value FROM (SELECT {K}, value FROM fx_voxels UNION ALL SELECT {K}, value FROM t) GROUP BY ALL")
def s20b(spark, d):
    v = _vox(spark, d)
    return S.put_tile(v, v.where("z < 3"), (4, 0, 1), "add")


@query("s20_append_slice", f"{VOX} SELECT {K}, value FROM fx_voxels UNION ALL SELECT image_id, x, y, (SELECT max(z) FROM fx_voxels m WHERE m.image_id = f.image_id) + 1, value FROM fx_voxels f WHERE z = 1")
def s20c(spark, d):
    v = _vox(spark, d)
    return S.append_slice(v, v.where("z = 1"))


@query("u05_concatenate", f"{VOX} SELECT * FROM fx_voxels UNION ALL SELECT image_id || '2', x, y, z, value FROM fx_voxels")
def u05(spark, d):
    v = _vox(spark, d)
    return v.unionByName(v.withColumn("image_id", F.concat("image_id", F.lit("2"))))


# -- projections

@query("p01_binarise", f"{VOX} SELECT {K}, 255 AS value FROM fx_voxels WHERE value >= 127")
def p01(spark, d):
    return V.binarise(_vox(spark, d)).select(*V.KEYS, "value")


@query("p02_threshold", f"{VOX} SELECT * FROM fx_voxels WHERE value > 200")
def p02(spark, d):
    return V.above(_vox(spark, d), 200)


@query("p03_eight_bit", f"{ctes('fx_pair')} SELECT {K}, CAST(least(255, round(abs(255 * pred))) AS INT) AS value FROM fx_pair")
def p03(spark, d):
    return fixture(spark, d, "fx_pair").select(*V.KEYS, V.to_eight_bit(F.col("pred")).alias("value"))


@query("p04_header_scale", f"{VOX} SELECT {K}, CASE substr(image_id, 1, 1) WHEN 'A' THEN 2e0 * value + 1e0 ELSE value END AS value FROM fx_voxels")
def p04(spark, d):
    v = _vox(spark, d)
    vol = v.select("image_id").distinct().select("image_id", F.when(F.col("image_id").startswith("A"), 2.0).when(F.col("image_id").startswith("N"), 1.0).otherwise(0.0).alias("slope"), F.when(F.col("image_id").startswith("N"), 0.0).otherwise(1.0).alias("inter"))
    return V.header_scale(v, vol).select(*V.KEYS, F.col("value").cast("double").alias("value"))


@query("p05_normalise", f"{VOX} SELECT {K}, {r('value / 255')} AS scaled, CASE WHEN value / 255 >= 0.5 THEN 1e0 ELSE 0e0 END AS binary, {r('(value - 127.5e0) / 127.5e0')} AS tanh FROM fx_voxels")
def p05(spark, d):
    v = F.col("value")
    return _vox(spark, d).select(*V.KEYS, F.round(V.normalise(v), 6).alias("scaled"), V.normalise(v, "binarize").alias("binary"), F.round(V.normalise(v, "tanh"), 6).alias("tanh"))


@query("p07_flip", f"{VOX} SELECT image_id, {NX - 1} - x AS x, y, z, value FROM fx_voxels")
def p07(spark, d):
    return V.flip(_vox(spark, d), "x", NX)


@query("p08_coronal_view", f"{VOX} SELECT image_id, y AS x, z AS y, {NX - 1} - x AS z, value FROM fx_voxels")
def p08(spark, d):
    return V.to_view(_vox(spark, d), DIMS, "coronal")


@query("p09_reorient", f"{VOX} SELECT image_id, {NY - 1} - y AS x, x AS y, {NZ - 1} - z AS z, value FROM fx_voxels")
def p09(spark, d):
    v = _vox(spark, d)
    vol = v.select("image_id").distinct().select("image_id", F.array(*map(F.lit, (1, 0, 2))).alias("axes"), F.array(F.lit(True), F.lit(False), F.lit(True)).alias("flips"), *(F.lit(n).alias(c) for n, c in zip(DIMS, ("nx", "ny", "nz"))))
    return V.reorient(v, vol)


@query("p10_clip", f"{VOX} SELECT image_id, x - 4 AS x, y - 2 AS y, z - 1 AS z, value FROM fx_voxels WHERE x BETWEEN 4 AND {NX - 9} AND y BETWEEN 2 AND {NY - 3} AND z BETWEEN 1 AND {NZ - 2}")
def p10(spark, d):
    return V.clip_sides(_vox(spark, d), DIMS, (4, 2, 1), (8, 2, 1))


@query("p11_pad", f"{VOX}, g AS (SELECT DISTINCT image_id, CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z FROM (SELECT DISTINCT image_id FROM fx_voxels), range({NX + 2}) a(i), range({NY + 2}) b(i), range({NZ + 1}) c(i)) SELECT image_id, x + 1 AS x, y + 1 AS y, z AS z, value FROM fx_voxels UNION ALL SELECT *, 7 FROM g WHERE NOT (x BETWEEN 1 AND {NX} AND y BETWEEN 1 AND {NY} AND z BETWEEN 0 AND {NZ - 1})")
def p11(spark, d):
    return V.pad_sides(_vox(spark, d), DIMS, (1, 1, 0), (1, 1, 1), 7)


@query("p12_decimate", f"{VOX} SELECT image_id, x // 2 AS x, y // 2 AS y, z, value FROM fx_voxels WHERE x % 2 = 0 AND y % 2 = 0")
def p12(spark, d):
    return V.decimate(_vox(spark, d))


@query("p13_channels", f"{VOX} SELECT {K}, value, CASE WHEN value % 3 = 2 THEN 0 ELSE 1 END AS channel FROM fx_voxels WHERE value % 3 IN (2, 0)")
def p13(spark, d):
    return V.pick_channels(_vox(spark, d).withColumn("channel", F.col("value") % 3), [2, 0])


@query("p14_frames", f"{VOX} SELECT {K}, value, z % 4 AS t FROM fx_voxels WHERE z % 4 IN (1, 3)")
def p14(spark, d):
    return V.pick_frames(_vox(spark, d).withColumn("t", F.col("z") % 4), [1, 3], 4)


@query("p16_crop", f"{VOX} SELECT * FROM fx_voxels WHERE x < 16 AND y < 16 AND z >= 2 AND z < 5")
def p16(spark, d):
    return V.crop(_vox(spark, d), (0, 0, 2), (16, 16, 5))


@query("p17_exceedance", f"{VOX} SELECT {K}, CASE WHEN value > 100 THEN 1 ELSE 0 END AS over FROM fx_voxels")
def p17(spark, d):
    return _vox(spark, d).select(*V.KEYS, V.exceeds(F.col("value"), 100).alias("over"))


@query("f02_linear_index", f"{VOX} SELECT {K}, (CAST(x AS BIGINT) * {NY} + y) * {NZ} + z AS idx FROM fx_voxels")
def f02(spark, d):
    return _vox(spark, d).select(*V.KEYS, V.voxel_id(DIMS).alias("idx"))


# -- neighbourhoods

@query("j01_adjacency", f"{VOX}, {_FG}, {_O26} SELECT a.image_id, a.x, a.y, a.z, b.x AS x2, b.y AS y2, b.z AS z2 FROM fg a, o JOIN fg b ON b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE (dx, dy, dz) > (0, 0, 0)")
def j01(spark, d):
    return V.adjacency(_fg(spark, d)).select(*V.KEYS, *(F.col(f"{c}2").cast("int").alias(f"{c}2") for c in "xyz"))


_COUNT = f"nc AS (SELECT a.image_id, a.x, a.y, a.z, count(b.x) AS n FROM fg a CROSS JOIN o LEFT JOIN fg b ON b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL)"


@query("v11_neighbour_counts", f"{VOX}, {_FG}, {_O26}, {_COUNT} SELECT {K}, n FROM nc")
def v11(spark, d):
    return V.neighbour_counts(_fg(spark, d)).select(*V.KEYS, "n")


@query("v11_endpoints", f"{VOX}, {_FG}, {_O26}, {_COUNT} SELECT {K} FROM nc WHERE n = 1")
def v11b(spark, d):
    return V.endpoints(_fg(spark, d))


_LABEL = f"""{VOX}, fm AS MATERIALIZED (SELECT image_id, x, y, z, (CAST(x AS BIGINT) * {NY} + y) * {NZ} + z AS id FROM fx_voxels WHERE value >= 127), {_O26},
ad AS MATERIALIZED (SELECT a.image_id, a.id AS u, b.id AS v FROM (SELECT *, x + dx AS x2, y + dy AS y2, z + dz AS z2 FROM fm, o) a JOIN fm b ON b.image_id = a.image_id AND b.x = a.x2 AND b.y = a.y2 AND b.z = a.z2),
{label_sql('fm', 'ad')}"""


@query("v06_label", f"{_LABEL} SELECT image_id, x, y, z, component FROM fm JOIN lb USING (image_id, id)")
def v06(spark, d):
    return V.label(_fg(spark, d, 127).select(*V.KEYS), DIMS)


@query("v07_small_objects", f"{_LABEL}, n AS (SELECT image_id, component FROM lb GROUP BY ALL HAVING count(*) >= 3) SELECT image_id, x, y, z FROM fm JOIN lb USING (image_id, id) JOIN n USING (image_id, component)")
def v07(spark, d):
    return V.remove_small_objects(_fg(spark, d, 127).select(*V.KEYS), DIMS, 3)


_GRID = f"gr AS (SELECT DISTINCT image_id, CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z FROM (SELECT DISTINCT image_id FROM fx_voxels), range({NX}) a(i), range({NY}) b(i), range({NZ}) c(i))"


def fill_sql(size: int, planar: bool) -> str:
    """Voxels of 60 or more and background components of under `size` voxels; planes by themselves or in space."""
    steps = ("(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)" if planar else "(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)")
    return f"""{VOX}, {_GRID}, ft AS (SELECT {K} FROM fx_voxels WHERE value >= 60), bg AS MATERIALIZED (SELECT *, (CAST(x AS BIGINT) * {NY} + y) * {NZ} + z AS id FROM (SELECT * FROM gr EXCEPT SELECT {K} FROM ft)),
    ad AS MATERIALIZED (SELECT a.image_id, a.id AS u, b.id AS v FROM (SELECT *, x + dx AS x2, y + dy AS y2, z + dz AS z2 FROM bg, (VALUES {steps}) o(dx, dy, dz)) a JOIN bg b ON b.image_id = a.image_id AND b.x = a.x2 AND b.y = a.y2 AND b.z = a.z2),
    {label_sql('bg', 'ad')}, sm AS (SELECT image_id, component FROM lb GROUP BY ALL HAVING count(*) < {size})
    SELECT {K} FROM ft UNION ALL SELECT image_id, x, y, z FROM bg JOIN lb USING (image_id, id) JOIN sm USING (image_id, component)"""


@query("v08_fill_holes", fill_sql(500, True))
def v08(spark, d):
    return V.fill_holes(_fg(spark, d, 60), DIMS, 500, planar=True)


@query("v08_fill_holes_in_space", fill_sql(500, False))
def v08b(spark, d):
    return V.fill_holes(_fg(spark, d, 60), DIMS, 500)


_BOX = lambda rx, ry, rz: f"(SELECT a.i - {rx} AS dx, b.i - {ry} AS dy, c.i - {rz} AS dz FROM range({2 * rx + 1}) a(i), range({2 * ry + 1}) b(i), range({2 * rz + 1}) c(i))"
_IN = f"x BETWEEN 0 AND {NX - 1} AND y BETWEEN 0 AND {NY - 1} AND z BETWEEN 0 AND {NZ - 1}"


@query("v09_closing", f"{VOX}, {_FG}, dl AS (SELECT DISTINCT image_id, CAST(x + dx AS INT) AS x, CAST(y + dy AS INT) AS y, CAST(z + dz AS INT) AS z FROM fg, {_BOX(1, 1, 1)} WHERE x + dx BETWEEN 0 AND {NX - 1} AND y + dy BETWEEN 0 AND {NY - 1} AND z + dz BETWEEN 0 AND {NZ - 1}) SELECT {K} FROM (SELECT image_id, CAST(x + dx AS INT) AS x, CAST(y + dy AS INT) AS y, CAST(z + dz AS INT) AS z, count(*) AS n FROM dl, {_BOX(1, 1, 1)} GROUP BY ALL) WHERE {_IN} AND n = (3 - (x = 0)::INT - (x = {NX - 1})::INT) * (3 - (y = 0)::INT - (y = {NY - 1})::INT) * (3 - (z = 0)::INT - (z = {NZ - 1})::INT)")
def v09(spark, d):
    return V.closing(_fg(spark, d), DIMS)


@query("v03_maximum_filter", f"{VOX}, m AS (SELECT image_id, CAST(x + dx AS INT) AS x, CAST(y + dy AS INT) AS y, CAST(z + dz AS INT) AS z, max(value) AS value FROM fx_voxels, {_BOX(2, 2, 1)} GROUP BY ALL) SELECT * FROM m WHERE {_IN}")
def v03(spark, d):
    return V.maximum_filter(_vox(spark, d), DIMS)


@query("v02_median_filter", f"{VOX}, {_GRID}, gv AS (SELECT gr.*, coalesce(value, 0) AS value FROM gr LEFT JOIN fx_voxels USING (image_id, x, y, z)), sp AS (SELECT image_id, x, y, z, CASE WHEN x + dx < 0 THEN -(x + dx) - 1 WHEN x + dx >= {NX} THEN {2 * NX - 1} - (x + dx) ELSE x + dx END AS sx, CASE WHEN y + dy < 0 THEN -(y + dy) - 1 WHEN y + dy >= {NY} THEN {2 * NY - 1} - (y + dy) ELSE y + dy END AS sy FROM gr, {_BOX(1, 1, 0)}), md AS (SELECT sp.image_id, sp.x, sp.y, sp.z, list_sort(list(gv.value))[5] AS value FROM sp JOIN gv ON gv.image_id = sp.image_id AND gv.x = sx AND gv.y = sy AND gv.z = sp.z GROUP BY ALL) SELECT * FROM md WHERE value <> 0")
def v02(spark, d):
    return V.median_filter(_vox(spark, d), DIMS)


_GK = V.gaussian_weights(1.0)
_PASS = lambda src, c, n: f"(SELECT {', '.join(k if k != c else f'g.{c}' for k in ('image_id', 'x', 'y', 'z'))}, sum(w * value) AS value FROM (SELECT CAST(i AS INT) AS {c}, k, w FROM range({n}) r(i), kw) g JOIN {src} s ON s.{c} = least({n - 1}, greatest(0, g.{c} + k)) GROUP BY ALL)"


@query("v01_gaussian_smooth", f"{VOX}, kw AS (SELECT unnest({list(range(-4, 5))}) AS k, unnest([{', '.join(f'{g!r}::DOUBLE' for g in _GK)}]) AS w), gx AS {_PASS('fx_voxels', 'x', NX).replace('image_id, g.x, y, z', 's.image_id, g.x, s.y, s.z')}, gy AS {_PASS('gx', 'y', NY).replace('image_id, x, g.y, z', 's.image_id, s.x, g.y, s.z')} SELECT image_id, x, y, z, round(value, 4) AS value FROM gy")
def v01(spark, d):
    return _dbl(V.gaussian_smooth(_vox(spark, d), DIMS, 1.0, three_d=False), "value", digits=4)


_EDT = f"{VOX}, {_GRID}, ft AS (SELECT {K} FROM fx_voxels WHERE value >= 100), bg AS (SELECT * FROM gr EXCEPT SELECT {K} FROM ft), di AS (SELECT f.image_id, f.x, f.y, f.z, sqrt(min(pow((f.x - b.x) * 2e0, 2) + pow((f.y - b.y) * 3e0, 2))) AS dist FROM ft f JOIN bg b ON b.image_id = f.image_id AND b.z = f.z AND b.x BETWEEN f.x - 12 AND f.x + 12 AND b.y BETWEEN f.y - 12 AND f.y + 12 GROUP BY ALL)"


@query("v04_plane_distance", f"{_EDT} SELECT {K}, {r('dist')} AS dist FROM di")
def v04(spark, d):
    return _dbl(V.plane_distance(_fg(spark, d, 100), DIMS, (2.0, 3.0)), "dist")


@query("v13_outline", f"{VOX}, q AS (SELECT image_id, x, y, z, value // 64 AS value FROM fx_voxels) SELECT a.image_id, a.x, a.y, a.z, a.value FROM q a CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy) LEFT JOIN q b ON b.image_id = a.image_id AND b.z = a.z AND b.x = a.x + dx AND b.y = a.y + dy AND b.value = a.value GROUP BY ALL HAVING count(b.value) < 4")
def v13(spark, d):
    return V.outline(_vox(spark, d).withColumn("value", F.expr("int(value div 64)")))


_IMG = f"v AS (SELECT DISTINCT image_id FROM fx_voxels)"


@query("v14_tile_grid", f"{VOX}, {_IMG} SELECT image_id, concat(a.i * 16, '_', b.i * 32) AS tile_id, CAST(a.i * 16 AS INT) AS ox, CAST(b.i * 32 AS INT) AS oy FROM v, range(4) a(i), range(2) b(i)")
def v14(spark, d):
    vol = _vox(spark, d).select("image_id").distinct().select("image_id", F.lit(NX).alias("nx"), F.lit(NY).alias("ny"))
    return V.tile_grid(vol, (16, 32))


_TILES = f"{VOX}, tl AS (SELECT image_id, CAST(a.i * 16 AS INT) AS ox, CAST(b.i * 16 AS INT) AS oy, x - CAST(a.i * 16 AS INT) AS tx, y - CAST(b.i * 16 AS INT) AS ty, z, value FROM fx_voxels, range(3) a(i), range(3) b(i) WHERE x BETWEEN a.i * 16 AND a.i * 16 + 31 AND y BETWEEN b.i * 16 AND b.i * 16 + 31)"


def _tiles(spark, d):
    return V.strided_tiles(_vox(spark, d), DIMS, (32, 32), (16, 16))


@query("v15_strided_tiles", f"{_TILES} SELECT * FROM tl")
def v15(spark, d):
    return _tiles(spark, d)


@query("v16_reassemble", f"{_TILES} SELECT image_id, ox + tx AS x, oy + ty AS y, z, avg(value) AS value FROM tl GROUP BY ALL")
def v16(spark, d):
    return V.reassemble(_tiles(spark, d))


@query("v17_tiles_with_content", f"{_TILES} SELECT image_id, ox, oy FROM tl GROUP BY ALL HAVING count(CASE WHEN value / 255 > 0.8 THEN 1 END) > least(0.2 * 1024, 1000)")
def v17(spark, d):
    return V.tiles_with_content(_tiles(spark, d).withColumn("value", F.col("value") / 255), 32 * 32, 0.2)


_LINES = "l AS (SELECT l_orderkey AS id, l_linenumber AS k, CAST(l_partkey % 64 AS INT) AS x1, CAST(l_suppkey % 64 AS INT) AS y1, 0 AS z1, CAST(l_orderkey % 64 AS INT) AS x2, CAST(l_quantity AS INT) AS y2, l_linenumber AS z2 FROM lineitem)"


@query("v20_line_voxels", f"WITH {_LINES}, d AS (SELECT *, greatest(abs(x2 - x1), abs(y2 - y1), abs(z2 - z1)) AS m FROM l), s AS (SELECT *, unnest(range(0, m + 1)) AS i FROM d) SELECT id, k, CAST(i AS INT) AS i, {', '.join(f'CAST({c}1 + CASE WHEN m = 0 THEN 0 ELSE ((2 * i * abs({c}2 - {c}1) + m) // (2 * m)) * sign({c}2 - {c}1) END AS INT) AS {c}' for c in 'xyz')} FROM s")
def v20(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    lines = t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), *((F.col(c) % 64).cast("int").alias(n) for c, n in (("l_partkey", "x1"), ("l_suppkey", "y1"))), F.lit(0).alias("z1"), (F.col("l_orderkey") % 64).cast("int").alias("x2"), F.col("l_quantity").cast("int").alias("y2"), F.col("l_linenumber").alias("z2"))
    return V.line_voxels(lines)


@query("v22_swc_raster", f"WITH s AS (SELECT o_orderkey AS id, (o_orderkey % 64)::DOUBLE AS x, (o_custkey % 64)::DOUBLE AS y, (o_custkey % 8)::DOUBLE AS z, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey // 2 END AS parent FROM orders) SELECT DISTINCT {', '.join(f'CAST(least(greatest(trunc(s.{c} + (p.{c} - s.{c}) * (i / 9)), 0), {n - 1}) AS INT) AS {c}' for c, n in zip('xyz', DIMS))} FROM s JOIN s p ON p.id = s.parent, range(10) t(i) WHERE s.parent > -1")
def v22(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    swc = o.select(F.col("o_orderkey").alias("id"), *((F.col(c) % m).cast("double").alias(n) for c, m, n in (("o_orderkey", 64, "x"), ("o_custkey", 64, "y"), ("o_custkey", 8, "z"))), F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(F.expr("o_orderkey div 2")).alias("parent"))
    return V.swc_raster(swc, DIMS, 10)


@query("v24_combine_skeleton", f"{ctes('fx_pair')}, m AS (SELECT image_id, max(pred) AS m FROM fx_pair GROUP BY ALL) SELECT {K}, {r('truth / m * pred')} AS value FROM fx_pair JOIN m USING (image_id)")
def v24(spark, d):
    p = fixture(spark, d, "fx_pair")
    return _dbl(V.combine_skeleton(p.withColumn("value", F.col("truth")), p.withColumn("value", F.col("pred"))), "value")


@query("w08_gradient", f"{VOX}, {_GRID}, gv AS (SELECT gr.*, coalesce(value, 0) AS value FROM gr LEFT JOIN fx_voxels USING (image_id, x, y, z)) SELECT {K}, CAST(CASE WHEN x = 0 THEN lead(value) OVER w - value WHEN x = {NX - 1} THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END AS DOUBLE) AS value FROM gv WINDOW w AS (PARTITION BY image_id, y, z ORDER BY x)")
def w08(spark, d):
    return V.gradient(V.dense(_vox(spark, d), DIMS), "x").select(*V.KEYS, F.col("value").cast("double").alias("value"))


@query("f13_neighbour_codes", f"{VOX}, {_FG}, {_O26} SELECT a.image_id, a.x, a.y, a.z, CAST(coalesce(sum(CASE WHEN b.x IS NOT NULL THEN 1 << ((dx + 1) * 9 + (dy + 1) * 3 + dz + 1 - CASE WHEN (dx, dy, dz) > (0, 0, 0) THEN 1 ELSE 0 END)::INT END), 0) AS BIGINT) AS code FROM fg a CROSS JOIN o LEFT JOIN fg b ON b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL")
def f13(spark, d):
    return V.neighbour_code(_fg(spark, d)).select(*V.KEYS, F.col("code").cast("long").alias("code"))


# -- aggregates

@query("a13_vessel_density", f"{VOX} SELECT image_id, count(CASE WHEN value > 100 THEN 1 END) AS tumour, count(CASE WHEN value > 180 THEN 1 END) AS vessel, {r('count(CASE WHEN value > 180 THEN 1 END) / (count(CASE WHEN value > 100 THEN 1 END) + count(CASE WHEN value > 180 THEN 1 END))')} AS density, count(CASE WHEN value > 180 THEN 1 END) * 8e0 AS vessel_volume, (count(CASE WHEN value > 100 THEN 1 END) + count(CASE WHEN value > 180 THEN 1 END)) * 8e0 AS total_volume FROM fx_voxels GROUP BY ALL")
def a13(spark, d):
    v = _vox(spark, d)
    return _dbl(V.vessel_density(v, v.withColumn("value", F.greatest(F.col("value") - 180, F.lit(0))), 8.0, 100), "density")


_N = NX * NY * NZ


@query("a17_whitening", f"{VOX}, m AS (SELECT image_id, sum(value) / {_N} AS mean, sqrt(sum(CAST(value AS DOUBLE) * value) / {_N} - pow(sum(value) / {_N}, 2)) AS std FROM fx_voxels GROUP BY ALL) SELECT {K}, {r('(value - mean) / (std + 1e-7)')} AS value FROM fx_voxels JOIN m USING (image_id)")
def a17(spark, d):
    return _dbl(V.whiten(_vox(spark, d).withColumn("value", F.col("value").cast("double")), ["image_id"], _N), "value").select(*V.KEYS, "value")


@query("a19_value_range", f"{VOX} SELECT image_id, CASE WHEN count(*) < {_N} THEN least(min(value), 0) ELSE min(value) END AS lo, max(value) AS hi FROM fx_voxels GROUP BY ALL")
def a19(spark, d):
    return V.value_range(_vox(spark, d), _N)


@query("a20_projection", f"{VOX} SELECT image_id, x, y, CAST(sum(value) AS BIGINT) AS value FROM fx_voxels GROUP BY ALL")
def a20(spark, d):
    return V.projection(_vox(spark, d))


@query("a21_block_mean", f"{VOX} SELECT image_id, x, y, z // 5 AS z, sum(value) / 5 AS value FROM fx_voxels GROUP BY ALL")
def a21(spark, d):
    return V.block_reduce(_vox(spark, d))


@query("j08_sample_points", f"{ctes('fx_points', 'fx_voxels')} SELECT edge_id, pos, sample_id, concat('A', split_part(sample_id, '-', 2)) AS image_id, p.x, p.y, p.z, coalesce(value, 0) AS value FROM fx_points p LEFT JOIN fx_voxels v ON v.image_id = concat('A', split_part(sample_id, '-', 2)) AND v.x = p.x AND v.y = p.y AND v.z = p.z")
def j08(spark, d):
    p = fixture(spark, d, "fx_points").drop("diameter").withColumn("image_id", F.concat(F.lit("A"), F.split_part("sample_id", F.lit("-"), F.lit(2))))
    return V.sample_at_points(p, _vox(spark, d)).select("edge_id", "pos", "sample_id", *V.KEYS, "value")


@query("a12_branch_perfusion", f"{ctes('fx_points', 'fx_voxels')}, s AS (SELECT concat('A', split_part(sample_id, '-', 2)) AS image_id, edge_id, coalesce(value, 0) AS value FROM fx_points p LEFT JOIN fx_voxels v ON v.image_id = concat('A', split_part(sample_id, '-', 2)) AND v.x = p.x AND v.y = p.y AND v.z = p.z) SELECT image_id, edge_id, max(value) AS max, {r('avg(value)')} AS mean, median(value) AS median, min(value) AS min FROM s GROUP BY image_id, edge_id")
def a12p(spark, d):
    p = fixture(spark, d, "fx_points").withColumn("image_id", F.concat(F.lit("A"), F.split_part("sample_id", F.lit("-"), F.lit(2))))
    return _dbl(V.branch_perfusion(p, _vox(spark, d)), "mean")
