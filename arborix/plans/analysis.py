"""Queries on statistics, maps, scores and data preparation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import maps as M
from ..operators import prep as P
from ..operators import scores as C
from ..operators import stats as A
from ..operators import voxels as V
from ..operators.ranks import ranked
from ..sources import tables as S
from ..sources.fixtures import DIMS, ctes, fixture
from .common import query, r

EDGES, POINTS, PAIR, VOX, SCORES = (ctes(n) for n in ("fx_edges", "fx_points", "fx_pair", "fx_voxels", "fx_scores"))
NX, NY, NZ = DIMS


def _f(spark, d, name):
    return fixture(spark, d, name)


def _rounded(df, *cols, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if c in cols else c for c in df.columns))


@query("a14_histogram", f"{EDGES}, e AS (SELECT sample_id, min(length) AS lo, max(length) AS hi FROM fx_edges GROUP BY ALL), b AS (SELECT sample_id, CAST(least(19, floor((length - lo) / ((hi - lo) / 20))) AS INT) AS bin, count(*) AS n FROM fx_edges JOIN e USING (sample_id) GROUP BY ALL) SELECT e.sample_id, CAST(i AS INT) AS bin, coalesce(n, 0) AS n FROM e CROSS JOIN range(20) t(i) LEFT JOIN b ON b.sample_id = e.sample_id AND b.bin = i")
def a14(spark, d):
    return A.histogram(_f(spark, d, "fx_edges"), "length", 20, ["sample_id"])


@query("a15_joint_histogram", f"{EDGES}, e AS (SELECT sample_id, min(length) AS l0, max(length) AS l1, min(diameter) AS d0, max(diameter) AS d1 FROM fx_edges GROUP BY ALL) SELECT sample_id, CAST(least(9, floor((length - l0) / ((l1 - l0) / 10))) AS INT) AS bin_a, CAST(least(9, floor((diameter - d0) / ((d1 - d0) / 10))) AS INT) AS bin_b, count(*) AS n FROM fx_edges JOIN e USING (sample_id) GROUP BY ALL")
def a15(spark, d):
    return A.joint_histogram(_f(spark, d, "fx_edges"), "length", "diameter", 10, ["sample_id"])


@query("a10_shared_ranges", f"{EDGES} SELECT 'length' AS metric, min(length) AS lo, 1e3 AS hi FROM fx_edges UNION ALL SELECT 'diameter', min(diameter), max(diameter) FROM fx_edges UNION ALL SELECT 'soam', min(soam), max(soam) FROM fx_edges")
def a10(spark, d):
    return A.shared_ranges(_f(spark, d, "fx_edges"), ["length", "diameter", "soam"], {"length": (None, 1000.0)})


_HOLM = "t AS (SELECT o_orderkey AS test, ((o_orderkey * 7919) % 9973) / 99730e0 AS p_value FROM orders), k AS (SELECT *, row_number() OVER (ORDER BY p_value, test) - 1 AS i, count(*) OVER () AS m FROM t)"


def _tests(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("test"), (((F.col("o_orderkey") * 7919) % 9973) / 99730).alias("p_value"))


@query("m12_holm", f"WITH {_HOLM} SELECT test, p_value, {r('0.05e0 / (m - i)', 9)} AS threshold, p_value < 0.05e0 / (m - i) AS reject FROM k")
def m12(spark, d):
    return _rounded(A.holm(_tests(spark, d), order=["test"]), "threshold", digits=9)


@query("m12_holm_step_down", f"WITH {_HOLM} SELECT test, p_value, {r('0.05e0 / (m - i)', 9)} AS threshold, min((p_value < 0.05e0 / (m - i))::INT) OVER (ORDER BY p_value, test) = 1 AS reject FROM k")
def m12b(spark, d):
    return _rounded(A.holm(_tests(spark, d), step_down=True, order=["test"]), "threshold", digits=9)


_TAIL = "exp(-z * z / 2) / 2.5066282746310002e0 * t * (0.319381530e0 + t * (-0.356563782e0 + t * (1.781477937e0 + t * (-1.821255978e0 + t * 1.330274429e0))))"
_WX = f"""{SCORES}, dd AS (SELECT a.method AS m1, b.method AS m2, a.score - b.score AS d FROM fx_scores a JOIN fx_scores b USING (case_id) WHERE a.method < b.method AND a.score <> b.score),
rk AS (SELECT m1, m2, abs(d) AS m, count(*) AS t, count(CASE WHEN d > 0 THEN 1 END) AS plus FROM dd GROUP BY ALL), rr AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY m1, m2 ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2e0 AS rank FROM rk),
ws AS (SELECT m1, m2, CAST(sum(t) AS BIGINT) AS n, sum(rank * plus) AS wp, sum(rank * (t - plus)) AS wm, sum(t * t * t - t) AS ties FROM rr GROUP BY ALL), wb AS (SELECT * FROM ws UNION ALL SELECT m2, m1, n, wm, wp, ties FROM ws), ms AS (SELECT DISTINCT method FROM fx_scores),
wz AS (SELECT *, abs(least(wp, wm) - n * (n + 1) / 4e0) / sqrt(n * (n + 1) * (2 * n + 1) / 24e0 - ties / 48e0) AS z FROM wb), wt AS (SELECT *, 1 / (1 + 0.2316419e0 * z) AS t FROM wz), wp_ AS (SELECT *, least(1e0, 2 * {_TAIL}) AS p FROM wt),
pw AS (SELECT a.method AS method_1, b.method AS method_2, n, CAST(wp AS DOUBLE) AS w_plus, CAST(wm AS DOUBLE) AS w_minus, p AS p_value FROM ms a CROSS JOIN ms b LEFT JOIN wp_ ON m1 = a.method AND m2 = b.method)"""


@query("m13_wilcoxon_ranks", f"{_WX} SELECT method_1, method_2, n, w_plus, w_minus, {r('p_value', 7)} AS p_value FROM pw")
def m13(spark, d):
    return _rounded(A.wilcoxon_pairs(_f(spark, d, "fx_scores")), "p_value", digits=7)


@query("m13_multiple_wilcoxon", f"{_WX}, hk AS (SELECT *, row_number() OVER (ORDER BY p_value NULLS LAST, method_1, method_2) - 1 AS k, count(*) OVER () AS m FROM pw) SELECT method_1, method_2, n, {r('0.05e0 / (m - k)', 7)} AS threshold, coalesce(p_value < 0.05e0 / (m - k), false) AS reject FROM hk")
def m13b(spark, d):
    return _rounded(A.multiple_wilcoxon(_f(spark, d, "fx_scores")).select("method_1", "method_2", "n", "threshold", "reject"), "threshold", digits=7)


@query("w05_rank", f"WITH {_HOLM} SELECT test, CAST(i AS BIGINT) AS rank FROM k")
def w05(spark, d):
    return ranked(_tests(spark, d), ["p_value", "test"]).select("test", "rank")


_MIRROR = """s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
t AS (SELECT event_type, event_id, value, i, n, unnest(range(-1 - 25 // (2 * n), 2 + 25 // (2 * n))) AS k FROM s),
m AS (SELECT event_type, event_id, value, i, n, 2 * n * k + i AS place FROM t UNION ALL SELECT event_type, event_id, value, i, n, 2 * n * k - 1 - i FROM t)"""


@query("l04_least_known", f"{POINTS} SELECT sample_id, edge_id, pos, diameter FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY diameter, edge_id, pos) AS k FROM fx_points WHERE diameter IS NOT NULL AND edge_id % 5 <> 0) WHERE k = 1")
def l04(spark, d):
    """Every fifth branch has diameters that are not numbers, and first points have none."""
    p = _f(spark, d, "fx_points").withColumn("diameter", F.when(F.col("edge_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("diameter")))
    return A.least_known(p, "diameter", ["edge_id", "pos"], ["sample_id"])


@query("l04_least_of_all", f"{POINTS} SELECT sample_id, edge_id, pos, diameter FROM fx_points WHERE diameter IS NOT NULL ORDER BY diameter, sample_id, edge_id, pos LIMIT 1")
def l04b(spark, d):
    return A.least_known(_f(spark, d, "fx_points"), "diameter", ["sample_id", "edge_id", "pos"])


@query("w10_running_median", f"WITH {_MIRROR} SELECT event_type, event_id, median FROM (SELECT event_type, event_id, i, place, median(value) OVER (PARTITION BY event_type ORDER BY place ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS median FROM m WHERE place >= -25 AND place < n + 25) WHERE place = i")
def w10(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("k", F.struct("ts", "event_id"))
    return A.running_median(e, ["event_type"], "k", "value").select("event_type", "event_id", "median")


_AV = "SELECT event_id, {0} AS v FROM events"


@query("f05_sigmoid_and_clip", f"SELECT event_id, {r('1 / (1 + exp(-value / 100))')} AS sigmoid, {r('greatest(1e-6, least(1 - 1e-6, value / 100))')} AS clipped, {r('log(10, greatest(1e-6, least(1 - 1e-6, value / 100)))')} + 0e0 AS logged FROM events")
def f05(spark, d):
    v = F.col("value") / 100
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(A.sigmoid(v), 6).alias("sigmoid"), F.round(A.clip01(v), 6).alias("clipped"), (F.round(F.log10(A.clip01(v)), 6) + 0.0).alias("logged"))


@query("f06_safe_divide", "SELECT o_orderkey, o_totalprice / CASE WHEN o_orderkey % 3 = 0 THEN 1e-10 ELSE o_orderkey % 3 END AS q FROM orders")
def f06(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", A.safe_divide(F.col("o_totalprice"), F.col("o_orderkey") % 3).alias("q"))


@query("f08_eigen2", f"{EDGES}, m AS (SELECT edge_id, length AS a, diameter AS b, soam AS c FROM fx_edges) SELECT edge_id, {r('(a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b)')} AS e1, {r('(a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b)')} AS e2, {r('CASE WHEN atan2(2 * b, a - c) < 0 THEN atan2(2 * b, a - c) / 2 + pi() ELSE atan2(2 * b, a - c) / 2 END')} AS theta FROM m")
def f08(spark, d):
    a, b, c = F.col("length"), F.col("diameter"), F.col("soam")
    e1, e2 = A.eigen2(a, b, c)
    return _f(spark, d, "fx_edges").select("edge_id", F.round(e1, 6).alias("e1"), F.round(e2, 6).alias("e2"), F.round(A.principal_angle(a, b, c), 6).alias("theta"))


#: The matrix [[a, k, k], [k, b, k], [k, k, c]] has the eigenvalues q + 2p cos(phi + 2 pi i / 3).
_E3 = f"""{EDGES}, m AS (SELECT edge_id, length AS a, diameter AS b, soam AS c, clr AS k, (length + diameter + soam) / 3 AS q FROM fx_edges),
p AS (SELECT *, sqrt((pow(a - q, 2) + pow(b - q, 2) + pow(c - q, 2) + 6 * k * k) / 6) AS p FROM m),
h AS (SELECT *, acos(greatest(-1e0, least(1e0, ((a - q) * (b - q) * (c - q) + 2 * k * k * k - (a + b + c - 3 * q) * k * k) / pow(p, 3) / 2))) / 3 AS phi FROM p),
v AS (SELECT edge_id, list_sort([{{'s': abs(x), 'v': x}} FOR x IN [q + 2 * p * cos(phi), q + 2 * p * cos(phi + 2 * pi() / 3), q + 2 * p * cos(phi + 4 * pi() / 3)]]) AS e FROM h)"""


@query("f08_eigen3", f"{_E3} SELECT edge_id, {r('e[1].v', 4)} + 0e0 AS e1, {r('e[2].v', 4)} + 0e0 AS e2, {r('e[3].v', 4)} + 0e0 AS e3 FROM v")
def f08b(spark, d):
    a, b, c, k = (F.col(x) for x in ("length", "diameter", "soam", "clr"))
    e = A.eigen3(a, b, c, k, k, k)
    return _f(spark, d, "fx_edges").select("edge_id", e.alias("e")).select("edge_id", *((F.round(F.col("e")[i], 4) + 0.0).alias(f"e{i + 1}") for i in range(3)))


_V7 = "pow(l1, 2) + pow(l2, 2) + pow(l3, 2)"


@query("f07_vesselness", f"{EDGES}, m AS (SELECT edge_id, soam / 50 - 0.05e0 AS l1, clr * 2 - 1.8e0 AS l2, -length / 10 AS l3 FROM fx_edges) SELECT edge_id, CASE WHEN l2 > 0 OR l3 > 0 THEN 0e0 ELSE {r(f'(1 - exp(-pow(abs(l2) / CASE WHEN l3 = 0 THEN 1e-10 ELSE abs(l3) END, 2) / (2 * 0.25e0))) * exp(-pow(abs(l1) / CASE WHEN l2 * l3 = 0 THEN 1e-10 ELSE sqrt(abs(l2 * l3)) END, 2) / (2 * 0.25e0)) * (1 - exp(-({_V7}) / (2 * 225e0)))', 9)} END AS value FROM m")
def f07(spark, d):
    e = F.array(F.col("soam") / 50 - 0.05, F.col("clr") * 2 - 1.8, -F.col("length") / 10)
    return _f(spark, d, "fx_edges").select("edge_id", F.round(A.vesselness(e), 9).alias("value"))


@query("f04_diameter", f"{POINTS} SELECT sample_id, edge_id, pos, 2 * (x * 100 + y) / 100e0 AS diameter FROM fx_points")
def f04(spark, d):
    return _f(spark, d, "fx_points").select("sample_id", "edge_id", "pos", A.diameter_of(F.col("x") * 100 + F.col("y")).alias("diameter"))


@query("f11_factor_pairs", "SELECT c_custkey, f AS a, c_custkey // f AS b FROM (SELECT c_custkey, unnest(range(1, c_custkey + 1)) AS f FROM customer) WHERE c_custkey % f = 0")
def f11(spark, d):
    p = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.explode(A.factor_pairs(F.col("c_custkey"))).alias("p"))
    return p.select("c_custkey", F.col("p.a").cast("long").alias("a"), F.col("p.b").cast("long").alias("b"))


@query("f12_skeleton_strength", f"{EDGES}, m AS (SELECT max(length) AS m FROM fx_edges) SELECT edge_id, {r('pow((exp(length / m) - 1) / (exp(1) - 1), 2)')} AS strength FROM fx_edges, m")
def f12(spark, d):
    e = _f(spark, d, "fx_edges")
    return e.crossJoin(F.broadcast(e.agg(F.max("length").alias("m")))).select("edge_id", F.round(A.skeleton_strength(F.col("length"), F.col("m")), 6).alias("strength"))


# -- maps and distances

_GRID = f"g AS (SELECT DISTINCT sample_id, CAST(a.i AS INT) AS gx, CAST(b.i AS INT) AS gy FROM fx_points, range(0, {NX}, 4) a(i), range(0, {NY}, 4) b(i))"
_NEAR = "nr AS (SELECT g.sample_id, gx, gy, p.x, p.y, p.v, p.vx, p.vy FROM g LEFT JOIN pv p ON p.sample_id = g.sample_id AND pow(gx - p.x, 2) + pow(gy - p.y, 2) <= 36)"
_PV = "pv AS (SELECT sample_id, x, y, coalesce(diameter, 1e0) AS v, (x % 5) / 5e0 AS vx, (y % 3) / 3e0 AS vy FROM fx_points)"


def _pv(spark, d):
    return _f(spark, d, "fx_points").select("sample_id", "x", "y", F.coalesce("diameter", F.lit(1.0)).alias("v"), ((F.col("x") % 5) / 5).alias("dx"), ((F.col("y") % 3) / 3).alias("dy"))


@query("j04_radius_join", f"{POINTS}, {_GRID}, {_PV} SELECT g.sample_id, gx, gy, count(*) AS n, {r('sum(sqrt(pow(gx - x, 2) + pow(gy - y, 2)))')} AS total FROM g JOIN pv p ON p.sample_id = g.sample_id AND pow(gx - p.x, 2) + pow(gy - p.y, 2) <= 36 GROUP BY ALL")
def j04(spark, d):
    p = _pv(spark, d)
    return M.radius_join(M.grid(p, (NX, NY), 16), p, 6.0).groupBy("sample_id", "gx", "gy").agg(F.count("*").alias("n"), F.round(F.sum("d"), 6).alias("total"))


@query("m01_metric_map", f"{POINTS}, {_GRID}, {_PV}, {_NEAR} SELECT sample_id, gx, gy, count(v) AS n, CASE WHEN count(v) >= 3 THEN {r('median(v)')} ELSE 0e0 END AS value, CASE WHEN count(v) >= 3 THEN {r('var_pop(v)')} ELSE 0e0 END AS variance FROM nr GROUP BY ALL")
def m01(spark, d):
    return _rounded(M.metric_map(_pv(spark, d), "v", (NX, NY), 6.0, n=16), "value", "variance")


@query("m01_threshold_map", f"{POINTS}, {_GRID}, {_PV}, {_NEAR} SELECT sample_id, gx, gy, count(v) AS n, CASE WHEN count(v) >= 3 THEN {r('avg((v > 3)::INT)')} ELSE 0e0 END AS value FROM nr GROUP BY ALL")
def m01b(spark, d):
    return _rounded(M.metric_map(_pv(spark, d), "v", (NX, NY), 6.0, 3.0, 16).drop("variance"), "value")


_W2 = "exp(-(pow(gx - x, 2) + pow(gy - y, 2)) / (2 * 9))"


@query("m02_coherence_map", f"{POINTS}, {_GRID}, {_PV}, {_NEAR}, s AS (SELECT sample_id, gx, gy, coalesce(sum({_W2} * vx * vx), 0) AS a, coalesce(sum({_W2} * vx * vy), 0) AS b, coalesce(sum({_W2} * vy * vy), 0) AS c FROM nr GROUP BY ALL), e AS (SELECT *, abs((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b)) AS e1, abs((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b)) AS e2 FROM s) SELECT sample_id, gx, gy, round((greatest(e1, e2) - least(e1, e2)) / greatest(e1 + e2, 1e-5), 5) AS coherence FROM e")
def m02(spark, d):
    return _rounded(M.coherence_map(_pv(spark, d), (NX, NY), 6.0, 16).drop("theta"), "coherence", digits=5)


@query("m03_density_map", f"{POINTS}, {_GRID}, k AS (SELECT sample_id, count(*) AS m, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vc, pow(count(*), -1e0 / 3) AS h2 FROM fx_points GROUP BY ALL), q AS (SELECT *, vx * vy - vc * vc AS det FROM k) SELECT g.sample_id, gx, gy, round(sum(exp(-0.5 * (vy / det / h2 * pow(gx - x, 2) - 2 * vc / det / h2 * (gx - x) * (gy - y) + vx / det / h2 * pow(gy - y, 2)))) / (2 * pi() * any_value(sqrt(det) * h2)), 5) AS density FROM g JOIN q USING (sample_id) JOIN fx_points p ON p.sample_id = g.sample_id GROUP BY ALL")
def m03(spark, d):
    return _rounded(M.density_map(_f(spark, d, "fx_points"), (NX, NY), n=16), "density", digits=5)


#: Two networks of each sample: the even and the odd branches.
_TWO = "A AS (SELECT sample_id, x, y, z FROM fx_points WHERE edge_id % 2 = 0), B AS (SELECT sample_id, x, y, z FROM fx_points WHERE edge_id % 2 = 1)"


def _two(spark, d):
    p = _f(spark, d, "fx_points")
    return tuple(p.where(F.col("edge_id") % 2 == k).select("sample_id", *"xyz") for k in (0, 1))


@query("j05_nearest", f"{POINTS}, {_TWO}, ua AS (SELECT DISTINCT * FROM A), ub AS (SELECT DISTINCT * FROM B) SELECT ua.sample_id, ua.x, ua.y, ua.z, {r('sqrt(min(pow(ua.x - ub.x, 2) + pow(ua.y - ub.y, 2) + pow(ua.z - ub.z, 2)))')} AS dist FROM ua LEFT JOIN ub ON ub.sample_id = ua.sample_id GROUP BY ALL")
def j05(spark, d):
    a, b = _two(spark, d)
    return _rounded(M.nearest(a.distinct(), b, ["sample_id"], cell=4.0), "dist")


@query("m05_mean_nearest", f"{POINTS}, {_TWO}, n1 AS (SELECT A.sample_id, A.x, A.y, A.z, sqrt(min(pow(A.x - B.x, 2) + pow(A.y - B.y, 2) + pow(A.z - B.z, 2))) AS d FROM (SELECT DISTINCT * FROM A) A JOIN B ON B.sample_id = A.sample_id GROUP BY ALL), n2 AS (SELECT B.sample_id, B.x, B.y, B.z, sqrt(min(pow(A.x - B.x, 2) + pow(A.y - B.y, 2) + pow(A.z - B.z, 2))) AS d FROM (SELECT DISTINCT * FROM B) B JOIN A ON B.sample_id = A.sample_id GROUP BY ALL) SELECT sample_id, {r('(a + b) / 2')} AS distance FROM (SELECT sample_id, avg(d) AS a FROM n1 GROUP BY ALL) JOIN (SELECT sample_id, avg(d) AS b FROM n2 GROUP BY ALL) USING (sample_id)")
def m05(spark, d):
    a, b = _two(spark, d)
    return _rounded(M.mean_nearest(a.distinct(), b.distinct(), ["sample_id"], True, cell=8.0), "distance")


@query("j06_squared_distance", f"{POINTS}, c AS (SELECT sample_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM fx_points GROUP BY ALL) SELECT edge_id, pos, p.sample_id, {r('pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2)', 4)} AS d2 FROM fx_points p JOIN c USING (sample_id)")
def j06(spark, d):
    p = _f(spark, d, "fx_points")
    c = p.groupBy("sample_id").agg(*(F.avg(k).alias(f"c{k}") for k in "xyz"))
    d2 = sum(((F.col(k) - F.col(f"c{k}")) ** 2 for k in "xyz"), F.lit(0.0))
    return p.join(c, "sample_id").select("edge_id", "pos", "sample_id", F.round(d2, 4).alias("d2"))


@query("j11_greedy_matching")
def j11(spark, d):
    p = _f(spark, d, "fx_points").groupBy("sample_id", "edge_id").agg(*(F.min_by(c, "pos").alias(c) for c in "xyz"))
    a, b = (p.where(F.col("edge_id") % 2 == k).withColumnRenamed("edge_id", "node_id") for k in (0, 1))
    return M.greedy_matching(a, b, 12.0)


@query("g16_edge_agreement", f"{EDGES}, s AS (SELECT DISTINCT sample_id, least(u, v) AS p, greatest(u, v) AS q FROM fx_edges WHERE edge_id % 8 = 0) SELECT e.sample_id, {r('count(s.p) / count(*)')} AS share FROM fx_edges e LEFT JOIN s ON s.sample_id = e.sample_id AND s.p = least(e.u, e.v) AND s.q = greatest(e.u, e.v) GROUP BY ALL")
def g16(spark, d):
    e = _f(spark, d, "fx_edges")
    same = e.select("sample_id", F.explode(F.array("u", "v")).alias("node_a")).distinct().withColumn("node_b", F.col("node_a"))
    return _rounded(M.edge_agreement(e, e.where("edge_id % 8 = 0"), same), "share")


# -- scores

@query("m06_dice", f"{PAIR} SELECT image_id, {r('(2 * sum(truth * pred) + 1e-4) / (sum(truth * truth) + sum(pred * pred) + 1e-4)')} AS soft, {r('(2 * sum(truth * pred) + 1) / (sum(truth) + sum(pred) + 1)')} AS plain FROM fx_pair GROUP BY ALL")
def m06(spark, d):
    return _rounded(C.dice(_f(spark, d, "fx_pair")), "soft", "plain")


_E = "-(greatest(1e-6, least(1 - 1e-6, truth)) * ln(greatest(1e-6, least(1 - 1e-6, pred))) + (1 - greatest(1e-6, least(1 - 1e-6, truth))) * ln(1 - greatest(1e-6, least(1 - 1e-6, pred))))"


@query("m07_cross_entropy", f"{PAIR} SELECT image_id, {r(f'avg({_E})')} AS bce FROM fx_pair GROUP BY ALL")
def m07(spark, d):
    return _rounded(C.cross_entropy(_f(spark, d, "fx_pair")), "bce")


@query("m09_confusion", f"{PAIR}, c AS (SELECT image_id, sum(truth * pred) AS tp, sum((1 - pred) * (1 - truth)) AS tn, sum(pred * (1 - truth)) AS fp, sum((1 - pred) * truth) AS fn FROM fx_pair GROUP BY ALL) SELECT image_id, round(tp, 4) AS tp, round(tn, 4) AS tn, round(fp, 4) AS fp, round(fn, 4) AS fn, {r('tp / (tp + fn)')} AS sensitivity, {r('tn / (fp + tn)')} AS specificity FROM c")
def m09(spark, d):
    return _rounded(_rounded(C.confusion(_f(spark, d, "fx_pair")), "tp", "tn", "fp", "fn", digits=4), "sensitivity", "specificity")


@query("m10_weighted_errors", f"{PAIR} SELECT image_id, {r(f'avg((truth + 0.1) / 1.1 * {_E})')} AS weighted_bce, {r('avg((truth + 0.1) / 1.1 * pow(truth - pred, 2))')} AS weighted_mse, {r('avg(pow(truth - pred, 2))')} AS mse, {r('avg(CASE WHEN truth <> 2 THEN pow(truth - pred, 2) END)')} AS mse_known FROM fx_pair GROUP BY ALL")
def m10(spark, d):
    return _rounded(C.weighted_errors(_f(spark, d, "fx_pair")), "weighted_bce", "weighted_mse", "mse", "mse_known")


_SETS = "t AS (SELECT image_id, x, y, z FROM fx_pair WHERE truth > 0.5), p AS (SELECT image_id, x, y, z FROM fx_pair WHERE pred > 0.5)"
_WAY = lambda a, b: f"(SELECT image_id, avg(d) AS d FROM (SELECT {a}.image_id, {a}.x, {a}.y, {a}.z, sqrt(min(pow({a}.x - {b}.x, 2) + pow({a}.y - {b}.y, 2) + pow({a}.z - {b}.z, 2))) AS d FROM {a} JOIN {b} ON {a}.image_id = {b}.image_id GROUP BY ALL) GROUP BY ALL)"


@query("m08_surface_distance", f"{PAIR}, {_SETS} SELECT image_id, {r('greatest(a.d, b.d)')} AS distance, {r('a.d')} AS truth_to_pred, {r('b.d')} AS pred_to_truth FROM {_WAY('t', 'p')} a JOIN {_WAY('p', 't')} b USING (image_id)")
def m08(spark, d):
    p = _f(spark, d, "fx_pair")
    return _rounded(C.surface_distance(p.where("truth > 0.5").select(*V.KEYS), p.where("pred > 0.5").select(*V.KEYS)), "distance", "truth_to_pred", "pred_to_truth")


# -- preparation

_TILES = f"{VOX}, tl AS (SELECT image_id, CAST(a.i * 16 AS INT) AS ox, CAST(b.i * 16 AS INT) AS oy, x - CAST(a.i * 16 AS INT) AS tx, y - CAST(b.i * 16 AS INT) AS ty, z, value / 255e0 AS value FROM fx_voxels, range(3) a(i), range(3) b(i) WHERE x BETWEEN a.i * 16 AND a.i * 16 + 31 AND y BETWEEN b.i * 16 AND b.i * 16 + 31)"


def _tiles(spark, d):
    return V.strided_tiles(_f(spark, d, "fx_voxels"), DIMS, (32, 32), (16, 16)).withColumn("value", F.col("value") / 255)


@query("d01_balanced_tiles", f"{_TILES}, s AS (SELECT image_id, ox, oy, len(list_filter(v, lambda x: x > 0.1)) AS n1, len(list_filter(v, lambda x: x > 0.9)) AS n9, min(ox * 1000 + oy) OVER (PARTITION BY image_id) = ox * 1000 + oy AS k FROM (SELECT image_id, ox, oy, list(value) AS v FROM tl GROUP BY ALL)) SELECT image_id, ox, oy FROM s WHERE n1 > 1000 OR n9 > 70 OR k")
def d01(spark, d):
    return P.balanced_tiles(_tiles(spark, d), 0.0, core=70)


#: Small tiles, of which some are kept by their mask, some by the second channel and some not at all.
@query("d02_balanced_tiles_by_sum", f"{ctes('fx_voxels')} SELECT image_id, CAST(x // 8 * 8 AS INT) AS ox, CAST(y // 8 * 8 AS INT) AS oy FROM fx_voxels GROUP BY ALL HAVING count(CASE WHEN value >= 250 THEN 1 END) > 5 OR count(CASE WHEN value > 150 THEN 1 END) > 100")
def d02(spark, d):
    tiles = V.strided_tiles(_f(spark, d, "fx_voxels"), DIMS, (8, 8), (8, 8))
    return P.balanced_tiles_by_sum(tiles.select("image_id", "ox", "oy", (F.col("value") >= 250).cast("int").alias("value"), F.col("value").alias("second")), 0.0, second="second")


_DIGEST = lambda seed, *c: f"CAST(concat('0x', substr(md5(concat_ws(':', '{seed}', {', '.join(f'{x}::VARCHAR' for x in c)})), 1, 8)) AS BIGINT)"


@query("d03_split", f"WITH h AS (SELECT c_custkey, row_number() OVER (ORDER BY {_DIGEST(0, 'c_custkey')}, c_custkey) AS k, count(*) OVER () AS n FROM customer) SELECT c_custkey, k <= greatest(1, floor(n * 0.1e0)) AS validation FROM h")
def d03(spark, d):
    return P.split(spark.read.parquet(f"{d}/customer.parquet"), "c_custkey").select("c_custkey", "validation")


@query("d04_folds", f"SELECT c_custkey, {_DIGEST(0, 'c_custkey')} % 5 = 2 AS held FROM customer")
def d04(spark, d):
    train, held = P.train_and_held(spark.read.parquet(f"{d}/customer.parquet"), "c_custkey", 5, 2)
    return train.select("c_custkey", F.lit(False).alias("held")).unionByName(held.select("c_custkey", F.lit(True).alias("held")))


@query("d05_random_crops", f"{VOX}, c AS (SELECT image_id, CAST(i AS INT) AS crop, {_DIGEST(0, 'image_id', 'i')} % {NX - 15} AS ox, {_DIGEST(1, 'image_id', 'i')} % {NY - 15} AS oy FROM (SELECT DISTINCT image_id FROM fx_voxels), range(4) t(i)) SELECT image_id, crop, CAST(x - ox AS INT) AS tx, CAST(y - oy AS INT) AS ty, z, value FROM fx_voxels JOIN c USING (image_id) WHERE x >= ox AND x < ox + 16 AND y >= oy AND y < oy + 16")
def d05(spark, d):
    v = _f(spark, d, "fx_voxels")
    vol = v.select("image_id").distinct().select("image_id", F.lit(NX).alias("nx"), F.lit(NY).alias("ny"))
    return P.random_crops(vol, v, (16, 16), 4)


@query("d06_batches", f"{POINTS} SELECT sample_id, edge_id, pos, CAST((row_number() OVER (PARTITION BY sample_id ORDER BY edge_id * 100000 + pos) - 1) // 32 AS BIGINT) AS batch FROM fx_points")
def d06(spark, d):
    p = _f(spark, d, "fx_points").withColumn("k", F.col("edge_id") * 100000 + F.col("pos"))
    return P.batches(p, ["sample_id"], "k", 32).select("sample_id", "edge_id", "pos", "batch")


@query("d07_tile_maximum", f"{_TILES}, m AS (SELECT image_id, ox, oy, max(value) AS m FROM tl GROUP BY ALL) SELECT image_id, ox, oy, tx, ty, z, {r('value / m')} AS value FROM tl JOIN m USING (image_id, ox, oy)")
def d07(spark, d):
    return _rounded(P.scale_by_tile_maximum(_tiles(spark, d)).select("image_id", "ox", "oy", "tx", "ty", "z", "value"), "value")


@query("d08_score_volume", f"{VOX} SELECT image_id, x, y, z, {r('value / 255e0 * 0.5')} AS value FROM fx_voxels")
def d08(spark, d):
    def scorer(frame):
        return frame.assign(value=frame.value * 0.5)

    scored = P.score_tiles(_tiles(spark, d), scorer)
    return _rounded(V.reassemble(scored), "value")


@query("w13_slice_batches", f"{VOX}, b AS (SELECT CAST(a.i AS INT) AS batch, CAST(s.i AS INT) AS slot, least({NZ - 1}, greatest(0, a.i * 3 + s.i - 1)) AS z FROM range(3) a(i), range(5) s(i) WHERE s.i < least(3, {NZ} - a.i * 3) + 2) SELECT v.image_id, v.x, v.y, v.z, value, batch, slot FROM fx_voxels v JOIN b ON b.z = v.z")
def w13(spark, d):
    return P.slice_batches(_f(spark, d, "fx_voxels"), NZ, 3, 1).select(*V.KEYS, "value", "batch", "slot")


@query("l05_first_files", "SELECT c_name AS file FROM customer ORDER BY c_name LIMIT 20")
def l05(spark, d):
    return P.sample_files(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("file")), 20)


@query("j10_pair_by_name", "SELECT a.c_name AS file, a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_name = b.c_name WHERE a.c_custkey % 2 = 0 AND b.c_custkey % 3 = 0")
def j10(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    side = lambda k, n: c.where(F.col("c_custkey") % k == 0).select(F.col("c_name").alias("file"), F.col("c_custkey").alias(n))
    return P.pair_by_name(side(2, "a"), side(3, "b"))


@query("u03_common_files", "SELECT c_name AS file FROM customer WHERE c_custkey % 2 = 0 INTERSECT SELECT c_name FROM customer WHERE c_custkey % 3 = 0")
def u03(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("file")).intersect(c.where("c_custkey % 3 = 0").select("c_name"))


_FILES = "f AS (SELECT 'weights.' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '-' || printf('%.6f', ((o_orderkey * 7919) % 99991) / 1e5) || '.hdf5' AS file, o_orderkey % 100 AS e, ((o_orderkey * 7919) % 99991) AS l FROM orders)"


def _files(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.concat(F.lit("weights."), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("-"), F.format_string("%.6f", ((F.col("o_orderkey") * 7919) % 99991) / 1e5), F.lit(".hdf5")).alias("file"))


@query("s18_best_weights", f"WITH {_FILES} SELECT arg_min(file, l * 1000 + e) AS file FROM f")
def s18(spark, d):
    return S.best_weights(_files(spark, d))


@query("s18_latest_weights", f"WITH {_FILES} SELECT max(file) AS file FROM f WHERE e = (SELECT max(e) FROM f)")
def s18b(spark, d):
    return S.best_weights(_files(spark, d), most_recent=True)


@query("f03_derived_ratios", f"{EDGES}, e AS (SELECT edge_id, length, soam, clr * length AS chord FROM fx_edges) SELECT edge_id, {r('soam / length', 9)} AS soam_per_length, {r('chord / length')} AS clr, {r('1 - chord / length')} AS neg_clr, {r('(1 - chord / length) / chord', 9)} AS c2l FROM e")
def f03(spark, d):
    e = _f(spark, d, "fx_edges").withColumn("chord", F.col("clr") * F.col("length"))
    c, n = F.col("chord"), F.col("length")
    return e.select("edge_id", F.round(F.col("soam") / n, 9).alias("soam_per_length"), F.round(c / n, 6).alias("clr"), F.round(1 - c / n, 6).alias("neg_clr"), F.round((1 - c / n) / c, 9).alias("c2l"))


@query("f01_scaled_distance", f"{POINTS} SELECT edge_id, sample_id, pos, {r('sqrt(pow(2e0 * x, 2) + pow(3e0 * y, 2) + pow(5e0 * z, 2))')} AS d FROM fx_points")
def f01(spark, d):
    p = _f(spark, d, "fx_points")
    return p.select("edge_id", "sample_id", "pos", F.round(G.dist([F.col(c) for c in "xyz"], [F.lit(0.0)] * 3, (2.0, 3.0, 5.0)), 6).alias("d"))
