"""Metrics of branches, from their ordered points.

points(sample_id, edge_id, pos, x, y, z, diameter): one window over the points of a branch serves all metrics; rows are
keyed by branch, so a cohort is one job and a branch never leaves its partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["sample_id", "edge_id"]
SIGMA, RADIUS = 3.0, 12


def kernel(sigma: float = SIGMA, radius: int = RADIUS) -> list[float]:
    """Weights of a truncated Gaussian at -radius..radius, with sum 1."""
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def dist(a: tuple, b: tuple, pix=(1.0, 1.0, 1.0)) -> Column:
    """Euclidean distance of two coordinate tuples, each axis scaled by its voxel size."""
    return F.sqrt(sum(((F.lit(p) * (x - y)) ** 2 for p, x, y in zip(pix, a, b)), F.lit(0.0)))


def order(keys=KEYS) -> Window:
    return Window.partitionBy(*keys).orderBy("pos")


def steps(points: DataFrame, pix, keys=KEYS) -> DataFrame:
    """points with `step`, the distance to the next one (null at the last)."""
    w = order(keys)
    xyz = [F.col(c) for c in "xyz"]
    return points.withColumn("step", dist(xyz, [F.lead(c).over(w) for c in xyz], pix))


def smoothed(points: DataFrame, pix, keys=KEYS, sigma: float = SIGMA, radius: int = RADIUS) -> DataFrame:
    """The polyline after smoothing along the branch, border values repeated, with the raw ends before and after; n + 2 rows a branch."""
    w, whole = order(keys), order(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = kernel(sigma, radius)
    scaled = points.select(*keys, "pos", *((F.col(c) * F.lit(p)).alias(c) for c, p in zip("xyz", pix)))
    near = scaled.select(*keys, "pos", *"xyz", *(F.first(c).over(whole).alias(f"{c}0") for c in "xyz"), *(F.last(c).over(whole).alias(f"{c}1") for c in "xyz"), F.count("*").over(whole).alias("n"))
    value = lambda c, k: F.coalesce(F.lag(c, -k).over(w), F.col(f"{c}0" if k < 0 else f"{c}1"))
    line = near.select(*keys, "pos", "n", *(sum((F.lit(weights[k + radius]) * value(c, k) for k in range(-radius, radius + 1)), F.lit(0.0)).alias(c) for c in "xyz"))
    ends = near.where("pos = 0").select(*keys, F.lit(-1).alias("pos"), "n", *(F.col(f"{c}0").alias(c) for c in "xyz"))
    ends = ends.unionByName(near.where("pos = 0").select(*keys, F.col("n").cast("int").alias("pos"), "n", *(F.col(f"{c}1").alias(c) for c in "xyz")))
    return line.unionByName(ends)


def turning(points: DataFrame, pix, keys=KEYS) -> DataFrame:
    """(keys, soam): the sum of angles of the smoothed polyline; 0 under five points, steps of length zero are left out."""
    w = order(keys)
    line = smoothed(points, pix, keys)
    v1 = [F.lead(c).over(w) - F.col(c) for c in "xyz"]
    v2 = [F.lead(c, 2).over(w) - F.lead(c).over(w) for c in "xyz"]
    dot = sum((a * b for a, b in zip(v1, v2)), F.lit(0.0))
    norm = lambda v: F.sqrt(sum((a * a for a in v), F.lit(0.0)))
    angles = line.select(*keys, "n", dot.alias("dot"), norm(v1).alias("n1"), norm(v2).alias("n2"))
    c = F.col("dot") / F.col("n1") / F.col("n2")
    snapped = F.when(F.abs(c - 1) < 1e-5, 1.0).when(F.abs(c + 1) < 1e-5, -1.0).otherwise(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))
    theta = F.when((F.col("n") >= 5) & (F.col("n1") > 0) & (F.col("n2") > 0), F.acos(snapped))
    return angles.groupBy(*keys).agg(F.coalesce(F.sum(theta), F.lit(0.0)).alias("soam"))


def branch_metrics(points: DataFrame, pix=(1.0, 1.0, 1.0), keys=KEYS) -> DataFrame:
    """One row per branch: n_points, length (at least 1), diameter (null points left out), chord (at least 1), soam, the ratios, and the unscaled unit direction."""
    ends = {}
    for name, pick in (("first", F.min_by), ("last", F.max_by)):
        ends[name] = pick(F.struct(*"xyz"), F.col("pos")).alias(name)
    per = steps(points, pix, keys).groupBy(*keys).agg(F.count("*").alias("n_points"), F.greatest(F.coalesce(F.sum("step"), F.lit(0.0)), F.lit(1.0)).alias("length"), F.avg("diameter").alias("diameter"), *ends.values())
    a, b = ([F.col(f"{e}.{c}") for c in "xyz"] for e in ("first", "last"))
    out = per.join(turning(points, pix, keys), keys).withColumn("chord", F.greatest(dist(a, b, pix), F.lit(1.0)))
    out = out.withColumn("soam_per_length", F.col("soam") / F.col("length")).withColumn("clr", F.col("chord") / F.col("length"))
    out = out.withColumn("neg_clr", 1 - F.col("clr")).withColumn("c2l", F.col("neg_clr") / F.col("chord"))
    size = F.greatest(dist(b, a), F.lit(1e-5))
    return out.select(*keys, "n_points", "length", "diameter", "chord", "soam", "soam_per_length", "clr", "neg_clr", "c2l", *(((q - p) / size).alias(f"d{c}") for c, p, q in zip("xyz", a, b)))


#: Metrics by name, for callers that choose one.
METRICS = {name: F.col for name in ("diameter", "length", "soam", "soam_per_length", "chord", "clr", "neg_clr", "c2l")}


def metric_aggregate(branches: DataFrame, metric: str, aggregate=F.avg, keys=("sample_id",)) -> DataFrame:
    """(keys, metric, value): any Column aggregate, or a grouped-aggregate pandas UDF, over a metric chosen by name."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    return branches.groupBy(*keys).agg(F.lit(metric).alias("metric"), aggregate(F.col(metric)).alias("value"))


def contiguous_prefix(points: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Rows whose number is below the first gap of 1, 2, 3, ... within their key."""
    seen = points.select(*keys, number).distinct().withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(number)))
    return points.join(seen.where(F.col("_rn") == F.col(number)).drop("_rn"), [*keys, number], "left_semi")


def subdivide(points: DataFrame, max_length: int = 10, keys=KEYS) -> DataFrame:
    """points with `piece`: branches of over 2 * max_length points are cut every max_length points, the last piece keeps the rest."""
    n = F.count("*").over(Window.partitionBy(*keys))
    last = F.floor((n - 2 * max_length - 1) / max_length) + 1
    piece = F.when(n > 2 * max_length, F.least(F.floor(F.col("pos") / max_length), last)).otherwise(0)
    return points.withColumn("piece", piece.cast("int"))


def drop_consecutive_duplicates(points: DataFrame, keys=KEYS) -> DataFrame:
    w = order(keys)
    same = F.lit(True)
    for c in "xyz":
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = points.withColumn("_same", same & F.lag("pos").over(w).isNotNull())
    return marked.where(~F.col("_same")).drop("_same")


def point_cloud(points: DataFrame, keys=("sample_id",)) -> DataFrame:
    """Distinct points with `branching`: true for first and last points of branches, which win over inner ones."""
    w = Window.partitionBy("sample_id", "edge_id")
    end = (F.col("pos") == F.min("pos").over(w)) | (F.col("pos") == F.max("pos").over(w))
    return points.withColumn("end", end).groupBy(*keys, *"xyz").agg(F.bool_or("end").alias("branching"))


def non_branching_points(points: DataFrame) -> DataFrame:
    """All points minus branching ones, as a row-wise set difference."""
    cloud = point_cloud(points)
    return points.select("sample_id", *"xyz").distinct().join(cloud.where("branching"), ["sample_id", *"xyz"], "left_anti")


def point_edges(points: DataFrame) -> DataFrame:
    """Undirected distinct pairs of consecutive points of a branch, self pairs left out."""
    w = order()
    pairs = points.select("sample_id", F.struct(*"xyz").alias("p"), F.when(F.lead("pos").over(w).isNotNull(), F.struct(*(F.lead(c).over(w).alias(c) for c in "xyz"))).alias("q")).where("q IS NOT NULL AND p <> q")
    return pairs.select("sample_id", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()


def branches_of_point(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sample_id, x, y, z, edge_id) for every branch that holds a wanted point, by exact equality."""
    return points.select("sample_id", *"xyz", "edge_id").distinct().join(wanted.select("sample_id", *"xyz").distinct(), ["sample_id", *"xyz"])
