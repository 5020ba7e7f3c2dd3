"""Sparse volumes: voxels(image_id, x, y, z, value); an absent row is background 0.

Neighbourhood operators explode constant offsets and group by the target voxel, so they shuffle by voxel and
a single large image spreads over all partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import written
from . import labels
from .blocks import by_blocks, largest, median
from .distances import distance

KEYS = ["image_id", "x", "y", "z"]
OFFSETS26 = [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if (dx, dy, dz) != (0, 0, 0)]
OFFSETS8 = [o for o in OFFSETS26 if o[2] == 0]
OFFSETS6 = [o for o in OFFSETS26 if sum(map(abs, o)) == 1]
OFFSETS4 = [o for o in OFFSETS6 if o[2] == 0]


def offsets_column(offsets) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a, b, c in offsets))).alias("_o")


def shifted(voxels: DataFrame, offsets, *columns: str) -> DataFrame:
    """Each voxel once at each of its neighbours' places."""
    moved = voxels.select("image_id", *"xyz", *columns, offsets_column(offsets))
    return moved.select("image_id", *((F.col(c) + F.col(f"_o.d{c}")).alias(c) for c in "xyz"), *columns, "_o")


def voxel_id(dims: tuple[int, int, int]) -> Column:
    """Linear index of x, y, z in C order."""
    return ((F.col("x").cast("long") * dims[1] + F.col("y")) * dims[2] + F.col("z")).cast("long")


def adjacency(voxels: DataFrame, offsets=OFFSETS26) -> DataFrame:
    """(image_id, x, y, z, x2, y2, z2): undirected neighbour pairs of foreground voxels, by half of the offsets."""
    half = [o for o in offsets if o > (0, 0, 0)]
    near = shifted(voxels.select(*KEYS), half).select("image_id", *((F.col(c) - F.col(f"_o.d{c}")).alias(c) for c in "xyz"), *(F.col(c).alias(f"{c}2") for c in "xyz"))
    there = voxels.select("image_id", *(F.col(c).alias(f"{c}2") for c in "xyz"))
    return near.join(there, ["image_id", "x2", "y2", "z2"], "left_semi").select(*KEYS, "x2", "y2", "z2")


def neighbour_counts(voxels: DataFrame, offsets=OFFSETS26) -> DataFrame:
    """voxels with their number of foreground neighbours."""
    n = shifted(voxels.select(*KEYS), offsets).groupBy(*KEYS).agg(F.count("*").alias("n"))
    return voxels.join(n, KEYS, "left").na.fill(0, ["n"])


def label(voxels: DataFrame, dims, offsets=OFFSETS26) -> DataFrame:
    """voxels with `component`, the smallest linear index of the connected voxels; labelled within blocks, then over block faces."""
    return labels.label(voxels, dims, offsets)


def remove_small_objects(voxels: DataFrame, dims, min_size: int, offsets=OFFSETS26) -> DataFrame:
    named = written(label(voxels, dims, offsets), "labels")
    big = named.groupBy("image_id", "component").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_size)
    return named.join(big, ["image_id", "component"], "left_semi").drop("component")


def dense(voxels: DataFrame, dims, value: str = "value") -> DataFrame:
    """Every voxel of each image's grid; absent ones are 0."""
    nx, ny, nz = dims
    grid = voxels.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("x"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(nz - 1))).alias("z"))
    return grid.join(voxels.select(*KEYS, value), KEYS, "left").na.fill(0, [value])


def fill_holes(voxels: DataFrame, dims, max_size: int, planar: bool = False) -> DataFrame:
    """Foreground with background components of under max_size voxels added; planar: plane by plane."""
    v = voxels.select(*KEYS)
    return v.unionByName(labels.small_holes(v, dims, OFFSETS4 if planar else OFFSETS6, max_size))


def box(size: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    rx, ry, rz = (s // 2 for s in size)
    return [(a, b, c) for a in range(-rx, rx + 1) for b in range(-ry, ry + 1) for c in range(-rz, rz + 1)]


def inside(dims) -> Column:
    return F.col("x").between(0, dims[0] - 1) & F.col("y").between(0, dims[1] - 1) & F.col("z").between(0, dims[2] - 1)


def closing(voxels: DataFrame, dims, size=(3, 3, 3)) -> DataFrame:
    """Dilation by a box, then erosion: a voxel stays if all of its box that lies in the volume is dilated. The cost does not grow with the box."""
    reach = tuple(2 * (s // 2) for s in size)
    return by_blocks(voxels.withColumn("_one", F.lit(1)), largest(size, then_least=True), reach, dims, "_one").select(*KEYS)


def maximum_filter(voxels: DataFrame, dims, size=(5, 5, 3), value: str = "value") -> DataFrame:
    """Largest value of a box, absent voxels being 0; places of value 0 are no rows. The cost does not grow with the box."""
    kind = voxels.schema[value].dataType.simpleString()
    out = by_blocks(voxels, largest(size), tuple(s // 2 for s in size), dims, value)
    return out.select(*KEYS, F.col("value").cast(kind).alias(value))


def median_filter(voxels: DataFrame, dims, size=(3, 3, 1), value: str = "value") -> DataFrame:
    """Median of a box with reflected edges; the upper of two middle values. Block by block: only blocks that have voxels are visited."""
    kind = voxels.schema[value].dataType.simpleString()
    out = by_blocks(voxels, median(size), tuple(s // 2 for s in size), dims, value)
    return out.select(*KEYS, F.col("value").cast(kind).alias(value))


def gaussian_weights(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def convolve(voxels: DataFrame, dims, axis: int, weights: list[float], value: str = "value") -> DataFrame:
    """One-dimensional pass with border values repeated: what a border voxel adds beyond the border falls on itself."""
    c, n, radius = "xyz"[axis], dims[axis], len(weights) // 2
    taps = F.explode(F.array(*(F.struct(F.lit(k - radius).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(weights)))).alias("_t")
    # target t sees source clamp(t + k); a source s is seen from t = s - k, and a border source also from all t beyond
    reach = voxels.select(*KEYS, value, taps).select(*KEYS, value, "_t.k", "_t.w")
    t = F.col(c) - F.col("k")
    span = F.when((F.col(c) == 0) & (F.col("k") < 0), F.sequence(F.lit(0), F.least(-F.col("k"), F.lit(n - 1)))).when((F.col(c) == n - 1) & (F.col("k") > 0), F.sequence(F.greatest(F.lit(n - 1) - F.col("k"), F.lit(0)), F.lit(n - 1))).otherwise(F.array(t))
    moved = reach.withColumn("_x", F.explode(span)).withColumn(c, F.col("_x")).where(F.col(c).between(0, n - 1))
    return moved.groupBy(*KEYS).agg(F.sum(F.col(value) * F.col("w")).alias(value))


def gaussian_smooth(voxels: DataFrame, dims, sigma: float, three_d: bool = True, value: str = "value") -> DataFrame:
    """Separable Gaussian smoothing; all weights are positive and sum to 1, so min-max scaling before and after cancels out."""
    out = voxels.select(*KEYS, F.col(value).cast("double").alias(value))
    for axis in range(3 if three_d else 2):
        out = convolve(out, dims, axis, gaussian_weights(sigma), value)
    return out


def plane_distance(voxels: DataFrame, dims, pix=(1.0, 1.0)) -> DataFrame:
    """(keys, dist): exact Euclidean distance of each foreground voxel to the nearest background voxel of its plane; planes without background have null."""
    return distance(voxels, dims, pix)


def vessel_diameters(voxels: DataFrame, dims, pix=(1.0, 1.0), scale: float = 100.0) -> DataFrame:
    """Distance map in hundredths, as integers without wrapping, then its maximum over a 5 x 5 x 3 box."""
    d = plane_distance(voxels, dims, pix).select(*KEYS, F.floor(F.col("dist") * scale).cast("long").alias("value"))
    return maximum_filter(d, dims)


def clean_up(voxels: DataFrame, dims, threshold: float, min_object: int, hole: int = 500, median=(3, 3, 1), close: bool = True) -> DataFrame:
    """Median, threshold, small objects out, holes filled in space and then plane by plane, closing."""
    m = median_filter(voxels, dims, median).where(F.col("value") > threshold).select(*KEYS)
    out = remove_small_objects(written(m, "median"), dims, min_object)
    out = fill_holes(written(out, "objects"), dims, hole)
    out = fill_holes(written(out, "filled"), dims, hole, planar=True)
    return closing(written(out, "planes"), dims) if close else out


def endpoints(voxels: DataFrame) -> DataFrame:
    return neighbour_counts(voxels).where("n = 1").select(*KEYS)


def outline(voxels: DataFrame) -> DataFrame:
    """Voxels of which a 4-neighbour in the plane has another value, absent and outside counting as other."""
    same = shifted(voxels, OFFSETS4, "value").groupBy(*KEYS, "value").agg(F.count("*").alias("n"))
    hit = voxels.select(*KEYS, "value").join(same, [*KEYS, "value"], "left")
    return hit.where(F.coalesce("n", F.lit(0)) < 4).select(*KEYS, "value")


def tile_grid(volumes: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(image_id, tile_id, ox, oy): a regular grid; dimensions must be multiples of the tile's."""
    w, h = size
    good = F.when((F.col("nx") % w != 0) | (F.col("ny") % h != 0), F.raise_error("image is not a multiple of the tile")).otherwise(F.col("nx")).cast("int")
    t = volumes.select("image_id", "nx", "ny", good.alias("_n")).select("image_id", "ny", F.explode(F.expr(f"sequence(0, _n - 1, {w})")).alias("ox")).select("image_id", "ox", F.explode(F.expr(f"sequence(0, ny - 1, {h})")).alias("oy"))
    return t.select("image_id", F.concat_ws("_", "ox", "oy").alias("tile_id"), "ox", "oy")


def strided_tiles(voxels: DataFrame, dims, tile: tuple[int, int], stride: tuple[int, int]) -> DataFrame:
    """Each voxel once in every overlapping tile that covers it: (image_id, ox, oy, tx, ty, z, value)."""
    out = voxels
    for c, o, t, s, n in zip("xy", ("ox", "oy"), tile, stride, dims):
        first = F.greatest(F.lit(0), F.ceil((F.col(c) - t + 1) / s).cast("int"))
        last = F.least(F.lit((n - t) // s), F.floor(F.col(c) / s).cast("int"))
        out = out.withColumn("_f", first).withColumn("_l", last).where("_f <= _l").withColumn(o, F.explode(F.sequence("_f", "_l"))).withColumn(o, F.col(o) * s).drop("_f", "_l")
    return out.select("image_id", "ox", "oy", (F.col("x") - F.col("ox")).alias("tx"), (F.col("y") - F.col("oy")).alias("ty"), "z", "value")


def reassemble(tiles: DataFrame) -> DataFrame:
    """Average of all tiles over a voxel; voxels under no tile are absent."""
    v = tiles.select("image_id", (F.col("ox") + F.col("tx")).alias("x"), (F.col("oy") + F.col("ty")).alias("y"), "z", "value")
    return v.groupBy(*KEYS).agg(F.avg("value").alias("value"))


def tiles_with_content(tiles: DataFrame, area: int, rate: float = 0.01, level: float = 0.8) -> DataFrame:
    """Tiles with more than min(rate * area, 1000) values above a level."""
    n = tiles.groupBy("image_id", "ox", "oy").agg(F.sum((F.col("value") > level).cast("long")).alias("n"))
    return n.where(F.col("n") > min(rate * area, 1000)).select("image_id", "ox", "oy")


def line_voxels(lines: DataFrame) -> DataFrame:
    """Voxels of straight lines (keys ..., x1..z1, x2..z2), one for each step along the longest axis."""
    delta = {c: F.col(f"{c}2") - F.col(f"{c}1") for c in "xyz"}
    dom = F.greatest(*(F.abs(v) for v in delta.values()))
    steps = lines.withColumn("_d", dom).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_d"))))
    move = lambda c: F.when(F.col("_d") == 0, 0).otherwise(F.floor((2 * F.col("_i") * F.abs(delta[c]) + F.col("_d")) / (2 * F.col("_d"))) * F.signum(delta[c]))
    keep = [c for c in lines.columns if c[:-1] not in ("x", "y", "z")]
    return steps.select(*keep, F.col("_i").alias("i"), *((F.col(f"{c}1") + move(c)).cast("int").alias(c) for c in "xyz"))


def skeleton_raster(line: DataFrame, pix=(1.0, 1.0, 1.0)) -> DataFrame:
    """Smoothed points as a set of voxels."""
    return line.select("sample_id", *(F.floor(F.col(c) / p).cast("int").alias(c) for c, p in zip("xyz", pix))).distinct()


def swc_raster(swc: DataFrame, dims, n: int = 50, keys: list[str] = ()) -> DataFrame:
    """(keys, x, y, z): n points on each parent edge, cut to integers inside the volume; parents are found by id among the nodes of the same keys, such as the file."""
    keys = list(keys)
    up = swc.select(*keys, F.col("id").alias("parent"), *(F.col(c).alias(f"{c}p") for c in "xyz"))
    pairs = swc.where("parent > -1").join(up, [*keys, "parent"]).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_t", F.col("_t") / (n - 1))
    at = lambda c, m: F.least(F.greatest((F.col(c) + (F.col(f"{c}p") - F.col(c)) * F.col("_t")).cast("int"), F.lit(0)), F.lit(m - 1)).alias(c)
    return pairs.select(*keys, *(at(c, m) for c, m in zip("xyz", dims))).distinct()


def combine_skeleton(skeleton: DataFrame, segmentation: DataFrame) -> DataFrame:
    """skeleton / max(segmentation) * segmentation, voxel by voxel; the maximum is one number for each image."""
    most = segmentation.groupBy("image_id").agg(F.max("value").alias("_m"))
    s = skeleton.select(*KEYS, F.col("value").alias("_s")).join(segmentation.select(*KEYS, "value"), KEYS).join(most, "image_id")
    return s.select(*KEYS, (F.col("_s") / F.col("_m") * F.col("value")).alias("value"))


def gradient(grid: DataFrame, axis: str, value: str = "value") -> DataFrame:
    """First derivative on a dense grid: central inside, one-sided at the borders."""
    w = Window.partitionBy("image_id", *(c for c in "xyz" if c != axis)).orderBy(axis)
    nxt, prev = F.lead(value).over(w), F.lag(value).over(w)
    d = F.when(prev.isNull() & nxt.isNull(), 0.0).when(prev.isNull(), nxt - F.col(value)).when(nxt.isNull(), F.col(value) - prev).otherwise((nxt - prev) / 2)
    return grid.select(*KEYS, d.alias(value))


# -- projections

def binarise(voxels: DataFrame, level: float = 127) -> DataFrame:
    return voxels.where(F.col("value") >= level).withColumn("value", F.lit(255))


def above(voxels: DataFrame, level: float) -> DataFrame:
    return voxels.where(F.col("value") > level)


def to_eight_bit(value: Column) -> Column:
    return F.least(F.lit(255), F.round(F.abs(255 * value))).cast("int")


def header_scale(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """slope * value + inter where the slope is not 0 and the pair not (1, 0)."""
    s = volumes.select("image_id", "slope", "inter")
    on = (F.col("slope") != 0) & ~((F.col("slope") == 1) & (F.col("inter") == 0))
    return voxels.join(s, "image_id").withColumn("value", F.when(on, F.col("slope") * F.col("value") + F.col("inter")).otherwise(F.col("value"))).drop("slope", "inter")


def normalise(value: Column, how: str = "scale") -> Column:
    if how == "scale":
        return value / 255
    if how == "none":
        return value
    if how == "binarize":
        return (value / 255 >= 0.5).cast("double")
    if how == "tanh":
        return (value - 127.5) / 127.5
    raise ValueError(f"unknown normalisation {how}")


def flip(voxels: DataFrame, axis: str, n: int) -> DataFrame:
    return voxels.withColumn(axis, F.lit(n - 1) - F.col(axis))


VIEWS = {"axial": "yxz", "coronal": "yzx", "sagittal": "zyx"}


def to_view(voxels: DataFrame, dims, view: str) -> DataFrame:
    """Axes permuted to a view, then z flipped."""
    if view not in VIEWS:
        raise ValueError(f"unknown view {view}")
    order = VIEWS[view]
    out = voxels.select("image_id", *(F.col(c).alias(n) for n, c in zip("xyz", order)), "value")
    return flip(out, "z", dims["xyz".index(order[2])])


def reorient(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Axes permuted and flipped by each volume's `axes` (e.g. [1, 0, 2]) and `flips`; the inverse uses the inverse permutation."""
    v = voxels.join(volumes.select("image_id", "axes", "flips", F.array("nx", "ny", "nz").alias("_n")), "image_id")
    at = F.array(*"xyz")
    new = lambda k: (lambda a: F.when(F.get("flips", F.lit(k)), F.get("_n", a) - 1 - F.get(at, a)).otherwise(F.get(at, a)))(F.get("axes", F.lit(k)))
    return v.select("image_id", *(new(k).alias(c) for k, c in enumerate("xyz")), "value")


def clip_sides(voxels: DataFrame, dims, lo, hi) -> DataFrame:
    if any(a < 0 or b < 0 or a + b >= n for a, b, n in zip(lo, hi, dims)):
        raise ValueError("clipping leaves nothing")
    out = voxels
    for c, a, b, n in zip("xyz", lo, hi, dims):
        out = out.where(F.col(c).between(a, n - 1 - b)).withColumn(c, F.col(c) - a)
    return out


def pad_sides(voxels: DataFrame, dims, lo, hi, fill: float = 0) -> DataFrame:
    """Voxels moved by the padding; a fill other than 0 adds the rows of the margin."""
    out = voxels.select("image_id", *((F.col(c) + a).alias(c) for c, a in zip("xyz", lo)), F.col("value"))
    if not fill:
        return out
    wide = [a + n + b for a, n, b in zip(lo, dims, hi)]
    grid = dense(voxels.select("image_id", *(F.lit(0).alias(c) for c in "xyz"), F.lit(0).alias("value")).distinct(), wide)
    outside = ~(F.col("x").between(lo[0], lo[0] + dims[0] - 1) & F.col("y").between(lo[1], lo[1] + dims[1] - 1) & F.col("z").between(lo[2], lo[2] + dims[2] - 1))
    return out.unionByName(grid.where(outside).select(*KEYS, F.lit(fill).alias("value")))


def decimate(voxels: DataFrame, factors=(2, 2, 1)) -> DataFrame:
    out = voxels
    for c, f in zip("xyz", factors):
        out = out.where(F.col(c) % f == 0).withColumn(c, F.expr(f"int({c} div {f})"))
    return out


def pick_channels(voxels: DataFrame, channels: list[int]) -> DataFrame:
    """The given channels, numbered in the given order."""
    new = F.coalesce(*(F.when(F.col("channel") == c, i) for i, c in enumerate(channels)))
    return voxels.where(F.col("channel").isin(channels)).withColumn("channel", new)


def pick_frames(voxels: DataFrame, frames: list[int], n: int) -> DataFrame:
    if len(set(frames)) != len(frames) or any(not 0 <= f < n for f in frames):
        raise ValueError("frames must be different and in range")
    return voxels.where(F.col("t").isin(frames))


def crop(voxels: DataFrame, lo=(0, 0, 10), hi=(256, 256, 13)) -> DataFrame:
    out = voxels
    for c, a, b in zip("xyz", lo, hi):
        out = out.where((F.col(c) >= a) & (F.col(c) < b))
    return out


def exceeds(value: Column, level: float) -> Column:
    return (value > level).cast("int")


# -- aggregates over volumes

def sample_at_points(points: DataFrame, voxels: DataFrame) -> DataFrame:
    """points(image_id, ...) with the volume's value at each, 0 where there is none."""
    return points.join(voxels.select(*KEYS, "value"), KEYS, "left").na.fill(0, ["value"])


def branch_perfusion(points: DataFrame, voxels: DataFrame) -> DataFrame:
    s = sample_at_points(points, voxels)
    return s.groupBy("image_id", "edge_id").agg(F.max("value").alias("max"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.min("value").alias("min"))


def vessel_density(tumour: DataFrame, vessel: DataFrame, voxel_volume: float = 1.0, level: float = 5.0) -> DataFrame:
    """Shares and volumes; a voxel that is both tumour and vessel counts in both parts of the total."""
    t = tumour.groupBy("image_id").agg(F.sum((F.col("value") > level).cast("long")).alias("tumour"))
    v = vessel.groupBy("image_id").agg(F.sum((F.col("value") > 0).cast("long")).alias("vessel"))
    both = t.join(v, "image_id", "full").na.fill(0)
    total = F.col("tumour") + F.col("vessel")
    return both.select("image_id", "tumour", "vessel", F.when(total > 0, F.col("vessel") / total).alias("density"), (F.col("vessel") * voxel_volume).alias("vessel_volume"), (total * voxel_volume).alias("total_volume"))


def channel_moments(voxels: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Mean and population deviation over n voxels, of which the absent ones are zeros."""
    return voxels.groupBy(*keys).agg((F.sum("value") / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("value") * F.col("value")) / n - (F.sum("value") / n) ** 2)).alias("std"))


def whiten(voxels: DataFrame, keys: list[str], n: int, eps: float = 1e-7) -> DataFrame:
    """(value - mean) / (std + eps) of the voxels that are there."""
    return voxels.join(channel_moments(voxels, keys, n), keys).withColumn("value", (F.col("value") - F.col("mean")) / (F.col("std") + eps)).drop("mean", "std")


def value_range(voxels: DataFrame, n: int) -> DataFrame:
    """Least and largest value, with an implicit 0 where voxels are absent."""
    per = voxels.groupBy("image_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("_n"))
    zero = F.when(F.col("_n") < n, F.lit(0))
    return per.select("image_id", F.least("lo", zero).alias("lo"), F.greatest("hi", zero).alias("hi"))


def overlay(voxels: DataFrame) -> DataFrame:
    """(image_id, x, y, value, class): the sum along z of a mask's voxels, and 2 where a voxel with over one neighbour lies there, else 1 where one with one does, else 0."""
    n = neighbour_counts(voxels.select(*KEYS).withColumn("value", F.lit(1)))
    kind = F.max(F.when(F.col("n") > 1, 2).when(F.col("n") == 1, 1).otherwise(0))
    return n.groupBy("image_id", "x", "y").agg(F.sum("value").alias("value"), kind.alias("class"))


def projection(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("image_id", "x", "y").agg(F.sum("value").alias("value"))


def block_reduce(voxels: DataFrame, size: int = 5, how: str = "mean") -> DataFrame:
    """Blocks of z slices: the mean over all slices, absent ones being 0, or the maximum."""
    f = F.sum("value") / size if how == "mean" else F.max("value")
    return voxels.groupBy("image_id", "x", "y", F.expr(f"int(z div {size})").alias("z")).agg(f.alias("value"))


# -- thinning

#: Bits of the 26 neighbours of a voxel in z, y, x order.
BITS = {o: i for i, o in enumerate(OFFSETS26)}


def neighbour_code(voxels: DataFrame) -> DataFrame:
    """voxels with `code`, one bit for each foreground neighbour."""
    moved = shifted(voxels.select(*KEYS), [tuple(-v for v in o) for o in OFFSETS26])
    bit = F.coalesce(*(F.when((F.col("_o.dx") == -o[0]) & (F.col("_o.dy") == -o[1]) & (F.col("_o.dz") == -o[2]), 1 << i) for o, i in BITS.items()))
    codes = moved.select(*KEYS, bit.alias("bit")).groupBy(*KEYS).agg(F.sum("bit").alias("code"))
    return voxels.join(codes, KEYS, "left").na.fill(0, ["code"])


def decode_code(code: Column) -> Column:
    """Offsets of the set bits of a neighbour code."""
    return F.filter(F.array(*(F.when(code.bitwiseAND(1 << i) != 0, F.struct(*(F.lit(v).alias(f"d{c}") for c, v in zip("xyz", o)))) for o, i in BITS.items())), lambda s: s.isNotNull())

