"""Blocks with a halo: operators on dense neighbourhoods run on one bounded array at a time.

Voxels are dealt into blocks of a fixed size; each block also gets the voxels up to `halo` beyond its sides. A block is
one group, whose size follows from the block and the halo, not from the image. Blocks without any voxel do not exist.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sides of a block.
SIDES = (64, 64, 32)
BLOCK = ["image_id", "bx", "by", "bz"]


def with_block(voxels: DataFrame, sides=SIDES) -> DataFrame:
    """voxels with the block that each is in."""
    return voxels.select("*", *(F.floor(F.col(c) / side).cast("int").alias(f"b{c}") for c, side in zip("xyz", sides)))


def over_blocks(voxels: DataFrame, run: Callable, halo: tuple[int, int, int], columns: str, dims: tuple[int, int, int] | None = None, value: str | None = "value", sides=SIDES, only: DataFrame | None = None) -> DataFrame:
    """(image_id, columns) of run(array, low, high, origin) for every block, or for those of only(image_id, bx, by, bz); columns are types of a schema.

    run gets the values of a block with its halo, cut at the volume's sides if dims are given, the block's own corners within that array, and the
    place of the array's first corner; it gives an array for each column. Without a value the array is a mask. Blocks outside of dims do not run.
    """
    kind = voxels.schema["image_id"].dataType.simpleString()
    out = voxels.select("image_id", *(F.col(c).cast("int").alias(c) for c in "xyz"), *([F.col(value).cast("double").alias("value")] if value else []))
    for k, (c, side, h) in enumerate(zip("xyz", sides, halo)):
        near, far = (F.floor(p / side).cast("int") for p in (F.col(c) - h, F.col(c) + h))
        if dims:
            out = out.where(F.col(c).between(0, dims[k] - 1))
            near, far = F.greatest(near, F.lit(0)), F.least(far, F.lit((dims[k] - 1) // side))
        out = out.withColumn(f"b{c}", F.explode(F.sequence(near, far)))
    if only is not None:
        out = out.join(only, BLOCK, "left_semi")

    def block(key, table):
        import numpy as np
        import pyarrow as pa

        first = [k.as_py() * s for k, s in zip(key[1:], sides)]
        last = [f + s for f, s in zip(first, sides)]
        lo, hi = [f - h for f, h in zip(first, halo)], [f + h for f, h in zip(last, halo)]
        if dims:
            lo = [max(0, v) for v in lo]
            last, hi = ([min(n, v) for v, n in zip(vs, dims)] for vs in (last, hi))
        array = np.zeros([b - a for a, b in zip(lo, hi)], float if value else bool)
        array[tuple(table[c].to_numpy() - a for c, a in zip("xyz", lo))] = table["value"].to_numpy() if value else True
        found = run(array, [f - a for f, a in zip(first, lo)], [e - a for e, a in zip(last, lo)], lo)
        return pa.table({"image_id": pa.repeat(key[0], len(found[0]))} | dict(zip(names, found)))

    names = [c.split()[0] for c in columns.split(", ")]
    return out.groupBy(*BLOCK).applyInArrow(block, f"image_id {kind}, {columns}")


def by_blocks(voxels: DataFrame, run: Callable, halo: tuple[int, int, int], dims: tuple[int, int, int] | None = None, value: str | None = "value", sides=SIDES, only: DataFrame | None = None) -> DataFrame:
    """(image_id, x, y, z, value) of run(array, low, high) for every block, or for those of only: as over_blocks(), but run gives an array of the block's own
    shape, of which the values other than 0 become rows."""

    def rows(array, low, high, origin):
        import numpy as np

        own = run(array, low, high)
        places = np.nonzero(own)
        return [*((p + a + o).astype(np.int32) for p, a, o in zip(places, low, origin)), own[places].astype(float)]

    return over_blocks(voxels, rows, halo, "x int, y int, z int, value double", dims, value, sides, only)


def running_largest(array, size: int, axis: int):
    """Largest of `size` neighbours along an axis, what lies beyond the array being less than all: within fixed runs of that length
    the maxima from the left and from the right, of which each window needs one of either."""
    import numpy as np

    if size == 1:
        return array
    lines = np.moveaxis(array, axis, -1)
    n, half = lines.shape[-1], size // 2
    runs = -(-(n + 2 * half) // size)
    wide = np.full((*lines.shape[:-1], runs * size), -np.inf)
    wide[..., half : half + n] = lines
    wide = wide.reshape(*lines.shape[:-1], runs, size)
    left = np.maximum.accumulate(wide, axis=-1).reshape(*lines.shape[:-1], -1)
    right = np.maximum.accumulate(wide[..., ::-1], axis=-1)[..., ::-1].reshape(*lines.shape[:-1], -1)
    return np.moveaxis(np.maximum(right[..., :n], left[..., 2 * half : 2 * half + n]), -1, axis)


def largest(size: tuple[int, int, int], then_least: bool = False) -> Callable:
    """Largest value of a box of odd sides; then_least: the least of those in turn, which needs twice the halo."""

    def run(array, low, high):
        for axis, s in enumerate(size):
            array = running_largest(array, s, axis)
        if then_least:
            for axis, s in enumerate(size):
                array = -running_largest(-array, s, axis)
        return array[tuple(slice(lo, hi) for lo, hi in zip(low, high))]

    return run


def box_counts(mask, size: tuple[int, int, int]):
    """How many places of a mask are set in each box that lies wholly in it, by running sums along each axis; the cost does not depend on the box."""
    import numpy as np

    out = mask.astype(np.int32)
    for axis, n in enumerate(size):
        if n > 1:
            sums = np.cumsum(out, axis=axis, dtype=np.int32)
            upper = np.take(sums, range(n - 1, sums.shape[axis]), axis=axis)
            lower = np.take(sums, range(sums.shape[axis] - n), axis=axis)
            rest = [slice(None)] * out.ndim
            rest[axis] = slice(1, None)
            upper[tuple(rest)] -= lower
            out = upper
    return out


def median(size: tuple[int, int, int]) -> Callable:
    """Median of a box with reflected edges; the upper of two middle values. A box of even size reaches one place farther back than ahead.

    Where a block has fewer different values than a box has places, as masks and bytes have, each value is counted in all boxes at once, which costs the same
    whatever the box; else the places of each box are partitioned.
    """

    def run(array, low, high):
        import numpy as np

        reach = [s // 2 for s in size]
        # what the array lacks of the box lies beyond the volume's sides
        wide = np.pad(array, [(max(0, r - lo), max(0, r - (n - hi))) for r, lo, hi, n in zip(reach, low, high, array.shape)], mode="symmetric")
        begin = [max(0, lo - r) for lo, r in zip(low, reach)]
        wide = wide[tuple(slice(b, b + hi - lo + n - 1) for b, lo, hi, n in zip(begin, low, high, size))]
        middle = size[0] * size[1] * size[2] // 2
        values = np.unique(wide)
        if len(values) <= size[0] * size[1] * size[2]:
            place = np.zeros([hi - lo for lo, hi in zip(low, high)], np.int32)
            for v in values[:-1]:  # the median is the first value that over half of the box does not exceed
                place += box_counts(wide <= v, size) <= middle
            return values[place]
        out = np.empty([hi - lo for lo, hi in zip(low, high)])
        for x in range(out.shape[0]):  # a plane at a time bounds the memory
            boxes = np.lib.stride_tricks.sliding_window_view(wide[x : x + size[0]], size)[0]
            out[x] = np.partition(boxes.reshape(*boxes.shape[:2], -1), middle, axis=-1)[..., middle]
        return out

    return run


def smoothed(array, sigma: float, axes):
    """Separable Gaussian smoothing with border values repeated."""
    import numpy as np

    from .voxels import gaussian_weights

    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    for axis in axes:
        wide = np.pad(array, [(radius, radius) if a == axis else (0, 0) for a in range(array.ndim)], mode="edge")
        n = array.shape[axis]
        array = sum(w * np.take(wide, range(k, k + n), axis=axis) for k, w in enumerate(weights))
    return array


def ridges(sigmas: list[float], alpha: float, beta: float, c: float, dark: bool, three_d: bool) -> Callable:
    """The largest vesselness over the scales, from the eigenvalues of the scaled Hessian; slices by themselves unless three_d."""

    def run(array, low, high):
        import numpy as np

        inner = tuple(slice(lo, hi) for lo, hi in zip(low, high))
        axes = [a for a in range(3 if three_d else 2)]
        best = None
        for s in sigmas:
            g = smoothed(array, s, axes)
            first = [np.gradient(g, axis=a) if array.shape[a] > 1 else np.zeros_like(g) for a in axes]
            h = np.empty((*(hi - lo for lo, hi in zip(low, high)), len(axes), len(axes)))
            for i in axes:
                for j in axes[i:]:
                    second = np.gradient(first[i], axis=j) if array.shape[j] > 1 else np.zeros_like(g)
                    h[..., i, j] = h[..., j, i] = second[inner] * s * s
            e = np.linalg.eigvalsh(h)
            e = np.take_along_axis(e, np.argsort(np.abs(e), axis=-1, kind="stable"), axis=-1)
            safe = lambda a, b: a / np.where(b == 0, 1e-10, b)
            strong = 1 - np.exp(-(e * e).sum(-1) / (2 * c * c))
            if three_d:
                plate, blob = safe(np.abs(e[..., 1]), np.abs(e[..., 2])), safe(np.abs(e[..., 0]), np.sqrt(np.abs(e[..., 1] * e[..., 2])))
                value = (1 - np.exp(-plate * plate / (2 * alpha * alpha))) * np.exp(-blob * blob / (2 * beta * beta)) * strong
                wrong = (e[..., 1:] < 0 if dark else e[..., 1:] > 0).any(-1)
            else:
                blob = safe(np.abs(e[..., 0]), np.abs(e[..., 1]))
                value = np.exp(-blob * blob / (2 * beta * beta)) * strong
                wrong = e[..., 1] < 0 if dark else e[..., 1] > 0
            value = np.nan_to_num(np.where(wrong, 0.0, value))
            best = value if best is None else np.maximum(best, value)
        return best

    return run


def box_means(size: int, passes: int, axes: tuple[int, ...]) -> Callable:
    """Repeated means of a box; what lies beyond the volume is 0 in every pass. The halo must be passes * (size // 2)."""

    def run(array, low, high):
        import numpy as np

        half = size // 2
        for _ in range(passes):
            for axis in axes:
                n = array.shape[axis]
                wide = np.pad(array, [(half, half) if a == axis else (0, 0) for a in range(3)])
                array = sum(np.take(wide, range(k, k + n), axis=axis) for k in range(size)) / size
        return array[tuple(slice(lo, hi) for lo, hi in zip(low, high))]

    return run
