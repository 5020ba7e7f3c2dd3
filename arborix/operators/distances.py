"""Exact Euclidean distance maps by lower envelopes, one axis after the other.

Only foreground voxels are rows; what is absent is background, at distance 0. A pass takes slabs of SLAB lines along an axis and
replaces each voxel's squared distance by the least of all parabolas of its line, found as their lower envelope in time linear in the line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLAB = 64


def envelope(f, step: float):
    """Along the first axis of f the least of f[j] + (step * (i - j)) ** 2 over all j, for every i; infinite where a line has no finite value."""
    import numpy as np

    n, lines = f.shape
    apex, edge, top = np.zeros((n, lines), np.int64), np.full((n + 1, lines), np.inf), np.full(lines, -1)
    all_ = np.arange(lines)
    for q in range(n):
        todo = np.flatnonzero(np.isfinite(f[q]))
        meet = np.full(lines, -np.inf)
        while len(todo):
            todo = todo[top[todo] >= 0]
            p = apex[top[todo], todo]
            at = (f[q, todo] - f[p, todo] + step * step * (q * q - p * p)) / (2 * step * step * (q - p))
            under = at <= edge[top[todo], todo]
            meet[todo] = np.where(under, -np.inf, at)
            todo = todo[under]
            top[todo] -= 1
        new = np.flatnonzero(np.isfinite(f[q]))
        top[new] += 1
        apex[top[new], new] = q
        edge[top[new], new] = meet[new]
        edge[top[new] + 1, new] = np.inf
    out, here = np.full((n, lines), np.inf), np.zeros(lines, np.int64)
    some = top >= 0
    for i in range(n):
        while (on := some & (edge[np.minimum(here + 1, n), all_] < i)).any():
            here[on] += 1
        p = apex[here, all_]
        out[i] = np.where(some, f[p, all_] + (step * (i - p)) ** 2, np.inf)
    return out


def _pass(axis: str, across: str, length: int, step: float):
    def slab(key, table):
        import numpy as np
        import pyarrow as pa

        at = table[axis].to_numpy()
        line = table[across].to_numpy() % SLAB
        f = np.zeros((length, SLAB))
        f[at, line] = table["sq"].fill_null(np.inf).to_numpy()
        sq = envelope(f, step)[at, line]
        return table.select(["image_id", "x", "y", "z"]).append_column("sq", pa.array(sq, mask=np.isinf(sq)))

    return slab


def distance(voxels: DataFrame, dims, pix=(1.0, 1.0)) -> DataFrame:
    """(keys, dist): distance of each foreground voxel to the nearest background voxel; two voxel sides measure within planes, three in space. Null where there is no background."""
    kind = voxels.schema["image_id"].dataType.simpleString()
    out = voxels.select("image_id", *(F.col(c).cast("int").alias(c) for c in "xyz"), F.lit(None).cast("double").alias("sq"))
    for k, step in enumerate(pix):
        axis = "xyz"[k]
        across, third = [c for c in "xyz" if c != axis]
        run = _pass(axis, across, dims[k], float(step))
        out = out.groupBy("image_id", F.floor(F.col(across) / SLAB).alias("_slab"), F.col(third).alias("_third")).applyInArrow(run, f"image_id {kind}, x int, y int, z int, sq double")
    return out.select("image_id", *"xyz", F.sqrt("sq").alias("dist"))
