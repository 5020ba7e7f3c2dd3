"""Joins of a few large rows with many small ones that hold one of each at a time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


def copies(df: DataFrame, n: int, name: str) -> DataFrame:
    """df once for each of 0 .. n - 1 (the column `name`), made by about sqrt(n) tasks."""
    root = max(1, math.isqrt(max(n, 1)))
    first = df.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(root - 1))))
    first = first.repartition(root, "_first") if root > 1 else first
    return first.withColumn(name, F.explode(F.expr(f"filter(sequence(_first, {max(n, 1) - 1}, {root}), i -> i < {n})"))).drop("_first")


def dealt(kinds: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of all tables (those of the first before those of the second and so on for each of the keys, `_kind` telling them apart), dealt by the keys and sorted by them.

    A task goes over them with what it holds of one key at a time; mapInArrow sees a key's rows one after the other.
    """
    small_batches(kinds[0].sparkSession)
    out = None
    for k, df in enumerate(kinds):
        df = df.withColumn("_kind", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.repartition(*keys).sortWithinPartitions(*keys, "_kind")


def runs(batches, keys: list[str]):
    """(key, kind, rows): runs of equal keys and kinds of sorted batches."""
    import numpy as np

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "_kind")]
        change = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if len(batch) > 1 else np.zeros(0, bool)
        for cut in np.split(np.arange(len(batch)), np.flatnonzero(change) + 1):
            if len(cut):
                yield tuple(c[cut[0]] for c in columns[:-1]), columns[-1][cut[0]], batch.slice(cut[0], len(cut))
