"""Ranks over a whole table without a window that one task would hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import written

_BITS = 33  # bits of monotonically_increasing_id that count rows within a partition


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """rows with their place, from 0, in the order of all of them.

    A range sort deals the rows over partitions and is written; what counts before a partition is a table of one row a partition.
    """
    out = written(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_m", _BITS)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = out.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).select("_p", before.alias("_before"))
    placed = out.withColumn("_p", part).join(F.broadcast(parts), "_p")  # a row for each partition of the sort
    return placed.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << _BITS) - 1))).drop("_m", "_p", "_before")


def running(rows: DataFrame, order: list, n: str, name: str) -> DataFrame:
    """rows with the sum of n over all rows before them, in an order without ties."""
    out = written(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", _BITS)), "running")
    until = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = out.groupBy("_p").agg(F.sum(n).alias("_n")).select("_p", until(Window.orderBy("_p"), "_n").alias("_first"))
    within = out.withColumn("_within", until(Window.partitionBy("_p").orderBy("_m"), n)).join(F.broadcast(parts), "_p")  # a row for each partition of the sort
    return within.withColumn(name, F.col("_first") + F.col("_within")).drop("_m", "_p", "_first", "_within")


def ranked_within(rows: DataFrame, keys: list[str], order: list, name: str = "rank", size: str = "size") -> DataFrame:
    """rows with their place among those of the same keys, from 0, and the number of these.

    A range sort over keys and order together deals a key's rows over as many partitions as they need; a key's first place and its number of rows are
    one row a key.
    """
    placed = ranked(rows, [*keys, *order], "_place")
    per = placed.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys))).agg(F.min("_place").alias("_first"), F.count("*").alias(size))
    per = written(per, "firsts")
    same = None
    for i, k in enumerate(keys):
        one = F.col(k).eqNullSafe(F.col(f"_key{i}"))
        same = one if same is None else same & one
    return placed.join(per, same).withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first", *(f"_key{i}" for i in range(len(keys))))
