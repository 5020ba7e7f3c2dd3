"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import drop, written

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, keys: list[str] = (), u: str = "u", v: str = "v") -> DataFrame:
    """(keys, node, component): component is the smallest node id reachable, for every node of an edge.

    Alternates large-star and small-star rounds, which needs about log(n) rounds even on paths. A
    star centre with very many leaves is an ordinary skewed equi-join, which adaptive execution
    splits. Every round is written to the shared folder; self loops keep their node. Rows with a null end
    are ignored.
    """
    keys = list(keys)
    e = edges.select(*keys, F.col(u).alias("u"), F.col(v).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    now = written(e.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(MAX_ROUNDS):
        # large star: larger neighbours move to the smallest of the neighbourhood
        both = now.select(*keys, "u", "v").union(now.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v >= u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select(*keys, "u", F.col("m").alias("v"))).distinct()
        after = written(small, "cc")
        n, links, total = after.agg(F.count("*"), F.sum((F.col("u") != F.col("v")).cast("long")), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now = after
        if before == (n, links, total):
            break
        before = (n, links, total)
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(*keys, F.col("u").alias("node")).agg(F.min("v").alias("component"))


def roots(links: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, node, root) of a forest links(keys, node, parent): where following parents ends. A root's parent is itself, or it has no row.

    Every round doubles how far a node sees, and is written; the depth of the forest costs its logarithm.
    """
    keys = list(keys)
    now = written(links.select(*keys, "node", F.col("parent").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        up = now.where("node <> root").select(*keys, F.col("node").alias("root"), F.col("root").alias("_up"))
        after = written(now.join(up, [*keys, "root"], "left").select(*keys, "node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")), "roots")
        moved = after.where("_moved").limit(1).count()
        drop(now)
        now = after
        if not moved:
            return now.select(*keys, "node", "root")
    raise RuntimeError("roots did not settle")
