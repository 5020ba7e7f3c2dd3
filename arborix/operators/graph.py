"""Network tables: edges(sample_id, mask_id, edge_id, u, v, attributes), never a matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import written
from .components import connected_components

KEYS = ["sample_id", "mask_id"]
ATTRIBUTES = ["length", "diameter", "soam", "clr"]


def with_ghosts(edges: DataFrame, undirected: bool = False) -> DataFrame:
    """Of parallel branches all but the last are led over a ghost node of their own; both halves carry the whole attributes.

    Parallel means the same ordered node pair, or any order if undirected. A ghost's id is -(edge_id + 1).
    """
    a, b = (F.least("u", "v"), F.greatest("u", "v")) if undirected else (F.col("u"), F.col("v"))
    w = Window.partitionBy(*KEYS, "_a", "_b")
    marked = edges.withColumn("_a", a).withColumn("_b", b).withColumn("_ghost", F.row_number().over(w.orderBy("edge_id")) < F.count("*").over(w))
    ghost = -(F.col("edge_id") + 1)
    halves = F.when(F.col("_ghost"), F.array(F.struct(F.col("u").alias("u"), ghost.alias("v")), F.struct(ghost.alias("u"), F.col("v").alias("v")))).otherwise(F.array(F.struct("u", "v")))
    kept = [c for c in edges.columns if c not in ("u", "v")]
    return marked.select(*kept, "_ghost", F.explode(halves).alias("_h")).select(*kept, "_h.u", "_h.v", F.col("_ghost").alias("ghost"))


def ghost_points(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Coordinates of ghost nodes: the midpoint moved by 0.05 |u - v| / sqrt(3) along (1, 1, 1)."""
    g = with_ghosts(edges).where("ghost").select(*KEYS, "edge_id").distinct().join(edges, [*KEYS, "edge_id"])
    at = lambda side: nodes.select("sample_id", F.col("node_id").alias(side), *(F.col(c).alias(f"{c}{side}") for c in "xyz"))
    g = g.join(at("u"), ["sample_id", "u"]).join(at("v"), ["sample_id", "v"])
    far = F.sqrt(sum(((F.col(f"{c}u") - F.col(f"{c}v")) ** 2 for c in "xyz"), F.lit(0.0)))
    return g.select(*KEYS, (-(F.col("edge_id") + 1)).alias("node_id"), *(((F.col(f"{c}u") + F.col(f"{c}v")) / 2 + 0.05 * far / F.sqrt(F.lit(3.0))).alias(c) for c in "xyz"))


def pair_edges(edges: DataFrame, attributes=ATTRIBUTES) -> DataFrame:
    """One row per undirected node pair; attributes of parallel and reversed edges add up; loops are left out."""
    pairs = edges.where("u <> v").groupBy(*KEYS, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return pairs.agg(F.count("*").alias("n_branches"), *(F.sum(c).alias(c) for c in attributes))


def node_table(edges: DataFrame) -> DataFrame:
    return edges.select(*KEYS, F.explode(F.array("u", "v")).alias("node")).distinct()


def component_sizes(edges: DataFrame) -> DataFrame:
    """(keys, node, component) for all nodes; nodes whose only edges are loops are components of their own."""
    return connected_components(edges, KEYS)


def largest_component(nodes: DataFrame) -> DataFrame:
    """(keys, component, n_nodes) of the component with most nodes; the smaller label wins a tie."""
    sizes = nodes.groupBy(*KEYS, "component").agg(F.count("*").alias("n_nodes"))
    first = Window.partitionBy(*KEYS).orderBy(F.desc("n_nodes"), "component")
    return sizes.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def degrees(edges: DataFrame) -> DataFrame:
    """(keys, node, degree): ends of branches at each node, a loop counts twice."""
    return edges.select(*KEYS, F.explode(F.array("u", "v")).alias("node")).groupBy(*KEYS, "node").agg(F.count("*").alias("degree"))


def prune_terminal(edges: DataFrame, min_length: float) -> DataFrame:
    """Drops loops, and terminal branches shorter than max(min_length, 2 * diameter) in networks of over two nodes."""
    e = edges.where("u <> v")
    d = degrees(e)
    n = node_table(e).groupBy(*KEYS).agg(F.count("*").alias("_n"))
    ends = d.where("degree = 1").select(*KEYS, "node")
    e = e.join(n, KEYS)
    tips = e.select(*KEYS, "edge_id", F.explode(F.array("u", "v")).alias("node"), "length", "diameter", "_n").join(ends, [*KEYS, "node"], "left_semi")
    gone = tips.where((F.col("length") < F.greatest(F.lit(min_length), 2 * F.col("diameter"))) & (F.col("_n") > 2)).select(*KEYS, "edge_id").distinct()
    return e.drop("_n").join(gone, [*KEYS, "edge_id"], "left_anti")


def merge_degree_two(edges: DataFrame) -> DataFrame:
    """Joins chains of branches through nodes of degree 2: length and soam add, diameter and clr are length-weighted means.

    A chain is a component of the branches that touch at such nodes; its ends are its nodes of another degree.
    Closed chains without such a node become loops at their smallest node. edge_id is the smallest of the chain.
    """
    e = edges.where("u <> v")
    inner = degrees(e).where("degree = 2").select(*KEYS, "node")
    ends = e.select(*KEYS, "edge_id", F.explode(F.array("u", "v")).alias("node"))
    touch = ends.join(inner, [*KEYS, "node"], "left_semi").groupBy(*KEYS, "node").agg(F.min("edge_id").alias("u"), F.max("edge_id").alias("v"))
    chain = connected_components(touch, KEYS).withColumnRenamed("node", "edge_id")
    e = e.join(chain, [*KEYS, "edge_id"], "left").withColumn("chain", F.coalesce("component", "edge_id")).drop("component")
    outer = ends.join(inner, [*KEYS, "node"], "left_anti").join(e.select(*KEYS, "edge_id", "chain"), [*KEYS, "edge_id"]).groupBy(*KEYS, "chain").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    weighted = lambda c: (F.sum(F.col(c) * F.col("length")) / F.sum("length")).alias(c)
    merged = e.groupBy(*KEYS, "chain").agg(F.sum("length").alias("length"), weighted("diameter"), F.sum("soam").alias("soam"), weighted("clr"), F.min(F.least("u", "v")).alias("least"), F.count("*").alias("n_merged"))
    out = merged.join(outer, [*KEYS, "chain"], "left")
    return out.select(*KEYS, F.col("chain").alias("edge_id"), F.coalesce("a", "least").alias("u"), F.coalesce("b", "least").alias("v"), *ATTRIBUTES, "n_merged")


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes(keys, node)."""
    for side in "uv":
        edges = edges.join(nodes.select(*KEYS, F.col("node").alias(side)).distinct(), [*KEYS, side], "left_semi")
    return edges


def collapse_branches(edges: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Each collapsed(keys, edge_id) branch becomes one node, the smaller of the merged ids."""
    gone = edges.join(collapsed.select(*KEYS, "edge_id").distinct(), [*KEYS, "edge_id"], "left_semi")
    new = connected_components(gone, KEYS)
    rest = edges.join(collapsed.select(*KEYS, "edge_id").distinct(), [*KEYS, "edge_id"], "left_anti")
    for side in "uv":
        name = new.select(*KEYS, F.col("node").alias(side), F.col("component").alias("_to"))
        rest = rest.join(name, [*KEYS, side], "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
    return rest


def collapsed_nodes(collapsed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sample_id, node_id, x, y, z): where a collapsed branch's node lies, the integer midpoint of its ends; its id is the smaller one."""
    at = lambda side: nodes.select("sample_id", F.col("node_id").alias(side), *(F.col(c).alias(f"{c}{side}") for c in "xyz"))
    both = collapsed.select("sample_id", "u", "v").join(at("u"), ["sample_id", "u"]).join(at("v"), ["sample_id", "v"])
    return both.select("sample_id", F.least("u", "v").alias("node_id"), *(F.floor((F.col(f"{c}u") + F.col(f"{c}v")) / 2).cast("int").alias(c) for c in "xyz"))


def compose(components: DataFrame) -> DataFrame:
    """The branches of all components as one network: the component's key goes, nodes are told apart by their ids, rows and attributes stay."""
    return components.drop("component")


def matrix_offsets(nodes: DataFrame) -> DataFrame:
    """Offset of each component when components are laid out block by block in label order."""
    sizes = nodes.groupBy(*KEYS, "component").agg(F.count("*").alias("n_nodes"))
    before = Window.partitionBy(*KEYS).orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum("n_nodes").over(before), F.lit(0)))


def single_component(edges: DataFrame) -> DataFrame:
    return edges.withColumn("component", F.lit(1))


def random_connected_subset(edges: DataFrame, size: int = 5, repeats: int = 10, seed: int = 0) -> DataFrame:
    """(keys, repeat, node): for each repeat a connected set of up to `size` nodes, grown from a seeded node by hashed choice."""
    sym = written(edges.select(*KEYS, "u", "v").union(edges.select(*KEYS, F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "sym")
    coin = lambda *c: F.xxhash64(F.lit(seed), "repeat", *c)
    nodes = sym.select(*KEYS, F.col("u").alias("node")).distinct()
    tries = nodes.select(*KEYS, "node", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    got = tries.groupBy(*KEYS, "repeat").agg(F.min_by("node", F.struct(coin("node"), "node")).alias("node"))
    got = written(got, "grown")
    for step in range(1, size):
        edge = got.join(sym.withColumnRenamed("u", "node"), [*KEYS, "node"]).select(*KEYS, "repeat", F.col("v").alias("node")).distinct()
        edge = edge.join(got, [*KEYS, "repeat", "node"], "left_anti")
        new = edge.groupBy(*KEYS, "repeat").agg(F.min_by("node", F.struct(coin(F.lit(step), F.col("node")), F.col("node"))).alias("node"))
        got = written(got.unionByName(new), "grown")
    return got
