"""Merkle manifest of a dataset by butterfly exchange.

The rows of a group (a language) are leaves in the order of their ids; every run of FANOUT consecutive nodes becomes one node, until one is
left, the group's subroot, and the subroots become the root in the same way.

Leaves are dealt into aligned blocks of FANOUT ** HEIGHT, so a block's tree is a whole subtree. The blocks then swap subtree roots in rounds:
in round r the up to FANOUT blocks whose numbers differ in digit r alone (to the base FANOUT) meet, each gets what all of
them hold, and each hashes the common ancestor for itself. So after its last round every block has its own proof up to the root, and nothing is handed
down again. A block meets FANOUT others at most in a round, and there are as many rounds as a block's number has digits. Where the last subtree of a
level has fewer blocks than the others, each of its blocks answers for several partners.

Places in a group come from a range sort of all leaves and the counts of its partitions, so a group of any share of the rows has no task of its own.

Defined cases: a null or empty text, and null in any other column, is a leaf as any other (`-`); rows without an id come first in their group; rows that share
an id are in the order of their leaves, and equal rows have equal results; rows without a group are a group, the first; an empty table
gives an empty result; further columns are ignored unless they are named in `carry`.
"""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranks import ranked
from .common import table, written

FANOUT = 8
#: Levels within a block: 4,096 leaves.
HEIGHT = 4
PATH = "array<struct<before: string, after: string>>"


def leaf(*columns: Column) -> Column:
    """Lowercase hex sha256 of the columns, each as its UTF-8 byte count, a colon and its value, or `-` if null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def proof(path: str | Column) -> Column:
    """All siblings of a path as one text, from the leaf's level to the root."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def folded(node: str | Column, path: str | Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, node, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def _parents(nodes: list[str]) -> list[str]:
    from hashlib import sha256

    return [sha256("".join(nodes[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(nodes), FANOUT)]


def _tree(nodes: list[str], n: int, height: int) -> list[list[str]]:
    """The levels of a block in a group of n leaves: `height` of them above the leaves, or as many as the group has."""
    levels = [nodes]
    while len(levels) <= height and n > 1:
        levels.append(_parents(levels[-1]))
        n = -(-n // FANOUT)
    return levels


def _subtree(height: int):
    def run(found: pa.Table) -> pa.Table:
        found = found.sort_by("i")
        n = found.column("n")[0].as_py()
        top = _tree(found.column("leaf").to_pylist(), n, height)[-1]
        return pa.table({"g": found.column("g")[:1], "p": found.column("p")[:1], "parts": pa.array([-(-n // FANOUT**height)], pa.int64()), "digest": pa.array(top, pa.string())})

    return run


def _with_paths(columns: list[str], height: int):
    def run(found: pa.Table, upper: pa.Table) -> pa.Table:
        found = found.sort_by("i")
        levels = _tree(found.column("leaf").to_pylist(), found.column("n")[0].as_py(), height)[:-1]
        rest = upper.column("path")[0].as_py()
        before, after = [], []
        for at in range(len(found)):
            for nodes in levels:
                first = at - at % FANOUT
                before.append("".join(nodes[first:at]))
                after.append("".join(nodes[at + 1 : first + FANOUT]))
                at //= FANOUT
            before += [s["before"] for s in rest]
            after += [s["after"] for s in rest]
        step = len(levels) + len(rest)
        ends = pa.array(range(0, step * len(found) + 1, step) if step else [0] * (len(found) + 1), pa.int32())
        path = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"]))
        out = {c: found.column(c) for c in columns}
        return pa.table(out | {c: pa.concat_arrays([pa.repeat(upper.column(c)[0], len(found))]) for c in ("subroot", "root")} | {"path": path})

    return run


def butterfly(nodes: DataFrame) -> DataFrame:
    """nodes(g, p, parts, digest), parts of them in each g, numbered from 0 -> (g, p, digest: the one all of g's nodes lead to, path: from the node to it).

    A round is one shuffle by (g, the number without its digit r), in groups of FANOUT rows at most, and is written.
    """
    now = written(nodes.select("g", "p", "parts", "digest", F.array().cast(PATH).alias("path")), "butterfly")
    most = now.agg(F.max("parts")).first()[0] or 0
    size = 1
    while size < most:
        at, digit, whole = F.col("p") % size, F.expr(f"p div {size}") % FANOUT, F.expr(f"p div {size * FANOUT}")
        there = F.least(F.lit(size), F.col("parts") - F.col("p") + at).cast("long")  # blocks of this one's subtree, fewer than size in the last
        sent = now.where(F.col("parts") > size).select("*", at.alias("at"), digit.alias("digit"), whole.alias("whole"), F.explode(F.sequence(at, F.lit(size - 1).cast("long"), there)).alias("slot"))
        met = F.array_sort(F.collect_list(F.struct("digit", "digest")).over(Window.partitionBy("g", "whole", "slot")))
        got = sent.withColumn("met", met).where("slot = at")
        text = lambda those: F.array_join(F.transform(those, lambda s: s["digest"]), "")
        step = F.struct(text(F.filter("met", lambda s: s["digit"] < F.col("digit"))).alias("before"), text(F.filter("met", lambda s: s["digit"] > F.col("digit"))).alias("after"))
        risen = got.select("g", "p", "parts", F.sha2(text(F.col("met")), 256).alias("digest"), F.concat("path", F.array(step)).cast(PATH).alias("path"))
        now = written(risen.unionByName(now.where(F.col("parts") <= size)), "butterfly")
        size *= FANOUT
    return now.select("g", "p", "digest", "path")


def manifest(leaves: DataFrame, group: str = "lang", order: str = "doc_id", carry: list[str] = (), height: int = HEIGHT) -> DataFrame:
    """(order, leaf, carry, subroot, root, path) of leaves(group, order, leaf, carry): every leaf with its proof, siblings before and after it at each level."""
    carry = list(carry)
    # equal rows are told apart, so that a range sort can part them
    rows = leaves.select(F.col(group).alias("_group"), F.col(order).alias("_order"), "leaf", *(F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)), F.monotonically_increasing_id().alias("_row"))
    placed = written(ranked(written(rows, "leaves"), ["_group", "_order", "leaf", "_row"], "_at"), "placed")
    groups = placed.groupBy("_group").agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    groups = written(ranked(groups, ["_group"], "g").withColumnRenamed("_group", "_name"), "groups")
    known = placed.join(groups, F.col("_group").eqNullSafe(F.col("_name"))).withColumn("i", F.col("_at") - F.col("_first"))
    kept = ["_order", "leaf", *(f"_c{k}" for k in range(len(carry)))]
    known = known.select("g", F.expr(f"i div {FANOUT**height}").alias("p"), "i", "n", *kept)
    blocks = butterfly(known.groupBy("g", "p").applyInArrow(_subtree(height), "g long, p long, parts long, digest string"))
    n = groups.count()
    top = butterfly(blocks.where("p = 0").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("p"), F.lit(n).cast("long").alias("parts"), "digest"))
    top = top.select(F.col("p").alias("g"), F.col("digest").alias("root"), F.col("path").alias("rest"))
    upper = blocks.join(top, "g").select("g", "p", F.col("digest").alias("subroot"), "root", F.concat("path", "rest").alias("path"))
    schema = ", ".join(f"`{c}` {known.schema[c].dataType.simpleString()}" for c in kept) + f", subroot string, root string, path {PATH}"
    out = known.groupBy("g", "p").cogroup(upper.groupBy("g", "p")).applyInArrow(_with_paths(kept, height), schema)
    return out.select(F.col("_order").alias(order), "leaf", *(F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)), "subroot", "root", "path")


def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", "lang", leaf(*columns(F.col("text"))).alias("leaf"), F.when(hit, leaf(*columns(lower))).alias("tampered"))
    out = manifest(leaves, carry=["tampered"])
    root = folded(F.coalesce("tampered", "leaf"), "path")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof("path"), 256).alias("proof_sha256"), root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 10, over: int = 4) -> str:
    """The same by window functions, level by level; `levels` and `over` bound the height within a language and above."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    h = lambda text: "sha256(" + " || ".join(map(enc, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    crc = "list_reduce([x::UBIGINT FOR x IN list_transform(range(len(d)), lambda k: ascii(d[k + 1]))], lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::BIGINT + 1]), 4294967295::UBIGINT)"
    out = [
        "WITH bits AS (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) t(i))",
        "tab AS (SELECT list(v ORDER BY i) AS tab FROM bits)",
        f"crcs AS (SELECT doc_id, xor({crc}, 4294967295::UBIGINT) % 3 = 0 AS hit FROM (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS d FROM documents WHERE doc_id IS NOT NULL), tab)",
        f"lv AS (SELECT doc_id, lang, {h('text')} AS leaf, CASE WHEN hit THEN {h(low)} END AS bad FROM documents LEFT JOIN crcs USING (doc_id))",
        "b0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM lv)",
        "l0 AS (SELECT lang AS k, i, n, leaf AS h FROM b0)",
        "d0 AS (SELECT doc_id, lang, leaf, i, coalesce(bad, leaf) AS f, '' AS proof FROM b0)",
    ]

    def rise(a: int, key: str) -> None:
        w = "PARTITION BY k, i // 8 ORDER BY i ROWS BETWEEN"
        out.append(f"s{a} AS (SELECT k, i, n, coalesce(string_agg(h, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef, coalesce(string_agg(h, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft FROM l{a})")
        out.append(f"d{a + 1} AS (SELECT doc_id, lang, leaf, d.i // 8 AS i, CASE WHEN n = 1 THEN f ELSE sha256(bef || f || aft) END AS f, proof || bef || aft AS proof{', sub' if key != 'lang' else ''} FROM d{a} d JOIN s{a} s ON s.k IS NOT DISTINCT FROM {key} AND s.i = d.i)")
        out.append(f"l{a + 1} AS (SELECT k, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM l{a} GROUP BY k, i // 8, n)")

    for a in range(levels):
        rise(a, "lang")
    t = levels + 1
    out.append(f"l{t} AS (SELECT 0 AS k, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, k AS name FROM l{levels})")
    out.append(f"d{t} AS (SELECT doc_id, lang, leaf, t.i, f, proof, t.h AS sub FROM d{levels} d JOIN l{t} t ON t.name IS NOT DISTINCT FROM lang)")
    for a in range(t, t + over):
        rise(a, "0")
    return ",\n".join(out) + f"\nSELECT doc_id, leaf, sub AS subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM d{t + over}, l{t + over}"


OP13_SQL = _sql()
