"""The manifest against a tree built level by level, with blocks so small that the exchange has several ragged rounds."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from arborix.llm import merkle

ROW = "doc_id long, source string, lang string, n_chars int, text string, root string, g long"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _up(nodes):
    """Levels from the nodes to the one that is left."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def _path(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at - at % 8
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])))
        at //= 8
    return out


def brute(rows):
    """rows of (doc_id, lang, leaf) -> (doc_id, leaf, subroot, root, path)."""
    langs = sorted({r[1] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[1] == lang), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[lang] = own, _up([r[2] for r in own])
    top = _up([trees[lang][1][-1][0] for lang in langs])
    return sorted(((r[0], r[2], levels[-1][0], top[-1][0], _path(levels, i) + _path(top, k)) for k, (own, levels) in enumerate(trees.values()) for i, r in enumerate(own)), key=str)


def _enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _docs(n, langs, seed):
    random.seed(seed)
    odd = [None, "", "Ünïcode ", "A" * 300_000]
    rows = [(i * 7 - 20, random.choice([None, "s"]), random.choice(langs), random.choice([None, i]), random.choice(odd) if i % 5 == 0 else f"Text {i}", "x", 1) for i in range(n)]
    return rows + rows[:3] + [(None, None, langs[0], None, None, None, None)] * 2 + [(1, "s", langs[-1], 2, f"other {k}", None, None) for k in range(3)]


@pytest.mark.parametrize(("n", "langs", "height"), [(1, ["a"], 1), (8, ["a"], 0), (75, ["b", None, "é", ""], 0), (700, ["a"] * 9 + ["b"], 1), (150, [f"l{k}" for k in range(70)], 4), (580, ["only"], 0)])
def test_manifest(spark, n, langs, height):
    rows = _docs(n, langs, n)
    docs = spark.createDataFrame(rows, ROW).repartition(5)
    docs = docs.withColumn("leaf", merkle.leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text"))))
    got = merkle.manifest(docs, height=height, carry=["text"]).withColumn("up", merkle.folded("leaf", "path")).collect()
    want = brute([(r[0], r[2], _h(*map(_enc, r[:5]))) for r in rows])
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got), key=str) == want
    assert all(r.up == r.root for r in got)
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, ((r[0], r[4]) for r in rows)))


def test_changed_leaves_are_found(spark):
    docs = spark.createDataFrame([(i, "a", f"{i:064x}") for i in range(100)], "doc_id long, lang string, leaf string")
    got = merkle.manifest(docs, height=1).withColumn("up", merkle.folded(F.when(F.col("doc_id") % 9 == 0, F.sha2("leaf", 256)).otherwise(F.col("leaf")), "path")).collect()
    assert {r.doc_id for r in got if r.up != r.root} == set(range(0, 100, 9))


def test_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, lang string, leaf string")).count() == 0
