"""Top products against all products, on small and odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborix.llm import topk

ROW = "vec_id long, embedding array<float>, v string, q int"


def brute(rows, k=5):
    """Each query row's (score, id) list, one for every row whose id is divisible by 50."""
    fine = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in e]) for i, e, *_ in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for at, (i, q) in enumerate(fine):
        if i is not None and i % 50 == 0:
            s = [(-sum(a * b for a, b in zip(q, v)), c is None, c) for j, (c, v) in enumerate(fine) if j != at and len(v) == len(q)]
            out.append((i, [(-s_, c) for s_, _, c in sorted(s, key=lambda t: (t[0], t[1], t[2] or 0))[:k]]))
    return sorted(out, key=str)


def run(spark, rows, k=5, parts=3):
    v = topk.quantised(spark.createDataFrame(rows, ROW).repartition(parts), "vec_id", "embedding")
    got = topk.top_products(v, v.where("id % 50 = 0"), k).collect()
    return sorted(((r.id, [(s.score, s.id) for s in r.top]) for r in got), key=str)


def _clustered(n, seed):
    """Tight groups, so that bounds do rule out blocks, with a third of the rows one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    same = rng.normal(size=16)
    return [(i, [float(x) for x in (same if i % 3 == 0 else centres[i % 12] + rng.normal(size=16) * 0.01)], "x", 1) for i in range(n)]


def test_clusters_and_a_third_of_one_vector(spark, monkeypatch):
    rows = _clustered(3000, 1)
    scored = []
    monkeypatch.setattr(topk, "WAVES", (1, 2))
    plain = topk.dealt
    monkeypatch.setattr(topk, "dealt", lambda kinds, keys: (scored.append(kinds[1].count()) if keys[0] == "block" else None, plain(kinds, keys))[1])
    assert run(spark, rows) == brute(rows)
    # distinct queries times blocks is what scoring everything would take
    assert 0 < sum(scored) < 0.5 * (1 + 40) * 12


def test_odd_rows(spark):
    rng = random.Random(2)
    vec = lambda d: [rng.uniform(-1, 1) for _ in range(d)]
    rows = [(i * 25, vec(4), None, None) for i in range(60)]
    rows += [(100, rows[4][1], "again", 0)] * 2 + [(100, vec(4), "other", 0), (None, rows[2][1], None, 1), (None, vec(4), None, 1)]
    rows += [(50, None, None, None), (150, [1.0, None, 0.0, 1.0], None, None), (200, [float("nan"), 0.0, 0.0, 0.0], None, 0), (250, [float("inf")] * 4, None, 0)]
    rows += [(350, vec(3), None, None), (351, vec(3), None, None), (400, [], None, None), (401, [], None, None), (450, vec(7), None, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, k=1) == brute(rows, 1)


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [0.5, -0.25], "t", 1) for i in range(1200)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(7, [1.0], "a", 1)], [(50, [1.0], "a", 1)]])
def test_few(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_huge_components_are_held(spark):
    v = topk.quantised(spark.createDataFrame([(50, [1e30, -1e30], "a", 1), (51, [1.0, 1.0], "a", 1)], ROW), "vec_id", "embedding")
    top = topk.top_products(v, v.where("id = 50")).select(F.inline("top")).collect()
    assert [tuple(r) for r in top] == [(0, 51)]
