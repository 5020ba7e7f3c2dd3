"""Exact signed-rank tests against enumeration; places, batches, quantiles and running medians of one key that holds every row."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborix.operators import prep, ranks, stats, topology


def test_signed_ranks_by_enumeration(spark):
    random.seed(1)
    sizes = range(5, 26)
    rows, want = [], {}
    for n in sizes:
        signs = [random.choice((-1, 1)) for _ in range(n)]
        ranks_ = random.sample(range(1, n + 1), n)
        rows += [(f"a{n}", n * 100 + i, float(s * r)) for i, (s, r) in enumerate(zip(signs, ranks_))] + [(f"b{n}", n * 100 + i, 0.0) for i in range(n)]
        low = min(sum(r for s, r in zip(signs, ranks_) if s > 0), sum(r for s, r in zip(signs, ranks_) if s < 0))
        if n <= 14:  # every choice of signs
            under = sum(sum(r for r, on in zip(range(1, n + 1), mask) if on) <= low for mask in itertools.product((0, 1), repeat=n))
        else:
            sums = np.zeros(n * (n + 1) // 2 + 1, object)
            sums[0] = 1
            for r in range(1, n + 1):
                sums[r:] = sums[r:] + sums[:-r].copy()
            under = sum(sums[: low + 1])
        want[n] = min(1.0, 2 * under / 2**n)
    got = {r.method_1: (r.n, r.p_value) for r in stats.wilcoxon_pairs(spark.createDataFrame(rows, "method string, case_id long, score double")).where("substr(method_1, 2) = substr(method_2, 2) AND method_1 < method_2").collect()}
    assert got == {f"a{n}": (n, pytest.approx(want[n], rel=1e-12)) for n in sizes}


def test_ties_and_many_cases_take_the_normal_form(spark):
    rows = [(m, i, float(i % 5 + (m == "b") * (1 + i % 2))) for m in "ab" for i in range(12)] + [(m, 100 + i, float(i * (m == "d"))) for m in "cd" for i in range(1, 40)]
    got = {(r.method_1, r.method_2): r.p_value for r in stats.wilcoxon_pairs(spark.createDataFrame(rows, "method string, case_id long, score double")).collect()}
    assert 0 < got["a", "b"] < 0.01 and got["a", "b"] != 2 / 2**12
    assert 0 < got["c", "d"] < 1e-6 and got["a", "a"] is None


@pytest.fixture
def one_key(spark):
    random.seed(2)
    data = [(None if i % 3 else "k", i, random.choice([None, 1.0, 2.5]) if i % 7 == 0 else random.random()) for i in range(900)]
    return data, spark.createDataFrame(data, "s string, i int, v double").repartition(6)


def test_places_within_keys(one_key):
    data, rows = one_key
    got = {r.i: (r.rank, r.size) for r in ranks.ranked_within(rows, ["s"], [F.desc("i")]).collect()}
    for s in (None, "k"):
        own = sorted((d[1] for d in data if d[0] == s), reverse=True)
        assert all(got[i] == (k, len(own)) for k, i in enumerate(own))
    batches = {r.i: r.batch for r in prep.batches(rows, ["s"], "i", 32).collect()}
    assert all(batches[i] == k // 32 for s in (None, "k") for k, i in enumerate(sorted(d[1] for d in data if d[0] == s)))


def test_quantiles_within_keys(one_key):
    data, rows = one_key
    got = {(r.s, r.p): r.q for r in topology.quantiles(rows, ["s"], "v", [0.0, 0.1, 0.5, 0.99]).collect()}
    for s in (None, "k"):
        own = np.sort([d[2] for d in data if d[0] == s and d[2] is not None])
        at = (np.arange(len(own)) + 0.5) / len(own)
        assert all(got[s, p] == pytest.approx(np.interp(p, at, own)) for p in (0.0, 0.1, 0.5, 0.99))


@pytest.mark.parametrize(("size", "run"), [(9, 4096), (9, 7), (4, 5), (51, 20)])
def test_running_medians_do_not_depend_on_runs(spark, size, run):
    v = [((i * 37) % 101) * 1.0 for i in range(150)]
    got = {r.i: r.median for r in stats.running_median(spark.createDataFrame([("s", i, x) for i, x in enumerate(v)], "s string, i int, v double"), ["s"], "i", "v", size, run).collect()}
    wide = np.pad(np.array(v), (size // 2, size - 1 - size // 2), mode="symmetric")
    assert got == {i: float(np.median(wide[i : i + size])) for i in range(len(v))}
