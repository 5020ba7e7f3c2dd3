"""Lexical search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from arborix.llm import lexical

DOC, ITEM = "doc_id long, text string, name string, tf int", "item_id string, text string, term string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    all_ = [(i, Counter(words(t))) for i, t, *_ in docs if words(t)]
    N, L = len(all_), sum(sum(c.values()) for _, c in all_)
    df = Counter(w for _, c in all_ for w in c)
    out = []
    for item, text in {(i, t or "") for i, t, *_ in items}:
        scored = []
        for i, c in all_:
            m = 10 + 90 * sum(c.values()) * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words(text)) if w in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda t: (t[0], t[1], t[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    got = lexical.search(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, ITEM), **how).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=str)


def _corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "X1", "naïve", "日本"]
    pick = lambda m: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=m))
    return [(i, pick(rng.randrange(1, 30)), "a", 1) for i in range(n)], [(f"q{i}", pick(rng.randrange(1, 12)), "b") for i in range(25)]


@pytest.mark.parametrize("shard", [40, 700, 10**6])
def test_against_all_scores(spark, shard):
    docs, items = _corpus(400, 1)
    docs = [d if d[0] % 3 else (d[0], "w1 W2 same-text w1", None, None) for d in docs]  # a third of the rows are one text
    assert run(spark, docs, items, shard=shard) == brute(docs, items)
    assert run(spark, docs, items, shard=shard, k=1) == brute(docs, items, 1)


def test_odd_rows(spark):
    docs, items = _corpus(40, 2)
    docs += [(None, docs[0][1], None, 1), (None, docs[0][1], None, 1), (5, docs[0][1], None, 1), (5, "w1", None, 1), (900, None, None, None), (901, "", None, None), (902, "  .,;!", None, None), (903, "w3 " * 200_000 + "w7", None, None)]
    items += [items[0], (items[0][0], "w1 w5", None), ("none", None, None), ("empty", "", None), ("unknown", "zzz qqq", None), (None, "w3 w7", None)]
    assert run(spark, docs, items, shard=50) == brute(docs, items)


def test_nothing(spark):
    docs, items = _corpus(5, 3)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None, "", 1)], items) == []


def test_reading_stops_strictly_below_the_kth():
    """Lists with steep ends: few positions are read, and ties at the k-th place still go to the smaller document."""
    n = 20_000
    rng = np.random.default_rng(4)
    impact = {t: np.sort(rng.integers(1, 50, n))[::-1].copy() for t in (1, 2, 3)}
    doc = {t: rng.permutation(n) for t in impact}
    for t in impact:
        impact[t][:20] += 1000
    total = np.zeros(n, np.int64)
    for t in (1, 3):
        np.add.at(total, doc[t], impact[t])
    s = lexical.Shard(np.concatenate([doc[t] for t in impact]), np.repeat(list(impact), n), np.concatenate(list(impact.values())))
    docs, scores, read = s.best(np.array([1, 3, 9]), 10)
    want = np.lexsort((np.arange(n), -total))[:10]
    assert docs.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert read < n / 20
    flat = lexical.Shard(np.arange(n)[::-1].copy(), np.full(n, 1), np.full(n, 7))
    assert flat.best(np.array([1]), 10)[0].tolist() == list(range(10))
