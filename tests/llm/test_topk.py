"""Exact top-k against brute force: ties, negative and huge values, clean-up, hot ids, norms that differ a lot."""

import math

import numpy as np

from lintlake.llm import topk


def brute(rows, k=20, every=20):
    good = [(i, [math.floor(64 * float(v)) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    dims = max((len(x) for _, x in good), default=0)
    good = [(i, x + [0] * (dims - len(x))) for i, x in good]
    out = []
    for i, q in good:
        if i % every == 0:
            found = sorted(((-sum(a * b for a, b in zip(q, x)), j) for j, x in good if j != i))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def got(spark, rows, **options):
    table = spark.createDataFrame([(i, x, "l", 7.0) for i, x in rows], "vec_id long, embedding array<double>, rank string, score double").repartition(4)
    return sorted(map(tuple, topk.top_products(table, **options).collect()))


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    lengths = rng.lognormal(0, 1.2, 700)
    rows = [(i, (rng.normal(size=12) * lengths[i]).tolist()) for i in range(700)]
    rows += [(i, [1.0] * 12) for i in range(700, 760)]  # ties
    rows += [(20, [0.5] * 12), (20, [0.5] * 12), (800, [0.0] * 12), (801, None), (802, [None] * 12), (803, [float("nan")] * 12), (804, [float("inf")] * 12), (None, [1.0] * 12), (805, [1.0, 2.0]), (-40, [0.25] * 12), (820, [])]
    for block in (64, 5000):
        assert got(spark, rows, block=block, head=4) == brute(rows)


def test_huge_components_stay_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-10, 10, 4) * 1e6 + rng.integers(0, 64, 4) / 64).tolist()) for i in range(60)]
    assert got(spark, rows, k=5) == brute(rows, k=5)


def test_few_and_none(spark):
    assert got(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 8192)]
    assert got(spark, [(0, [1.0])]) == [] and got(spark, []) == []
    assert got(spark, [(0, []), (3, []), (1, [])]) == [(0, 1, 1, 0), (0, 2, 3, 0)]
