"""Neighbours against brute force: recall, exact scores, copies, clean-up, few candidates."""

import math

import numpy as np

from lintlake.llm import nn_descent


def brute(rows, top=20, every=20):
    good = [(i, np.array(x, float)) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    dims = max(len(x) for _, x in good)
    ids, m = np.array([i for i, _ in good]), np.array([np.pad(x, (0, dims - len(x))) for _, x in good])
    out = []
    for a, i in enumerate(ids):
        if i % every == 0:
            s = m @ m[a]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:top]
            out.append((int(i), [(int(ids[j]), float(s[j])) for j in order]))
    return out


def got(spark, rows, **options):
    table = spark.createDataFrame([(i, x, 3, "r") for i, x in rows], "vec_id long, embedding array<float>, label int, rank string").repartition(4)
    found: dict = {}
    for r in sorted(nn_descent.nearest(table, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    return found


def check(found, want, least):
    hits = total = 0
    for i, rows in want:
        mine = found.get(i, [])
        assert [r for *_, r in mine] == list(range(1, len(rows) + 1))
        assert [(-s, j) for j, s, _ in mine] == sorted((-s, j) for j, s, _ in mine)
        scores = {j: s for j, s, _ in mine}
        hits += sum(j in scores for j, _ in rows)
        total += len(rows)
        assert all(abs(scores[j] - s) < 1e-6 for j, s in rows if j in scores)
    assert hits >= least * total


def test_recall_with_lengths_and_copies(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32) * rng.lognormal(0, 0.3, (1500, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[5].tolist()) for i in range(300)]
    rows += [(3000, None), (3001, [0.0] * 16), (3020, [float("nan")] * 16), (3040, [1.0, None]), (None, x[0].tolist()), (3060, [1.0, 2.0])]
    check(got(spark, rows), brute(rows), 0.95)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(120)] + [(40, [1.0, 1.0, 1.0, 1.0])]
    rows = [r for r in rows if r[0] != 40][:100]
    check(got(spark, rows), brute(rows), 1.0)
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])]
    assert {q: [j for j, *_ in v] for q, v in got(spark, few).items()} == {0: [2, 1]}
    assert got(spark, [(0, [1.0])]) == {} and got(spark, []) == {}
