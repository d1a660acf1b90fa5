"""Hard negatives against brute force: clean-up, shifted labels, ties, repeated ids, bounds, the curve."""

import math

import numpy as np

from lintlake.llm import hard_negatives as hard


def brute(rows, every=50, positives=5, negatives=3):
    good = [(i, label, x) for i, label, x in rows if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    dims = max((len(x) for _, _, x in good), default=0)
    good = [(i, math.fmod(label + 1, 10) if i % 7 == 0 else label, [math.floor(256 * float(v)) for v in x] + [0] * (dims - len(x))) for i, label, x in good]
    out = []
    for i, label, q in good:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j, other) for j, other, x in good if j != i)
        for s, j, _ in [r for r in scored if r[2] == label][:positives]:
            window = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            out += [(i, j, rank + 1, n, -s, -t) for rank, (t, n, _) in enumerate(window)]
    return sorted(out)


def got(spark, rows, **options):
    table = spark.createDataFrame([(i, label, x, 3.0, 1) for i, label, x in rows], "vec_id long, label int, embedding array<double>, score double, block int").repartition(4)
    return sorted(map(tuple, hard.hard_negatives(table, **options).collect()))


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 12))
    rows = [(i, int(i % 6), (centres[i % 6] * rng.lognormal(0, 0.5) + rng.normal(size=12)).tolist()) for i in range(900)]
    rows += [(i, 3, [0.25] * 12) for i in range(900, 1100)]  # ties, many in one place of the curve
    rows += [(50, 2, [1.0] * 12), (50, 2, [1.0] * 12), (1150, 1, [0.0] * 12), (1200, None, [1.0] * 12), (1201, 1, None), (1250, 1, [None] * 12),
             (1300, 1, [float("nan")] * 12), (1350, 4, [float("inf")] * 12), (None, 1, [1.0] * 12), (1400, 2, [1.0, 2.0]), (-50, -3, [0.5] * 12), (1450, 8, [])]
    want = brute(rows)
    assert len(want) > 150
    for block, group in ((2048, 256), (64, 7)):
        assert got(spark, rows, block=block, group=group) == want


def test_small_and_empty(spark):
    assert got(spark, []) == [] and got(spark, [(0, 1, [1.0])]) == [] and got(spark, [(50, 1, None)]) == []
    assert got(spark, [(50, 1, []), (2, 1, []), (3, 2, [])]) == [(50, 2, 1, 3, 0, 0)]
    rows = [(50, 1, [1e6, 3.0]), (51, 1, [2e6, 1.0]), (52, 2, [1.5e6, 0.0]), (53, 3, [1.2e6, -1.0])]
    assert got(spark, rows) == brute(rows)


def test_bounds_hold_every_row():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-900, 900, (200, 9)).astype(float), rng.integers(-900, 900, (30, 9)).astype(float)
    least, most = hard.product_bounds(q, x.min(0)[None], x.max(0)[None])
    scores = hard.products(q, x)
    assert (scores >= least).all() and (scores <= most).all()
    big = hard.products(q * 1e6, x * 1e6 + 1)
    assert (big == (q.astype(np.int64) * 10**6) @ (x.astype(np.int64) * 10**6 + 1).T).all()


def test_curve_is_a_walk_through_all_cells():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        places = hard.hilbert_places(cells, bits)
        assert sorted(places) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(axis=1)
        assert (steps == 1).all()
