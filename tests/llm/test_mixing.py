"""Mixing against a plain reading: targets by resharing, taken near target, nobody above the cap."""

import random
from collections import defaultdict

import pytest

from lintlake.llm import mixing


def reshared(sizes, weights=mixing.WEIGHTS, cap=3):
    """Share, stop whoever is above the cap, reshare the excess, until nobody is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: level * w[s] for s in open_}
        fixed |= {s: cap * sizes[s] for s in over}


def make(seed=3):
    rng = random.Random(seed)
    rows, n = [], 0
    for source, docs in (("b", 200), ("a", 5), ("c", 60), (None, 40), ("z", 2), ("é", 30), ("hot", 600)):
        for _ in range(docs):
            rows.append((n, " ".join("w" * (1 + i % 5) for i in range(rng.randint(0, 120))), source, 1.5))
            n += 1
    return rows + [(n, None, "b", 0.0), (n, None, "b", 0.0), (None, "a b", "c", 0.0), (5, " x\ty ", "a", 0.0), (5, " x\ty ", "a", 0.0)]


def test_digest(spark):
    rows = make()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size double").repartition(5)
    got = mixing.mix_digest(docs).collect()
    size = lambda t: len((t or "").split())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, size(t)) for i, t, _, _ in rows)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    want, taken = reshared(sizes), defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 60), (s, taken[s], t)
    again = mixing.mix_digest(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_rows_follow_copies(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 7), "s" + str(i % 4), "en") for i in range(100)], "doc_id long, text string, source string, lang string")
    copies = {r.doc_id: r.copies for r in mixing.document_copies(docs).collect()}
    mix = mixing.mixed_rows(docs)
    assert mix.columns == docs.columns
    seen = defaultdict(int)
    for r in mix.collect():
        seen[r.doc_id] += 1
    assert all(seen[i] == c for i, c in copies.items())


@pytest.mark.parametrize("case", ["repeated", "no ids", "one hot row"])
def test_repeated_rows_stay_near_the_target(spark, case):
    """Twenty of each row, rows without ids, and a third of all rows alike: within 2 % of every target, in the digest and in the mix."""
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(20, 60), source) for i, source in enumerate(["a"] * 40 + ["b"] * 120 + ["c"] * 60)]
    if case == "repeated":
        rows *= 20
    elif case == "no ids":
        rows = [(None, t, s) for _, t, s in rows * 5]
    else:
        rows = rows * 4 + [(7777, "x " * 30, "b")] * 500
    docs = spark.createDataFrame([(*r, 1.0, 3) for r in rows], "doc_id long, text string, source string, copies double, base int").repartition(6)
    digest = mixing.mix_digest(docs).collect()
    assert len(digest) == len(rows)
    targets, taken, mixed = {r.source: r.target for r in digest}, defaultdict(int), defaultdict(int)
    for r in digest:
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    mix = mixing.mixed_rows(docs)
    assert mix.columns == docs.columns
    for r in mix.collect():
        mixed[r.source] += len(r.text.split())
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in targets.items()), (taken, targets)
    assert mixed == taken


@pytest.mark.parametrize("sent", [mixing.SENT, 0])
def test_mix_keeps_texts_in_place(spark, monkeypatch, sent):
    """The mix agrees with the digest row by row, and texts meet a plan that may be sent without an exchange, however large the tables are."""
    monkeypatch.setattr(mixing, "SENT", sent)
    rows = [(n, t, s, 7) for n, t, s, _ in make(5) if n not in (None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan_docs = docs.localCheckpoint()
        mix = mixing.mixed_rows(plan_docs)
        plan = mix._jdf.queryExecution().executedPlan().toString()
        got = [r.doc_id for r in mix.collect()]
        copies = defaultdict(int)
        for r in mixing.document_copies(docs).collect():
            copies[r.doc_id] += r.copies * r.repeats
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ("hashpartitioning" not in plan) == (sent > 0)
    seen = defaultdict(int)
    for i in got:
        seen[i] += 1
    # The null text stands twice under one id; its copies sum up.
    assert {i: c for i, c in copies.items() if c} == dict(seen)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "w w", "b"), (3, "w", "c")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_digest(docs).collect()}
    assert got[1].size == 300_000 and got[1].taken == 300_000 and got[2].taken == 6 and got[3].taken == 3


def test_empty(spark):
    assert mixing.mix_digest(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
