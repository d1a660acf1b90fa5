"""Ranked search against the score's definition: several segments, ties, nulls, hot lengths, long texts, extra columns."""

import math
import random
import re
from collections import Counter

from lintlake.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for row, (i, c) in enumerate(held):
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, row))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i, _) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def got(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1.0, 2) for i, t in docs], "doc_id long, text string, score double, rank int").repartition(3)
    i = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(map(tuple, lexical.ranked_documents(d, i, **options).collect()), key=repr)


def corpus():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Straße", "ÄRGER", "x_y", "A-b", "naïve", "１２", " wide", "é"]
    docs = [(i, " ".join(draw.choices(words, weights=[1 / (1 + j) for j in range(len(words))], k=draw.choice([1, 2, 5, 5, 5, 60])))) for i in range(400)]
    docs += [(i, "w1 w2 w3 w4 w5") for i in range(400, 700)]  # one stratum, all tied
    docs += [(700, None), (701, ""), (702, " .,;"), (None, "w1 w1 w39"), (None, "w39"), (5, "w39 w39"), (5, "w39 w39"), (703, "w7 " * 50_000), (-4, "w39")]
    items = [(0, "w39 w0"), (1, "W1 w1 w2"), (2, "Straße ärger ÄRGER é"), (3, None), (4, "absent"), (5, ""), (5, "w7"), (None, "w39"), (6, " ".join(words) * 3)]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = corpus()
    want = brute(docs, items)
    for size in (16_000_000, 300):
        assert got(spark, docs, items, segment_bytes=size) == want
    # Items beyond what may be broadcast, in several blocks.
    monkeypatch.setattr(lexical, "ITEM_BYTES", 40)
    assert got(spark, docs, items, k=3, segment_bytes=3_000) == brute(docs, items, 3)


def test_bounds_leave_strata_out():
    """A search visits strata in order of their bounds and stops; the result is that of visiting all."""
    import numpy as np
    import pyarrow as pa

    docs, items = corpus()
    ids, texts = pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())
    row = lexical._segment(0, ids, texts)
    row["ids"], row["terms"], row["dfs"] = row["ids"].to_pylist(), row["terms"].to_pylist(), row["dfs"].tolist()
    held = lexical._Stratified(row, pa.array(["w39", "w7"]), row["docs"], row["words"])
    numbers, weights = np.array([0, 1]), np.array([9, 4])
    best, scores = held.search(numbers, weights, 1, 5)
    every, all_scores = held.search(numbers, weights, 1, 10_000)
    assert scores.tolist() == all_scores[:5].tolist() and best.tolist() == every[:5].tolist()
    floored, high = held.search(numbers, weights, int(scores[2]), 5)
    assert high.tolist() == [s for s in scores.tolist() if s >= scores[2]] and len(floored) >= 3


def test_empty_tables(spark):
    assert got(spark, [], [(0, "w1")]) == [] and got(spark, [(0, "w1")], []) == [] and got(spark, [(0, None)], [(0, "w1")]) == []
    assert got(spark, [(4, "b")], [(0, "b a b")]) == brute([(4, "b")], [(0, "b a b")])


def test_a_task_holds_one_segment_at_a_time(spark, monkeypatch):
    """A segment is a file of the index, so no reader holds two, and Python gets them one by one."""
    docs, items = corpus()
    table, searching, index = lexical.Workspace.table, lexical._searching, []

    def written(self, frame, name, *options):
        made = table(self, frame, name, *options)
        if name == "index":
            index.append((made.count(), len(made.inputFiles())))
        return made

    def watched(*numbers):
        run = searching(*numbers)

        def one_by_one(batches):
            def checked():
                for batch in batches:
                    assert batch.num_rows <= 1
                    yield batch

            return run(checked())

        return one_by_one

    monkeypatch.setattr(lexical.Workspace, "table", written)
    monkeypatch.setattr(lexical, "_searching", watched)
    assert got(spark, docs, items, segment_bytes=300) == brute(docs, items)
    assert index[0][0] == index[0][1] > 20
