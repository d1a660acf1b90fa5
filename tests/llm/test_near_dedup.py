"""Near duplicates against all pairs by plain sets; components against union-find."""

import random
import re

import pytest

from lintlake.llm import near_dedup
from lintlake.llm.components import connected_components
from lintlake.llm.shared import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """{id: (set size, smallest id reachable)} by comparing every pair of sets."""
    def shingles(text):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets, top = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(rng.randint(60, 160))]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(800)]
    texts = [t for _ in range(12) for t in family(rng, words, rng.randint(1, 9), 3)]
    chain = [rng.choice(words) for _ in range(150)]
    for _ in range(12):  # neighbours link, ends do not: the component is a path
        for _ in range(2):
            chain[rng.randrange(len(chain))] = rng.choice(words)
        texts.append(" ".join(chain))
    texts += family(rng, words, 90, 4) + ["exact copy of one text here"] * 60
    texts += [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "A b\tc d", "a b c d e", "ünï É x", "ünï é x", "ab c", "a bc", "x " * 40_000, "x " * 30_000]
    rng.shuffle(texts)
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 5, True) for i, t in rows], "doc_id long, text string, component_id int, kept boolean").repartition(5)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    want = plain(rows)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (n, c, c == i) for i, (n, c) in want.items()}
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_open_buckets_are_finished(spark, monkeypatch):
    """Where the stars miss links of buckets with three or more members, the pass over open buckets finds them."""
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, real = plain(rows), near_dedup._verified
    sizes = {c: sum(x[1] == c for x in want.values()) for _, c in want.values()}

    def blind(work, pairs, texts, name, *rest):
        return real(work, pairs.where("a % 3 = 0") if name == "first" else pairs, texts, name, *rest)

    monkeypatch.setattr(near_dedup, "_verified", blind)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert all(got[i] == c for i, (_, c) in want.items() if sizes[c] > 50)


def test_rows_grow_with_the_members(spark, monkeypatch):
    """One group of near copies with up to eight edits, most of them similar but not linked: rows that meet texts grow in proportion, not with the square."""
    rng, made = random.Random(4), []
    words = [f"w{i}" for i in range(800)]
    texts, real = family(rng, words, 800, 8), near_dedup.Workspace.table

    def counted(self, frame, name):
        out = real(self, frame, name)
        if name.endswith(("-pairs", "-needs", "-listed", "-links")):
            made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup.Workspace, "table", counted)
    most = []
    for n in (200, 800):
        made.clear()
        rows = list(enumerate(texts[:n]))
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: c for i, (_, c) in plain(rows).items()}
        most.append(max(made))
    assert most[1] <= 8 * most[0] and most[1] <= 4 * 800


def test_odd_ids(spark):
    rows = [(None, "same words in here now ok"), (7, "same words in here now ok"), (3, "same words in here now ok"), (3, "same words in here now ok"), (None, "alone in this one text yes"), (None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("3", "3", True), ("3", "3", True), ("7", "3", False), ("None", "3", False), ("None", "None", True), ("None", "None", True)]
    left = near_dedup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in left if r.doc_id is not None] == [3]


def test_different_texts_under_one_id_stay(spark):
    rows = [(1, "one text of its own that nothing else is like"), (1, "quite another story told with other words here"), (1, "quite another story told with other words here"), (2, None), (2, None)]
    left = near_dedup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in left) == sorted({(i, t or "") for i, t in rows})


def test_empty(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_connected_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    top = {n: n for e in edges for n in e}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    found = connected_components(Workspace(spark, "test"), spark.createDataFrame(edges, "u long, v long"), "t").collect()
    want = {n: find(n) for n in top if any(a != b and n in (a, b) for a, b in edges)}
    assert len(found) == len(want) and {r.node: r.label for r in found} == want


def test_few_rows_make_few_files(spark, monkeypatch):
    """Where Spark keeps all partitions of a shuffle, small tables are still a few files a core."""
    docs = spark.createDataFrame([(i, f"{i} and then {i % 90} other words of its own {i}") for i in range(1500)], "doc_id long, text string")
    real, made = Workspace.table, {}

    def counted(self, frame, name):
        out = real(self, frame, name)
        made[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(near_dedup.Workspace, "table", counted)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "120"}
    before = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        assert near_dedup.near_duplicates(docs).count() == 1500
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert made["classes"] <= 4 * spark.sparkContext.defaultParallelism
