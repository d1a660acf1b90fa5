"""Scores against a plain trigram model with the same formulas; probabilities that sum to one; sequences against arrays."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lintlake.llm import lm_scoring as LM
from lintlake.llm.elias_fano import DECADES, LEVELS, EliasFano, NgramTrie, discount, levels, ones_twos, quantise


#: Two codes are multiplied, each up to one step too low.
STEP = 1 - 10 ** (-2 * DECADES / (LEVELS - 1))


def rows_of(seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "A", "a", "cat", "Dog", "Ünï"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[40, 30, 9, 9, 8, 8, 3] + [1] * 60, k=rng.randint(0, 60)))) for i in range(150)]
    return rows + [(1000 + i, " ".join(f"rare{i}x{j}" for j in range(3))) for i in range(20)] + [(2000, None), (2001, ""), (2002, " \t\n"), (None, "the cat"), (5, "again the cat"), (2003, "long " * 50_000)]


def fold(text):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split(" ") for w in w.split("\n") for w in w.split("\t") for w in [w.strip("\r")] if w] + ["</s>"]


def test_counts_and_base(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = LM.score_documents(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in fold(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((str(i), held(i), len(fold(t)), sum(c[w] > 0 for w in fold(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in fold(t)), 4)) for i, t in rows))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert all(r.score <= 1e-9 for r in got)


def plain_scores(rows):
    """(doc_id, score) by a trigram model held in dictionaries."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not held(i) for w in fold(t))
    name = lambda w: w if w in ("<s>", None) or count[w] >= 2 else "<rare>"
    triples = lambda t: [(u, v, w) for u, v, w in zip(*(["<s>", "<s>", *map(name, fold(t))][k:] for k in range(3)))]
    tri = Counter(g for i, t in rows if not held(i) for g in triples(t))
    pair, total3, total2, kinds3, kinds2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for (u, v, w), n in tri.items():
        pair[v, w] += n
        total3[u, v] += n
        kinds3[u, v] += 1
        total2[v] += n
    kinds2.update(v for v, _ in pair)
    d = lambda c: discount(*ones_twos(np.array(list(c.values()))))
    d1, d2, d3, table = d(count), d(pair), d(tri), levels()
    code = lambda p, least=0: table[quantise(np.array([p], float), least)[0]]
    n, ones = sum(count.values()), sum(c == 1 for c in count.values())
    unseen = d1 * len(count) / n
    rare = unseen + ones * (1 - d1) / n
    out = []
    for i, t in rows:
        score = 0.0
        for word, (u, v, w) in zip(fold(t), triples(t)):
            a, b = 0.0, 1.0
            if total2[v]:
                a, b = code((pair[v, w] - d2) / total2[v]) if pair[v, w] else 0.0, code(d2 * kinds2[v] / total2[v], 1)
            if total3[u, v]:
                back = code(d3 * kinds3[u, v] / total3[u, v], 1)
                a, b = (code((tri[u, v, w] - d3) / total3[u, v]) if tri[u, v, w] else 0.0) + back * a, back * b
            own = (count[word] - d1) / n if count[word] else unseen
            low, share = (own, 1.0) if count[word] >= 2 else (rare, own / rare)
            score += math.log10((code(a) + code(b, 1) * low) * share)
        out.append((str(i), score))
    return sorted(out)


@pytest.mark.parametrize("options,parts", [({}, 3), ({"shard_bytes": 10**9}, 1), ({"shard_bytes": 2_000}, 5), ({"hot": 100}, 3), ({"hot": 7, "shard_bytes": 5_000}, 2)])
def test_scores_equal_a_plain_model_whatever_the_shards(spark, options, parts):
    rows = rows_of()
    got = sorted((str(r.doc_id), r.score) for r in LM.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), **options).collect())
    want = plain_scores(rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-9)


def test_trie_equals_plain_discounting():
    rng = np.random.default_rng(3)
    grams, counts = np.unique(rng.integers(0, 12, (4000, 3)) ** 2 // 9, axis=0, return_counts=True)
    v, u, w = (grams[:, i].astype(np.uint64) for i in range(3))
    trie = NgramTrie.from_buffer(NgramTrie.build(v, u, w, counts).to_bytes())
    pairs, tri, ctx = Counter(), {}, defaultdict(int)
    for (x, y, z), n in zip(grams.tolist(), counts.tolist()):
        pairs[x, z] += n
        tri[x, y, z] = n
        ctx[x, y] += n
    d = lambda c: min(0.95, (sum(n == 1 for n in c) + 1) / (sum(n == 1 for n in c) + 2 * sum(n == 2 for n in c) + 2))
    d2, d3 = d(list(pairs.values())), d(list(tri.values()))
    words = sorted({z for _, _, z in tri} | {999})
    for x in sorted({a for a, _ in pairs})[:4] + [77]:
        total = sum(n for (a, _), n in pairs.items() if a == x)
        for y in [0, 1, 4, 77]:
            a, b = trie.query(*(np.array(c, np.uint64) for c in ([x] * len(words), [y] * len(words), words)))
            back2 = d2 * sum(k[0] == x for k in pairs) / total if total else 1.0
            back3 = d3 * sum(k[:2] == (x, y) for k in tri) / ctx[x, y] if (x, y) in ctx else 1.0
            for i, z in enumerate(words):
                p2 = (pairs[x, z] - d2) / total if (x, z) in pairs else 0.0
                p3 = (tri[x, y, z] - d3) / ctx[x, y] if (x, y, z) in tri else 0.0
                assert a[i] == pytest.approx(p3 + back3 * p2, rel=STEP) and b[i] == pytest.approx(back3 * back2, rel=STEP)
            assert a.sum() + b[0] <= 1 + 1e-9


def test_unigrams_sum_to_one():
    counts = np.array([0, 1, 1, 2, 5, 9])
    p, share, rare = LM.unigrams(counts, 18, 5, 2, 1)
    assert p.sum() == pytest.approx(1) and p[:3].sum() == pytest.approx(rare) and share[:3].sum() == pytest.approx(1)


def test_sequences():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 1), (1, 1), (5, 7), (1000, 10**6), (3000, 3000), (20_000, 10**12)):
        x = np.sort(rng.integers(0, universe, n).astype(np.uint64))
        s = EliasFano.encode(x, universe)
        assert n == 0 or (s.access(np.arange(n)) == x).all()
        q = np.concatenate([x, rng.integers(0, universe + 3, 500).astype(np.uint64)])
        w = np.searchsorted(x, q)
        ok = w < n
        ok[ok] &= x[w[ok]] == q[ok]
        assert (s.find(q) == np.where(ok, w, -1)).all()


def test_squeeze_round_trip():
    for x in (np.zeros(0, np.uint64), np.arange(9, dtype=np.uint32), np.array([2**63, 1], np.uint64), np.array([7], "<u2")):
        assert (LM.expand(LM.squeeze(x)) == x).all()


def test_empty_and_untrained(spark):
    assert LM.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = LM.score_documents(spark.createDataFrame([(i, "a b") for i in out], "doc_id long, text string")).collect()
    assert [(r.base_score, r.score, r.n_known, r.train_tokens) for r in got] == [(0.0, 0.0, 0, 0)] * 3
