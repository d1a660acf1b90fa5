"""The model against a plain interpolated modified Kneser-Ney, and junk against clean text."""

import math
import random
from collections import Counter

import numpy as np

from lintlake.llm import quality as Q
from lintlake.llm.shared import Workspace

SYL = {"en": ["the", "ing", "er", "and", "tion", "ed"], "de": ["sch", "ung", "ein", "lich", "ge", "ver"]}


def clean(rng, lang, n=40):
    return " ".join("".join(rng.choices(SYL[lang], k=rng.randint(1, 3))) for _ in range(n)) + "."


def plain_probability(texts):
    grams = Counter()
    for t in texts:
        s = Q.symbols([t])[0].tolist()
        grams.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    counts = {4: grams}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def cuts(c):
        n = [sum(v == i for v in c.values()) for i in range(5)]  # counts of counts
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if n[i] and n[1] else 0.5 for i in (1, 2, 3)]

    n4 = {k: cuts({**c}) for k, c in counts.items()}

    def p(g):
        k = len(g)
        if not k:
            return 1 / Q.SYMBOLS
        ctx = [(h, n) for h, n in counts[k].items() if h[:-1] == g[:-1]]
        if not ctx:
            return p(g[1:])
        d = n4[k]
        total, spared = sum(n for _, n in ctx), sum(d[min(n, 3)] for _, n in ctx)
        n = counts[k][g]
        return ((n - d[min(n, 3)]) if n else 0) / total + spared / total * p(g[1:])

    return p


def test_probabilities_equal_a_plain_model(spark):
    rng = random.Random(1)
    texts = [clean(rng, "en", 15) for _ in range(6)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    work = Workspace(spark, "test")
    rows = Q.kneser_ney(work, work.table(Q.count_grams(docs), "grams")).where("lang = 'en'").collect()
    p, made = plain_probability(texts), {(r["size"], r.code): r.p for r in rows}
    digits = lambda code, k: tuple(code // Q.SYMBOLS ** (k - 1 - i) % Q.SYMBOLS for i in range(k))
    for (k, code), got in list(made.items())[:400]:
        assert math.isclose(got, p(digits(code, k)), rel_tol=1e-9), (k, code)
    table = Q.QualityModel({r.lang: bytes(r.codes) for r in Q.kneser_ney(Workspace(spark, "t2"), Q.count_grams(docs)).groupBy("lang").applyInArrow(Q._coded, "lang string, codes binary").collect()}).table("en")
    for context in [(0, 1, 2), Q.symbols(["the"])[0][-3:].tolist(), [29, 29, 29], [35, 35, 35]]:
        base = (context[0] * 48 + context[1]) * 48 + context[2]
        probs = np.exp(-table[base * 48 : base * 48 + 48].astype(float) * Q.STEP)
        for w in (0, 4, 28, 40):
            assert abs(math.log(max(p((*map(int, context), w)), 1e-7)) + float(table[base * 48 + w]) * Q.STEP) < 0.6 * Q.STEP
        assert 0.9 < probs.sum() < 1.1


def test_junk_goes_and_clean_stays(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        lang = ("en", "de", "xx", None)[i % 4]
        rows.append((i, clean(rng, lang if lang in SYL else "en", rng.randint(3, 60)), lang, 1, True))
        labels.append((i, 1, 0))
    junk = [(1000, "THING!! AND!! " * 30, "en", 0, True), (1001, "sch | ung | ein | " * 30, "de", 0, True), (1002, "a###b$$$ " * 40, "xx", 0, True), (1003, None, "en", 0, True), (1004, "", None, 0, True)]
    docs = spark.createDataFrame(rows + junk + [rows[0]], "doc_id long, text string, lang string, n_symbols int, keep boolean")
    labels = spark.createDataFrame(labels + [(1000, 0, 0), (None, 1, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    digest = Q.quality_digest(docs, labels).collect()
    assert not any(r.keep for r in digest if r.doc_id >= 1000) and sum(r.keep for r in digest if r.doc_id < 1000) >= 236
    assert all(r.perplexity is None for r in digest if r.doc_id in (1003, 1004))
    left = Q.trusted_documents(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(r.keep for r in digest)
    none = Q.quality_digest(docs, labels.limit(0)).collect()
    assert sum(r.keep for r in none) == 244 and Q.quality_digest(docs.limit(0), labels).count() == 0


def kept_share(rows, of):
    some = [r.keep for r in rows if of(r)]
    return sum(some) / len(some)


def test_rare_language_keeps_its_clean_documents(spark):
    """Two trusted rows of a language among thousands of others: its other clean documents stay, junk in it goes."""
    rng = random.Random(5)
    rows = [(i, clean(rng, "en", rng.randint(20, 60)), "en") for i in range(1200)]
    rows += [(i, clean(rng, "de", rng.randint(20, 60)), "rare") for i in range(2000, 2040)]
    rows += [(3000, "a###b$$$ " * 40, "rare")]
    labels = [(i, 1, 0) for i in range(1200)] + [(i, 1, 0) for i in (2000, 2001)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    digest = Q.quality_digest(docs, labels).collect()
    assert kept_share(digest, lambda r: 2000 <= r.doc_id < 3000) == 1 and kept_share(digest, lambda r: r.lang == "en") > 0.99
    assert not any(r.keep for r in digest if r.doc_id == 3000)


def test_every_language_has_its_model_and_threshold(spark):
    """Forty languages, more than the 32 that had models: thresholds differ, clean text stays and other languages' text goes."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02d}": ["".join(rng.choices(letters, k=3)) for _ in range(6)] for k in range(40)}
    text = lambda lang: " ".join("".join(rng.choices(words[lang], k=2)) for _ in range(50)) + "."
    rows = [(1000 * k + i, text(lang), lang) for k, lang in enumerate(words) for i in range(12)]
    foreign = [(100_000 + k, text(f"l{(k + 1) % 40:02d}"), f"l{k:02d}") for k in range(40)]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    digest = Q.quality_digest(spark.createDataFrame(rows + foreign, "doc_id long, text string, lang string"), labels).collect()
    assert len({r.threshold for r in digest}) == 40
    assert kept_share(digest, lambda r: r.doc_id < 100_000) > 0.97
    own = {k: [r.perplexity for r in digest if r.lang == k and r.doc_id < 100_000] for k in words}
    assert all(r.perplexity > max(own[r.lang]) for r in digest if r.doc_id >= 100_000)


def test_both_ways_to_the_codes_give_the_same(spark):
    """Codes broadcast, or blocks of documents joined with them; thresholds are plain quantiles of the trusted rows outside the sample."""
    rng = random.Random(9)
    rows = [(i, clean(rng, "en", rng.randint(5, 60)), ("en", "de", None)[i % 3]) for i in range(240)] + [(900, "x" * 70_000, "en"), (901, None, "de"), (902, "ab", "nowhere")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, n double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    key = lambda r: r.doc_id
    place, blocks = (sorted(Q.quality_digest(docs, labels, train_rows=30, shared_bytes=n).collect(), key=key) for n in (Q.SHARED_BYTES, 0))
    assert place == blocks
    whole = sorted(Q.trusted_documents(docs, labels, train_rows=30).collect(), key=key)
    assert [r.doc_id for r in whole] == [r.doc_id for r in place if r.keep] and whole[0].n == 1.0

    trusted, cuts = Q.trusted_rows(docs, labels, 30)
    outside = trusted.join(docs.select("doc_id", "lang"), "doc_id").join(cuts.withColumnRenamed("lang", "l"), Q.F.col("lang").eqNullSafe(Q.F.col("l"))).where(~Q.sampled())
    of, limit = {}, {r.lang: math.log(r.threshold) for r in place}
    measured = {r.doc_id: round(math.log(r.perplexity), 3) for r in place if r.perplexity}
    for r in outside.collect():
        of.setdefault(r.lang, []).append(measured[r.doc_id])
    at = lambda xs, q: sorted(xs)[max(math.ceil(q * len(xs) - 1e-9), 1) - 1]
    # The pool's quantiles are of other numbers, so only the order of distances is checked against them.
    for lang, xs in of.items():
        spread = (limit[lang] - at(xs, 0.5)) * (len(xs) + Q.SHRINK) - len(xs) * (at(xs, Q.QUANTILE) - at(xs, 0.5))
        of[lang] = spread / Q.SHRINK
    assert len(of) == 3 and max(of.values()) - min(of.values()) < 1e-6
