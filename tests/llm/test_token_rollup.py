"""Rollups against a recount of what a plain dictionary of documents holds after each batch."""

import random
from collections import Counter

from lintlake.llm import token_rollup as R
from lintlake.llm.queries import tokenizer_path
from lintlake.llm.shared import Workspace

COUNTS = "doc_id long, source string, lang string, tokenizer string, version int, tokens long"


def held(ledger):
    return {(r.source, r.lang, r.tokenizer, r.version): (r.docs, r.tokens) for r in ledger.totals().collect()}


def recount(state):
    docs, tokens = Counter(), Counter()
    for (_, tokenizer), (source, lang, version, n) in state.items():
        docs[source, lang, tokenizer, version] += 1
        tokens[source, lang, tokenizer, version] += n
    return {k: (docs[k], tokens[k]) for k in docs}


def test_batches_replays_and_broken_commits(spark):
    ledger = R.TokenLedger(spark, Workspace(spark, "test").path("ledger"))
    rng, state = random.Random(4), {}
    for batch in range(1, 5):
        counts, gone = {}, {rng.randint(0, 40) for _ in range(4 * (batch > 1))}
        for _ in range(30):
            counts[rng.choice([None, *range(40)]), rng.choice(["w", "t"])] = (rng.choice(["a", "b", None]), rng.choice(["en", "de"]), batch, rng.randint(0, 99))
        rows = [(k[0], v[0], v[1], k[1], v[2], v[3]) for k, v in counts.items()]
        frames = spark.createDataFrame(rows + rows[:3], COUNTS), spark.createDataFrame([(g,) for g in gone], "doc_id long")
        if batch == 3:  # a commit that broke off after its facts
            frames[0].withColumn("sign", R.F.lit(1)).write.parquet(ledger._path("facts", batch))
        assert ledger.commit(batch, *frames)
        before = held(ledger)
        assert not ledger.commit(batch, *frames) and held(ledger) == before
        state = {k: v for k, v in (state | counts).items() if k[0] not in gone}
        assert before == recount(state)


def test_history_equals_a_recount(spark):
    docs = [(i, "w!! " * (i % 5) + "--- é1", "s" + str(i % 2), "en", 9) for i in range(40)] + [(50, None, "s0", None, 1), (51, "", None, "en", 1)]
    labels = [(i, 0, 0) for i in range(0, 40, 4)] + [(1, 1, 1)]
    work = Workspace(spark, "test")
    got = R.corpus_history(
        R.TokenLedger(spark, work.path("ledger")), work, spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, tokens int"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {"bpe": tokenizer_path()}).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    state = {}
    for i, text, source, lang, _ in docs:
        if i not in {x[0] for x in labels if x[1] == 0}:
            state[i, "bpe"] = (source, lang, 1, len(t.encode(text or "").ids))
            state[i, "words"] = (source, lang, 2, sum(any(c.isalnum() for c in w) for w in (text or "").split()))
    assert {(r.source, r.lang, r.tokenizer, r.version): (r.docs, r.tokens) for r in got} == recount(state)


def test_empty(spark):
    ledger = R.TokenLedger(spark, Workspace(spark, "test").path("ledger"))
    assert ledger.commit(1) and ledger.totals().count() == 0 and ledger.committed() == [1]
