"""Packing against brute force: every id once, gapless offsets, sequences within the limit, hashes of real ids."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from lintlake.llm import packing
from lintlake.llm.queries import tokenizer_path

ROWS = [
    (1, "Hello world"), (2, None), (3, ""), (4, "Ünïcode, wörds! 123 it's <|endoftext|> x\x0b\x0cy z"), (5, "long " * 9000), (6, "same"), (6, "same"),
    (None, "no id"), (7, "   \n\t "), (8, "İSTANBUL ΣΑΣ é 한글 \U0001f600"),
]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_pieces_cover_every_id_once(spark, whole):
    docs = spark.createDataFrame([(i, t, "other", 3) for i, t in ROWS], "doc_id long, text string, shard string, ids int")
    rows = packing.pack(docs, tokenizer_path()).collect()
    want = defaultdict(list)
    for i, t in ROWS:
        want[i].append(whole(t))
    got, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        got[r.doc_id].append((r.start, r.length, tuple(ids), r.doc_tokens))
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, texts in want.items():
        if len(texts) == 1:
            flat = [x for p in sorted(got[i]) for x in p[2]]
            assert flat == texts[0] and {p[3] for p in got[i]} == {len(flat)}
        else:
            assert sorted(p[2] for p in got[i]) == sorted(map(tuple, texts))
    for parts in seqs.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= packing.LENGTH
    total = sum(len(x) for v in want.values() for x in v)
    assert len(seqs) == -(-total // packing.LENGTH)


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2000, 400)
    pieces = packing.place_pieces(lengths, list(range(400)), 4096, 1.0, 1 / 4096)
    cost = defaultdict(float)
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 4096
    full = sorted(cost.values())[1:]
    assert max(full) / min(full) < 1.35


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
