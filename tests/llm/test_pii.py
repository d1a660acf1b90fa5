"""Spans against the patterns as written, planted context identifiers, and long runs."""

import hashlib
import random
import re
import time

from lintlake.llm import pii

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 14 <= len(d := re.sub("[^0-9]", "", t)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 10 <= len(re.sub("[^0-9]", "", t)) <= 15),
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PLAIN) for m in re.finditer(p, text) if ok(m.group())]
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(5)
    fixed = ["a@b@c.d e@f.g@h.i.j", "1.2.3.4.5.6.7.8 999.1.1.1 00255.1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (017) 555-7713 +1-2 +", "ü@x.y é.a@b-c.d-", "@a.b", "a@b.c@d.e.f"]
    for text in fixed + ["".join(rng.choices("ab@.+-% 0123456789()é", k=rng.randint(0, 60))) for _ in range(20_000)]:
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_are_linear():
    for piece in ("a", "1", "1.", "@", "a@", "+1", "1 ", "a.1@b"):
        start = time.time()
        text = piece * (600_000 // len(piece))
        pii.candidates(text, pii.base_spans(text))
        assert time.time() - start < 6, piece


def test_digest_and_bootstrapping(spark):
    rng = random.Random(2)
    rows = [(i, f"wrote to mail {rng.randint(0, 9**6)}@host{i}.example.com yesterday") for i in range(40)]
    rows += [(100 + i, f"wrote to mail user{rng.randint(1000, 9**6)}#host today") for i in range(4)]
    rows += [(200 + i, f"the total was {rng.randint(1000, 9**6)} units") for i in range(40)]
    rows += [(300, None), (301, ""), (None, "a@b.c"), (302, "a@b.c"), (302, "a@b.c"), (303, "x" * 300_000 + " 4111111111111111")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, spans string, base int")
    got = pii.entity_digest(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    names = pii.KINDS
    for i, t in rows:
        base = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in plain_spans(t or ""))
        assert by[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(by[i].spans.split(","))
    for i in range(4):
        assert by[100 + i].n_context == 1 and by[100 + i].spans.startswith("context:14:")
    assert not any(by[200 + i].spans for i in range(40)) and by[300].spans == "" and by[303].n_card == 1


def test_redact(spark):
    docs = spark.createDataFrame([(1, "hi a@b.c, +1 (017) 555-7713!", 5), (2, None, 0), (3, "plain", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    assert got == {1: ("hi <email>, <phone>!", 20), 2: (None, None), 3: ("plain", 5)}


def test_empty(spark):
    assert pii.entity_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
