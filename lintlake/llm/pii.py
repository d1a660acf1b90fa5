"""Personal data: base patterns, and identifiers found by bootstrapped context patterns.

One pass over the texts finds the base spans (seeds) and candidates: chunks
with an ``@`` or four digits outside base spans. Seeds and candidates induce
lexical patterns: the word before, the two words before, the shape of the
text, and word before with shape. Spark then scores the graph of patterns and
instances in rounds. A pattern's confidence is the mean score of its distinct
instances, shrunk by its support; an instance that is no seed scores by
noisy-or over its confident patterns. Patterns with high confidence and enough
seeds add the candidates that they reach, as spans of kind ``context``.

Offsets are code points, ends exclusive. Every scan is linear in the text,
also in long runs of digits or letters.

Defined cases: null text is empty; null and repeated document ids are kept, a
result row per row; candidates never overlap base spans; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.shared import Workspace

KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS = 3
#: Patterns below the first are ignored in a round; those at the second, with so many seeds, extract.
TRUST, ACCEPT, SEEDS = 0.5, 0.8, 10

# The base patterns, with possessive repeats and run starts that leave the matches as they are.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGITS = re.compile(r"[^0-9]+")
_CANDIDATE = re.compile(r"@|[0-9]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_EDGE = "\"'`.,;:!?()[]{}<>|=#$%&*"
_DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(map(int, digits[-2::-2].translate(_DOUBLED)))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted; leftmost and non-overlapping per kind."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        if at >= last and (m := _DOMAIN.match(text, at)):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                last = m.end()
        # What stands before this sign can't belong to a later local part.
        last = max(last, at + 1)
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _DIGITS.sub("", m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _shape(text: str) -> str:
    shape = re.sub(r"[0-9]+", lambda m: f"0{len(m.group())}", re.sub(r"[^\W\d_]+", "a", text))
    return shape if len(shape) <= 64 else "#" + hashlib.md5(shape.encode()).hexdigest()


def _word_before(text: str, start: int, floor: int) -> tuple[str, int]:
    """The word that ends before ``start``; words over 32 characters count by their end."""
    end = start
    while end > floor and text[end - 1] in " \t\n\x0b\x0c\r" + _EDGE:
        end -= 1
        if start - end > 16:
            return "", start
    begin = end
    while begin > floor and end - begin < 32 and text[begin - 1] not in " \t\n\x0b\x0c\r":
        begin -= 1
    return text[begin:end].lower(), begin


def _patterns(text: str, start: int, end: int) -> list[str]:
    shape = _shape(text[start:end])
    one, at = _word_before(text, start, 0)
    two, _ = _word_before(text, at, 0)
    return [f"w {one}", f"ww {two} {one}", f"s {shape}", f"ws {one} {shape}"]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Chunks without their edge marks that hold an ``@`` or four digits and touch no base span."""
    out, pos, t = [], 0, 0
    taken = sorted((a, b) for a, _, b in taken)
    reach = -1  # the furthest end of the base spans that begin before the chunk's end
    while m := _CANDIDATE.search(text, pos):
        left = max(text.rfind(c, pos, m.start()) for c in " \t\n\x0b\x0c\r")
        begin = left + 1 if left >= 0 else pos
        stop = _SPACE.search(text, m.end())
        end = pos = stop.start() if stop else len(text)
        while t < len(taken) and taken[t][0] < end:
            reach = max(reach, taken[t][1])
            t += 1
        if reach > begin:
            continue
        chunk = text[begin:end]
        core = chunk.lstrip(_EDGE)
        begin += len(chunk) - len(core)
        core = core.rstrip(_EDGE)
        if "@" in core or sum(map(core.count, "0123456789")) >= 4:
            out.append((begin, begin + len(core)))
    return out


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_SCAN = "base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,end:int,seed:boolean,instance:bigint,patterns:array<string>>>"


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``found`` (seeds and candidates with their patterns); docs must have text."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    finds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))]))

    def run(batches):
        for batch in batches:
            bases, founds = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                found = [(a, b, True) for a, _, b in base] + [(a, b, False) for a, b in candidates(text, base)]
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                founds.append([{"start": a, "end": b, "seed": s, "instance": _key(text[a:b]), "patterns": _patterns(text, a, b)} for a, b, s in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bases, spans), pa.array(founds, finds)], [*batch.schema.names, "base", "found"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, {_SCAN}")


def score_patterns(work: Workspace, edges: DataFrame, rounds: int = ROUNDS, trust: float = TRUST) -> DataFrame:
    """(pattern, confidence, seeds) from distinct edges (pattern, instance, seed).

    Each round is a join of the edges with the scores of one side and an
    aggregation for the other; tables between rounds lie in the shared folder.
    """
    scores = None
    for turn in range(rounds):
        scored = edges.withColumn("score", F.col("seed").cast("double")) if scores is None else (
            edges.join(scores, "instance", "left").select("pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score")))
        support = F.sum("score")
        # Rounded, so that the order of additions cannot decide a threshold.
        rated = scored.groupBy("pattern").agg(
            F.round(support / F.count("*") * (1 - 1 / (1 + support)), 9).alias("confidence"), F.sum(F.col("seed").cast("long")).alias("seeds"))
        patterns = work.table(rated, f"patterns-{turn}")
        if turn:
            work.drop(f"patterns-{turn - 1}")
        if turn + 1 < rounds:
            trusted = patterns.where(F.col("confidence") >= trust)
            reached = edges.where("not seed").join(trusted.select("pattern", "confidence"), "pattern")
            scores = work.table(reached.groupBy("instance").agg(
                F.round(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6))))), 9).alias("score")), f"instances-{turn}")
    return patterns


def find_entities(docs: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, seeds: int = SEEDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, both arrays of (start, kind number, end) sorted by start and kind.

    ``keep`` names the columns to carry; without text, the tables in between hold none.
    """
    work = Workspace(docs.sparkSession, "pii")
    columns = docs.columns if keep is None else keep
    scanned = scan(docs).select(*columns, "base", "found", F.monotonically_increasing_id().alias("_row"))
    scanned = work.table(scanned, "scanned")
    finds = scanned.select("_row", F.explode("found").alias("f")).select(
        "_row", "f.start", "f.end", "f.seed", "f.instance", F.explode("f.patterns").alias("pattern"))
    edges = work.table(finds.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    patterns = score_patterns(work, edges, rounds)
    accepted = patterns.where((F.col("confidence") >= accept) & (F.col("seeds") >= seeds)).select("pattern")
    added = (
        finds.where("not seed").join(accepted, "pattern", "left_semi")
        .groupBy("_row").agg(F.collect_set(F.struct("start", F.lit(KINDS.index("context")).alias("kind"), "end")).alias("added"))
    )
    added = work.table(added.withColumnRenamed("_row", "_at"), "added")
    work.drop("edges")
    joined = scanned.drop("found").join(added, F.col("_row") == F.col("_at"), "left")
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return joined.select(*columns, "base", F.array_sort(F.concat("base", F.coalesce("added", nothing))).alias("spans"))


def _written(spans) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def entity_digest(docs: DataFrame) -> DataFrame:
    """doc_id, base spans per kind, hash of the base spans, all spans, and n_context (added ones)."""
    found = find_entities(docs.select("doc_id", "text"), keep=["doc_id"])
    count = lambda n: F.size(F.filter("spans", lambda s: s.kind == n)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; n_chars, where there is one, follows.

    Overlapping spans are replaced as one, named after the first.
    """

    def run(batches):
        for batch in batches:
            texts = []
            for value, spans in zip(batch.column("text"), batch.column("spans")):
                text, parts, pos, last = value.as_py(), [], 0, -1
                for s in spans.as_py() if text is not None else []:
                    if s["start"] >= last:
                        parts += [text[pos : s["start"]], f"<{KINDS[s['kind']]}>"]
                        pos = last = s["end"]
                    elif s["end"] > last:
                        pos = last = s["end"]
                texts.append(text if not parts else "".join([*parts, text[pos:]]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(n).type) if n == "text" else batch.column(n) for n in batch.schema.names if n != "spans"], [n for n in batch.schema.names if n != "spans"])

    found = find_entities(docs, **options).drop("base")
    out = found.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
