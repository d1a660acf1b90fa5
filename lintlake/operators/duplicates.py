"""Repeated code: line blocks across a corpus, and immediate repeats in a text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.rules import security

KEYS = ["project", "path", "language"]


def line_blocks(files: DataFrame, k: int = 5) -> DataFrame:
    """md5 of every run of ``k`` non-blank lines, white space evened out.

    Blocks are formed inside the row, so only hashes are shuffled later.
    """
    trimmed = F.transform(
        F.split("text", "\n", -1),
        lambda x: F.regexp_replace(F.trim(x), r"\s+", " "),
    )
    kept = files.select(*KEYS, F.filter(trimmed, lambda x: ~x.rlike(r"\A\s*\z")).alias("_l")).where(F.size("_l") >= k)
    starts = F.sequence(F.lit(1), F.size("_l") - k + 1)
    blocks = F.transform(starts, lambda i: F.md5(F.array_join(F.slice("_l", i, F.lit(k)), "\n").cast("binary")))
    return kept.select(*KEYS, F.posexplode(blocks).alias("position", "block"))


def duplicate_blocks(files: DataFrame, k: int = 5) -> DataFrame:
    """Blocks that occur more than once, with copies and files.

    Counts are combined per (block, file) first and then per block, so a block
    that fills a third of the corpus is only a number in each task.
    """
    per_file = line_blocks(files, k).groupBy("block", "project", "path").agg(F.count("*").alias("_n"))
    return (
        per_file.groupBy("block")
        .agg(F.sum("_n").cast("bigint").alias("copies"), F.count("*").alias("files"))
        .where("copies > 1")
    )


def _equal_runs(equal: np.ndarray):
    """(start, end) of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
    return zip(edges[::2].tolist(), edges[1::2].tolist())


class _Runs:
    """Maximal stretches with a period; one stretch stands for all multiples of its period."""

    def __init__(self, n: int, shortest: int):
        self.best, self.shortest, self.found = np.zeros(n, dtype=np.int64), shortest, {}

    def covers(self, period: int, places: np.ndarray) -> np.ndarray:
        """Which places lie in a known stretch whose period divides this one."""
        known = np.zeros(len(places), dtype=bool)
        for divisor, stretches in self.found.items():
            if period % divisor == 0:
                for start, end in stretches:
                    known |= (places >= start) & (places + period < end)
        return known

    def add(self, start: int, end: int, period: int) -> None:
        self.found.setdefault(period, []).append((start, end))
        places = np.arange(start, end)
        # The longest half at a place: as many whole periods as fit twice into the rest of the stretch.
        half = (end - places) // (2 * period) * period
        half[half < self.shortest] = 0
        self.best[start:end] = np.maximum(self.best[start:end], half)


GRAM = 16
#: Rows are searched for equal grams in pieces of about this many bytes.
PIECE = 1 << 20


def _gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of every run of ``GRAM`` codes, by doubling."""
    hashes, width = codes.astype(np.uint64) + np.uint64(1), 1
    while width < GRAM:
        hashes = hashes[:-width] * np.uint64(pow(1099511628211, width, 1 << 64)) + hashes[width:]
        width *= 2
    # Mixed, so that the least one of a stretch is any of its places.
    hashes ^= hashes >> np.uint64(29)
    return hashes * np.uint64(0x9E3779B97F4A7C15)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = pick(values[:-step], values[step:])
        reach += step
    return values


def _marks(hashes: np.ndarray, shortest: int) -> np.ndarray:
    """Places whose gram is the least of some ``shortest`` characters around it.

    Equal stretches of ``shortest`` characters have theirs at the same places.
    """
    width = shortest - GRAM + 1
    least = _sliding(hashes, width, np.minimum)
    ends = np.zeros(width - 1, dtype=np.uint64)
    return np.flatnonzero(_sliding(np.concatenate((ends, least, ends)), width, np.maximum) == hashes)


def _periods(hashes: np.ndarray, shortest: int, n: int):
    """Distances from ``shortest`` on at which ``shortest`` characters may recur; all, where that is less work."""
    marks = _marks(hashes, shortest)
    keys = hashes[marks]
    order = np.argsort(keys, kind="stable")
    keys, marks = keys[order], marks[order]
    group = np.diff(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))))
    if int((group * group).sum()) > 64 * n:
        return range(shortest, n // 2 + 1)
    found = []
    for lag in range(1, int(group.max())):
        found.append((marks[lag:] - marks[:-lag])[keys[lag:] == keys[:-lag]])
    periods = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return periods[(periods >= shortest) & (periods <= n // 2)].tolist()


def rows_that_may_repeat(texts: pa.Array, shortest: int = 50) -> np.ndarray:
    """Numbers of the texts in which ``shortest`` bytes may occur twice, in order; none that holds a repeat is left out."""
    if not len(texts):
        return np.zeros(0, dtype=np.int64)
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    found, row = [], 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + PIECE, side="right")) - 1)
        codes = data[ends[row] : ends[last]]
        if len(codes) >= 2 * shortest:
            hashes = _gram_hashes(codes)
            marks = _marks(hashes, shortest)
            rows = np.searchsorted(ends[row : last + 1] - ends[row], marks, side="right") - 1
            order = np.lexsort((hashes[marks], rows)) if last - row > 1 else np.argsort(hashes[marks])
            keys, rows = hashes[marks][order], rows[order]
            found.append(row + np.unique(rows[1:][(keys[1:] == keys[:-1]) & (rows[1:] == rows[:-1])]))
        row = last
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def immediate_repeats(text: str, shortest: int = 50) -> list[int]:
    """Starts of non-overlapping ``XX`` with ``len(X) >= shortest``, longest X first at each start.

    A repeat with period p lies in a stretch whose places equal the place p
    later. Short periods are compared directly where some grams agree. A longer
    one is a distance at which ``shortest`` characters recur, so it is among the
    distances of equal marks (see :func:`_marks`); a stretch holds a multiple of ``p - GRAM`` where
    even the next characters agree, so hashes are compared at those places
    only. Multiples of a known stretch's period are skipped inside it, so
    periodic text stays cheap.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    gram = GRAM
    if n < 2 * shortest:
        return []
    hashes = _gram_hashes(codes)
    periods = _periods(hashes, shortest, n)
    if not len(periods):
        return []
    runs = _Runs(n, shortest)
    # A stretch of two halves with a shorter period has equal grams at the period's distance at this many places in a row.
    places = np.arange(0, len(hashes), shortest - gram + 2)
    ahead = np.minimum(places + np.arange(1, shortest)[:, None], len(hashes) - 1)
    for period in (np.flatnonzero((hashes[ahead] == hashes[places]).any(axis=1)) + 1).tolist():
        equal = codes[:-period] == codes[period:]
        for b, e in _equal_runs(equal):
            if e + period - b >= 2 * shortest and not runs.covers(period, np.array([b]))[0]:
                runs.add(b, e + period, period)
    for period in periods:
        here = hashes[: len(hashes) - period : period - gram]
        there = hashes[period :: period - gram][: len(here)]
        hits = np.flatnonzero(here == there) * (period - gram)
        if not hits.size:
            continue
        hits = hits[~runs.covers(period, hits)]
        if not hits.size:
            continue
        # A stretch of a full period reaches half a period to one side of the place; look at some places there first.
        steps = np.linspace(0, max(period // 2 - gram, 0), 9).astype(np.int64)
        last = len(hashes) - period - 1
        same = lambda at: (at >= 0) & (at <= last) & (hashes[np.clip(at, 0, last)] == hashes[np.clip(at, 0, last) + period])
        likely = same(hits[:, None] + steps).all(axis=1) | same(hits[:, None] - steps).all(axis=1)
        done = 0
        for hit in hits[likely].tolist():
            if hit < done:
                continue
            low, high = hit, hit
            # Grow the window until the stretch around the hit ends inside it.
            reach = period
            while True:
                low, high = max(0, hit - reach), min(n - period, hit + 2 * reach)
                equal = codes[low:high] == codes[low + period : high + period]
                own = next(((b, e) for b, e in _equal_runs(equal) if b <= hit - low < e), None)
                if own is None or ((own[0] > 0 or low == 0) and (own[1] < high - low or high == n - period)):
                    break
                reach *= 2
            if own is not None:
                done = low + own[1]
                if own[1] - own[0] >= period:
                    runs.add(low + own[0], low + own[1] + period, period)
    out, at = [], 0
    for start in np.flatnonzero(runs.best):
        if start >= at:
            out.append(int(start))
            at = start + 2 * int(runs.best[start])
    return out


def _repeats(batches):
    schema = pa.schema([(c, pa.string()) for c in KEYS] + [("line", pa.int32()), ("column", pa.int32())])
    for batch in batches:
        rows = {c: [] for c in (*KEYS, "line", "column")}
        batch = batch.take(pa.array(rows_that_may_repeat(batch.column(3))))
        for project, path, language, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for at in immediate_repeats(text):
                place = (text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at))
                for key, value in zip(rows, (project, path, language, *place)):
                    rows[key].append(value)
        yield pa.RecordBatch.from_pydict(rows, schema=schema)


def repeated_text(files: DataFrame) -> DataFrame:
    """Texts of 50 or more characters repeated at once, with line and column."""
    wanted = files.where(F.length("text") >= 100).select(*KEYS, "text")
    return wanted.mapInArrow(_repeats, "project string, path string, language string, line int, column int")


def repeat_findings(files: DataFrame) -> DataFrame:
    """Repeats as findings of the rule that reports them, without a ``match``."""
    rule, nothing = security.REPEAT_RULE, F.lit(None).cast("string")
    return repeated_text(files).select(
        *KEYS,
        F.lit(rule.engine).alias("engine"),
        F.lit(rule.rule).alias("rule"),
        F.lit(rule.category).alias("category"),
        nothing.alias("sub_category"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.message).alias("message"),
        nothing.alias("suggestion"),
        "line",
        "column",
        F.lit("").alias("match"),
        F.lit(False).alias("auto_fixable"),
        F.lit(None).cast("int").alias("number"),
        F.lit(-1).alias("rule_order"),
    )
