"""Sliding-window admission per key: exact, since each decision rests on earlier ones.

A request is let in while fewer than ``max_requests`` admitted ones lie in the
window before it. The state of a key is its admitted times inside one window,
so it never holds more than ``max_requests`` numbers.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, ts timestamp, allowed boolean, remaining int"


def decide(times, admitted: deque, max_requests: int, window_us: int):
    """(allowed, remaining) for ordered times; ``admitted`` is updated in place."""
    for at in times:
        while admitted and admitted[0] <= at - window_us:
            admitted.popleft()
        allowed = len(admitted) < max_requests
        if allowed:
            admitted.append(at)
        yield allowed, max_requests - len(admitted)


def admit_requests(requests: DataFrame, max_requests: int, window_seconds: int) -> DataFrame:
    """Batch form over ``requests(key, ts)``.

    A pause of a full window empties the state, so a key is cut at its pauses
    and the pieces are decided apart. Pauses are found in (key, bucket) parts
    one window wide; per key only one row per bucket is ordered, never the
    requests. A piece itself is sequential by nature: it streams through its
    task in time order and holds no more than one window of admitted times.
    """
    window_us = window_seconds * 1_000_000
    timed = (
        requests.select("key", F.col("ts").cast("timestamp").alias("ts"))
        .withColumn("_us", F.unix_micros("ts"))
        .withColumn("_b", F.floor(F.col("_us") / window_us).cast("bigint"))
    )
    last = timed.groupBy("key", (F.col("_b") + 1).alias("_b")).agg(F.max("_us").alias("_carried"))
    inside = Window.partitionBy("key", "_b").orderBy("_us")
    near = timed.join(last, ["key", "_b"], "left").withColumn("_before", F.coalesce(F.lag("_us").over(inside), "_carried"))
    fresh = F.col("_before").isNull() | (F.col("_us") - F.col("_before") >= window_us)
    flagged = near.withColumn("_start", F.when(fresh, F.col("_us"))).withColumn(
        "_start", F.max("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    earlier = Window.partitionBy("key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = flagged.groupBy("key", "_b").agg(F.max("_start").alias("_last")).select(
        "key", "_b", F.max("_last").over(earlier).alias("_open")
    )
    pieces = flagged.join(carried, ["key", "_b"]).select(
        "key", "ts", "_us", F.coalesce("_start", "_open").alias("_piece")
    )
    # One pass over sorted partitions: state is only the last window of the current piece.
    ordered = pieces.repartition("key", "_piece").sortWithinPartitions("key", "_piece", "_us")

    def run(batches):
        current, admitted = None, deque()
        for batch in batches:
            allowed, remaining = [], []
            for key, piece, at in zip(batch["key"], batch["_piece"], batch["_us"]):
                if (key, piece) != current:
                    current, admitted = (key, piece), deque()
                for a, r in decide((at,), admitted, max_requests, window_us):
                    allowed.append(a)
                    remaining.append(r)
            yield pd.DataFrame({"key": batch["key"], "ts": batch["ts"], "allowed": allowed, "remaining": remaining})

    return ordered.mapInPandas(run, OUTPUT)


class AdmissionProcessor(StatefulProcessor):
    """Streaming form: requests wait until the watermark has passed them, then are decided in order of time.

    State of a key: the waiting times, no more than arrive within the allowed
    lateness, and the admitted times of one window. One timer stands for the
    earliest waiting request; with none waiting, for the newest admitted time
    leaving its window, after which the key holds nothing.
    """

    def __init__(self, max_requests: int, window_seconds: int):
        self.max_requests = max_requests
        self.window_us = window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getValueState("admitted", "times array<bigint>")
        self.waiting = handle.getListState("waiting", "at bigint")
        self.alarm = handle.getValueState("alarm", "ms bigint")

    def _set_alarm(self, ms: int | None) -> None:
        if self.alarm.exists():
            self.handle.deleteTimer(self.alarm.get()[0])
        if ms is None:
            self.alarm.clear()
        else:
            self.handle.registerTimer(ms)
            self.alarm.update((ms,))

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for part in rows:
            # Event times arrive as nanosecond or microsecond stamps; state keeps microseconds.
            times = part["ts"].astype("datetime64[us]").astype("int64")
            for at in times:
                self.waiting.appendValue((int(at),))
            first = int(times.min()) if first is None else min(first, int(times.min()))
        if first is not None:
            due = first // 1000 + 1
            # An alarm for an earlier waiting request stands; one for eviction gives way.
            if self._none_waited_before(due):
                self._set_alarm(due)
        return iter([])

    def _none_waited_before(self, due: int) -> bool:
        return not self.alarm.exists() or due < self.alarm.get()[0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.alarm.clear()
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        held = deque(self.admitted.get()[0]) if self.admitted.exists() else deque()
        times = sorted(t for (t,) in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [t for t in times if t < now_us], [t for t in times if t >= now_us]
        decisions = list(decide(ready, held, self.max_requests, self.window_us))
        if later:
            self.waiting.put([(t,) for t in later])
            self._set_alarm(later[0] // 1000 + 1)
        else:
            self.waiting.clear()
        if held and held[-1] + self.window_us > now_us:
            self.admitted.update((list(held),))
            if not later:
                self._set_alarm((held[-1] + self.window_us) // 1000 + 1)
        else:
            self.admitted.clear()
        if ready:
            yield pd.DataFrame({
                "key": [key[0]] * len(ready),
                "ts": pd.to_datetime(pd.Series(ready, dtype="int64"), unit="us"),
                "allowed": [a for a, _ in decisions],
                "remaining": pd.Series([r for _, r in decisions], dtype="int32"),
            })

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, max_requests: int, window_seconds: int, lateness: str = "1 minute") -> DataFrame:
    """``requests(key, ts)`` as a stream to one decision per request, given once the watermark has passed it.

    Decisions equal the batch form's for every request that comes within ``lateness``.
    """
    return (
        requests.select("key", "ts")
        .withWatermark("ts", lateness)
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=AdmissionProcessor(max_requests, window_seconds),
            outputStructType=OUTPUT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
