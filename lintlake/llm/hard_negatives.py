"""Hard negatives from Hilbert-ordered Parquet blocks with zone maps.

Rows are ordered by label and by their place on a Hilbert curve through the
components that vary most, cut into blocks of one label, and written as a
Parquet table, a block a row, with the smallest and largest value of each
component (its zone map). For an anchor, interval arithmetic over a zone map
gives the least and the greatest product any row of the block can have.

Positives: the block an anchor lies in gives it a floor, the score of its
``POSITIVES``-th best there; blocks of its label whose greatest product reaches
the floor are read. Negatives: each positive opens a window of scores; blocks
of other labels whose interval meets one of the anchor's windows are read. All
products are exact integers and bounds are rounded outwards, so nothing that
counts is skipped. Anchors travel in groups, and zone maps in pages, which meet
by equality of a slot number; then groups meet the blocks they chose by number.

Defined cases: rows with a null vec_id, label or vector, or a null or
non-finite component take no part; shorter vectors count as padded with zeros;
rows that repeat an id are rows each, but an anchor never meets a row of its
own id, and anchors that repeat an id give their rows once each; a positive
without negatives in its window, and an empty table, give no rows; a positive
score below 0 has an empty window; products beyond 64 bits raise an error;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintlake.llm.shared import Workspace, parts_for

EVERY, SHIFTED, LABELS, SCALE = 50, 7, 10, 256.0
POSITIVES, NEGATIVES = 5, 3
#: A window holds the scores s with LEAST * positive <= 100 * s <= MOST * positive.
LEAST, MOST = 50, 95
#: Rows in a block, anchors in a group, zone maps in a page.
BLOCK, GROUP, PAGE = 2048, 256, 256
#: Components the curve runs through, and bits of each: together they fill a long.
CURVE, BITS = 8, 7
#: Bytes of vectors in a partition of the ordered table.
PART = 32_000_000


def mining_rows(table: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, label, x array<double> of integers) of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % SHIFTED == 0, (label + 1) % LABELS).otherwise(label)
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long"), shifted.alias("label"), x.alias("x")).where(F.forall("x", finite))
    # The floor of a double can exceed a long; it stays a double.
    return rows.withColumn("x", F.transform("x", lambda v: F.floor(v * scale).cast("double")))


def matrix(column, dims: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``dims``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    lengths = np.diff(offsets)
    if (lengths == dims).all():
        return flat.reshape(-1, dims).astype(np.float64, copy=False)
    out = np.zeros((len(lengths), dims))
    at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = flat
    return out


def component_ranges(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest, largest, variance) of each component: partial results per batch, merged in Spark; ``dims`` rows reach the driver."""

    def partial(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), dims)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (np.arange(dims), x.min(0), x.max(0), x.sum(0), (x * x).sum(0), np.full(dims, float(len(x))))],
                    ["dim", "low", "high", "total", "squares", "n"])

    parts = rows.select("x").mapInArrow(partial, "dim long, low double, high double, total double, squares double, n double")
    found = parts.groupBy("dim").agg(F.min("low"), F.max("high"), F.sum("total"), F.sum("squares"), F.sum("n")).orderBy("dim").collect()
    low, high, total, squares, n = (np.array([r[i] for r in found]) for i in range(1, 6))
    return low, high, squares / n - (total / n) ** 2


def hilbert_places(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (integers below 2**bits, one column a dimension)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    # Undo the rotations and reflections of each level, from the coarsest on.
    for level in range(bits - 1, 0, -1):
        side, below = 1 << level, (1 << level) - 1
        for d in range(dims):
            upper = (x[d] & side) != 0
            swap = np.where(upper, 0, (x[0] ^ x[d]) & below)
            x[0] ^= np.where(upper, below, swap)
            x[d] ^= swap
    # Gray code over the dimensions.
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> level) & 1)
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of integer-valued rows, as exact 64-bit integers."""
    size = float(np.abs(q).max(initial=0.0)) * float(np.abs(x).max(initial=0.0)) * q.shape[1]
    if size < 2**53:
        return (q @ x.T).astype(np.int64)
    if size < 2**63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
    return (whole(q) @ whole(x).T).astype(np.int64)


def product_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) product of each row of ``q`` with any point of each box, by interval arithmetic, rounded outwards."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    most, least = plus @ high.T + minus @ low.T, plus @ low.T + minus @ high.T
    slack = 1e-12 * q.shape[1] * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
    return least - slack, most + slack


def _bytes(*arrays: np.ndarray):
    return [pa.array([np.ascontiguousarray(a).tobytes()]) for a in arrays]


def _longs(*values: int):
    return [pa.array([v], pa.int64()) for v in values]


def ordered_blocks(rows: DataFrame, dims: int, ranges, block: int, parts: int) -> DataFrame:
    """Blocks of one label in order of the curve: block, label, ids, x and the zone map (low, high)."""
    low, high, variance = ranges
    along = np.argsort(-variance, kind="stable")[:CURVE]
    width = np.maximum(high - low, 1e-300)[along]

    def placed(batches):
        for batch in batches:
            x = matrix(batch.column("x"), dims)[:, along]
            cells = np.clip((x - low[along]) / width * (1 << BITS), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "x")), pa.array(hilbert_places(cells))], ["vec_id", "label", "x", "place"])

    def cut(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held_x, held_ids, held, label = [], [], 0, None

        def full():
            ids, x = np.concatenate(held_ids), np.concatenate(held_x)
            return pa.RecordBatch.from_arrays([*_longs(number, label), *_bytes(ids, x, x.min(0), x.max(0))], ["block", "label", "ids", "x", "low", "high"])

        for batch in batches:
            labels, ids = batch.column("label").to_numpy(), batch.column("vec_id").to_numpy()
            x, at = matrix(batch.column("x"), dims), 0
            while at < len(ids):
                if held and (labels[at] != label or held == block):
                    yield full()
                    number, held_x, held_ids, held = number + 1, [], [], 0
                label = int(labels[at])
                upto = min(at + block - held, at + int(np.searchsorted(labels[at:], label, "right")))
                held_x.append(x[at:upto])
                held_ids.append(ids[at:upto])
                held, at = held + upto - at, upto
        if held:
            yield full()

    order = rows.mapInArrow(placed, "vec_id long, label long, x array<double>, place long")
    order = order.repartitionByRange(parts, "label", "place", "vec_id").sortWithinPartitions("label", "place", "vec_id")
    return order.mapInArrow(cut, "block long, label long, ids binary, x binary, low binary, high binary")


def zone_pages(blocks: DataFrame, dims: int) -> DataFrame:
    """Zone maps, up to ``PAGE`` of a label in a row; only their columns of the blocks are read."""

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, {}

        def page(label):
            rows = held.pop(label)
            return pa.RecordBatch.from_arrays([*_longs(number, label), *_bytes(np.array([r["block"] for r in rows], np.int64)), *([pa.array([b"".join(r[c] for r in rows)]) for c in ("low", "high")])],
                                              ["page", "label", "blocks", "low", "high"])

        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["label"], []).append(row)
                if len(held[row["label"]]) == PAGE:
                    yield page(row["label"])
                    number += 1
        for label in list(held):
            yield page(label)
            number += 1

    return blocks.select("block", "label", "low", "high").mapInArrow(run, "page long, label long, blocks binary, low binary, high binary")


def best_places(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def anchor_groups(blocks: DataFrame, dims: int, every: int, k: int, group: int) -> DataFrame:
    """Anchors of one label in groups: grp, label, q_ids, q, floor (k-th best product in the anchor's own block; null bits as the least long)."""

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, {}

        def full(label, rows):
            ids, q, floor = (np.concatenate(c) for c in zip(*rows))
            return pa.RecordBatch.from_arrays([*_longs(number, label), *_bytes(ids, q, floor)], ["grp", "label", "q_ids", "q", "floor"])

        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["x"], np.float64).reshape(-1, dims)
                mine = np.flatnonzero(ids % every == 0)
                for a in range(0, len(mine), group):
                    some = mine[a : a + group]
                    scores, floor = products(x[some], x), np.full(len(some), np.iinfo(np.int64).min)
                    for i, at in enumerate(some):
                        others = scores[i][ids != ids[at]]
                        if len(others) >= k:
                            floor[i] = np.partition(others, len(others) - k)[len(others) - k]
                    rows = held.setdefault(row["label"], [])
                    if rows and sum(len(r[0]) for r in rows) + len(some) > group:
                        yield full(row["label"], held.pop(row["label"]))
                        number += 1
                    held.setdefault(row["label"], []).append((ids[some], x[some], floor))
        for label, rows in held.items():
            yield full(label, rows)
            number += 1

    return blocks.select("label", "ids", "x").mapInArrow(run, "grp long, label long, q_ids binary, q binary, floor binary")


#: Anchors on their way to a block: anchor = place in the whole, known by group and place there.
_CHOSEN = "block long, grp long, at binary, q_ids binary, q binary, low binary, high binary"


def _chosen(dims: int):
    """From rows (group, its windows low..high, page of zone maps) to the anchors that need each block."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q"], np.float64).reshape(-1, dims)
                low, high = (np.frombuffer(row[c], np.int64).reshape(len(ids), -1) for c in ("w_low", "w_high"))
                least, most = product_bounds(q, *(np.frombuffer(row[c], np.float64).reshape(-1, dims) for c in ("low", "high")))
                meets = np.zeros(least.shape, bool)
                for w in range(low.shape[1]):
                    open_ = (low[:, w] <= high[:, w])[:, None]
                    meets |= open_ & (most >= low[:, w, None].astype(float)) & (least <= high[:, w, None].astype(float))
                for j, block in enumerate(np.frombuffer(row["blocks"], np.int64)):
                    at = np.flatnonzero(meets[:, j])
                    if len(at):
                        yield pa.RecordBatch.from_arrays([*_longs(int(block), row["grp"]), *_bytes(at, ids[at], q[at], low[at], high[at])], [f.split()[0] for f in _CHOSEN.split(", ")])

    return run


def _read(dims: int, k: int):
    """From rows (anchors, block) to each window's k best rows of the block."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, at = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["at"], np.int64)
                q, x = (np.frombuffer(row[c], np.float64).reshape(-1, dims) for c in ("q", "x"))
                ids = np.frombuffer(row["ids"], np.int64)
                low, high = (np.frombuffer(row[c], np.int64).reshape(len(at), -1) for c in ("low", "high"))
                scores, out = products(q, x), []
                for i in range(len(at)):
                    other = ids != q_ids[i]
                    for w in range(low.shape[1]):
                        some = np.flatnonzero(other & (scores[i] >= low[i, w]) & (scores[i] <= high[i, w]))
                        some = some[best_places(scores[i][some], ids[some], k)]
                        out.append((np.full(len(some), (row["grp"] << 12) + at[i]), np.full(len(some), q_ids[i]), np.full(len(some), w), ids[some], scores[i][some]))
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["anchor", "anchor_id", "win", "vec_id", "score"])

    return run


def _found(groups: DataFrame, pages: DataFrame, blocks: DataFrame, slots: int, same: bool, dims: int, k: int) -> DataFrame:
    """(anchor, anchor_id, win, vec_id, score): the k best rows in each window of each anchor, of its own label or of the others."""
    g = groups.select("grp", F.col("label").alias("own"), "q_ids", "q", "w_low", "w_high", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    p = pages.select("label", "blocks", "low", "high", F.pmod(F.xxhash64("page"), F.lit(slots)).cast("int").alias("slot"))
    labels = F.col("own") == F.col("label") if same else F.col("own") != F.col("label")
    chosen = g.join(p, "slot").where(labels).select("grp", "q_ids", "q", "w_low", "w_high", "blocks", "low", "high").mapInArrow(_chosen(dims), _CHOSEN)
    met = chosen.join(blocks.select("block", "ids", "x"), "block")
    rows = met.mapInArrow(_read(dims, k), "anchor long, anchor_id long, win long, vec_id long, score long")
    order = Window.partitionBy("anchor", "win").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _windows(least: int, most: int, k: int):
    """Groups with their positives' windows in place of floors; a missing positive has a window that holds nothing."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["q_ids"]) // 8
                low, high = np.ones((n, k), np.int64), np.zeros((n, k), np.int64)
                for p in row["positives"] or []:
                    at, score = p["anchor"] - (row["grp"] << 12), p["score"]
                    low[at, p["rank"] - 1], high[at, p["rank"] - 1] = -((-least * score) // 100), (most * score) // 100
                yield pa.RecordBatch.from_arrays(
                    [*_longs(row["grp"], row["label"]), pa.array([row["q_ids"]]), pa.array([row["q"]]), *_bytes(low, high)], ["grp", "label", "q_ids", "q", "w_low", "w_high"])

    return run


def hard_negatives(table: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
                   scale: float = SCALE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = table.sparkSession
    work = Workspace(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = work.table(mining_rows(table, scale), "rows")
    n, dims = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not dims:
        # Without components all scores are 0, and so is every window.
        if not n:
            return spark.createDataFrame([], schema)
        rows, dims = rows.withColumn("x", F.array(F.lit(0.0))), 1
    parts = parts_for(spark, n * dims * 8.0, PART) if n > block else 1
    blocks = work.table(ordered_blocks(rows, dims, component_ranges(rows, dims), block, parts), "blocks")
    # Tasks big enough to fill pages and groups, whatever the number of files.
    pages = work.table(zone_pages(blocks.coalesce(int(-(-n // (PAGE * block)))), dims), "zones")
    slots = max(1, pages.count())
    groups = work.table(anchor_groups(blocks.coalesce(parts_for(spark, n, 4 * every * group)), dims, every, positives, group), "anchors")

    def floors(batches):
        for batch in batches:
            top = [np.full(len(f) // 8, np.iinfo(np.int64).max).tobytes() for f in batch.column("floor").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("grp", "label", "q_ids", "q", "floor")), pa.array(top, pa.binary())], ["grp", "label", "q_ids", "q", "w_low", "w_high"])

    opened = "grp long, label long, q_ids binary, q binary, w_low binary, w_high binary"
    near = work.table(_found(groups.mapInArrow(floors, opened), pages, blocks, slots, True, dims, positives), "positives")
    by_group = near.groupBy(F.shiftright("anchor", 12).alias("grp")).agg(F.collect_list(F.struct("anchor", "rank", "score")).alias("positives"))
    windows = groups.join(by_group, "grp").select("grp", "label", "q_ids", "q", "positives").mapInArrow(_windows(least, most, positives), opened)
    windows = work.table(windows, "windows")
    far = _found(windows, pages, blocks, slots, False, dims, negatives)
    far = far.select("anchor", (F.col("win") + 1).alias("place"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("rank").cast("int").alias("rank"))
    close = near.select("anchor", F.col("rank").cast("long").alias("place"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(close, ["anchor", "place"]).select(*[f.split()[0] for f in schema.split(", ")])


def negatives_sql(every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> str:
    """The same rows in DuckDB SQL, from the definition."""
    return f"""
WITH rows_in AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
         list_transform(embedding, lambda v: floor({SCALE} * CAST(v AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM rows_in a JOIN rows_in b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id),
near AS (
  SELECT * FROM (SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS place FROM scored WHERE same)
  WHERE place <= {positives}),
far AS (
  SELECT n.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY n.a, n.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM near n JOIN scored s ON n.a = s.a AND NOT s.same AND {LEAST} * n.positive_score <= 100 * s.score AND 100 * s.score <= {MOST} * n.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM far WHERE rank <= {negatives}
"""
