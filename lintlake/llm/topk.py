"""Exact top-k inner products by norm order, rotated partial sums and Cauchy-Schwarz bounds.

Vectors are cut into blocks in descending order of length. The eigenvectors of
the vectors' second moments (the right singular vectors) rotate everything, so
that the first coordinates hold most of each product. For a query, a block is
skipped if its longest vector times the query's length stays below the query's
threshold; a vector is skipped if its partial product over the first
coordinates plus the product of the residual lengths does. What is left is
scored exactly on the original integers.

Thresholds come first: each query block meets the block of longest vectors and
keeps its k-th best score there. With them the other pairs of blocks prune.

The rotation only feeds bounds, and bounds get slack for rounding, so results
are exact. Ties go to the smaller id; nothing that ties the k-th is lost.

Defined cases: vectors that are null or hold null or non-finite components
take no part; an empty or shorter vector counts as padded with zeros; rows
that repeat an id are candidates each; a query never meets rows of its own id;
fewer than k candidates give all; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintlake.llm.shared import Workspace

K, EVERY, SCALE = 20, 20, 64.0
#: Vectors in a block, queries in a block, and rotated coordinates in a partial sum.
BLOCK, QUERIES, HEAD = 4096, 512, 24


def clean_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, x array<double>) of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return table.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", x.alias("x")).where(F.forall("x", finite))


def second_moments(vectors: DataFrame, column: str, dims: int) -> np.ndarray:
    """Sum of x x^T, a dims x dims matrix: partial sums per batch, added up in Spark."""

    def partial(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(column), dims)
                scale = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                total += (x / scale).T @ (x / scale)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], ["place", "value"])

    sums = vectors.select(column).mapInArrow(partial, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(dims * dims)
    for r in sums.collect():  # dims * dims numbers, whatever the table's size
        out[r.place] = r.value
    return out.reshape(dims, dims)


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``dims``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims).astype(np.float64, copy=False)
    out = np.zeros((len(lengths), dims))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out


def _packed(rows: DataFrame, dims: int, keys: list[str]) -> DataFrame:
    """Rows of a block as one row: ids and a row-major matrix of doubles, longest first."""

    def run(table: pa.Table) -> pa.Table:
        x, ids = _matrix(table.column("x"), dims), table.column("vec_id").to_numpy()
        order = np.lexsort((ids, -np.linalg.norm(x, axis=1)))
        return pa.table({**{k: pa.array([table.column(k)[0].as_py()], pa.int64()) for k in keys}, "ids": pa.array([ids[order].tobytes()]), "x": pa.array([np.ascontiguousarray(x[order]).tobytes()]),
                         "longest": pa.array([float(np.linalg.norm(x, axis=1).max(initial=0.0))])})

    return rows.groupBy(*keys).applyInArrow(run, ", ".join(f"{k} long" for k in keys) + ", ids binary, x binary, longest double")


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products of integer-valued rows, as integers."""
    size = float(np.abs(q).max(initial=0.0)) * float(np.abs(x).max(initial=0.0)) * q.shape[-1]
    if size < 2**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    if size < 2**62:
        return np.einsum("ij,ij->i", q.astype(np.int64), x.astype(np.int64))
    return np.array([sum(int(a) * int(b) for a, b in zip(r, s)) for r, s in zip(q, x)], dtype=object).astype(np.int64)


def best_of_pair(q_ids, q, x_ids, x, rotation, head: int, k: int, floor: np.ndarray):
    """(query places, ids, scores): each query's k best of the block with scores at its floor or above."""
    qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    slack = 1e-9 * (qn * xn.max(initial=0.0)) + 1e-9
    out_q, out_id, out_s = [], [], []
    live = np.flatnonzero(qn * xn.max(initial=0.0) + slack >= floor)
    if not live.size or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    qr, xr = q[live] @ rotation, x @ rotation
    rest_q, rest_x = (np.sqrt(np.maximum((m[:, head:] ** 2).sum(axis=1), 0)) for m in (qr, xr))
    partial = qr[:, :head] @ xr[:, :head].T
    bound = partial + rest_q[:, None] * rest_x[None, :] + slack[live][:, None]
    for row, at in enumerate(live):
        # Longest first: the block is left where length alone rules out the rest.
        stop = np.searchsorted(-xn, -max(0.0, (floor[at] - slack[at]) / max(qn[at], 1e-300)), "right") if floor[at] > 0 else len(x)
        near = np.flatnonzero(bound[row, :stop] >= floor[at])
        near = near[x_ids[near] != q_ids[at]]
        if near.size > k:
            # The k best bounds' scores raise the floor before the others are scored.
            first = near[np.argpartition(-bound[row, near], k - 1)[:k]]
            lower = np.sort(exact_scores(np.broadcast_to(q[at], (k, q.shape[1])), x[first]))[0]
            near = near[bound[row, near] >= max(floor[at], lower)]
        if near.size:
            s = exact_scores(np.broadcast_to(q[at], (near.size, q.shape[1])), x[near])
            best = np.lexsort((x_ids[near], -s))[:k]
            best = best[s[best] >= floor[at]]
            out_q.append(np.full(best.size, at))
            out_id.append(x_ids[near][best])
            out_s.append(s[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


_BEST = "query_id long, query_row long, vec_id long, score long"


def _compare(dims: int, rotation: np.ndarray, head: int, k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, x_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q, x = (np.frombuffer(row[c], np.float64).reshape(-1, dims) for c in ("q", "x"))
                floor = np.frombuffer(row["floor"], np.float64) if row["floor"] else np.full(len(q), -np.inf)
                at, ids, scores = best_of_pair(q_ids, q, x_ids, x, rotation, head, k, floor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[at]), pa.array(row["q_block"] * 2**20 + at), pa.array(ids), pa.array(scores)], ["query_id", "query_row", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(table: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE, block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, vec_id, score. Queries: ids divisible by ``every``."""
    spark = table.sparkSession
    work = Workspace(spark, "topk")
    whole = clean_vectors(table).select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("double")).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    vectors = work.table(whole.withColumn("norm", norm), "vectors")
    n, dims = vectors.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not dims:
        zeros = vectors if n else vectors.limit(0)
        return _all_zero(zeros, every, k)
    rotation = np.linalg.eigh(second_moments(vectors, "x", dims))[1][:, ::-1].copy()
    head = min(head, dims)
    # Range partitions in order of length, numbered within: block numbers follow the norms.
    blocks = -(-n // block)
    cuts = vectors.stat.approxQuantile("norm", [i / blocks for i in range(1, blocks)], 0.25 / blocks) if blocks > 1 else []
    bounds = sorted(set(cuts), reverse=True)
    # Norms that tie fill one range, so it is dealt on by hash of the id; the range's number still follows the norm.
    ranges = F.lit(len(bounds)) - F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: F.col("norm") >= b)) if bounds else F.lit(0)
    ranged = vectors.withColumn("range", ranges.cast("long"))
    counts = ranged.groupBy("range").agg(F.ceil(F.count("*") / block).cast("long").alias("pieces"))
    dealt = ranged.join(counts, "range").withColumn("piece", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), "pieces"))
    data = work.table(_packed(dealt.select("range", "piece", "vec_id", "x"), dims, ["range", "piece"]).repartition(blocks), "data")
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    q_blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("q_block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(q_blocks)))
    queries = _packed(asked.select("q_block", "vec_id", "x"), dims, ["q_block"]).select("q_block", F.col("ids").alias("q_ids"), F.col("x").alias("q"))
    queries = work.table(queries, "queries")
    compare = _compare(dims, rotation, head, k)
    pairs_schema = _BEST
    # The longest vectors give every query its floor.
    top = data.where("range = 0 and piece = 0").select("ids", "x")
    first = queries.join(top, F.lit(True)).withColumn("floor", F.lit(None).cast("binary"))
    first = work.table(_ranked(first.mapInArrow(compare, pairs_schema), k), "first")
    floors = first.where(F.col("rank") == k).select("query_row", F.col("score").alias("floor"))
    floors = floors.withColumn("q_block", F.shiftright("query_row", 20)).groupBy("q_block").agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("query_row") - F.shiftleft("q_block", 20)).alias("at"), "floor"))).alias("floors"))

    def with_floor(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                floor = np.full(len(r["q_ids"]) // 8, -np.inf)
                for at, value in r.pop("floors") or []:
                    floor[at] = value
                r["floor"] = floor.tobytes()
                length = np.linalg.norm(np.frombuffer(r["q"], np.float64).reshape(len(floor), -1), axis=1)
                # Shorter vectors than this can't reach any floor of the block.
                reach = np.where(floor > 0, (floor - 1e-6) / np.maximum(length, 1e-300) * (1 - 1e-9), -np.inf)
                r["need"] = float(reach.min(initial=np.inf))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("q_block", pa.int64()), ("q_ids", pa.binary()), ("q", pa.binary()), ("floor", pa.binary()), ("need", pa.float64())]))

    ready = queries.join(floors, "q_block", "left").mapInArrow(with_floor, "q_block long, q_ids binary, q binary, floor binary, need double")
    ready = work.table(ready.repartition(q_blocks), "ready")
    # Blocks of queries meet the blocks of vectors that are long enough; rows of the join are pairs of blocks.
    rest = ready.join(data.where("range > 0 or piece > 0"), F.col("longest") >= F.col("need"))
    found = rest.mapInArrow(compare, pairs_schema).unionByName(first.drop("rank"))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _all_zero(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """Vectors without components all score 0: every query takes the k smallest other ids."""
    few = vectors.select("vec_id").orderBy("vec_id").limit(k + 1)
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.monotonically_increasing_id().alias("query_row"))
    found = asked.join(F.broadcast(few), F.col("query_id") != F.col("vec_id")).withColumn("score", F.lit(0).cast("long"))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
