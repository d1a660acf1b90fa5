"""Approximate nearest neighbours by NN-descent and greedy graph search, in Spark joins.

Equal vectors form a class, so thousands of copies are one node. A graph of
the K nearest found neighbours starts from blocks along random projections.
In each round a node collects its neighbours and a sample of the nodes that
list it, and introduces them to each other: neighbours of neighbours. Only
pairs with a new member count, and only those that would enter a list travel.

A query starts at its own node's neighbours and, where lengths differ, at the
longest vectors (at most ``ENTRIES``), and keeps the best ``beam`` nodes
found; each round expands the best ones not yet expanded by a join with the
graph, until all in the beam are. The best are scored exactly.

For inner products, vectors get one more component that makes all lengths
equal while the graph is built (nearest and largest product are then the same);
queries have 0 there. The walk uses 8-bit components with a scale per vector;
reported scores are exact products in double precision.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without id; shorter vectors count as
padded with zeros; repeated ids are candidates each, except for a query of the
same id; ties go to the smaller id; fewer candidates than asked for give all;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintlake.llm.shared import Workspace, whole_groups
from lintlake.llm.topk import _matrix, clean_vectors

TOP, EVERY = 20, 20
#: Neighbours kept, reverse neighbours sampled, pairs per member and meeting, rounds at most, and the share of changes that ends them.
K, REVERSE, MEET, ROUNDS, CHANGE = 32, 40, 12, 9, 0.04
#: Vectors in a starting block, and random projections.
BLOCK, PROJECTIONS = 512, 3
#: Nodes kept and expanded at once in a search, and scored exactly.
BEAM, EXPAND, EXACT = 256, 64, 64
#: Longest vectors at which every search also starts, if they exceed the mean length by a tenth.
ENTRIES = 128


def _rows(blobs, width: int) -> np.ndarray:
    """Coded rows as float32: 8-bit components times their scale, then the length-evening component."""
    raw = np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(-1, width + 7)
    head = np.ascontiguousarray(raw[:, :8]).view("<f4")
    return np.column_stack([raw[:, 8:].view(np.int8).astype(np.float32) * head[:, :1], head[:, 1]])


def _coded(x: np.ndarray, even: np.ndarray) -> list[bytes]:
    scale = (np.abs(x).max(axis=1) / 127).astype("<f4")
    coded = np.rint(x / np.maximum(scale, 1e-30)[:, None]).astype(np.int8)
    head = np.column_stack([scale, even]).astype("<f4")
    return [a.tobytes() + b.tobytes() for a, b in zip(head, coded)]


def _nodes(vectors: DataFrame, dims: int, longest: float) -> DataFrame:
    """(node, code, spot): 8-bit components with the length-evening one, and places along projections."""
    axes = np.random.default_rng(7).normal(size=(dims + 1, PROJECTIONS))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), dims)
                even = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(_coded(x, even), pa.binary()), pa.array((np.column_stack([x, even]) @ axes).tolist(), pa.list_(pa.float64()))], ["node", "code", "spots"])

    return vectors.select("node", "x").mapInArrow(run, "node long, code binary, spots array<double>")


def _best_within(ids, x, k):
    """(node, neighbour, score) rows of each member's k best within a block."""
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    k = min(k, len(ids) - 1)
    if k < 1:
        return None
    c = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[c].ravel(), np.take_along_axis(s, c, 1).ravel()


_PAIRS = "node long, neighbour long, score float"


def _pairs_batch(parts):
    a, b, s = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float32))], ["node", "neighbour", "score"])


def _start(nodes: DataFrame, width: int, parts: int, k: int) -> DataFrame:
    """Pairs from blocks of nodes that lie side by side along a projection."""

    def run(batches):
        table = [b for b in batches if b.num_rows]
        for batch in table:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = _best_within(part.column("node").to_numpy(), _rows(part.column("code"), width), k)
                if found:
                    yield _pairs_batch([found])

    out = None
    for p in range(PROJECTIONS):
        spot = F.col("spots")[p]
        along = nodes.select("node", "code", spot.alias("spot")).repartitionByRange(parts, "spot", "node").sortWithinPartitions("spot", "node")
        found = along.select("node", "code").mapInArrow(run, _PAIRS)
        out = found if out is None else out.unionByName(found)
    return out


def _merge(nodes: DataFrame, old: DataFrame | None, pairs: DataFrame, k: int) -> DataFrame:
    """(node, code, neighbours, floor, changed) with the k best of the old lists and the pairs."""
    rows = pairs.where("node != neighbour").withColumn("fresh", F.lit(True))
    if old is not None:
        rows = rows.unionByName(old.select("node", F.explode("neighbours").alias("e")).select("node", F.col("e.id").alias("neighbour"), F.col("e.score").alias("score"), F.lit(False).alias("fresh")))
    best = rows.repartition("node").groupBy("node", "neighbour").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("score").desc(), "neighbour"))
    lists = best.withColumn("place", place).where(F.col("place") <= k).groupBy("node").agg(
        F.collect_list(F.struct(F.col("neighbour").alias("id"), "score", "fresh")).alias("neighbours"),
        F.when(F.count("*") >= k, F.min("score")).alias("floor"), F.sum(F.col("fresh").cast("long")).alias("changed"))
    return nodes.select("node", "code").join(lists, "node", "left").select("node", "code", F.coalesce("neighbours", F.array()).alias("neighbours"), "floor", F.coalesce("changed", F.lit(0)).alias("changed"))


def _introduce(graph: DataFrame, width: int, turn: int, reverse: int, meet: int) -> DataFrame:
    """Pairs among the neighbours and sampled reverse neighbours of every node, better than the members' floors."""
    edges = graph.select("node", F.explode("neighbours").alias("e")).select("node", F.col("e.id").alias("other"), F.col("e.fresh").alias("fresh"))
    back = edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh")
    # New ones first, then by a hash that differs between rounds; the group limit runs before the shuffle.
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("fresh").desc(), F.xxhash64("other", F.lit(turn))))
    back = back.withColumn("place", place).where(F.col("place") <= reverse).drop("place")
    pool = edges.unionByName(back).groupBy("node", "other").agg(F.max("fresh").alias("fresh"))
    members = graph.select(F.col("node").alias("other"), "code", "floor")
    met = pool.join(members, "other").select("node", "other", "fresh", "code", "floor")
    met = met.repartition("node").sortWithinPartitions("node")

    def run(batches):
        for table in whole_groups(batches, "node"):
            centre, ids = table.column("node").to_numpy(), table.column("other").to_numpy()
            fresh, floor = table.column("fresh").to_numpy(), table.column("floor").fill_null(-np.inf).to_numpy()
            x = _rows(table.column("code"), width)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(centre)) + 1, [len(centre)]])
            parts = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                new = fresh[a:b]
                if b - a < 2 or not new.any():
                    continue
                s = x[a:b] @ x[a:b].T
                s[~(new[:, None] | new[None, :])] = -np.inf
                np.fill_diagonal(s, -np.inf)
                k = min(meet, b - a - 1)
                c = np.argpartition(-s, k - 1, axis=1)[:, :k]
                v = np.take_along_axis(s, c, 1)
                r, at = np.nonzero(v > floor[a:b, None])
                if r.size:
                    parts.append((ids[a:b][r], ids[a:b][c[r, at]], v[r, at]))
            if parts:
                yield _pairs_batch(parts)

    return met.mapInArrow(run, _PAIRS)


def build_graph(work: Workspace, nodes: DataFrame, count: int, width: int, k: int = K, rounds: int = ROUNDS, change: float = CHANGE) -> DataFrame:
    """The neighbour graph after at most ``rounds`` rounds, or when fewer than ``change`` of the list entries are new."""
    parts = max(1, count // (4 * BLOCK))  # ranges of some blocks each, so that a small table is one block
    graph = work.table(_merge(nodes, None, _start(nodes, width, parts, k), k), "graph-0")
    for turn in range(1, rounds + 1):
        nxt = _merge(nodes, graph, _introduce(graph, width, turn, REVERSE, MEET), k)
        graph = work.table(nxt, f"graph-{turn}")
        work.drop(f"graph-{turn - 1}")
        work.release()
        if (graph.agg(F.sum("changed")).first()[0] or 0) <= change * k * count:
            break
    return graph


def _search(work: Workspace, graph: DataFrame, asked: DataFrame, entries: list[int], width: int, beam: int, expand: int) -> DataFrame:
    """(query, node, score): the beam of every query node after greedy search. asked: (query, code) with the last component 0."""
    # A node is among its own links, so that expanding it scores it too.
    links = graph.select("node", F.explode(F.array_union("neighbours.id", F.array("node"))).alias("other"))
    codes = graph.select(F.col("node").alias("other"), "code")
    near = links.join(codes, "other").repartition("node").sortWithinPartitions("node").select("node", "other", "code")

    def gather(batches):
        for table in whole_groups(batches, "node"):
            node = table.column("node").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]])
            ids, codes_ = table.column("other").to_numpy(), table.column("code").to_pylist()
            spans = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(node[cuts[:-1]]), pa.array([ids[a:b] for a, b in spans], pa.list_(pa.int64())), pa.array([b"".join(codes_[a:b]) for a, b in spans], pa.binary())], ["node", "ids", "codes"])

    adjacent = work.table(near.mapInArrow(gather, "node long, ids array<long>, codes binary"), "adjacent")

    def look(batches):
        for batch in batches:
            parts = []
            if batch.num_rows:
                q = _rows(batch.column("code"), width)
                for i, (query, ids, blob, floor) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("query", "ids", "codes", "floor")))):
                    raw = np.frombuffer(blob, np.uint8).reshape(-1, width + 7)
                    s = (raw[:, 8:].view(np.int8).astype(np.float32) @ q[i, :-1]) * np.ascontiguousarray(raw[:, :4]).view("<f4")[:, 0]
                    ids = np.array(ids)
                    keep = (ids != query) & (s > (-np.inf if floor is None else floor))
                    if keep.any():
                        parts.append((np.full(int(keep.sum()), query), ids[keep], s[keep]))
            if parts:
                yield _pairs_batch(parts)

    # The start: the query's own node and the entries are expanded first.
    starts = F.array_union(F.array("query"), F.array(*[F.lit(e).cast("long") for e in entries]).cast("array<long>"))
    state = asked.select("query", F.explode(starts).alias("node"), F.lit(float("-inf")).cast("float").alias("score"), F.lit(False).alias("done"))
    turn = 0
    while True:
        ranked = state.withColumns({
            "place": F.row_number().over(Window.partitionBy("query").orderBy(F.col("done"), F.col("score").desc(), "node")),
            "floor": F.min(F.when(F.col("score") > float("-inf"), F.col("score"))).over(Window.partitionBy("query")), "held": F.count("*").over(Window.partitionBy("query"))})
        # Starts have no score yet; all of them are expanded at once, before better ones could push them out.
        chosen = (F.col("place") <= expand) | (F.col("score") == float("-inf"))
        todo = ranked.where(~F.col("done") & chosen).select("query", "node", F.when(F.col("held") >= beam, F.col("floor")).alias("floor"))
        todo = work.table(todo, f"todo-{turn}")
        if not todo.limit(1).count():
            break
        front = todo.join(asked, "query").join(adjacent, "node").select("query", "code", "ids", "codes", "floor")
        found = front.mapInArrow(look, _PAIRS).select(F.col("node").alias("query"), F.col("neighbour").alias("node"), "score", F.lit(False).alias("done"))
        marked = todo.select("query", "node", F.lit(float("-inf")).cast("float").alias("score"), F.lit(True).alias("done"))
        merged = state.unionByName(found).unionByName(marked).repartition("query").groupBy("query", "node").agg(F.max("score").alias("score"), F.max("done").alias("done"))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "node"))
        nxt = work.table(merged.where("query != node").withColumn("place", place).where(F.col("place") <= beam).drop("place"), f"beam-{turn}")
        work.drop(f"todo-{turn}", f"beam-{turn - 1}")
        work.release()
        state, turn = nxt, turn + 1
    return state


def nearest(table: DataFrame, top: int = TOP, every: int = EVERY, k: int = K, rounds: int = ROUNDS, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` largest inner products found for rows whose id divides by ``every``."""
    spark = table.sparkSession
    work = Workspace(spark, "nn-descent")
    zero = F.exists("x", lambda v: v != 0)
    rows = clean_vectors(table).where(zero)
    # Equal vectors are one node, named by their smallest id. Padding is taken off, so that it makes no difference.
    trimmed = F.expr("slice(x, 1, coalesce(array_max(transform(x, (v, i) -> if(v != 0, i + 1, 0))), 0))")
    rows = rows.withColumn("x", F.transform(trimmed, lambda v: F.when(v == 0, 0.0).otherwise(v)))
    rows = work.table(rows.withColumn("hash", F.xxhash64("x")), "rows")
    nodes = work.table(rows.groupBy("hash", "x").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "nodes")
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    count, dims, longest, mean = nodes.agg(F.count("*"), F.max(F.size("x")), F.max(length), F.avg(length)).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = dims + 1
    entries = [r.node for r in nodes.withColumn("length", length).where(F.col("length") > 1.1 * mean).orderBy(F.col("length").desc(), "node").limit(ENTRIES).select("node").collect()]
    coded = work.table(_nodes(nodes, dims, longest), "coded")
    graph = build_graph(work, coded, count, width, k, rounds)

    # Members of a class that can be reported: the smallest ids, one more than asked for as a query skips its own.
    place = F.row_number().over(Window.partitionBy("hash", "x").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= top + 1)
    of_node = nodes.select("hash", F.col("x").alias("y"), "node")
    members = few.join(of_node, (few.hash == of_node.hash) & (few.x == of_node.y)).select("node", "vec_id", few.x)
    members = work.table(members, "members")
    asking = rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("query_row", F.monotonically_increasing_id())
    asking = asking.join(of_node, (asking.hash == of_node.hash) & (asking.x == of_node.y)).select("query_row", F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    asking = work.table(asking, "asking")
    distinct = asking.select("query").distinct()

    def without_last(batches):
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column("code"), width)[:, :-1]
                yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(_coded(x, np.zeros(len(x))), pa.binary())], ["query", "code"])

    codes = distinct.join(coded.select(F.col("node").alias("query"), "code"), "query").select("query", "code").mapInArrow(without_last, "query long, code binary")
    codes = work.table(codes, "codes")
    found = _search(work, graph, codes, entries, width, beam, expand)

    best = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "node"))
    short = found.withColumn("place", best).where(F.col("place") <= EXACT).select("query", "node")
    short = short.unionByName(distinct.select("query", F.col("query").alias("node")))
    exact = F.aggregate(F.zip_with("a", "x", lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    vec = nodes.select("node", "x")
    scored = short.join(vec, "node").join(vec.select(F.col("node").alias("query"), F.col("x").alias("a")), "query").select("query", "node", exact.alias("score"))
    scored = work.table(scored, "scored")
    # A class brings its smallest ids; ranks within the query node first, so hot classes don't multiply queries.
    listed = scored.join(members.select("node", "vec_id"), "node")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    listed = work.table(listed.withColumn("place", first).where(F.col("place") <= 2 * top + 2).select("query", "vec_id", "score"), "listed")
    pairs = asking.join(listed, "query").where("query_id != vec_id")
    final = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.withColumn("rank", final.cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
