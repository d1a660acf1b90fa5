"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation (the smallest neighbour of every node) and one
join of the edges with it. Both sides of the join are tables in the shared
folder, so adaptive execution can split a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.shared import Workspace


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Edges in a file of a round.
EDGES = 200_000


def connected_components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node on an edge (u, v); label is the smallest node of the component.

    The number of rounds is logarithmic in the size of the largest component.
    A round's tables have as many files as its edges need.
    """
    edges = work.table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges-0")
    before, turn = _state(edges), 0
    while before[0]:
        turn += 1
        parts = work.parts(before[0], EDGES)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).coalesce(parts), f"{name}-large-{turn}")
        # Large star: neighbours above a node move to the node's smallest neighbour.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = work.table(large.coalesce(parts), f"{name}-mid-{turn}")
        # Small star: a node and its neighbours below move to the smallest of them.
        least = work.table(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), f"{name}-small-{turn}")
        moved = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        nxt = work.table(moved.select("e.*").where("u != v").distinct().coalesce(parts), f"{name}-edges-{turn}")
        after = _state(nxt)
        work.drop(f"{name}-edges-{turn - 1}", f"{name}-large-{turn}", f"{name}-mid-{turn}", f"{name}-small-{turn}")
        edges = nxt
        if after == before:
            break
        before = after
    # At rest every edge points from a node to its component's smallest node.
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops)
