"""Mixing sources to target weights by entropy balancing.

Every document gets a rate ``min(cap, exp(l_s * size / mean size of its source))``,
the solution closest to "each document once" (in relative entropy) under
one token total per source. The dual in ``l_s`` is convex; safeguarded
Newton steps solve it, each one a distributed aggregation over a histogram
of (source, size). Rates become whole copies by carrying the rounding error,
in tokens, from the longest documents of a source to the shortest.

Rows of one (source, size) stand in a line, by a hash of their ids in buckets,
and the first ones take one copy more. Places come from running sums of the
rows that agree in doc_id, source and size, over the buckets and within each,
so a third of all rows may be one row repeated. In one task lie a row for each
source, for the targets, and a source's distinct sizes, for the rounding: these
are bounded by the longest text, not by the number of documents.

Defined cases: null text has size 0; null source is a source of its own,
ordered last; rows that repeat, or have no id, count each, and some of those
that agree may get one copy more than the others; empty documents are taken
once and add nothing; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintlake.llm.shared import Workspace, word_count

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
#: Documents of one (source, size) that share a rounding bucket.
BUCKET = 4096
#: Rows of the plan, one a (source, size), up to which it is broadcast to the texts.
SENT = 500_000


def source_targets(totals: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Word targets for (source, source_size): shares by weight, none above ``cap`` times its source.

    ``totals`` has one row per source. The windows without a key run over
    sources, not documents. With sources ordered by cap / weight, those before
    some place are at their cap and the rest share what is left by weight; the
    first place at which nobody else exceeds the cap is the fixed point of
    resharing the excess.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    rows = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    rows = rows.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "total": F.sum("source_size").over(everything).cast("double"),
        "capped": F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        "rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    level = (F.col("total") - F.col("capped")) / F.col("rest")
    fits = F.when(level * F.col("weight") <= F.col("most"), level)
    rows = rows.withColumn("level", F.first(fits, ignorenulls=True).over(
        Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return rows.select("source", "source_size", target.alias("target"))


def _newton(spark, work: Workspace, groups: DataFrame, targets: DataFrame, cap: int, rounds: int, tolerance: float) -> DataFrame:
    """(source, scale, tilt): each round sums the rates' tokens and their slope per source."""
    state = targets.withColumns({
        "tilt": F.lit(0.0), "low": F.lit(-700.0), "high": F.lit(700.0),
        "full": F.col("target") >= F.col("source_size") * cap * (1 - 1e-12),
    })
    state = work.table(state, "tilt-0")
    for turn in range(1, rounds + 1):
        rate = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0)))
        capped = F.least(rate, F.lit(float(cap)))
        tokens = F.col("n") * F.col("size")
        sums = (
            groups.join(state, groups.source.eqNullSafe(state.source)).groupBy(state.source)
            .agg(F.sum(tokens * capped).alias("mass"),
                 F.sum(F.when(rate < cap, tokens * rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"))
        )
        s = state.alias("s").join(sums.alias("m"), F.col("s.source").eqNullSafe(F.col("m.source")), "left")
        gap = F.coalesce(F.col("m.mass"), F.lit(0.0)) - F.col("s.target")
        low = F.when(gap <= 0, F.col("s.tilt")).otherwise(F.col("s.low"))
        high = F.when(gap >= 0, F.col("s.tilt")).otherwise(F.col("s.high"))
        step = F.when(F.col("m.slope") > 0, F.col("s.tilt") - gap / F.col("m.slope"))
        inside = (step > low) & (step < high)
        # Outside the bracket the step is halved towards it, so every round narrows the bracket.
        nxt = F.when(F.col("s.full") | (F.abs(gap) <= tolerance * F.col("s.target")), F.col("s.tilt")).when(inside, step).otherwise((low + high) / 2)
        done = F.col("s.full") | (F.abs(gap) <= tolerance * F.col("s.target")) | (F.col("s.source_size") == 0)
        state = work.table(
            s.select("s.source", "s.source_size", "s.target", "s.scale", nxt.alias("tilt"), low.alias("low"), high.alias("high"), "s.full", done.alias("done")),
            f"tilt-{turn}")
        work.drop(f"tilt-{turn - 1}")
        if not state.where("not done").limit(1).count():
            break
    return state


def _round_copies(rows: pd.DataFrame) -> pd.DataFrame:
    """Copies for one source's sizes: ``base`` for all and one more for ``extra`` of the ``n``."""
    rows = rows.sort_values("size", ascending=False, kind="stable")
    carry, base, extra = 0.0, [], []
    for size, n, rate, cap in zip(rows["size"], rows["n"], rows["rate"], rows["cap"]):
        whole = int(rate)
        want = (rate - whole) * n * size + carry
        more = min(max(round(want / size), 0), n if whole < cap else 0) if size else 0
        carry = want - more * size
        base.append(whole)
        extra.append(more)
    rows["base"], rows["extra"] = base, extra
    return rows[["source", "size", "n", "base", "extra"]]


def _decisions(docs: DataFrame, weights, cap: int, rounds: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, repeats, base, more): ``base`` copies of each of the ``repeats`` rows and one of ``more`` of them; and the sources' rows."""
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    sized = docs.select("doc_id", "source", word_count("text").alias("size"))
    keyed = work.table(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("repeats")), "keyed")
    groups = work.table(keyed.groupBy("source", "size").agg(F.sum("repeats").alias("n")), "groups")
    totals = groups.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    totals = work.table(totals, "totals")
    scale = totals.select(F.col("source").alias("name"), F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0)).alias("scale"))
    targets = source_targets(totals.select("source", "source_size"), weights, cap)
    targets = targets.join(scale, targets.source.eqNullSafe(scale.name)).drop("name")
    tilts = _newton(spark, work, groups, targets, cap, rounds, tolerance)
    tilts = tilts.withColumn("cap", F.lit(cap))
    rated = groups.join(tilts, groups.source.eqNullSafe(tilts.source)).select(groups.source, "size", "n", _rate(cap).alias("rate"), "cap")
    plan = rated.groupBy("source").applyInPandas(_round_copies, "source string, size long, n long, base int, extra long")
    plan = work.table(plan, "plan")
    k, p = keyed.alias("k"), plan.alias("p")
    joined = k.join(p, F.col("k.source").eqNullSafe(F.col("p.source")) & (F.col("k.size") == F.col("p.size"))).select("k.*", "p.n", "p.base", "p.extra")
    joined = joined.withColumn("bucket", _bucket("doc_id", "n"))
    # Rows before a key: those of the buckets before its own, and those before it there.
    held = joined.groupBy("source", "size", "bucket").agg(F.sum("repeats").alias("rows"))
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("bucket") == F.col("_bucket"))
    inside = Window.partitionBy("source", "size", "bucket").orderBy(_spot_hash("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("repeats").over(inside), F.lit(0))
    more = F.greatest(F.least(F.col("extra") - first, F.col("repeats")), F.lit(0))
    chosen = joined.join(held, same).withColumn("more", more.cast("long"))
    return chosen.select("doc_id", "source", "size", "repeats", "base", "more", "n", "bucket"), tilts


def _bucket(doc_id, n) -> F.Column:
    return F.pmod(F.xxhash64(doc_id), F.ceil(F.col(n) / BUCKET).cast("long"))


def _spot_hash(doc_id) -> F.Column:
    return F.xxhash64(doc_id, F.lit(9))


def _rate(cap: int) -> F.Column:
    tilted = F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0))), F.lit(float(cap)))
    return F.when(F.col("full") & (F.col("size") > 0), F.lit(float(cap))).otherwise(tilted)


def document_copies(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, rounds: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """(doc_id, source, size, repeats, source_size, target, rate, copies): of the rows that agree in doc_id, source and size, ``repeats`` are taken ``copies`` times."""
    chosen, tilts = _decisions(docs, weights, cap, rounds, tolerance)
    parts = F.array(F.struct(F.col("more").alias("repeats"), (F.col("base") + 1).alias("copies")), F.struct((F.col("repeats") - F.col("more")).alias("repeats"), F.col("base").alias("copies")))
    rows = chosen.select("doc_id", "source", "size", F.inline(F.filter(parts, lambda x: x.repeats > 0)))
    t = tilts.alias("t")
    return rows.alias("c").join(t, F.col("c.source").eqNullSafe(F.col("t.source"))).select(
        "c.doc_id", "c.source", "c.size", "c.repeats", "t.source_size", "t.target", _rate(cap).alias("rate"), F.col("c.copies").cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, rounds: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """The mix itself: every row as often as its copies say (0 to ``cap`` times); columns as in ``docs``.

    Texts are not shuffled: rows of one (source, size) stand in a line, so the
    plan is the place in each line up to which rows get one copy more. One key
    at most lies across that place; its rows are numbered by input partition,
    then over the partitions.
    """
    chosen, _ = _decisions(docs, weights, cap, rounds, tolerance)
    work = Workspace(docs.sparkSession, "mixed-rows")
    # The first row of each line that does not get all of its one more; nulls come first in a struct as they do in the line.
    spot = F.struct(F.col("bucket").alias("bucket"), _spot_hash("doc_id").alias("hash"), F.col("doc_id").alias("id"))
    edge = F.min(F.when(F.col("more") < F.col("repeats"), F.struct(spot.alias("spot"), "more")))
    edges = chosen.groupBy("source", "size").agg(F.any_value("n").alias("_n"), F.any_value("base").alias("_base"), edge.alias("_edge"))
    edges = work.table(edges.withColumnsRenamed({"source": "_source", "size": "_size"}), "edges")
    some_split = not edges.where("_edge.more > 0").isEmpty()
    # A row per source and size: usually few enough to go to the texts, which then stay where they are.
    sent = F.broadcast(edges) if edges.count() <= SENT else edges
    same = docs["source"].eqNullSafe(sent["_source"]) & (word_count(docs["text"]) == sent["_size"])
    own = F.struct(_bucket("doc_id", "_n").alias("bucket"), _spot_hash("doc_id").alias("hash"), F.col("doc_id").alias("id"))
    placed = docs.withColumn("_part", F.spark_partition_id()).join(sent, same).withColumn("_own", own)
    at_edge = F.coalesce((F.col("_own") == F.col("_edge.spot")) & (F.col("_edge.more") > 0), F.lit(False))
    more = F.coalesce(F.col("_own") < F.col("_edge.spot"), F.lit(True)).cast("int")
    rows = placed.where(~at_edge).select(*docs.columns, (F.col("_base") + more).alias("_copies"))
    if some_split:
        # Written, so that both uses below see the same partition of each row.
        key = ["_id", "_source", "_size"]
        some = work.table(placed.where(at_edge).select(*docs.columns, "_part", F.col("doc_id").alias("_id"), "_source", "_size", "_base", F.col("_edge.more").alias("_more")), "split")
        counts = some.groupBy(*key, "_part").agg(F.count("*").alias("_rows"))
        before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*[F.col(c).alias(f"{c}2") for c in (*key, "_part")], F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
        agree = F.col("_part") == F.col("_part2")
        for c in key:
            agree &= F.col(c).eqNullSafe(F.col(f"{c}2"))
        place = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(F.xxhash64("text"))) + F.col("_before")
        split_rows = some.join(offsets, agree).withColumn("_copies", F.col("_base") + (place <= F.col("_more")).cast("int"))
        rows = rows.unionByName(split_rows.select(*docs.columns, "_copies"))
    return rows.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def mix_digest(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, size, source_size, target, taken, and source and copies."""
    rows = document_copies(docs)
    rows = rows.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
