"""Call, import and inheritance graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.session import RoundTables, cut_lineage


def reference_counts(definitions: DataFrame, used: DataFrame) -> DataFrame:
    """Per symbol name: defining files, using files, uses.

    ``definitions(path, kind, name)``, ``used(name, used_in, uses)``. Both sides are
    reduced to one row per name before they meet, so a name that is defined and
    used everywhere forms one row, not all pairs.
    """
    defined = definitions.where(F.col("kind").isin("function", "class")).groupBy("name").agg(
        F.countDistinct("path").alias("defined_in")
    )
    return defined.join(used, "name")


def find_symbol(definitions: DataFrame, name: str, path: str | None = None) -> DataFrame:
    found = definitions.where(F.col("name") == name)
    return found.where(F.col("path") == path) if path else found


def find_references(uses: DataFrame, name: str) -> DataFrame:
    return uses.where(F.col("name") == name)


def neighbourhood(edges: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """``edges(caller, callee)``: functions within ``depth`` calls of one function.

    Rows: ``direction`` callees / callers, ``name``, ``distance`` (shortest).
    Each step joins the distinct names of the last one, never the paths. The
    edges are written to the shared folder once, so the steps do not read and
    parse the files again.
    """
    spark = edges.sparkSession
    pairs = cut_lineage(edges.select("caller", "callee").distinct())
    result = None
    for direction, source, target in (("callees", "caller", "callee"), ("callers", "callee", "caller")):
        seen = spark.createDataFrame([(start, 0)], "name string, distance int")
        frontier = seen
        for step in range(1, depth + 1):
            reached = (
                pairs.join(frontier.select(F.col("name").alias(source)), source, "left_semi")
                .select(F.col(target).alias("name")).distinct()
                .join(seen.select("name"), "name", "left_anti")
            )
            frontier = reached.withColumn("distance", F.lit(step))
            seen = seen.unionByName(frontier)
        rows = seen.where("distance > 0").select(F.lit(direction).alias("direction"), "name", "distance")
        result = rows if result is None else result.unionByName(rows)
    return result


def module_dependents(edges: DataFrame) -> DataFrame:
    """``edges(project, module, imported)``: fan-out and fan-in of each module."""
    out = edges.groupBy("project", F.col("module").alias("name")).agg(F.countDistinct("imported").alias("dependencies"))
    back = edges.groupBy("project", F.col("imported").alias("name")).agg(F.countDistinct("module").alias("dependents"))
    return out.join(back, ["project", "name"], "full").select(
        "project", "name", F.coalesce("dependencies", F.lit(0)).alias("dependencies"),
        F.coalesce("dependents", F.lit(0)).alias("dependents"),
    )


def circular_modules(edges: DataFrame) -> DataFrame:
    """Modules on an import cycle with the cycle group they belong to.

    Strongly connected groups by folding: a module with one way out stands for
    the place where that way first divides, found by doubling its steps, so a
    chain of n modules takes about log2 n rounds; modules without a way out go.
    Folding is repeated along the edges and against them. What is left, where
    every module has several ways in and out, is labelled round by round. Rows
    stay one per module or edge. Rows: ``project, module, cycle, size``.
    """
    rounds = RoundTables(edges.sparkSession, "cycles")
    rest = edges.select("project", F.col("module").alias("a"), F.col("imported").alias("b")).where("a <> b").distinct()
    found = _cycles(rounds, rounds.table(rest))
    if found is None:
        rounds.close()
        return edges.select("project", "module", F.col("module").alias("cycle"), F.lit(0).cast("bigint").alias("size")).limit(0)
    groups = found.groupBy("project", "label").agg(F.count("*").alias("size"), F.min("name").alias("cycle"))
    return rounds.close(
        found.join(groups, ["project", "label"]).select("project", F.col("name").alias("module"), "cycle", "size")
    )


def _cycles(rounds: RoundTables, rest: DataFrame) -> DataFrame | None:
    """(project, name, label) of all names on cycles of ``rest(project, a, b)``; None if there are no edges."""
    if rest.isEmpty():
        return None
    # Groups are the same against the edges, where modules with one way in fold.
    for a, b in (("a", "b"), ("b", "a")):
        turned = rest.select("project", F.col(a).alias("a"), F.col(b).alias("b"))
        ways = turned.select("project", F.col("a").alias("name"), F.col("b").alias("to")).unionByName(
            turned.select("project", F.col("b").alias("name"), F.lit(None).cast("string").alias("to"))
        ).groupBy("project", "name").agg(F.count("to").alias("ways"), F.min("to").alias("to"))
        ways, few = rounds.table(ways, dead=F.col("ways") == 0, single=F.col("ways") == 1)
        if few["dead"] or few["single"]:
            return _folded(rounds, turned, ways)
    return _by_labels(rounds, rest)


def _jumps(rounds: RoundTables, ways: DataFrame) -> list[DataFrame]:
    """Per name with one way out, its place after 1, 2, 4, ... steps.

    ``to`` is that place, or with ``ended`` the first one with no way or several
    ways out; ``low`` is the smallest name passed. In the last table, names that
    have not ended run into a cycle without a way out, and ``to`` lies on it.
    """
    single = ways.where("ways = 1").select("project", "name", "to")
    more = single.select("project", F.col("name").alias("to"), F.lit(True).alias("_more"))
    first = single.join(more, ["project", "to"], "left").select(
        "project", "name", "to", F.col("name").alias("low"), F.col("_more").isNull().alias("ended")
    )
    last, counted = rounds.table(first, going=~F.col("ended"))
    jumps, going, span = [last], counted["going"], 1
    while going:
        onward = last.select(
            "project", F.col("name").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"), F.col("ended").alias("_ended")
        )
        moved = last.where("NOT ended").join(onward, ["project", "to"]).select(
            "project", "name", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), F.col("_ended").alias("ended")
        )
        last, counted = rounds.table(last.where("ended").unionByName(moved), going=~F.col("ended"))
        jumps.append(last)
        span *= 2
        # A round in which no way ended leaves only ways into cycles, each no longer than there are names.
        if counted["going"] == going and span >= going:
            break
        going = counted["going"]
    return jumps


def _folded(rounds: RoundTables, rest: DataFrame, ways: DataFrame) -> DataFrame:
    """Names on cycles, from the cycles among names with several ways out."""
    jumps = _jumps(rounds, ways)
    last = jumps[-1]
    many = ways.where("ways > 1")
    there = last.select("project", F.col("name").alias("b"), F.col("to").alias("_to"), "ended")
    kept = (
        rest.join(many.select("project", F.col("name").alias("a")), ["project", "a"], "left_semi")
        .join(there, ["project", "b"], "left").where("ended IS NULL OR ended")
        .select("project", "a", F.col("b").alias("via"), F.coalesce("_to", "b").alias("root"))
        .join(many.select("project", F.col("name").alias("root")), ["project", "root"], "left_semi")
    )
    kept = rounds.table(kept)
    closed = last.where("NOT ended")
    found = closed.join(closed.select("project", F.col("to").alias("name")).distinct(), ["project", "name"], "left_semi").select(
        "project", "name", F.col("low").alias("label")
    )
    inner = _cycles(rounds, rounds.table(kept.where("a <> root").select("project", "a", F.col("root").alias("b")).distinct()))
    roots = kept.where("a = root").select("project", F.col("a").alias("name")).distinct()
    if inner is not None:
        roots = roots.join(inner, ["project", "name"], "left_anti")
    roots = roots.withColumn("label", F.col("name"))
    roots = rounds.table(roots if inner is None else inner.unionByName(roots))
    # A folded name is on its root's cycle if a name of that cycle leads to it.
    entered = (
        kept.where("via <> root")
        .join(roots.select("project", F.col("name").alias("a"), "label"), ["project", "a"])
        .join(roots.select("project", F.col("name").alias("root"), "label"), ["project", "root", "label"])
        .select("project", F.col("via").alias("name"), "label").distinct()
    )
    marked, counted = rounds.table(entered, any=F.lit(True))
    for jump in jumps if counted["any"] else []:
        step = jump.where("NOT ended").select("project", "name", "to")
        passed = marked.join(step, ["project", "name"]).select("project", F.col("to").alias("name"), "label")
        marked = rounds.table(marked.unionByName(passed).distinct())
    return rounds.table(found.unionByName(roots).unionByName(marked))


def _by_labels(rounds: RoundTables, rest: DataFrame) -> DataFrame:
    """Names on cycles: the smallest name spreads along the edges, then what reaches its owner inside its label is a group."""
    label = _spread(rounds, rest)
    owner = label.where("label = name")
    inside = (
        rest.join(label.select("project", F.col("name").alias("a"), F.col("label").alias("la")), ["project", "a"])
        .join(label.select("project", F.col("name").alias("b"), F.col("label").alias("lb")), ["project", "b"])
        .where("la = lb")
        .select("project", "a", "b", F.col("la").alias("label"))
    )
    group = _reach_back(rounds, rounds.table(inside), owner)
    several = group.join(
        group.groupBy("project", "label").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), ["project", "label"], "left_semi"
    ).select("project", "name", "label")
    left = rest
    for end in ("a", "b"):
        left = left.join(group.select("project", F.col("name").alias(end)), ["project", end], "left_anti")
    others = _cycles(rounds, rounds.table(left.select("project", "a", "b")))
    return several if others is None else several.unionByName(others)


def _spread(rounds: RoundTables, rest: DataFrame) -> DataFrame:
    """Smallest name that reaches each module along the edges."""
    names = rest.select("project", F.col("a").alias("name")).union(rest.select("project", "b")).distinct()
    label = rounds.table(names.withColumn("label", F.col("name")))
    while True:
        sent = rest.join(label.withColumnRenamed("name", "a"), ["project", "a"]).groupBy("project", "b").agg(
            F.min("label").alias("_new")
        )
        moved, counted = rounds.table(
            label.join(sent.withColumnRenamed("b", "name"), ["project", "name"], "left").select(
                "project", "name", F.least("label", F.coalesce("_new", "label")).alias("label"),
                (F.coalesce(F.col("_new"), F.col("label")) < F.col("label")).alias("_changed"),
            ),
            changed=F.col("_changed"),
        )
        label = moved.drop("_changed")
        if not counted["changed"]:
            return label


def _reach_back(rounds: RoundTables, inside: DataFrame, owner: DataFrame) -> DataFrame:
    """Modules that reach their label's owner inside the label."""
    seen = frontier = owner.select("project", "label", "name")
    while True:
        step, counted = rounds.table(
            inside.join(frontier.withColumnRenamed("name", "b"), ["project", "label", "b"], "left_semi")
            .select("project", "label", F.col("a").alias("name")).distinct()
            .join(seen, ["project", "label", "name"], "left_anti"),
            any=F.lit(True),
        )
        if not counted["any"]:
            return seen
        frontier, seen = step, rounds.table(seen.unionByName(step))


def inheritance_depth(edges: DataFrame) -> DataFrame:
    """``edges(project, path, language, child, parent)`` to depth per class.

    The classes of one file are walked inside its row by index arrays. A walk
    ends at a missing parent, at Object, or before a class it has met already.
    """
    per_file = edges.groupBy("project", "path", "language").agg(F.sort_array(F.collect_list(F.struct("child", "parent"))).alias("_e"))
    indexed = per_file.select(
        "project", "path", "language",
        F.expr("transform(_e, e -> e.child)").alias("_names"),
        F.expr(
            "transform(_e, e -> if(e.parent IS NULL OR lower(e.parent) = 'object' AND e.parent IN ('Object', 'object'), -1, "
            "cast(array_position(transform(_e, x -> x.child), e.parent) as int)))"
        ).alias("_next"),
    )
    # cur: index of the class, 0 = parent outside the file; a hop to it still counts.
    walk = (
        "aggregate(sequence(1, size(_names)), named_struct('cur', i + 1, 'depth', 0, 'open', true), (s, k) -> "
        "if(NOT s.open OR s.cur = 0 OR element_at(_next, s.cur) < 0, "
        "named_struct('cur', s.cur, 'depth', s.depth, 'open', false), "
        "named_struct('cur', element_at(_next, s.cur), 'depth', s.depth + 1, 'open', element_at(_next, s.cur) <> 0)))"
    )
    met = (
        "size(array_distinct(aggregate(sequence(1, size(_names)), array(i + 1), "
        "(l, k) -> concat(l, array(element_at(_next, element_at(l, -1))))))) - 1"
    )
    depths = F.expr(
        f"transform(_names, (n, i) -> named_struct('child', n, 'depth', if(({walk}).open, {met}, ({walk}).depth)))"
    )
    return indexed.select("project", "path", "language", F.explode(depths).alias("_d")).select(
        "project", "path", "language", F.col("_d.child").alias("class_name"), "_d.depth"
    )


def inheritance_summary(depths: DataFrame) -> DataFrame:
    return depths.groupBy("project", "path").agg(
        F.max("depth").alias("max_depth"), F.floor(F.avg("depth") + 0.5).cast("int").alias("average_depth"),
        F.count("*").alias("classes"),
    )
