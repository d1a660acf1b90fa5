"""Near-duplicate documents by MinHash, verified on full shingle sets.

1. One pass gives each document the size and a 128-bit hash of its set of word
   shingles, 512 minima of universal hashes, and 20 band keys of 4 minima each.
   A pair at the threshold of 0.85 shares no band with probability 4e-7, at the
   0.80 that the pipeline asks for with probability 3e-5.
2. Documents with equal sets form a class; its smallest id stands for it. From
   here on only classes are compared, so exact copies never pair up.
3. Classes that share a band key form a bucket. Each bucket first links its
   members to its smallest one. Pairs pass a check of the signatures with a wide
   margin, then of the full sets.
4. Components of those links come from large-star and small-star. Buckets whose
   members lie in one component are done. In the others, members outside the
   bucket's largest component first meet their most similar one, which joins most
   of them; components are updated, and a last pass compares every pair across
   components by signature, in blocks of members, and verifies it. Only members
   outside a bucket's largest component meet the whole bucket, so no link between
   components is lost and a large group of near copies stays linear.

Defined cases: null and empty texts, and texts of white space, have an empty
set and are components of their own; fewer than five words form one shingle;
repeated rows give repeated result rows; rows with a null id get the component
of their class, whose id is null if no row of the class has one, and classes
without an id link to nothing; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.components import connected_components
from lintlake.llm.shared import Workspace, batches_of, slices_of
from lintlake.llm.shingles import constants, minima, mix, shingle_sets

WIDTH, BANDS, ROWS = 5, 20, 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Minima in a signature, of which 8 bits each are kept; BANDS * ROWS of them make the bands.
MINIMA = 512
#: Signatures may agree this much less than sets: 6 standard deviations of 512 minima at 0.85.
MARGIN = 0.095
#: Passes over open buckets in which a member meets only its most similar one, before the pass over all pairs.
PASSES = 1
#: Members that meet in one task.
BLOCK, STAR = 256, 64
#: Shingles, in all sets of one side, that meet in one task.
BLOCK_SHINGLES = 1_000_000
#: Bytes of text whose shingles are hashed at once; arrays of eight bytes a place stand beside them.
SLICE = 250_000
#: Documents in a file of the texts that are compared.
TEXTS = 2_000
#: Documents in a batch of the first pass, which reads all texts.
BATCH = 1000


def _fingerprints(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    factors, shifts = constants(11, MINIMA) | np.uint64(1), constants(12, MINIMA)
    weights = constants(13, rows) | np.uint64(1)

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
            for a, b in slices_of(sizes, SLICE):
                sets = shingle_sets(texts.slice(a, b - a), width)
                some = [i for i, s in enumerate(sets) if len(s)]
                one, two = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                marks, keys = [None] * len(sets), [None] * len(sets)
                if some:
                    with np.errstate(over="ignore"):
                        for i in some:
                            one[i] = np.sum(mix(sets[i] + np.uint64(1)), dtype=np.uint64).astype(np.int64)
                            two[i] = np.sum(mix(sets[i] ^ np.uint64(0x5555555555555555)), dtype=np.uint64).astype(np.int64)
                        least = minima([sets[i] for i in some], factors, shifts)
                        banded = mix((least[:, : bands * rows].reshape(len(some), bands, rows).astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64)).astype(np.int64)
                    for at, i in enumerate(some):
                        marks[i], keys[i] = least[at].astype(np.uint8).tobytes(), banded[at]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two),
                    pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "h1", "h2", "signature", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, signature binary, keys array<long>")


def _similar_signatures(pairs: DataFrame, least_share: float, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose signatures agree in ``least_share``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((left == right).mean(axis=1) >= least_share))

    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return pairs.where(fits).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(work: Workspace, pairs: DataFrame, texts: DataFrame, name: str, width: int, percent: int, parts: int) -> DataFrame:
    """Pairs (u, v) that link on full sets. A left side meets its right sides in blocks, each of which carries its text once."""
    pairs = work.table(pairs.coalesce(parts), f"{name}-pairs")
    counts = work.table(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("long").alias("blocks")).coalesce(parts), f"{name}-counts")
    dealt = pairs.join(counts, "a").withColumn("block", F.pmod(F.xxhash64("b"), "blocks"))
    needs = dealt.select("a", "block", F.col("b").alias("node")).unionByName(
        counts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("a").alias("node")))
    needs = work.table(needs.coalesce(parts), f"{name}-needs")

    def check(table: pa.Table) -> pa.Table:
        a, nodes = table.column("a")[0].as_py(), table.column("node").to_pylist()
        out = []
        if a in nodes:
            texts = table.column("text").combine_chunks()
            first = nodes.index(a)
            own = shingle_sets(texts.slice(first, 1), width)[0]
            sizes = np.asarray(pa.compute.binary_length(texts))
            for lo, hi in slices_of(sizes, 4_000_000):
                for node, other in zip(nodes[lo:hi], shingle_sets(texts.slice(lo, hi - lo), width)):
                    if node != a:
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        if both * 100 >= percent * (len(own) + len(other) - both):
                            out.append(node)
        return pa.table({"u": pa.array([a] * len(out), pa.int64()), "v": pa.array(out, pa.int64())})

    rows = needs.join(texts, "node").select("a", "block", "node", "text")
    linked = work.table(rows.groupBy("a", "block").applyInArrow(check, "u long, v long").coalesce(parts), f"{name}-links")
    work.drop(f"{name}-pairs", f"{name}-counts", f"{name}-needs")
    return linked


def _dealt(members: DataFrame, best_only: bool) -> DataFrame:
    """Members dealt to blocks (i, j) of their buckets, minor members in one role and all members in the other.

    ``members``: (band, key, node, n, signature, keys, label, minor, minors, total, minor_n, total_n);
    minor members go to every block of the bucket (or to one, for the best), all members to every block of minors.
    """
    of = lambda rows, shingles: F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("long")
    blocks, of_minors = of("total", "total_n"), of("minors", "minor_n")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # Looking for the best one, a member meets one block of each of its buckets; the last pass leaves no block out.
    met = F.array(F.pmod(F.xxhash64("node", F.lit(2)), blocks)) if best_only else upto(blocks)
    place = lambda i, j, minor: F.struct(i.alias("i"), j.alias("j"), F.lit(minor).alias("role"))
    as_minor = F.transform(met, lambda j: place(F.pmod(F.xxhash64("node"), of_minors), j, True))
    as_any = F.transform(upto(of_minors), lambda i: place(i, F.pmod(F.xxhash64("node", F.lit(1)), blocks), False))
    # Both roles of a row at once, so that what the members come from runs once.
    places = F.when(F.col("minor"), F.concat(as_minor, as_any)).otherwise(as_any)
    return members.withColumn("place", F.explode(places)).select("band", "key", "place.i", "place.j", "place.role", "node", "n", "signature", "keys", "label", "minor")


def _candidates(table: pa.Table, least_share: float, percent: int, once: bool):
    """(x, places similar to x, shares) for every minor member x of a block; with ``once`` a pair counts in one direction and in the first band both share."""
    band = table.column("band")[0].as_py()
    role = table.column("role").to_numpy()
    node, n, label, minor = (table.column(c).to_numpy() for c in ("node", "n", "label", "minor"))
    marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(node), -1)
    keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    left, right = np.flatnonzero(role), np.flatnonzero(~role)
    for x in left:
        ok = label[right] != label[x]
        if once:  # two minor members meet in both directions; one of them is enough
            ok &= ~minor[right] | (node[right] > node[x])
        ok &= np.minimum(n[right], n[x]) * 100 >= np.maximum(n[right], n[x]) * percent
        some = right[ok]
        if some.size:
            share = (marks[some] == marks[x]).mean(axis=1)
            some, share = some[share >= least_share], share[share >= least_share]
            if once and some.size:
                first = (keys[some] == keys[x]).argmax(axis=1) == band
                some, share = some[first], share[first]
            if some.size:
                yield x, some, share


def _best_pairs(members: DataFrame, least_share: float, percent: int) -> DataFrame:
    """Pairs (a, b): each minor member's most similar one of another label."""

    def compare(table: pa.Table) -> pa.Table:
        node, out = table.column("node").to_numpy(), []
        for x, some, share in _candidates(table, least_share, percent, False):
            out.append((node[x], node[some[share.argmax()]], float(share.max())))
        a, b, share = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "share": pa.array(share, pa.float64())})

    found = _dealt(members, True).groupBy("band", "key", "i", "j").applyInArrow(compare, "a long, b long, share double")
    found = found.groupBy("a").agg(F.max_by("b", F.struct("share", "b")).alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


_MEMBER = "band int, key long, i long, j long, role boolean, node long, n long, signature binary, keys array<long>, label long, minor boolean"


def _spanning_links(work: Workspace, members: DataFrame, texts: DataFrame, name: str, least_share: float, percent: int, width: int, parts: int) -> DataFrame:
    """Links (u, v) on full sets that join the components of open buckets; none that a block's other links make needless."""

    def similar(table: pa.Table) -> pa.Table:
        """The members of a block that have a similar one in it."""
        kept = np.zeros(table.num_rows, bool)
        for x, some, _ in _candidates(table, least_share, percent, True):
            kept[x] = kept[some] = True
        return table.filter(pa.array(kept)).select([f.split()[0] for f in _MEMBER.split(", ")])

    def check(table: pa.Table) -> pa.Table:
        texts, sets = table.column("text").combine_chunks(), []
        for lo, hi in slices_of(np.asarray(pa.compute.binary_length(texts)), 4_000_000):
            sets += shingle_sets(texts.slice(lo, hi - lo), width)
        node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
        top = {x: x for x in label.tolist()}

        def find(x):
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        out = []
        for x, some, share in _candidates(table, least_share, percent, True):
            for y in some[np.argsort(-share, kind="stable")]:
                a, b = find(int(label[x])), find(int(label[y]))
                if a != b:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if both * 100 >= percent * (len(sets[x]) + len(sets[y]) - both):
                        top[max(a, b)] = min(a, b)
                        out.append((int(node[x]), int(node[y])))
        u, v = zip(*out) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    listed = work.table(_dealt(members, False).groupBy("band", "key", "i", "j").applyInArrow(similar, _MEMBER).coalesce(parts), f"{name}-listed")
    met = listed.join(texts, "node")
    links = work.table(met.groupBy("band", "key", "i", "j").applyInArrow(check, "u long, v long").coalesce(parts), f"{name}-links")
    work.drop(f"{name}-listed")
    return links


def _open_pass(work: Workspace, members: DataFrame, nodes: DataFrame, texts: DataFrame, labels: DataFrame, name: str, best_only: bool, least_share: float, width: int, percent: int, parts: int) -> DataFrame:
    """labels (node, label) after one pass over the buckets whose members have more than one label."""
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("band", "key", "node", "n", "total", "label")
    labelled = work.table(labelled.coalesce(parts), f"{name}-labelled")
    sizes = labelled.groupBy("band", "key", "label").agg(F.count("*").alias("held"), F.sum("n").alias("held_n"))
    main = F.max_by(F.struct("label", "held", "held_n"), F.struct("held", "label"))
    open_ = sizes.groupBy("band", "key").agg(main.alias("main"), F.sum("held_n").alias("total_n"), F.count("*").alias("labels")).where("labels > 1")
    open_ = work.table(open_.select("band", "key", F.col("main.label").alias("main"), F.col("main.held").alias("most"), "total_n", (F.col("total_n") - F.col("main.held_n")).alias("minor_n")).coalesce(parts), f"{name}-open")
    if not open_.limit(1).count():
        work.drop(f"{name}-labelled", f"{name}-open")
        return labels
    rest = labelled.join(open_, ["band", "key"]).join(nodes.select("node", "signature", "keys"), "node").withColumns({
        "minor": F.col("label") != F.col("main"), "minors": F.col("total") - F.col("most")})
    if best_only:
        links = _verified(work, _best_pairs(rest, least_share, percent), texts, name, width, percent, parts)
    else:
        links = _spanning_links(work, rest, texts, name, least_share, percent, width, parts)
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    joined = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
    again = work.table(connected_components(work, joined.coalesce(parts), name).select(F.col("node").alias("label"), F.col("label").alias("top")).coalesce(parts), f"{name}-again")
    known = labels.unionByName(again.select(F.col("label").alias("node"), "label")).groupBy("node").agg(F.min("label").alias("label"))
    merged = work.table(known.join(again, "label", "left").select("node", F.coalesce("top", "label").alias("label")).coalesce(parts), f"{name}-labels")
    work.drop(f"{name}-labelled", f"{name}-open", f"{name}-again", f"{name}-links")
    return merged


def near_duplicates(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, margin: float = MARGIN) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, and class_id (smallest id with the same set)."""
    work = Workspace(docs.sparkSession, "near-dedup")
    least_share = max(0.0, percent / 100 - margin)
    with batches_of(docs.sparkSession, BATCH):
        prints = work.table(_fingerprints(docs, width, bands, rows), "prints")
    total = prints.count()
    parts = work.parts(total)
    classes = prints.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    classes = work.table(classes.coalesce(parts), "classes")
    nodes = classes.where("node is not null")
    keyed = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    least, most = F.min(F.struct("node", "n")), F.max(F.struct("node", "n"))
    buckets = keyed.groupBy("band", "key").agg(least.alias("lo"), most.alias("hi"), F.count("*").alias("total")).where("total > 1")
    buckets = work.table(buckets.coalesce(parts), "buckets")
    # Buckets of two are their pair; only larger ones look up their members.
    twos = buckets.where("total = 2").select(F.col("lo.node").alias("a"), F.col("hi.node").alias("b"))
    larger = buckets.where("total > 2").select("band", "key", "lo", "total")
    members = work.table(keyed.join(larger, ["band", "key"]).select("band", "key", "node", "n", "lo", "total").coalesce(parts), "members")
    stars = members.where("node != lo.node").select(F.col("lo.node").alias("a"), F.col("node").alias("b"))
    pairs = work.table(twos.unionByName(stars).distinct().coalesce(parts), "pairs")
    sig = lambda side: nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("signature").alias(f"s{side}"))
    alike = work.table(_similar_signatures(pairs.join(sig("b"), "b").join(sig("a"), "a").coalesce(parts), least_share, percent), "alike")
    # Texts of the classes that may still be compared, once each.
    involved = alike.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node")).distinct()
    # A merge join whatever the sizes: the list of classes has no bound that would allow a broadcast.
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(involved.hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    texts = work.table(texts.coalesce(work.parts(total, TEXTS)), "texts")
    links = _verified(work, alike, texts, "first", width, percent, parts)
    labels = work.table(connected_components(work, links, "one").coalesce(parts), "labels")
    work.drop("pairs", "alike", "first-links")

    for turn in range(PASSES + 1):
        labels = _open_pass(work, members, nodes, texts, labels, f"pass-{turn}", turn < PASSES, least_share, width, percent, parts)
    work.drop("members", "texts", "buckets")
    merged = nodes.select("h1", "h2", F.col("n").alias("size"), "node").join(labels, "node", "left")
    merged = work.table(merged.select("h1", "h2", "size", F.col("node").alias("class_id"), F.coalesce("label", "node").alias("component")).coalesce(parts), "merged")

    p, m = prints.select("doc_id", "n", "h1", "h2").alias("p"), merged.alias("m")
    found = p.join(m, (F.col("p.h1") == F.col("m.h1")) & (F.col("p.h2") == F.col("m.h2")) & (F.col("p.n") == F.col("m.size")), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.expr("doc_id <=> CASE WHEN n = 0 THEN doc_id ELSE component END").alias("kept"),
                        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")).coalesce(parts)


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row for each group of near duplicates: the one with the smallest id. Rows without an id stay.

    Rows that repeat in id and text are one document. Different texts under one id all stay once the id stays.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), **options).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))
