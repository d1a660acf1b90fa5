"""Ranked lexical search over a length-stratified index.

The index is cut by documents into segments. In a segment the documents lie in
order of length, so those of one normaliser m, a stratum, lie side by side; a
term's postings follow the strata and, in each, the term frequency. A posting's
impact depends on (m, tf) alone and is computed once for each such run.

A search gives every (item, stratum) the sum of the best impacts of the item's
terms there. Strata are visited in falling order of that bound, more at a time
as the visits go on, and the rest is left once the bounds fall below the k-th
best score. A first search over an eighth of the segments gives each item a
floor that prunes the others. Bounds are the same integers as the scores, so
the result is exact.

Segments meet blocks of items by a join on a slot number. Items of up to
``ITEM_BYTES`` in all, measured before, are broadcast and segments stay where
they are; beyond, segments are dealt to slots of ``SLOT_BYTES``, each of which
gets every block of items. What leaves a segment are k rows an item at most.
A segment is a file of the index, and Python gets segments one by one: readers
hold a batch of rows whole, so a task needs memory for one segment, however
many of them its input makes.

Defined cases: null and empty texts have no terms, and documents without a term
are not counted; items without a term or without a match give no rows; rows
that repeat an id are documents, or items, each; among equal scores a null
doc_id comes last; empty tables give no rows; other columns are ignored; a very
long text is one document of a segment of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintlake.llm.shared import LOWER, UPPER, Workspace, batches_of, parts_for, ragged, slices_of

TOP = 10
#: Bytes of text in a segment; items, and bytes of item text, in a block.
SEGMENT, ITEMS, ITEM_BYTES = 16_000_000, 512, 2_000_000
#: Bytes of postings in a slot.
SLOT_BYTES = 64_000_000
#: Documents that Python gets at once when it builds segments.
ROWS = 2_000
#: One of so many segments gives the floors.
PROBE = 8
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Byte by byte: A-Z lower-cased, ASCII that is no letter or digit a space, all else (ASCII terms, parts of other characters) as it is.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SEGMENT = "segment long, docs long, words long, ids array<long>, lengths binary, terms array<string>, dfs array<int>, places binary, tfs binary"


def _terms(texts: pa.Array):
    """(terms of all texts, number of the text each lies in)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    data = texts.buffers()[2]
    plain = pa.py_buffer((data.to_pybytes() if data else b"").translate(_BYTES))
    moved = pa.Array.from_buffers(pa.large_string(), len(texts), [None, texts.buffers()[1], plain], offset=texts.offset)
    lists = pc.ascii_split_whitespace(moved)
    offsets = np.asarray(lists.offsets)
    flat, owner = lists.flatten(), np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(offsets))
    full = pc.not_equal(flat, "")
    return flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def _segment(number: int, ids: pa.Array, texts: pa.Array) -> dict:
    flat, owner = _terms(texts)
    words, coded = len(owner), flat.dictionary_encode()
    del flat
    order = np.asarray(pc.array_sort_indices(coded.dictionary))
    code = np.empty(len(order), np.int64)
    code[order] = np.arange(len(order))
    lengths = np.bincount(owner, minlength=len(texts))
    held = np.flatnonzero(lengths)
    by_length = held[np.argsort(lengths[held], kind="stable")]
    place = np.zeros(len(texts), np.int64)
    place[by_length] = np.arange(len(by_length))
    keys = code[np.asarray(coded.indices)]
    terms = coded.dictionary.take(pa.array(order))
    del coded
    keys *= max(len(by_length), 1)
    keys += place[owner]
    del owner
    # Sorted in place, equal keys are neighbours.
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    tf = np.diff(first, append=len(keys))
    term, at = np.divmod(keys[first], max(len(by_length), 1))
    del keys, first
    # Documents of one length are a run of places; within it, postings go by term frequency.
    rows = np.lexsort((at, tf, lengths[by_length][at], term))
    return {"segment": number, "docs": len(by_length), "words": words, "ids": ids.take(pa.array(by_length)), "lengths": lengths[by_length].astype(np.int64).tobytes(),
            "terms": terms, "dfs": np.bincount(term, minlength=len(order)).astype(np.int32),
            "places": at[rows].astype(np.int32).tobytes(), "tfs": tf[rows].astype(np.int32).tobytes()}


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT) -> DataFrame:
    """Segments of the index, one row each; a narrow pass over the documents."""

    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def full():
            table = pa.Table.from_batches(held).combine_chunks()
            found = _segment(number, *(table.column(c).combine_chunks() for c in ("doc_id", "text")))
            arrays = [*(pa.array([found[c]], pa.int64()) for c in ("segment", "docs", "words")), pa.ListArray.from_arrays(pa.array([0, len(found["ids"])], pa.int32()), found["ids"]), pa.array([found["lengths"]]),
                      pa.ListArray.from_arrays(pa.array([0, len(found["terms"])], pa.int32()), found["terms"].cast(pa.string())),
                      pa.ListArray.from_arrays(pa.array([0, len(found["dfs"])], pa.int32()), pa.array(found["dfs"])), pa.array([found["places"]]), pa.array([found["tfs"]])]
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _SEGMENT.split(", ")])

        def cut():
            yield full()
            pa.default_memory_pool().release_unused()

        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0))
            for a, b in slices_of(sizes, segment_bytes):
                part = int(sizes[a:b].sum())
                if held and size + part > segment_bytes:
                    yield from cut()
                    number, held, size = number + 1, [], 0
                held.append(batch.slice(a, b - a))
                size += part
        if held:
            yield from cut()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SEGMENT)


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_row, item_id, bytes, terms): the items with their terms in any order, repeats included."""
    plain = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return items.select(F.monotonically_increasing_id().alias("item_row"), "item_id", F.octet_length(plain).alias("bytes"), F.regexp_extract_all(plain, F.lit(f"({TERM})"), F.lit(1)).alias("terms"))


def _weighted(items: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """(item_row, item_id, bytes, terms array<struct<term, weight>>); a term's weight counts its repeats in the item."""
    asked = items.select("item_row", F.explode("terms").alias("term")).groupBy("item_row", "term").agg(F.count("*").alias("repeats"))
    df = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select("t.terms", "t.dfs").join(asked.select(F.col("term").alias("terms")).distinct(), "terms", "left_semi")
    df = df.groupBy("terms").agg(F.sum("dfs").alias("df")).withColumnRenamed("terms", "term")
    weight = F.floor(1000 * F.log((2 * F.lit(n).cast("double") + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("repeats")
    known = asked.join(df, "term").groupBy("item_row").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("terms"))
    return items.drop("terms").join(known, "item_row")


def _blocks(items: DataFrame, blocks: int, slots: int) -> DataFrame:
    """Items in blocks, each block once for every slot of segments."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_row"), F.lit(blocks)))
    packed = dealt.groupBy("block").agg(F.collect_list(F.struct("item_row", "item_id", "floor", "terms")).alias("items"))
    return packed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


class _Stratified:
    """A segment ready for search: strata, and the postings of the terms asked for, with impacts."""

    def __init__(self, row: dict, vocabulary: pa.Array, n: int, total: int):
        ids = _array(row["ids"], pa.int64())
        self.ids = pc.fill_null(ids, 2**63 - 1).to_numpy()
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        lengths = np.frombuffer(row["lengths"], np.int64)
        m = 25 + (75 * lengths * n) // max(total, 1)
        self.first = np.flatnonzero(np.diff(m, prepend=-1))
        self.count = np.diff(np.append(self.first, len(m)))
        stratum = np.repeat(np.arange(len(self.first), dtype=np.int32), self.count)
        terms = _array(row["terms"], pa.string())
        wanted = np.asarray(pc.fill_null(pc.index_in(vocabulary, terms), -1))
        dfs = np.asarray(row["dfs"]).astype(np.int64)
        starts = np.cumsum(dfs) - dfs
        self.known = wanted >= 0
        wanted, sizes = wanted[self.known], dfs[wanted[self.known]]
        rows = ragged(starts[wanted], sizes)
        self.place = np.frombuffer(row["places"], np.int32)[rows]
        tf = np.frombuffer(row["tfs"], np.int32)[rows]
        postings = len(rows)
        del rows
        self.to = np.full(len(vocabulary), -1)
        self.to[self.known] = np.arange(len(wanted))
        term, layer = np.repeat(np.arange(len(wanted), dtype=np.int32), sizes), stratum[self.place]
        # One impact for each run of (term, stratum, tf), spread over its postings.
        new = np.ones(postings, bool)
        new[1:] = (np.diff(term) != 0) | (np.diff(layer) != 0) | (np.diff(tf) != 0)
        runs = np.flatnonzero(new)
        times = tf[runs].astype(np.int64)
        each = (1_000_000_000 * times) // (1000 * times + 8 * m[self.place[runs]])
        # Below 1,000,000.
        self.impact = np.repeat(each.astype(np.int32), np.diff(np.append(runs, postings)))
        # Postings of a (term, stratum), and its best impact.
        cell = np.ones(postings, bool)
        cell[1:] = (np.diff(term) != 0) | (np.diff(layer) != 0)
        self.cell = np.flatnonzero(cell)
        self.cell_size = np.diff(np.append(self.cell, postings))
        self.cell_layer = layer[self.cell]
        self.best = np.maximum.reduceat(self.impact, self.cell).astype(np.int64) if postings else np.zeros(0, np.int64)
        self.cells = np.searchsorted(term[self.cell], np.arange(len(wanted) + 1))

    def search(self, numbers: np.ndarray, weights: np.ndarray, floor: int, k: int):
        """(places, scores) of the k best documents with a score of ``floor`` or more, best first."""
        rows, weights = self.to[numbers], weights[self.to[numbers] >= 0]
        rows = rows[rows >= 0]
        cells = ragged(self.cells[rows], self.cells[rows + 1] - self.cells[rows])
        weight = np.repeat(weights, self.cells[rows + 1] - self.cells[rows])
        layer = self.cell_layer[cells]
        bound = np.zeros(len(self.first), np.int64)
        np.add.at(bound, layer, weight * self.best[cells])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        by_layer = np.argsort(layer, kind="stable")
        cells, weight, from_layer = cells[by_layer], weight[by_layer], np.searchsorted(layer[by_layer], np.arange(len(self.first) + 1))
        reach = np.cumsum(self.count[order])
        scores = np.zeros(len(self.ids), np.int64)
        at, found, step = 0, np.zeros(0, np.int64), 8 * k
        while at < len(order) and bound[order[at]] >= floor:
            upto = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + step, "right")))
            visit = order[at:upto]
            visit = visit[bound[visit] >= floor]
            mine = ragged(from_layer[visit], from_layer[visit + 1] - from_layer[visit])
            size = self.cell_size[cells[mine]]
            posts = ragged(self.cell[cells[mine]], size)
            np.add.at(scores, self.place[posts], np.repeat(weight[mine], size) * self.impact[posts])
            found = np.concatenate([found, ragged(self.first[visit], self.count[visit])])
            found = found[(scores[found] > 0) & (scores[found] >= floor)]
            if len(found) >= k:
                floor = max(floor, int(np.partition(scores[found], len(found) - k)[len(found) - k]))
                found = found[scores[found] >= floor]
            at, step = upto, step * 8
        best = found[np.lexsort((self.ids[found], -scores[found]))][:k]
        return best, scores[best]


def _searching(n: int, total: int, k: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                # A segment's columns stay in Arrow's memory; only the items become Python's.
                row = {c: batch.column(c).slice(i, 1).flatten() for c in ("ids", "terms", "dfs")}
                row |= {c: batch.column(c)[i].as_buffer() for c in ("lengths", "places", "tfs")}
                items = batch.column("items")[i].as_py()
                vocabulary = sorted({t["term"] for item in items for t in item["terms"]})
                number = {t: j for j, t in enumerate(vocabulary)}
                held = _Stratified(row, pa.array(vocabulary, pa.string()), n, total)
                out = []
                for item in items:
                    numbers = np.array([number[t["term"]] for t in item["terms"]], np.int64)
                    weights = np.array([t["weight"] for t in item["terms"]], np.int64)
                    for place, score in zip(*held.search(numbers, weights, item["floor"], k)):
                        out.append((item["item_row"], item["item_id"], None if held.null[place] else int(held.ids[place]), int(score)))
                columns = list(zip(*out)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_row", "item_id", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = TOP, work: Workspace | None = None) -> DataFrame:
    """Each item's k best documents: item_id, rank, doc_id, score. ``index``: a table of ``build_index``."""
    spark = index.sparkSession
    work = work or Workspace(spark, "lexical-search")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n, total, postings = index.agg(zero("docs"), zero("words"), zero(2 * F.octet_length("places"))).first()
    items = work.table(_item_terms(items.withColumn("item_id", F.col("item_id").cast("long"))), "items")
    items = work.table(_weighted(items, index, n), "weighted")
    rows, size = items.agg(F.count("*"), F.sum("bytes")).first()
    blocks = max(1, -(-rows // ITEMS), -(-(size or 0) // ITEM_BYTES))
    small = (size or 0) <= ITEM_BYTES
    slots = 4 if small else parts_for(spark, postings, SLOT_BYTES)
    slotted = index.withColumn("slot", F.pmod(F.xxhash64("segment"), F.lit(slots)).cast("int"))
    order = Window.partitionBy("item_row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())

    def found(part: DataFrame, asked: DataFrame) -> DataFrame:
        packed = _blocks(asked, blocks, slots)
        met = part.join(F.broadcast(packed), "slot") if small else part.repartition(slots, "slot").join(packed, "slot")
        met = met.select("ids", "lengths", "terms", "dfs", "places", "tfs", "items")
        return met.mapInArrow(_searching(n, total, k), "item_row long, item_id long, doc_id long, score long")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    probe = F.pmod(F.xxhash64("segment", F.lit(1)), F.lit(PROBE)) == 0
    with batches_of(spark, 1):
        first = work.table(ranked(found(slotted.where(probe), items.withColumn("floor", F.lit(1).cast("long")))), "first")
    floors = first.where(F.col("rank") == k).select("item_row", F.col("score").alias("floor"))
    asked = items.join(floors, "item_row", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long")))
    with batches_of(spark, 1):
        rest = work.table(ranked(found(slotted.where(~probe), asked).unionByName(first.drop("rank"))), "ranked")
    return rest.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = TOP, segment_bytes: int = SEGMENT) -> DataFrame:
    """Index ``docs`` and rank them for each of ``items``."""
    work = Workspace(docs.sparkSession, "lexical")
    with batches_of(docs.sparkSession, ROWS):
        index = work.table(build_index(docs, segment_bytes), "index", 1)
    return search(index, items, k, work)


def ranking_sql(k: int = TOP) -> str:
    """The same ranking in DuckDB SQL, from the definition of the score."""
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS terms FROM documents),
lengths AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS words FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs_n, CAST(sum(words) AS BIGINT) AS all_words FROM lengths),
normal AS (SELECT r, doc_id, 25 + (75 * words * docs_n) // all_words AS m FROM lengths, totals),
posts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM posts GROUP BY term), totals),
items AS (SELECT row_number() OVER () AS i, item_id, {terms} AS terms FROM benchmark),
asked AS (SELECT i, item_id, unnest(terms) AS term FROM items),
scored AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM asked JOIN weights USING (term) JOIN posts USING (term) JOIN normal USING (r) GROUP BY i, item_id, r, doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM best WHERE place <= {k}
"""
