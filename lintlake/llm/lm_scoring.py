"""Language-model scores of whole texts by an Elias-Fano n-gram trie, trained and queried in shards.

The model interpolates absolutely discounted trigrams, bigrams and unigrams:
P(w | u v) = a + b * P(w), with a and b from the trie of the shard that holds
context v. Words with one training occurrence and unseen words form a class:
its n-grams are those of the class, times the word's share of the class.
All probabilities sum to at most one over the known words and one unseen word.

1. Texts are cut into blocks of bounded size. A block keeps its tokens as codes
   in its own vocabulary, so texts are read and hashed once.
2. Vocabulary: blocks send (word, training count), summed beforehand, to shards
   by word hash. A shard answers with the total count and an id, small for
   frequent words.
3. Blocks send their distinct trigrams with training counts to shards by context
   v. A context of very many occurrences is split by its preceding word, so no
   shard grows with a frequent word; its parts lie in shards of their own.
4. A shard sums counts once and keeps its distinct trigrams with each block's
   places among them. Discounts come from the corpus's counts of counts. Pairs
   (v, w) of split contexts are summed over all parts, and the parts get the
   pair's count and the context's numbers back, so a split changes no score.
5. A shard builds its trie, maps it, and answers its distinct trigrams with
   quantised a and b. Blocks add up their documents' scores.

Scores do not depend on the number of shards, parts, blocks or cores.

What moves is distinct per block, sorted and compressed: it grows with the
corpus, and no part of it passes through the driver but eight numbers.

Defined cases: null text is empty and scores its end token; a null id is not
held out; repeated rows count each time; with no training document the model
gives every token to the unseen word; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import mmap
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.elias_fano import NgramTrie, discount, distinct, levels, ones_twos, quantise
from lintlake.llm.shared import Workspace, parts_for, slices_of, total_bytes
from lintlake.llm.shingles import constants, mix, word_hashes

U = np.uint64
#: Bytes of text in a block and, on average, of the texts behind a shard.
BLOCK_BYTES, SHARD_BYTES = 8_000_000, 12_000_000
#: Occurrences from which a context is split by the word before it; a part's number stands above the word's id.
HOT = 500_000
PART, MOST_PARTS = 42, 2**21
END_HASH = constants(21, 1)[0]
RARE, START, FIRST = 0, 1, 2
FOLDS, HELD = 7, 2


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed."""
    width = 8 if values.dtype.itemsize == 8 else values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    raw = np.ascontiguousarray(planes).tobytes()
    return np.array([len(values), width], "<u8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def expand(data: bytes) -> np.ndarray:
    n, width = (int(x) for x in np.frombuffer(data, "<u8", 2))
    if not n:
        return np.zeros(0, f"<u{width}")
    raw = pa.decompress(data[16:], n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel()


def _blocks(docs: DataFrame, folds: int, held: int) -> DataFrame:
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, all_ids = batch.column("text"), batch.column("doc_id").to_pylist()
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
            for lo, hi in slices_of(sizes, BLOCK_BYTES):
                words, lengths = [], []
                for a, b in slices_of(sizes[lo:hi], 1_000_000):
                    hashes, at = word_hashes(texts.slice(lo + a, b - a))
                    words.append(np.insert(hashes, at[1:], END_HASH))
                    lengths.append(np.diff(at) + 1)
                vocab, codes = np.unique(np.concatenate(words), return_inverse=True)
                lengths = np.concatenate(lengths)
                ids = all_ids[lo:hi]
                out = [i is not None and zlib.crc32(str(i).encode()) % folds == held for i in ids]
                train = np.bincount(codes, np.repeat(~np.array(out), lengths), len(vocab)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part * 2**32 + number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([out], pa.list_(pa.bool_())), pa.array([lengths.tolist()], pa.list_(pa.int32())),
                    pa.array([squeeze(codes.astype(np.uint32))]), pa.array([vocab.tobytes()]), pa.array([squeeze(train)])],
                    ["block", "ids", "held", "lengths", "codes", "vocab", "train"])
                number += 1

    return docs.select("doc_id", "text").mapInArrow(run, "block long, ids array<long>, held array<boolean>, lengths array<int>, codes binary, vocab binary, train binary")


def _vocabulary(blocks: DataFrame, shards: int) -> DataFrame:
    """Answers (block, shard, counts, ids) in the order of each block's vocabulary; block -1 carries a shard's totals."""

    def send(batches):
        for batch in batches:
            for block, vocab, train in zip(*(batch.column(c).to_pylist() for c in ("block", "vocab", "train"))):
                hashes, counts = np.frombuffer(vocab, np.uint64), expand(train)
                shard = ((hashes >> U(32)) * U(shards) >> U(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(shard)) + 1
                parts = list(zip([0, *cuts], [*cuts, len(hashes)]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(parts), pa.int64()), pa.array([int(shard[a]) for a, _ in parts], pa.int64()),
                    pa.array([hashes[a:b].tobytes() for a, b in parts]), pa.array([squeeze(counts[a:b]) for a, b in parts])], ["block", "shard", "hashes", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blocks_, parts = table.column("block").to_pylist(), [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        sent = [expand(x) for x in table.column("counts").to_pylist()]
        words, at = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(at, np.concatenate(sent), len(words)).astype(np.uint64)
        ids = np.zeros(len(words), np.uint64)
        order = np.lexsort((words, -counts.astype(np.int64)))
        kept = order[counts[order] >= 2]
        ids[kept] = FIRST + np.arange(len(kept), dtype=np.uint64) * U(shards) + U(shard)
        ends = np.cumsum([len(p) for p in parts])
        spans = list(zip(ends - [len(p) for p in parts], ends))
        totals = [int(counts.sum()), int((counts > 0).sum()), int((counts == 1).sum()), int((counts == 2).sum())]
        return pa.table({
            "block": pa.array([*blocks_, -1], pa.int64()), "shard": pa.array([shard] * (len(parts) + 1), pa.int64()),
            "counts": pa.array([*(squeeze(counts[at[a:b]]) for a, b in spans), None], pa.binary()), "ids": pa.array([*(squeeze(ids[at[a:b]]) for a, b in spans), None], pa.binary()),
            "totals": pa.array([*([None] * len(parts)), totals], pa.list_(pa.int64()))})

    sent = blocks.select("block", "vocab", "train").mapInArrow(send, "block long, shard long, hashes binary, counts binary")
    return sent.repartition(shards, "shard").groupBy("shard").applyInArrow(answer, "block long, shard long, counts binary, ids binary, totals array<long>")


def _split(context: np.ndarray) -> np.ndarray:
    return context >> U(PART) > 0


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Marks of the rows that differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _order(place: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The order by (place, u, w); place counts contexts, so it and u share one key."""
    return np.lexsort((w, place.astype(np.uint64) * (u.max(initial=U(0)) + U(1)) + u))


class _Block:
    """A block with the global counts and ids of its words."""

    def __init__(self, row: pa.Table, answers: pa.Table):
        one = {c: row.column(c)[0].as_py() for c in row.column_names}
        self.block, self.doc_ids, self.held = one["block"], one["ids"], np.array(one["held"])
        self.lengths, self.codes = np.array(one["lengths"], np.int64), expand(one["codes"]).astype(np.int64)
        shards = answers.column("shard").to_pylist()
        order = np.argsort(shards)
        counts, ids = (answers.column(c).to_pylist() for c in ("counts", "word_ids"))
        self.counts = np.concatenate([expand(counts[i]) for i in order])
        self.ids = np.concatenate([expand(ids[i]) for i in order])

    def trigrams(self, hot: int, rare: int, shards: int):
        """(shard, context, u, w, training count) of the distinct trigrams, sorted, and each token's place among them."""
        w = self.ids[self.codes]
        first = np.cumsum(self.lengths) - self.lengths
        v = np.concatenate([[U(START)], w[:-1]])
        v[first] = START
        often = np.concatenate([[U(0)], np.where(w == RARE, U(rare), self.counts[self.codes])[:-1]])
        often[first] = 0
        u = np.concatenate([[U(START)], v[:-1]])
        u[first] = START
        with np.errstate(over="ignore"):
            parts = np.minimum(often // U(hot) + U(1), U(MOST_PARTS))
            context = v | np.where(parts > 1, mix(u + U(77)) % parts + U(1), U(0)) << U(PART)
            key = mix(mix(mix(context) + u) + w)
        by_key = np.argsort(key)
        new = _starts(key[by_key])
        index = by_key[new]
        at = np.empty(len(key), np.int64)
        at[by_key] = np.cumsum(new) - 1
        train = np.bincount(at, np.repeat(~self.held, self.lengths), len(index)).astype(np.uint32)
        context, u, w = context[index], u[index], w[index]
        # Contexts in the order of their shards; parts of split contexts have shards of their own, numbered after the others.
        names, place = np.unique(context, return_inverse=True)
        of = (mix(names + U(5)) % U(shards)).astype(np.int64) + np.where(_split(names), shards, 0)
        turn = np.empty(len(names), np.int64)
        turn[np.argsort(of, kind="stable")] = np.arange(len(names))
        order = _order(turn[place], u, w)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return of[place][order], context[order], u[order], w[order], train[order], rank[at]


def _ask(hot: int, rare: int, shards: int):
    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(row, answers)
        shard, context, u, w, train, _ = block.trigrams(hot, rare, shards)
        cuts = np.flatnonzero(np.diff(shard)) + 1
        parts = list(zip([0, *cuts], [*cuts, len(shard)]))
        return pa.table({
            "shard": pa.array([int(shard[a]) for a, _ in parts], pa.int64()), "block": pa.array([block.block] * len(parts), pa.int64()),
            **{n: pa.array([squeeze(x[a:b]) for a, b in parts], pa.binary()) for n, x in (("u", u), ("w", w), ("train", train))},
            # Contexts as steps: they are sorted, so the steps are small.
            "context": pa.array([squeeze(np.diff(context[a:b], prepend=U(0))) for a, b in parts], pa.binary())})

    return run


def _mapped(trie: NgramTrie) -> NgramTrie:
    """The trie read back from an anonymous memory map, compact, without the arrays it was built from."""
    data = trie.to_bytes()
    area = mmap.mmap(-1, max(len(data), 1))
    area.write(data)
    return NgramTrie.from_buffer(area)


_COUNTED = "shard long, context binary, u binary, w binary, train binary, blocks array<long>, places array<binary>, numbers array<long>"
_PAIR = "shard long, context long, v long, w long, n long"
_ANSWER = "block long, shard long, a binary, b binary"


def _pairs_of(context: np.ndarray, w: np.ndarray, train: np.ndarray):
    """(context, w, count) of the distinct pairs, from rows sorted by context."""
    if not len(context):
        return context, w, train
    order = np.argsort(np.cumsum(_starts(context)).astype(np.uint64) * (w.max() + U(1)) + w)
    c, y = context[order], w[order]
    first = np.flatnonzero(_starts(c, y))
    return c[first], y[first], np.add.reduceat(train[order], first)


def _count(table: pa.Table) -> pa.Table:
    """A shard's distinct trigrams with their counts, where each block's requests lie among them, and counts of counts."""
    pieces = [np.cumsum(expand(x), dtype=np.uint64) for x in table.column("context").to_pylist()]
    ends = np.cumsum([len(x) for x in pieces])
    context = np.concatenate(pieces)
    u, w, train = (np.concatenate([expand(x) for x in table.column(c).to_pylist()]) for c in ("u", "w", "train"))
    order = _order(np.searchsorted(distinct(context[_starts(context)]), context), u, w)
    c, x, y = context[order], u[order], w[order]
    new = _starts(c, x, y)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    c, x, y, n = c[first], x[first], y[first], np.add.reduceat(train[order].astype(np.int64), first)
    whole = np.flatnonzero((n > 0) & ~_split(c))
    numbers = [*ones_twos(_pairs_of(c[whole], y[whole], n[whole])[2]), *ones_twos(n)]
    places = [squeeze(np.diff(p, prepend=0).astype(np.uint32)) for p in np.split(at, ends[:-1])]
    return pa.table({
        "shard": table.column("shard").slice(0, 1).combine_chunks(), "context": pa.array([squeeze(np.diff(c, prepend=U(0)))], pa.binary()),
        **{k: pa.array([squeeze(z)], pa.binary()) for k, z in (("u", x), ("w", y), ("train", n.astype(np.uint64)))},
        "blocks": pa.array([table.column("block").to_pylist()], pa.list_(pa.int64())), "places": pa.array([places], pa.list_(pa.binary())),
        "numbers": pa.array([numbers], pa.list_(pa.int64()))})


def _split_pairs(batches):
    """(shard, context, v, w, count in this part) of the pairs of split contexts, those that are only asked for included."""
    for batch in batches:
        for shard, context, w, train in zip(*(batch.column(k).to_pylist() for k in ("shard", "context", "w", "train"))):
            c, y, n = _pairs_of(np.cumsum(expand(context), dtype=np.uint64), expand(w), expand(train).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(z.astype(np.int64)) for z in (np.full(len(c), shard), c, c & U(2**PART - 1), y, n)], ["shard", "context", "v", "w", "n"])


def _answers(row: dict, discounts: tuple[float, float], shared: dict | None = None) -> pa.Table:
    """(block, shard, a, b) of one shard: its trie answers each distinct trigram once."""
    c = np.cumsum(expand(row["context"]), dtype=np.uint64)
    u, w, n = (expand(row[k]) for k in ("u", "w", "train"))
    some = np.flatnonzero(n)
    a, b = _mapped(NgramTrie.build(c[some], u[some], w[some], n[some].astype(np.int64), discounts, shared)).query(c, u, w)
    a, b = quantise(a), quantise(b, 1)
    places = [np.cumsum(expand(p), dtype=np.int64) for p in row["places"]]
    return pa.table({
        "block": pa.array(row["blocks"], pa.int64()), "shard": pa.array([row["shard"]] * len(places), pa.int64()),
        "a": pa.array([squeeze(a[p]) for p in places], pa.binary()), "b": pa.array([squeeze(b[p]) for p in places], pa.binary())})


def _answer_whole(discounts: tuple[float, float]):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _answers(batch.slice(i, 1).to_pylist()[0], discounts).to_batches()

    return run


def _answer_split(discounts: tuple[float, float]):
    def run(row: pa.Table, pairs: pa.Table) -> pa.Table:
        shared = {k: pairs.column(k).to_numpy() for k in ("context", "w", "c2", "total", "kinds")}
        shared.update({k: shared[k].astype(np.uint64) for k in ("context", "w")})
        return _answers(row.to_pylist()[0], discounts, shared)

    return run


def unigrams(counts: np.ndarray, total: int, known: int, ones: int, twos: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(w), share of w in the rare class, P(rare class)) for words with these training counts."""
    if not total:
        return np.ones(len(counts)), np.ones(len(counts)), 1.0
    d = discount(ones, twos)
    unseen = d * known / total
    p = np.where(counts > 0, (counts.astype(np.float64) - d) / total, unseen)
    rare = unseen + ones * (1 - d) / total
    return p, p / rare, rare


def _score(hot: int, shards: int, total: int, known: int, ones: int, twos: int):
    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        kind = answers.column("kind").to_numpy()
        block = _Block(row, answers.filter(pa.array(kind == 0)))
        *_, at = block.trigrams(hot, ones, shards)
        grams = answers.filter(pa.array(kind == 1))
        order = np.argsort(grams.column("shard").to_pylist())
        table = levels()
        a, b = (table[np.concatenate([expand(x[i]) for i in order])] for x in (grams.column(c).to_pylist() for c in ("counts", "word_ids")))
        p, share, rare = unigrams(block.counts, total, known, ones, twos)
        is_rare = block.counts < 2
        low, factor = np.where(is_rare, rare, p)[block.codes], np.where(is_rare, share, 1.0)[block.codes]
        score = np.log10((a[at] + b[at] * low) * factor)
        base = np.log10((block.counts.astype(np.float64) + 1) / (total + known + 1))[block.codes]
        first = np.cumsum(block.lengths) - block.lengths
        sums = lambda x: np.add.reduceat(x, first)
        return pa.table({
            "doc_id": pa.array(block.doc_ids, pa.int64()), "held_out": pa.array(block.held), "n_tokens": pa.array(block.lengths, pa.int64()),
            "n_known": pa.array(sums((block.counts[block.codes] > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array([total] * len(block.lengths), pa.int64()),
            "base_score": pa.array(sums(base)), "score": pa.array(sums(score))})

    return run


def score_documents(docs: DataFrame, folds: int = FOLDS, held: int = HELD, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    work = Workspace(spark, "lm")
    size = total_bytes(docs)
    shards, width = parts_for(spark, size, shard_bytes), parts_for(spark, size, BLOCK_BYTES)
    blocks = work.table(_blocks(docs, folds, held), "blocks")
    words = work.table(_vocabulary(blocks, shards), "words")
    work.release()
    sums = words.where("block = -1").select(*[F.sum(F.col("totals")[i]).alias(f"t{i}") for i in range(4)]).first()
    total, known, ones, twos = (int(x or 0) for x in sums)
    asked = words.where("block >= 0").select("block", "shard", "counts", F.col("ids").alias("word_ids"))
    # As many partitions as blocks or shards, whatever the session's number is.
    rows = blocks.select("block", "ids", "held", "lengths", "codes").repartition(width, "block").groupBy("block")
    requests = rows.cogroup(asked.repartition(width, "block").groupBy("block")).applyInArrow(
        _ask(hot, ones, shards), "shard long, block long, u binary, w binary, train binary, context binary")
    counted = work.table(requests.repartition(shards, "shard").groupBy("shard").applyInArrow(_count, _COUNTED), "counted")
    del requests
    work.release()
    answers = work.table(_answered(work, counted, shards), "answers")
    work.drop("counted", "pairs", "sums")
    work.release()
    both = asked.withColumn("kind", F.lit(0)).unionByName(answers.select("block", "shard", F.col("a").alias("counts"), F.col("b").alias("word_ids"), F.lit(1).alias("kind")))
    return rows.cogroup(both.repartition(width, "block").groupBy("block")).applyInArrow(
        _score(hot, shards, total, known, ones, twos),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _answered(work: Workspace, counted: DataFrame, shards: int) -> DataFrame:
    """(block, shard, a, b): shards of whole contexts answer where they lie, those of split contexts with their pairs' sums."""
    split = counted.where(F.col("shard") >= shards)
    pairs = work.table(split.select("shard", "context", "w", "train").mapInArrow(_split_pairs, _PAIR), "pairs")
    sums = work.table(pairs.groupBy("v", "w").agg(F.sum("n").alias("c2")), "sums")
    one2, two2, one3, two3 = (int(x or 0) for x in counted.select(*[F.sum(F.col("numbers")[i]) for i in range(4)]).first())
    more = sums.agg(F.count_if(F.col("c2") == 1), F.count_if(F.col("c2") == 2)).first()
    discounts = discount(one2 + more[0], two2 + more[1]), discount(one3, two3)
    of_context = sums.where("c2 > 0").groupBy("v").agg(F.sum("c2").alias("total"), F.count("*").alias("kinds"))
    known = pairs.join(sums.join(of_context, "v"), ["v", "w"]).select("shard", "context", "w", "c2", "total", "kinds")
    whole = counted.where(F.col("shard") < shards).mapInArrow(_answer_whole(discounts), _ANSWER)
    parts = split.repartition(shards, "shard").groupBy("shard").cogroup(known.repartition(shards, "shard").groupBy("shard"))
    return whole.unionByName(parts.applyInArrow(_answer_split(discounts), _ANSWER))
