"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text, per language.

The units are characters in 48 classes, so the model has a fixed largest size
(48^4 codes a language) whatever the corpus, while junk, tables and shouting
stand out by their marks. Training is a series of Spark aggregations and
joins, sharded by (language, context): counts, continuation counts of the
lower orders, discounts from counts of counts, context weights, and each
order's probabilities joined with the next lower order's. A language's
probabilities become one table of 8-bit codes.

Scoring brings the codes to the texts: up to ``SHARED_BYTES`` of them, measured
before, are broadcast, and documents are scored where they are read, so no text
is exchanged. Beyond that, documents of a language go into compressed blocks,
and groups of blocks meet their language's codes by a join on (language, salt);
no number of languages is too large, and both ways give the same scores. The
pooled model judges languages without a training row, and documents without a
language. Letters outside ASCII share 12 classes, by code point modulo 12, so
other scripts are told apart less well than marks and shapes are.

Trusted rows are labelled quality 1 and toxic 0. A sample of each language's
trusted rows, about ``TRAIN`` at most, is for training; every language with two
trusted rows has one in it and one outside. All trusted rows outside the sample
make the thresholds. A document is kept if its log perplexity is at most its
language's ``QUANTILE``, whose distance from the language's median is shrunk
towards the pool's as if ``SHRINK`` rows had that one; the pool's is shrunk
towards ``SPREAD`` times the distance from its median to its ``BULK`` quantile.
A language without such rows takes the pool's median and threshold.

Defined cases: null and empty texts have no perplexity and are not kept; very
short texts are judged with ``PRIOR`` further characters at the median, so one
odd character doesn't reject them; repeated rows are judged alike; without
labels everything with text is kept; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lintlake.llm.shared import Workspace, slices_of

ORDER, TRAIN = 4, 10_000
QUANTILE, BULK, SPREAD, SHRINK, PRIOR = 0.995, 0.95, 4.0, 1_000, 40
#: Bytes of text in a block, and blocks that meet a language's codes in one group.
BLOCK_BYTES, GROUP = 1_000_000, 8
#: Bytes of compressed codes that may be broadcast, and languages a task keeps open.
SHARED_BYTES, OPEN = 64_000_000, 12
#: Training ids that may be broadcast.
SHARED_IDS = 1_000_000
#: The pooled model's name; no language has it.
POOL = "*"
#: Natural logarithms in an 8-bit code's step.
STEP = 1 / 16

SYMBOLS = 48
_CLASS = np.full(128, 35, np.int64)  # other marks and control characters
_CLASS[ord("a") : ord("z") + 1] = np.arange(26)
_CLASS[ord("A") : ord("Z") + 1] = 26
_CLASS[ord("0") : ord("9") + 1] = 27
for _i, _marks in enumerate((" \t", "\n\r", ".", ",", "!?;:", "\"'`()-", "|")):
    _CLASS[[ord(c) for c in _marks]] = 28 + _i


def symbols(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(classes of all characters, each text after ORDER - 1 line breaks; characters of each text)."""
    lengths = np.array([len(t or "") for t in texts], np.int64)
    lead = "\n" * (ORDER - 1)
    points = np.frombuffer("".join(lead + (t or "") for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], 36 + points % 12), lengths


def codes_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(code of every character with the three before it, characters of each text)."""
    s, lengths = symbols(texts)
    code = s[: len(s) - ORDER + 1].copy()
    for j in range(1, ORDER):
        code = code * SYMBOLS + s[j : len(s) - ORDER + 1 + j]
    places = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    inside = np.zeros(len(s) + 1, np.int64)
    np.add.at(inside, places, 1)
    np.add.at(inside, places + lengths, -1)
    return code[np.cumsum(inside)[: len(code)] > 0], lengths


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, code, n) of trusted rows (lang, text), for the languages and for the pool; summed per task first."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                mine = [t for l, t in zip(langs, texts) if l == lang]
                for a, b in slices_of(np.array([len(t or "") for t in mine]), 1_000_000):
                    n = np.bincount(codes_of(mine[a:b])[0], minlength=SYMBOLS**ORDER).astype(np.int32)
                    for name in {lang, POOL}:
                        if name in totals:
                            totals[name] += n
                        else:
                            totals[name] = n.copy()
                if len(totals) > 4:  # many languages: send what is there, so memory stays bounded
                    yield from _sent(totals)
        yield from _sent(totals)

    return docs.select("lang", "text").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _sent(totals):
    for lang, n in totals.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at].astype(np.int64))], ["lang", "code", "n"])
    totals.clear()


def kneser_ney(work: Workspace, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, size, code, p, back): interpolated probabilities per order, and the weight that the code's context leaves to the next lower order.

    Lower orders count the distinct characters before a gram. Every step is an
    aggregation or a join on (lang, code) or (lang, context).
    """
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = counts[k + 1].groupBy("lang", (F.col("code") % SYMBOLS**k).alias("code")).agg(F.count("*").alias("n"))
    lower, made = None, None
    for k in range(1, order + 1):
        own = work.table(counts[k].withColumn("context", F.floor(F.col("code") / SYMBOLS)), f"counts-{k}")
        of = own.groupBy("lang").agg(*[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        # Where a count of counts is missing the estimate fails, and the absolute discount stands in.
        d = lambda i: F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05)), F.lit(i - 0.05))).otherwise(F.lit(0.5))
        discounts = of.select("lang", d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3"))
        rows = own.join(discounts, "lang")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.withColumn("cut", cut)
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("spared"))
        rows = rows.join(contexts, ["lang", "context"])
        seen, back = (F.col("n") - F.col("cut")) / F.col("total"), F.col("spared") / F.col("total")
        if lower is None:
            rows = rows.select("lang", "code", (seen + back / SYMBOLS).alias("p"), back.alias("back"))
        else:
            below = lower.select("lang", F.col("code").alias("suffix"), F.col("p").alias("q"))
            rows = rows.withColumn("suffix", F.col("code") % SYMBOLS ** (k - 1)).join(below, ["lang", "suffix"]).select("lang", "code", (seen + back * F.col("q")).alias("p"), back.alias("back"))
        lower = work.table(rows.withColumn("size", F.lit(k)), f"order-{k}")
        made = lower if made is None else made.unionByName(lower)
    return made


def _coded(table: pa.Table) -> pa.Table:
    """A language's model as one array of 8-bit codes of -log p, for every code of the full order."""
    size, code, p, back = (table.column(c).to_numpy() for c in ("size", "code", "p", "back"))
    full = np.full(1, 1.0 / SYMBOLS, np.float32)
    for k in range(1, ORDER + 1):
        mine = size == k
        # Unseen grams get the lower order's probability times their context's weight; unseen contexts all of it.
        weight = np.ones(SYMBOLS ** (k - 1), np.float32)
        weight[code[mine] // SYMBOLS] = back[mine]
        if k == 1:
            full = np.full(SYMBOLS, weight[0] / SYMBOLS, np.float32)
        else:
            full = np.tile(full, SYMBOLS)
            full *= np.repeat(weight, SYMBOLS)
        full[code[mine]] = p[mine]
    codes = np.clip(np.rint(-np.log(full) / STEP), 0, 255).astype(np.uint8)
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()]), "codes": pa.array([pa.compress(codes.tobytes(), codec="zstd", asbytes=True)], pa.binary())})


class QualityModel:
    """Codes by language; languages that have none take the pool's."""

    def __init__(self, shards: dict[str, bytes]):
        self.shards = shards
        self._open: dict[str, np.ndarray] = {}

    def table(self, lang) -> np.ndarray:
        name = lang if lang in self.shards else POOL
        if name not in self._open:
            if len(self._open) >= OPEN:
                self._open.pop(next(x for x in self._open if x != POOL))
            self._open[name] = np.frombuffer(pa.decompress(self.shards[name], SYMBOLS**ORDER, codec="zstd", asbytes=True), np.uint8)
        return self._open[name]

    def surprise(self, langs: list, texts: list) -> tuple[list[np.ndarray], np.ndarray]:
        """(sums of -log p of texts under each language's model, characters)."""
        codes, lengths = codes_of(texts)
        ends = np.cumsum(lengths)
        out = []
        for lang in langs:
            sums = np.concatenate([[0], np.cumsum(self.table(lang)[codes], dtype=np.int64)])
            out.append((sums[ends] - sums[ends - lengths]) * STEP)
        return out, lengths


def _blocks(docs: DataFrame) -> DataFrame:
    """(lang, id, rows): rows of a language as compressed Arrow data; ``docs`` has lang and text."""

    def packed(rows: list[pa.RecordBatch]) -> bytes:
        table = pa.Table.from_batches(rows).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    def run(batches):
        held: dict[str | None, list] = {}
        sizes: dict[str | None, int] = {}
        part, number, total = TaskContext.get().partitionId(), 0, 0

        def sent(lang):
            nonlocal number, total
            number, total = number + 1, total - sizes.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([part * 2**32 + number], pa.int64()), pa.array([packed(held.pop(lang))], pa.binary())], ["lang", "id", "rows"])

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            bytes_of = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0))
            for lang in set(langs):
                mine = np.flatnonzero([x == lang for x in langs])
                for a, b in slices_of(bytes_of[mine], BLOCK_BYTES):
                    size = int(bytes_of[mine[a:b]].sum())
                    held.setdefault(lang, []).append(batch.take(pa.array(mine[a:b])))
                    sizes[lang], total = sizes.get(lang, 0) + size, total + size
                    if sizes[lang] >= BLOCK_BYTES:
                        yield sent(lang)
            while total > 16 * BLOCK_BYTES:  # many languages: the largest goes
                yield sent(max(sizes, key=sizes.get))
        for lang in list(held):
            yield sent(lang)

    return docs.mapInArrow(run, "lang string, id long, rows binary")


def measure(work: Workspace, docs: DataFrame, shards: DataFrame | None, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """``docs`` (with lang and text) and own_sum, pool_sum (of -log p) and n_symbols, by the codes in ``shards`` (lang, codes)."""
    if shards is None or (shards.agg(F.sum(F.octet_length("codes"))).first()[0] or 0) <= shared_bytes:
        return _measured_in_place(docs, shards)
    return _measured_in_blocks(work, docs, shards)


def _measured_in_place(docs: DataFrame, shards: DataFrame | None) -> DataFrame:
    """A narrow pass over ``docs`` with all codes broadcast; their size is checked before."""
    held = {r.lang: bytes(r.codes) for r in shards.collect()} if shards is not None else {}
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        model = QualityModel(shared.value)
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            sums, count = np.zeros((2, len(texts))), np.array([len(x or "") for x in texts], np.int64)
            rows: dict = {}
            for i, lang in enumerate(langs):
                rows.setdefault(lang, []).append(i)
            for lang, mine in rows.items() if model.shards else ():
                names = [lang, POOL] if lang in model.shards else [POOL]
                for a, b in slices_of(count[mine], 500_000):
                    some = mine[a:b]
                    found, _ = model.surprise(names, [texts[i] for i in some])
                    sums[0, some], sums[1, some] = found[0], found[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums[0]), pa.array(sums[1]), pa.array(count)], [*batch.schema.names, "own_sum", "pool_sum", "n_symbols"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, own_sum double, pool_sum double, n_symbols long")


def _measured_in_blocks(work: Workspace, docs: DataFrame, shards: DataFrame) -> DataFrame:
    """The same by a join of compressed blocks of documents with their language's codes."""
    spark = docs.sparkSession
    blocks = work.table(_blocks(docs), "blocks")
    sizes = blocks.groupBy("lang").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("salts"))
    # Languages of several groups only: their number is bounded by that of the groups.
    large = sizes.where("salts > 1 and lang is not null").withColumnRenamed("lang", "l")
    alone = blocks.where("lang is null").withColumn("salt", F.col("id"))
    dealt = blocks.join(large, F.col("lang") == F.col("l"), "left").where("lang is not null").withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("id"), "salts")).otherwise(F.lit(0).cast("long")))
    dealt = dealt.select("lang", "salt", "rows").unionByName(alone.select("lang", "salt", "rows"))
    pool = shards.where(F.col("lang") == POOL).first()  # one row of 48^4 bytes at most
    shared = spark.sparkContext.broadcast(bytes(pool.codes) if pool else None)
    if pool:
        of = shards.where(F.col("lang") != POOL).join(sizes, "lang")
        given = of.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "codes")
    else:
        given = spark.createDataFrame([], "lang string, salt long, codes binary")
    made = pa.schema([("own_sum", pa.float64()), ("pool_sum", pa.float64()), ("n_symbols", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lang = left.column("lang")[0].as_py() if left.num_rows else None
        own = right.column("codes").to_pylist()
        model = QualityModel(({POOL: shared.value} if shared.value else {}) | ({lang: own[0]} if own else {}))
        parts = []
        for data in left.column("rows").to_pylist():
            table = pa.ipc.open_stream(data).read_all()
            texts = table.column("text").to_pylist()
            sums, count = np.zeros((2, len(texts))), np.array([len(x or "") for x in texts], np.int64)
            if model.shards:
                for a, b in slices_of(count, 500_000):
                    found, count[a:b] = model.surprise([lang, POOL] if own else [POOL], texts[a:b])
                    sums[0, a:b], sums[1, a:b] = found[0], found[-1]
            for name, values in zip(made.names, (*sums, count)):
                table = table.append_column(name, pa.array(values))
            parts.append(table)
        return pa.concat_tables(parts) if parts else empty

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    empty = pa.schema([*to_arrow_schema(docs.schema), *made]).empty_table()
    return dealt.groupBy("lang", "salt").cogroup(given.groupBy("lang", "salt")).applyInArrow(run, f"{kept}, own_sum double, pool_sum double, n_symbols long")


def trusted_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash) of trusted documents, and (lang, cut, lo, hi): see ``sampled``."""
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    bad = labels.where("quality = 0 or toxic = 1").select("doc_id").distinct()
    trusted = trusted.join(bad, "doc_id", "left_anti").withColumn("hash", F.xxhash64("doc_id"))
    known = docs.select("doc_id", "lang").join(trusted, "doc_id")
    cuts = known.groupBy("lang").agg(F.least(F.lit(2 / 3), train_rows / F.count("*")).alias("cut"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
    return trusted, cuts


def sampled() -> F.Column:
    """Whether a trusted row (hash, cut, lo, hi) is for training."""
    share = F.pmod(F.shiftright("hash", 7), F.lit(1 << 31)) / F.lit(float(1 << 31))
    return ((share < F.col("cut")) | (F.col("hash") == F.col("lo"))) & (F.col("hash") != F.col("hi"))


def train(work: Workspace, docs: DataFrame, trusted: DataFrame, cuts: DataFrame) -> DataFrame | None:
    """(lang, codes) of every language in the training sample and of the pool; None without one."""
    # The ids of the sample come first, so that texts stay where they are as long as the ids may be broadcast.
    named = docs.select("doc_id", "lang").join(trusted, "doc_id").join(cuts.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")))
    ids = work.table(named.where(sampled()).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct(), "sample")
    ids = F.broadcast(ids) if ids.count() <= SHARED_IDS else ids
    learn = docs.select("doc_id", "lang", "text").join(ids, (F.col("doc_id") == F.col("_id")) & F.col("lang").eqNullSafe(F.col("_lang")))
    learn = learn.select(F.coalesce("lang", F.lit(POOL)).alias("lang"), "text")
    grams = work.table(count_grams(learn), "grams")
    if not grams.limit(1).count():
        return None
    shards = work.table(kneser_ney(work, grams).groupBy("lang").applyInArrow(_coded, "lang string, codes binary"), "shards")
    work.drop("grams", *[f"counts-{k}" for k in range(1, ORDER + 1)], *[f"order-{k}" for k in range(1, ORDER + 1)])
    work.release()
    return shards


def thresholds(work: Workspace, measured: DataFrame, trusted: DataFrame, cuts: DataFrame, quantile: float = QUANTILE, shrink: float = SHRINK) -> tuple[DataFrame, tuple[float, float]]:
    """(l, mid, high): median and threshold of log perplexity of each language, from all its trusted rows outside the training sample; and the pool's."""
    held = measured.where("n_symbols > 0").select("doc_id", "lang", "own_sum", "pool_sum", "n_symbols").join(trusted, "doc_id")
    held = held.join(cuts.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l"))).where(~sampled())
    # Exact quantiles from a histogram in thousandths: its rows are bounded by the codes, not by the corpus.
    x = lambda c: F.round(F.col(c) / F.col("n_symbols"), 3)
    both = F.array(F.struct(F.lit(False).alias("pool"), F.col("lang"), x("own_sum").alias("x")), F.struct(F.lit(True).alias("pool"), F.lit(None).cast("string").alias("lang"), x("pool_sum").alias("x")))
    bins = held.select(F.inline(both)).groupBy("pool", "lang", "x").agg(F.count("*").alias("n"))
    of = Window.partitionBy("pool", "lang")
    share = bins.withColumn("share", F.sum("n").over(of.orderBy("x")) / F.sum("n").over(of))
    at = lambda q: F.min(F.when(F.col("share") >= q, F.col("x")))
    found = work.table(share.groupBy("pool", "lang").agg(F.sum("n").alias("rows"), at(0.5).alias("mid"), at(BULK).alias("bulk"), at(quantile).alias("top")), "quantiles")
    pool = found.where("pool").first()
    if pool is None:
        return found.where("not pool").select(F.col("lang").alias("l"), "mid", F.lit(float("inf")).alias("high")), (0.0, float("inf"))
    shrunk = lambda rows, own, prior: (rows * own + shrink * prior) / (rows + shrink)
    spread = shrunk(pool.rows, pool.top - pool.mid, SPREAD * max(pool.bulk - pool.mid, 0.02))
    high = F.col("mid") + shrunk(F.col("rows"), F.col("top") - F.col("mid"), spread)
    return found.where("not pool").select(F.col("lang").alias("l"), "mid", high.alias("high")), (pool.mid, pool.mid + spread)


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN, quantile: float = QUANTILE, shared_bytes: int = SHARED_BYTES, whole: bool = True) -> DataFrame:
    """``docs`` with n_symbols, perplexity, threshold (a perplexity) and keep; docs must have doc_id, lang and text.

    Without ``whole`` only doc_id and lang of ``docs`` come along, from the table of the measured numbers.
    """
    work = Workspace(docs.sparkSession, "quality")
    trusted, cuts = trusted_rows(docs, labels, train_rows)
    trusted, cuts = work.table(trusted, "trusted"), work.table(cuts, "cuts")
    shards = train(work, docs, trusted, cuts)
    # Numbers are written, texts are not: rows that keep their columns are measured again on their way out.
    numbers = measure(work, docs.select("doc_id", "lang", "text"), shards, shared_bytes).drop("text")
    numbers = work.table(numbers, "numbers")
    work.release()
    limits, (mid, high) = thresholds(work, numbers, trusted, cuts, quantile)
    rows = measure(work, docs, shards, shared_bytes) if whole else numbers
    columns = docs.columns if whole else ["doc_id", "lang"]
    rows = rows.join(limits, F.col("lang").eqNullSafe(F.col("l")), "left").withColumns({"mid": F.coalesce("mid", F.lit(mid)), "high": F.coalesce("high", F.lit(high))})
    some = F.col("n_symbols") > 0
    judged = (F.col("own_sum") + PRIOR * F.col("mid")) / (F.col("n_symbols") + PRIOR)
    return rows.select(*columns, "n_symbols", F.when(some, F.exp(F.col("own_sum") / F.col("n_symbols"))).alias("perplexity"),
                       F.exp(F.least("high", F.lit(700.0))).alias("threshold"), (some & (judged <= F.col("high"))).alias("keep"))


def quality_digest(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs.select("doc_id", "lang", "text"), labels, whole=False, **options)


def trusted_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that are kept, with its columns."""
    # Columns may clash with those of the scores, so they travel under other names.
    own = {c: c if c in ("doc_id", "lang", "text") else f"_own_{c}" for c in docs.columns}
    kept = score(docs.select(*[F.col(c).alias(n) for c, n in own.items()]), labels, **options).where("keep")
    return kept.select(*[F.col(n).alias(c) for c, n in own.items()])
