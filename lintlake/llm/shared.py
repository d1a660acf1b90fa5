"""What the operators share: table access, tables in the shared folder, words, and a chunk-wise tokenizer."""

from __future__ import annotations

import gc
import os
import uuid
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.session import checkpoint_dir

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Tables that a job writes to cut its lineage.

    They lie in the folder that ``spark.checkpoint.dir`` names, which all
    executors reach, so a lost executor costs only the tasks it was running.
    A table is dropped as soon as no later step reads it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, frame: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
        """The rows of ``frame`` as a table, in files of ``rows_a_file`` rows at most if given."""
        frame.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def parts(self, rows: int, each: int = 20_000) -> int:
        """Files for so many rows: ``each`` rows a file, and four a core at least; a task and its file cost the same however few rows they hold."""
        return max(4 * self.spark.sparkContext.defaultParallelism, -(-rows // each))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark remove shuffle files of steps whose results are written; it does so when their plans are collected.

        The session holds the plan it ran last, so a query of one row takes its place first.
        """
        gc.collect()
        self.spark.range(1, numPartitions=1).collect()
        self.spark._jvm.System.gc()


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Python gets batches of this many rows in jobs that run inside; the session's own setting comes back after them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def whole_groups(batches, key: str):
    """Batches of rows sorted by ``key``, cut anew so that no group spans two of them."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))
        if last == 0 and (not held or held[-1].column(key)[-1].as_py() == keys[0]):
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
        if table.num_rows:
            yield table.combine_chunks()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def parts_for(spark: SparkSession, amount: float, each: float) -> int:
    """So many partitions that each holds about ``each`` of ``amount``, one per core at least."""
    return int(max(spark.sparkContext.defaultParallelism, -(-amount // each), 1))


def total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def word_count(text) -> F.Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the runs (start, length), one run after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])


def slices_of(sizes: np.ndarray, limit: int):
    """Ranges of rows whose sizes sum to ``limit`` or less; a larger row stands alone."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > limit:
            yield first, i
            first, held = i, 0
        held += int(n)
    if first < len(sizes):
        yield first, len(sizes)


#: Stands between chunks that are encoded together, and how many are.
MARK, GROUP = "\x01", 50


@lru_cache(maxsize=4)
def encoder_for(path: str) -> "ChunkEncoder":
    """One encoder per tokenizer and Python worker, kept for the worker's next tasks."""
    return ChunkEncoder(path)


class ChunkEncoder:
    """Token ids of whole texts by a tokenizer whose tokens never span white space.

    Texts are cut at ASCII white space, each distinct chunk of a batch is
    encoded once, and the ids are laid out again in text order. For a
    tokenizer that drops white space this equals encoding the whole text.
    The cache is emptied when it holds ``limit`` chunks.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of chunks, encoded many at a time with a mark between them; chunks that hold the mark go alone."""
        clean = self.mark is not None and not any(MARK in c for c in chunks)
        each = GROUP if clean else 1
        texts = [f" {MARK} ".join(chunks[i : i + each]) for i in range(0, len(chunks), each)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        if each == 1:
            return ids, sizes
        marks = np.flatnonzero(ids == self.mark)
        # A chunk ends at the mark after it, or with its text.
        ends = np.sort(np.concatenate([marks, np.cumsum(sizes) - 0.5]))
        before = np.searchsorted(marks, ends)  # marks left of each end
        upto = np.ceil(ends).astype(np.int64) - before
        return ids[ids != self.mark], np.diff(upto, prepend=0)

    def _learn(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 5_000):
            part = chunks[at : at + 5_000]
            ids, lengths = self._encoded(part)
            total, first = len(ids), len(self.known)
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while first + len(part) > len(self.starts):
                self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
            self.ids[self.used : self.used + total] = ids
            self.starts[first : first + len(part)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[first : first + len(part)] = lengths
            self.known.update(zip(part, range(first, first + len(part))))
            self.used += total

    def _chunks(self, texts):
        """(numbers of the chunks in text order, first place of each text)."""
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.limit:
            self._clear()
        numbers = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        if (new := np.flatnonzero(numbers < 0)).size:
            numbers[new] = np.arange(len(self.known), len(self.known) + new.size)
            self._learn([names[i] for i in new])
        codes = coded.indices.to_numpy(zero_copy_only=False)
        return (numbers[codes] if len(codes) else np.zeros(0, np.int64)), offsets

    def counts(self, texts) -> np.ndarray:
        """Tokens of each text; 0 for null."""
        numbers, offsets = self._chunks(texts)
        sums = np.concatenate([[0], np.cumsum(self.lengths[numbers])])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, places where each text's ids begin and the last end)."""
        numbers, offsets = self._chunks(texts)
        lengths = self.lengths[numbers]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[ragged(self.starts[numbers], lengths)], sums[offsets]
