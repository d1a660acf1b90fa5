"""Token counts as delta-maintained rollups.

A ledger keeps, per batch, signed facts: a count that holds now (+1) or no
longer (-1) for a document under a tokenizer. A batch brings counts (new or
revised) and deletes; what the ledger held for those documents is retracted
and the new counts are asserted. Totals by source, language, tokenizer and
version are sums of the batches' small aggregated deltas, never a recount.

A commit is idempotent: facts are written first, the delta is derived from the
written facts, and the delta's completed folder is the commit mark. A batch
that was committed before is skipped; one that broke off is written anew.

Defined cases: a document is its doc_id (null is a key like any other); of
several counts for a document and tokenizer in one batch the one with the
highest version, then most tokens, then first source and language wins, so
repeated rows count once; a delete beats counts of the same batch; deletes of
unknown documents do nothing; null text has 0 tokens; empty batches commit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.shared import encoder_for, slices_of, word_count

FACTS = "doc_id long, source string, lang string, tokenizer string, version int, tokens long, sign int"
DELTA = "source string, lang string, tokenizer string, version int, docs long, tokens long"


def count_tokens(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """``docs`` (doc_id, source, lang, text) without text, with a long column per name in ``tokenizers`` (name: file)."""
    names = list(tokenizers)

    def run(batches):
        encoders = [encoder_for(tokenizers[n]) for n in names]
        for batch in batches:
            texts = batch.column("text")
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
            for a, b in slices_of(sizes, 4_000_000):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in part.schema.names if n != "text"), *(pa.array(e.counts(part.column("text")), pa.int64()) for e in encoders)],
                    [*(n for n in part.schema.names if n != "text"), *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kept}, " + ", ".join(f"`{n}` long" for n in names))


class TokenLedger:
    """Facts and deltas under one folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.root}/{kind}/batch={batch}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self) -> list[int]:
        """Numbers of the batches whose delta is complete (one name per batch, not per row)."""
        fs, top = self._fs(f"{self.root}/deltas")
        if not fs.exists(top):
            return []
        marks = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/deltas/batch=*/_SUCCESS"))
        return sorted(int(m.getPath().getParent().getName().split("=")[1]) for m in marks or [])

    def _read(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        paths = [self._path(kind, b) for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        """The counts that hold now: facts that were asserted more often than retracted."""
        facts = self._read("facts", FACTS, self.committed())
        keys = ["doc_id", "source", "lang", "tokenizer", "version", "tokens"]
        return facts.groupBy(*keys).agg(F.sum("sign").alias("net")).where("net > 0").select(*keys)

    def commit(self, batch: int, counts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Apply a batch once. counts: (doc_id, source, lang, tokenizer, version, tokens); deletes: (doc_id). False if it was committed before."""
        done = self.committed()
        if batch in done:
            return False
        fields = ["source", "lang", "tokenizer", "version", "tokens"]
        empty = self.spark.createDataFrame([], FACTS)
        counts = (counts if counts is not None else empty).select("doc_id", *fields)
        gone = (deletes if deletes is not None else empty).select("doc_id").distinct().withColumn("gone", F.lit(True))
        best = F.max_by(F.struct("source", "lang", "version", "tokens"), F.struct("version", "tokens", F.xxhash64("source", "lang"))).alias("best")
        fresh = counts.groupBy("doc_id", "tokenizer").agg(best)
        fresh = fresh.alias("c").join(gone.alias("g"), F.col("c.doc_id").eqNullSafe(F.col("g.doc_id")), "left_anti").select(
            "doc_id", "best.source", "best.lang", "tokenizer", "best.version", "best.tokens", F.lit(1).alias("sign"))
        if done:
            held = self.current().alias("h")
            revised = fresh.select("doc_id", "tokenizer").alias("r")
            out = held.join(revised, F.col("h.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("h.tokenizer") == F.col("r.tokenizer")), "left_semi")
            dropped = held.join(gone.alias("g"), F.col("h.doc_id").eqNullSafe(F.col("g.doc_id")), "left_semi")
            retracted = out.unionByName(dropped).withColumn("sign", F.lit(-1))
            fresh = fresh.unionByName(retracted)
        fresh.write.mode("overwrite").parquet(self._path("facts", batch))
        facts = self._read("facts", FACTS, [batch])
        delta = facts.groupBy("source", "lang", "tokenizer", "version").agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        delta.write.mode("overwrite").parquet(self._path("deltas", batch))
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, version, docs, tokens) over the committed deltas; groups without documents are left out."""
        rows = self._read("deltas", DELTA, self.committed())
        return rows.groupBy("source", "lang", "tokenizer", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")


def corpus_history(ledger: TokenLedger, work, docs: DataFrame, labels: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """Totals after three batches: all documents; deletes of rejected ones; recounts of words; the second batch sent twice.

    Words of version 1 are runs without white space; in version 2 only those
    with a letter or digit count.
    """
    plain = docs.select("doc_id", "source", "lang", "text")
    lettered = F.coalesce(F.regexp_count(F.regexp_replace("text", r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    plain = plain.withColumns({"_one": word_count("text"), "_two": lettered})
    counted = work.table(count_tokens(plain, tokenizers), "counts")
    row = lambda name, version, column: F.struct(F.lit(name).alias("tokenizer"), F.lit(version).alias("version"), F.col(column).alias("tokens"))
    keys = ["doc_id", "source", "lang"]
    first = counted.select(*keys, F.explode(F.array(row("words", 1, "_one"), *[row(n, 1, n) for n in tokenizers])).alias("c")).select(*keys, "c.*")
    second = counted.select(*keys, row("words", 2, "_two").alias("c")).select(*keys, "c.*")
    rejected = labels.where("quality = 0").select("doc_id")
    ledger.commit(1, first)
    ledger.commit(2, deletes=rejected)
    kept = second.join(rejected.distinct(), "doc_id", "left_anti")
    ledger.commit(3, kept)
    ledger.commit(2, deletes=rejected)
    return ledger.totals()
