"""Cost-balanced packing of documents into training sequences.

A piece of ``n`` tokens costs ``linear * n + quadratic * n * n``: projections
and attention within the piece. Documents are dealt to shards of bounded size
by hash; per shard, documents go in descending order of cost, each to the
cheapest sequence with room for it. What fits nowhere whole is cut at the room
that the cheapest open sequence has, so all sequences of a shard but the last
tokens' room are filled.

Defined cases: null or empty text is the end token alone; a document longer
than a sequence fills whole sequences first; repeated rows are packed each by
itself; ties go by document id, then length; an empty table gives no pieces;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.shared import encoder_for, slices_of, total_bytes

LENGTH = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Bytes of text per shard; about 1.3 million tokens.
SHARD_BYTES = 4_000_000
PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(shard, doc_id, ids) with ids as little-endian unsigned 32-bit integers; ``docs`` has shard, doc_id, text."""

    def run(batches):
        encoder = encoder_for(tokenizer_path)
        for batch in batches:
            texts = batch.column("text")
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
            for a, b in slices_of(sizes, 4_000_000):
                ids, at = encoder.encode(texts.slice(a, b - a))
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                places = (at + np.arange(len(at))) * 4
                # Offsets of one part stay below 2^31 unless a single text has over 500 million tokens.
                made = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(places.astype("<i8")), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(a, b - a), batch.column("doc_id").slice(a, b - a), made.cast(pa.binary())], ["shard", "doc_id", "ids"])

    return docs.select("shard", "doc_id", "text").mapInArrow(run, "shard long, doc_id long, ids binary")


def place_pieces(lengths: np.ndarray, order_ids: list, limit: int, linear: float, quadratic: float):
    """(document, start, length, sequence, offset) arrays for one shard.

    ``lengths`` are tokens of each document; ``order_ids`` breaks ties.
    """
    total = int(lengths.sum())
    count = -(-total // limit)
    room, cost = np.full(count, limit, np.int64), np.zeros(count)
    weight = lambda n: linear * n + quadratic * n * n
    out: list[tuple[int, int, int, int, int]] = []
    fresh = 0

    def put(doc, start, n, seq):
        out.append((doc, start, n, seq, int(limit - room[seq])))
        room[seq] -= n
        cost[seq] += weight(n)

    rest: list[tuple[int, int, int]] = []
    for doc in range(len(lengths)):
        start, n = 0, int(lengths[doc])
        while n >= limit:
            put(doc, start, limit, fresh)
            fresh, start, n = fresh + 1, start + limit, n - limit
        if n:
            rest.append((doc, start, n))
    rest.sort(key=lambda x: (-x[2], order_ids[x[0]], x[0]))
    for doc, start, n in rest:
        while n:
            fits = np.flatnonzero(room >= n)
            if fits.size:
                put(doc, start, n, int(fits[np.argmin(cost[fits])]))
                break
            open_ = np.flatnonzero(room > 0)
            # No sequence takes it whole: fill the roomiest, which leaves the fewest cuts.
            seq = int(open_[np.lexsort((cost[open_], -room[open_]))[0]])
            take = int(room[seq])
            put(doc, start, take, seq)
            start, n = start + take, n - take
    return out


def _pack_shard(limit: int, linear: float, quadratic: float, with_ids: bool):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        doc_ids = table.column("doc_id").to_pylist()
        rows = sorted(zip(((x is None, x or 0) for x in doc_ids), table.column("ids").to_pylist(), doc_ids), key=lambda r: (r[0], len(r[1]), r[1]))
        ids = [np.frombuffer(r[1], "<u4") for r in rows]
        pieces = place_pieces(np.array([len(x) for x in ids], np.int64), [r[0] for r in rows], limit, linear, quadratic)
        raw = [ids[d][s : s + n].tobytes() for d, s, n, _, _ in pieces]
        columns = [
            [rows[p[0]][2] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], [zlib.crc32(x) for x in raw], [len(ids[p[0]]) for p in pieces],
            [shard * 2**32 + p[3] for p in pieces], [p[4] for p in pieces], raw if with_ids else [None] * len(raw),
        ]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)

    return run


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC,
         end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids); ids null unless asked for."""
    rows = docs.select("doc_id", "text")
    shards = max(1, -(-total_bytes(rows) // shard_bytes))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    packed = tokenized(rows, tokenizer_path, end_id).groupBy("shard").applyInArrow(
        _pack_shard(limit, linear, quadratic, with_ids),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return packed


def packed_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return pack(docs, tokenizer_path, with_ids=False).drop("ids")
