"""Documents in packed blocks, and questions from blocks to a distributed table of counts.

Operators that need a corpus-wide count for every n-gram or window of a text would shuffle one
row per token. Here a task packs its documents into blocks of about ``BLOCK_BYTES`` text. A block
asks about its *distinct* hashes only, once each, as sorted and compressed arrays: one message
row per (block, hash range). The range's task adds the counts up and answers in the same order;
blocks and answers then meet again. The number of ranges follows from the size of the table, so a
range's task is bounded by ``RANGE_BYTES`` of packed questions. Distinct hashes spread evenly over ranges, so a frequent
word costs one entry a block, whatever its share of the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marksheet.llm.scratch import written
from marksheet.llm.textbatch import text_buffer

BLOCK_BYTES = 8 << 20
RANGE_BYTES = 8 << 20
BLOCK_SCHEMA = "ids binary, has_id binary, flags binary, offsets binary, texts binary"


def pack(a: np.ndarray) -> bytes:
    """Array to bytes: byte planes, then zstd (level 1)."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() if len(a) else b"", 1)


def unpack(raw: bytes, dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(dtype).ravel() if len(flat) else np.zeros(0, dtype)


def places(a: np.ndarray, kind: str | None = None) -> np.ndarray:
    """Of each entry, its place among the sorted distinct entries."""
    order = np.argsort(a, kind=kind)
    ranked = a[order]
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1])) if len(a) else 0
    return out


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def block_table(docs: DataFrame, key: str = "doc_id", text: str = "text", flag=None) -> DataFrame:
    """One row per block (``block`` long, then BLOCK_SCHEMA), written to the shared folder: all
    rows of ``docs`` in some order, null text as empty, ``flag`` (a boolean column) kept a row."""
    def run(batches):
        held, size = [], 0

        def block():
            cols = pa.Table.from_batches(held).combine_chunks()
            ids = cols.column(0).combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            data, off = text_buffer(pa.concat_arrays(cols.column(2).chunks))
            row = [pack(ids.fill_null(0).to_numpy()), pack(ids.is_valid().to_numpy(zero_copy_only=False)),
                   pack(cols.column(1).to_numpy()), pack(off), zstandard.compress(data.tobytes(), 3)]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["ids", "has_id", "flags", "offsets", "texts"])

        for batch in batches:
            a = 0
            off = text_buffer(batch.column(2))[1]
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(off, off[a] + BLOCK_BYTES - size, "right")) - 1)
                held.append(batch.slice(a, b - a))
                size += int(off[b] - off[a])
                a = b
                if size >= BLOCK_BYTES or a < batch.num_rows:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    rows = docs.select(F.col(key).cast("long").alias("id"), (F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))).alias("flag"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, BLOCK_SCHEMA).withColumn("block", F.monotonically_increasing_id()), "blocks")


class Block:
    """A block row, decoded."""

    def __init__(self, ids, has_id, flags, offsets, texts):
        self.ids, self.has_id = unpack(ids, np.int64), unpack(has_id, bool)
        self.flags, self.off = unpack(flags, bool), unpack(offsets, np.int64)
        self.data = np.frombuffer(zstandard.decompress(texts), np.uint8)

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, mask=~self.has_id)


def block_of(batch: pa.RecordBatch, i: int) -> Block:
    return Block(*[batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("ids", "has_id", "flags", "offsets", "texts")])


MESSAGE_SCHEMA = "kind int, span int, block long, hashes binary, counts binary"


def messages(kind: int, block: int, hashes: np.ndarray, counts: np.ndarray, spans: int) -> pa.RecordBatch:
    """One message per hash range from a block's distinct sorted ``hashes`` and their counts."""
    edges = np.array([(k << 64) // spans for k in range(1, spans)], dtype=np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])
    full = np.flatnonzero(np.diff(cuts))
    part = [(slice(cuts[k], cuts[k + 1])) for k in full]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(full), kind, np.int32)), pa.array(full.astype(np.int32)), pa.array(np.full(len(full), block, np.int64)),
         pa.array([pack_sorted(hashes[s]) for s in part], pa.binary()), pa.array([pack(counts[s].astype(np.uint32)) for s in part], pa.binary())],
        names=["kind", "span", "block", "hashes", "counts"])


def answers(msgs: DataFrame, shared_only: bool = False) -> DataFrame:
    """(kind, span, block, reply, total, distinct): the corpus-wide sum of each hash's counts, in
    the order of the question (``shared_only``: one byte that tells whether the sum exceeds one).
    ``total`` and ``distinct`` (hashes with a positive sum) stand on one row of each range."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(x) for x in frame["hashes"]]
        place = places(np.concatenate(keys), "stable")  # sorted runs: merged
        total = np.bincount(place, np.concatenate([unpack(c, np.uint32) for c in frame["counts"]])).astype(np.int64)  # below 2**53
        reply = (total > 1 if shared_only else total.astype(np.uint64))[place]
        reply = np.split(reply, np.cumsum([len(k) for k in keys])[:-1])
        n = np.zeros(len(frame), np.int64)
        d = n.copy()
        n[0], d[0] = total.sum(), (total > 0).sum()
        return pd.DataFrame({"kind": frame["kind"], "span": frame["span"], "block": frame["block"], "reply": [pack(x) for x in reply], "total": n, "distinct": d})

    return msgs.groupBy("kind", "span").applyInPandas(run, "kind int, span int, block long, reply binary, total long, distinct long")


def reply_array(frame: pd.DataFrame, kind: int, dtype) -> np.ndarray:
    """A block's answers of one kind, in hash order."""
    own = frame[frame["kind"] == kind].sort_values("span")
    return np.concatenate([np.zeros(0, dtype)] + [unpack(x, dtype) for x in own["reply"]])


def spans_of(table: DataFrame) -> int:
    """How many hash ranges the questions of a block table go to: about RANGE_BYTES asked in each,
    however large the table (a block asks for about three times its compressed text)."""
    return max(1, -(-3 * (table.agg(F.sum(F.length("texts"))).first()[0] or 0) // RANGE_BYTES))
