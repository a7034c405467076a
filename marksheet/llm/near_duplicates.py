"""Operator 3: SimHash near-duplicates found by a pigeonring filter.

Fingerprint: 64-bit SimHash over word shingles (XXH64, seed 42). Links: at most ``MAX_BITS``
differing bits. Candidate search follows the pigeonring principle. The fingerprint is a ring of
four 16-bit segments; if two fingerprints differ in at most 3 bits, some segment starts a chain
whose first 1, 2, 3, 4 segments differ in at most 0, 1, 2, 3 bits (the floor of 3/4 bit each).
So each fingerprint is filed under the exact value of every pair of consecutive segments and
looked up under that value and its 16 one-bit changes in the second segment (the two-segment
chain); the longer chains are checked in the bucket, the full distance last. No link is lost.

Scale: equal fingerprints are one node, so groups of copies cost one row. Keys have 32 bits and
spread evenly. A bucket yields a forest of links (at most one link a member), never all pairs: a
large bucket is searched breadth first against its unvisited rest only, in bounded memory.
Components come from alternating large-star/small-star rounds on written tables, whose edges the
tasks contract first, a bounded block at a time. Nothing but a row of the emptiness test reaches the driver.

Defined results: null or empty text has fingerprint zero and links like any other; texts of
fewer words than a shingle are one shingle; repeated rows and rows with a null id are kept, one
output row each (a null id never names a component unless all its rows are null); extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marksheet.llm.scratch import written
from marksheet.llm.textbatch import LOWER, find_words, pieces

SHINGLE_WORDS = 3
MAX_BITS = 3
SEGMENTS, SEGMENT_BITS = 4, 16
FLIP = 0x8000000000000000  # signed order <-> unsigned order


def text_fingerprints(data: np.ndarray, off: np.ndarray, shingle: int) -> np.ndarray:
    """SimHash of each row: lower-cased A-Z, words joined by one space, repeats counted."""
    data = LOWER[data]
    start, end, first = find_words(data, off)
    docs = len(off) - 1
    counts = np.diff(first)
    # words separated by exactly one byte, so that a shingle is one slice of `flat`
    size = end - start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.full(int(at[-1]), 0x20, np.uint8)
    src = np.arange(int(size.sum())) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.zeros(0, np.int64)
    if len(size):
        flat[np.repeat(at[:-1], size) + src] = data[np.repeat(start, size) + src]
    shingles = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    s_first = np.concatenate([[0], np.cumsum(shingles)])
    row = np.repeat(np.arange(docs), shingles)
    a = first[:-1][row] + np.arange(len(row)) - s_first[row]
    b = np.minimum(a + shingle, first[1:][row]) - 1
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    lo, hi = at[a], at[b] + size[b] if len(b) else at[a]
    h = np.fromiter((digest(raw[x:y], 42) for x, y in zip(lo.tolist(), hi.tolist())), np.uint64, len(row))
    ones = np.zeros((docs, 64), np.int64)
    full = np.flatnonzero(shingles)
    for part in np.array_split(full, max(1, len(h) // 200_000 + 1)):
        if len(part):
            x0, x1 = s_first[part[0]], s_first[part[-1] + 1]
            bits = np.unpackbits(h[x0:x1].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[part] = np.add.reduceat(bits, s_first[part] - x0, axis=0, dtype=np.int32)
    bit = (2 * ones > shingles[:, None]).astype(np.uint8)
    return np.packbits(bit, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content, fp) for every row, all long; ``content`` is a hash of the text."""
    def run(batches):
        for batch, data, off in pieces(batches, "_text", 1 << 20):
            fp = text_fingerprints(data, off, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["_key", "content", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("_key"), F.xxhash64(text).alias("content"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "_key long, content long, fp long").withColumnRenamed("_key", key)


def _rings(fp: np.ndarray) -> np.ndarray:
    """The four rotations that bring segment i to the top (rows: rotations)."""
    return np.stack([fp] + [(fp << np.uint64(16 * i)) | (fp >> np.uint64(64 - 16 * i)) for i in range(1, SEGMENTS)])


def bucket_rows(fps: DataFrame) -> DataFrame:
    """(key, fp, filed): each fingerprint under its four two-segment keys, and looked up under
    the keys within one bit in the second segment."""
    flips = (np.uint64(1) << np.arange(32, 48, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i, ring in enumerate(_rings(fp)):
                top = ring >> np.uint64(32)
                tag = np.uint64(i) << np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array((top | tag).view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.ones(len(fp), bool))], names=["key", "fp", "filed"])
                near = ((ring[:, None] ^ flips[None, :]) >> np.uint64(32)).ravel() | tag
                yield pa.RecordBatch.from_arrays([pa.array(near.view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64)), pa.array(np.zeros(len(near), bool))], names=["key", "fp", "filed"])

    return fps.mapInArrow(run, "key long, fp long, filed boolean")


def _close(x: np.ndarray, ring: int, bits: int) -> np.ndarray:
    """Chain budgets (two, then three segments from the bucket's start), then the full distance."""
    r = np.uint64(16 * ring)
    x = ((x << r) | (x >> (np.uint64(64) - r))) if ring else x
    ok = np.bitwise_count(x >> np.uint64(32)) <= (2 * bits) // SEGMENTS
    idx = np.flatnonzero(ok)
    idx = idx[np.bitwise_count(x[idx] >> np.uint64(16)) <= (3 * bits) // SEGMENTS]
    return idx[np.bitwise_count(x[idx]) <= bits]


def _bucket_links(fp: np.ndarray, filed: np.ndarray, ring: int, bits: int):
    """A forest over the bucket's links. A link needs one filed end: unfiled members of one
    bucket meet each other in another bucket if they are close."""
    left = np.ones(len(fp), bool)
    for root in np.flatnonzero(filed):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            v = todo.pop()
            rest = np.flatnonzero(left if filed[v] else left & filed)
            if not len(rest):
                continue
            hit = rest[_close(fp[rest] ^ fp[v], ring, bits)]
            if len(hit):
                left[hit] = False
                yield np.full(len(hit), fp[v]), fp[hit]
                todo.extend(hit.tolist())


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between different fingerprints whose transitive closure equals that of all
    links at ``bits`` or fewer differing bits. ``fps`` holds distinct fingerprints."""
    width = 32

    def run(batches):
        held: list = []  # rows of the bucket that is still open

        def flush(key, fp, filed, last):
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            a = np.concatenate([[0], cut])
            b = np.concatenate([cut, [len(key)]])
            if not last:
                a, b = a[:-1], b[:-1]
            many = np.flatnonzero((b - a > 1) & (np.logical_or.reduceat(filed, a) if len(a) else False)) if len(a) else []
            out = []
            for g in many:
                s = slice(a[g], b[g])
                out.extend(_bucket_links(fp[s], filed[s], int(key[a[g]] >> width) & 3, bits))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            if held and held[-1][0][-1] == cols[0][0] == cols[0][-1]:
                held.append(cols)  # one bucket goes on over whole batches
                continue
            cols = [np.concatenate([h[k] for h in held] + [cols[k]]) for k in range(3)]
            yield from flush(*cols, last=False)
            tail = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [[c[tail:] for c in cols]]
        if held:
            yield from flush(*[np.concatenate([h[k] for h in held]) for k in range(3)], last=True)

    rows = bucket_rows(fps).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "a long, b long")


EDGE_BLOCK = 1 << 18  # edges that a task contracts at once


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): each node over these edges that is not the smallest of its component, with the smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[:len(u)], at[len(u):]
    up = np.arange(len(nodes))
    while True:
        a, b = up[u], up[v]
        if np.array_equal(a, b):
            break
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, up[up]):
            up = up[up]
    low = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[low], nodes[up[low]]


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: edges with the same components, of which those of a block in a task are stars."""
    def run(batches):
        def stars():
            u, v = local_roots(*[np.concatenate([h[k] for h in held]) for k in (0, 1)])
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held, rows = [], 0
        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in (0, 1)])
            rows += batch.num_rows
            if rows >= EDGE_BLOCK:
                yield stars()
                held, rows = [], 0
        if rows:
            yield stars()

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), by alternating large-star
    and small-star rounds. Before a round the tasks contract the edges they hold, so that few rounds are
    left; none is when every node has either larger neighbours only or one smaller one, its root.
    Nodes are compared as signed longs."""
    pairs = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v")
    nxt = written(_contracted(pairs), tag)
    while True:
        cur = written(_contracted(nxt), tag)
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lower = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < u")
        lower = written(lower.select(F.col("u").alias("node"), "low", "high"), tag)
        if lower.where("low <> high").isEmpty():
            return lower.select("node", F.col("low").alias("root"))
        large = cur.join(lower.select("node", "low"), F.col("v") == F.col("node"), "left").select("u", F.coalesce("low", "v").alias("v"))
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = written(small.unionByName(small_low.select("u", F.col("m").alias("v"))).distinct(), tag)


def near_duplicate_components(docs: DataFrame, shingle: int = SHINGLE_WORDS, bits: int = MAX_BITS,
                              key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content, fp, root, component_id) for every row; component_id is the smallest key
    reachable, root the component's own name (a fingerprint)."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError("the two-segment index is exact up to 3 differing bits")
    docs_fp = written(fingerprints(docs, shingle, key, text), "fingerprints")
    nodes = docs_fp.groupBy("fp").agg(F.min(key).alias("low"))
    roots = components(links(nodes.select("fp"), bits))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = written(named.join(lows, "root").select("fp", "root", "component_id"), "fp-components")
    return docs_fp.join(by_fp, "fp").select(key, "content", "fp", "root", "component_id")


def keep_one_per_group(docs: DataFrame, shingle: int = SHINGLE_WORDS, bits: int = MAX_BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, all columns kept: the one with the smallest key (then the
    smallest text hash; a null key comes last). Of repeated rows one stays."""
    names = near_duplicate_components(docs, shingle, bits, key, text)
    first = F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("content").alias("c"))).alias("f")
    keep = names.groupBy("root").agg(first).select(F.col("f.k").alias("_k"), F.col("f.c").alias("_c"))
    kept = docs.withColumn("_content", F.xxhash64(text)).join(keep, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_content") == F.col("_c")), "left_semi")
    return kept.dropDuplicates([key, "_content"]).drop("_content")


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    out = near_duplicate_components(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
