"""Operator 12: near-duplicates by b-bit MinHash.

Set of a text: the 64-bit hashes of its distinct ``SHINGLE_WORDS``-word shingles. Texts of equal
sets are one class from the start. A class has ``MINIMA`` minima:
1. *Bands*: ``BANDS`` groups of ``ROWS`` minima are the keys of buckets. Two sets at the threshold
   (0.85) share no bucket with a chance of (1 - 0.85^4)^32, about 6e-11.
2. *b-bit signature*: the low ``BITS`` bits of every minimum, packed. Two signatures agree at a
   place by chance once in 2^BITS, so from the share e of equal places the similarity is estimated
   as (e - 2^-BITS) / (1 - 2^-BITS): one XOR and a bit count per word. Pairs in a bucket whose
   estimate is ``MARGIN`` standard errors below the threshold, or whose sizes alone exclude it,
   are passed over. A bucket yields a forest over the pairs that are left; its components over all
   buckets are *clusters*, and every link lies inside one.
3. *Full sets*: a cluster's classes bring their whole sets together. Pairs are confirmed by the
   intersection of the sets, nearest by estimate first; pairs that confirmed links already join
   need no check. All others that pass the estimate are checked, so no link is lost.

Scale: no row is ever a candidate pair: buckets and clusters yield forests, at most one row a
member. A bucket of more than ``BLOCK`` classes, or a cluster of more than ``CLUSTER_BLOCK``, is cut
into blocks; each two blocks are one bounded piece of work. Full sets are only made for classes
in a cluster. Components come from star rounds on written tables. Nothing reaches the driver but
what tells that these are done.

Shingles and sets are told apart by 64-bit hashes. Defined results: null or empty text, or text
without a word: an empty set, linked with nothing (not even its like); such a row is its own
component. Fewer words than a shingle: the whole sequence is the one shingle. Repeated rows are
kept, one output row each. A null id names no component unless all its members are null; its row is
not kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marksheet.llm.near_duplicates import components
from marksheet.llm.scratch import written
from marksheet.llm.textbatch import LOWER, find_words, hash_words, inside, join_hash, mix, pieces, windows

SHINGLE_WORDS = 5
LEAST_PERCENT = 85  # 100 * intersection >= LEAST_PERCENT * union
BANDS, ROWS = 32, 4
MINIMA = 256
BITS = 2
MARGIN = 6.0
BLOCK, CLUSTER_BLOCK = 4096, 512
SEED = 12
_TAIL = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each row, one row after the other; where each row starts)."""
    low = LOWER[data]
    start, end, first = find_words(low, off)
    h = hash_words(low, start, end)
    every = windows(h, width)
    whole = inside(first, width, len(every))
    out, sizes = [np.zeros(0, np.uint64)], np.zeros(len(off) - 1, np.int64)
    for r in range(len(off) - 1):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= width:
            own = np.sort(every[a: b - width + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            x = h[a: a + 1]
            for w in range(a + 1, b):
                x = join_hash(x, h[w: w + 1])
            own = mix(x + _TAIL * np.uint64(b - a))
        else:
            continue
        out.append(own)
        sizes[r] = len(own)
    assert whole.sum() == np.maximum(np.diff(first) - width + 1, 0).sum()
    return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])


def minima_of(flat: np.ndarray, at: np.ndarray, count: int = MINIMA) -> np.ndarray:
    """(rows, count) uint32: minima of ``count`` linear hashes over each row's shingles; rows are not empty."""
    rng = np.random.default_rng(SEED)
    scale = rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, count, dtype=np.uint32)
    out = np.empty((count, len(at) - 1), np.uint32)
    x = (flat >> np.uint64(32)).astype(np.uint32)
    row = 0
    while row < len(at) - 1:  # runs of rows that stay in the processor's cache
        end = max(row + 1, int(np.searchsorted(at, at[row] + 16_384, "right")) - 1)
        part, begin = x[at[row]: at[end]], at[row:end] - at[row]
        for k in range(count):
            out[k, row:end] = np.minimum.reduceat(part * scale[k] + shift[k], begin)
        row = end
    return np.ascontiguousarray(out.T)


def signatures_of(minima: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(rows, words) uint64: the low bits of every mixed minimum, packed."""
    low = (mix(minima.astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    per = 8 // bits
    packed = np.zeros((len(low), low.shape[1] // per), np.uint8)
    for k in range(per):
        packed |= low[:, k::per] << np.uint8(bits * k)
    return packed.view(np.uint64)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """(rows, BANDS) uint64."""
    m = minima[:, : BANDS * ROWS].astype(np.uint64).reshape(len(minima), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), m.shape[:2])
    for k in range(ROWS):
        key = join_hash(key, m[:, :, k])
    return key


def set_name(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 3)


def text_signatures(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(doc_id, content, n, cls, sig, bands) for every row; a row without a word has n = 0."""
    def run(batches):
        for batch, data, off in pieces(batches, "_text", 1 << 20):
            flat, at = shingle_sets(data, off, width)
            n = np.diff(at)
            full = np.flatnonzero(n)
            minima = minima_of(flat, np.append(at[full], at[-1]))
            sig, bands = signatures_of(minima), band_keys(minima)
            name = np.array([set_name(flat[at[r]: at[r + 1]]) for r in full.tolist()], np.uint64)
            cls, has = np.zeros(len(n), np.uint64), n > 0
            cls[full] = name
            blobs = [[None] * len(n), [None] * len(n)]
            for i, r in enumerate(full.tolist()):
                blobs[0][r], blobs[1][r] = sig[i].tobytes(), bands[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(cls.view(np.int64), mask=~has), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())],
                names=["doc_id", "content", "n", "cls", "sig", "bands"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, content long, n long, cls long, sig binary, bands binary")


def paired_blocks(rows: DataFrame, group: str, sizes: DataFrame, block: int) -> DataFrame:
    """Rows of groups of two or more, with (low, high, side): a group of more than ``block`` rows is cut
    into blocks by ``cls``, and a row stands once for each two blocks that its own is one of."""
    rows = rows.join(sizes, group).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).drop("size", "blocks", "other")


def bucket_members(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, low, high, side, cls, n, sig): members of buckets of two classes or more."""
    def run(batches):
        for batch in batches:
            bands = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            cls = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(bands), pa.array(cls)], names=["key", "cls"])

    filed = classes.select("cls", "bands").mapInArrow(run, "key long, cls long")
    sizes = filed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = paired_blocks(filed, "key", sizes, block).join(classes.select("cls", "n", "sig"), "cls")
    return rows.select("key", "low", "high", "side", "cls", "n", "sig")


def most_differences(percent: int = LEAST_PERCENT, margin: float = MARGIN, minima: int = MINIMA, bits: int = BITS) -> int:
    """The most unequal places at which the similarity may still be ``percent``."""
    chance = 2.0 ** -bits
    p = 1 - (chance + (1 - chance) * percent / 100)
    return int(np.floor(minima * p + margin * np.sqrt(minima * p * (1 - p))))


def unequal_places(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Differing places of every signature of ``a`` with every one of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint16)
    last = np.uint64(sum(1 << k for k in range(0, 64, bits)))
    for w in range(a.shape[1]):
        x = a[:, w, None] ^ b[None, :, w]
        for _ in range(bits - 1):  # all bits of a place onto its last one
            x |= x >> np.uint64(1)
        out += np.bitwise_count(x & last)
    return out


def _groups(batches, keys: int):
    """Runs of rows with equal first ``keys`` columns, each as a list of columns (Arrow arrays); rows come sorted."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        cols = [batch.column(k).to_numpy() for k in range(keys)]
        first = [held[0].column(k)[0].as_py() for k in range(keys)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if len(held) > 1 and any(c[0] != f for c, f in zip(cols, first)):
            cut = np.concatenate([[0], cut])
        if not len(cut):
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        before = whole.num_rows - batch.num_rows
        at = np.concatenate([[0], cut + before])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in whole.slice(a, b - a).columns]
        held = [batch.slice(int(cut[-1]))]
    if held:
        yield [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in pa.Table.from_batches(held).combine_chunks().columns]


def _words(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(len(col), -1)


def _forest(n, sig, side, cross: bool, percent: int, most: int):
    """(i, j) pairs: a forest over the pairs that may be linked by estimate and size. With ``cross``
    only pairs of different blocks count (those of one block are met elsewhere)."""
    left = np.ones(len(n), bool)
    for root in range(len(n)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            v = todo.pop()
            rest = np.flatnonzero(left & (side != side[v])) if cross else np.flatnonzero(left)
            rest = rest[100 * np.minimum(n[rest], n[v]) >= percent * np.maximum(n[rest], n[v])]
            if len(rest):
                near = rest[unequal_places(sig[v: v + 1], sig[rest])[0] <= most]
                left[near] = False
                yield v, near
                todo.extend(near.tolist())


def candidate_forest(members: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """(a, b): pairs that may be linked; their components are those of all such pairs in a bucket."""
    most = most_differences(percent)
    rows = members.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches):
        for _, low, high, side, cls, n, sig in _groups(batches, 3):
            if len(cls) < 2:
                continue
            cls, n, side = cls.to_numpy(), n.to_numpy(), side.to_numpy()
            out = list(_forest(n, _words(sig), side, low[0].as_py() != high[0].as_py(), percent, most))
            if out:
                a, b = np.concatenate([np.full(len(near), cls[v]) for v, near in out]), np.concatenate([cls[near] for _, near in out])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Common entries of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _links(sets: list[np.ndarray], sig: np.ndarray, side: np.ndarray, cross: bool, percent: int, most: int):
    """(i, j) pairs: a forest over the links. Of each member the nearest unasked neighbours in other
    components are checked on the full sets, in rounds of twice as many, until none is left."""
    n = np.array([len(x) for x in sets])
    far = unequal_places(sig, sig)
    open_ = (far <= most) & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n))
    open_ &= (side[:, None] != side) if cross else ~np.eye(len(n), dtype=bool)
    label, count = np.arange(len(n)), 1
    while True:
        open_ &= label[:, None] != label  # joined pairs need no check
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            return
        near = np.where(open_[rows], far[rows], np.uint16(65535))
        near = near.argmin(axis=1)[:, None] if count == 1 else np.argpartition(near, min(count, len(n)) - 1, axis=1)[:, :count]
        i, j = np.repeat(rows, near.shape[1]), near.ravel()
        ok = open_[i, j]
        pairs = np.unique(np.column_stack([np.minimum(i, j), np.maximum(i, j)])[ok], axis=0)
        for i, j in pairs[np.argsort(far[pairs[:, 0], pairs[:, 1]], kind="stable")].tolist():
            open_[i, j] = open_[j, i] = False
            if label[i] == label[j]:
                continue
            both = intersection(sets[i], sets[j])
            if 100 * both >= percent * (n[i] + n[j] - both):
                label[label == label[j]] = label[i]
                yield i, j
        count = min(2 * count, len(n))


def confirmed_links(units: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """(a, b): links on full sets whose components are those of all links in a cluster."""
    most = most_differences(percent)
    rows = units.select("root", "low", "high", "side", "cls", "sig", "own").repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")

    def run(batches):
        for _, low, high, side, cls, sig, own in _groups(batches, 3):
            sets, cls = [np.frombuffer(x.as_py(), np.uint64) for x in own], cls.to_numpy()
            out = np.array(list(_links(sets, _words(sig), side.to_numpy(), low[0].as_py() != high[0].as_py(), percent, most)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(cls[out[:, 0]]), pa.array(cls[out[:, 1]])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, need: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(cls, root, sig, own): signature and whole set of each needed class, from the one row that
    stands for it."""
    def run(batches):
        for batch, data, off in pieces(batches, "_text", 1 << 20):
            flat, at = shingle_sets(data, off, width)
            sig = signatures_of(minima_of(flat, at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())],
                names=["cls", "root", "sig", "own"])

    rows = docs.select(F.col(key).cast("long").alias("_k"), F.xxhash64(text).alias("_c"), F.col(text).alias("_text"))
    rows = rows.join(need, F.col("_k").eqNullSafe(F.col("rep.k")) & (F.col("_c") == F.col("rep.c"))).dropDuplicates(["cls"]).select("cls", "root", "_text")
    return rows.mapInArrow(run, "cls long, root long, sig binary, own binary")


def near_duplicates(docs: DataFrame, percent: int = LEAST_PERCENT, width: int = SHINGLE_WORDS, key: str = "doc_id", text: str = "text",
                    block: int = BLOCK, cluster_block: int = CLUSTER_BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    sigs = written(text_signatures(docs, width, key, text), "minhash-signatures")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("k"), F.col("content").alias("c"))).alias("rep")
    classes = written(sigs.where("n > 0").groupBy("cls").agg(rep, F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    clusters = components(candidate_forest(bucket_members(classes, block), percent), "minhash-clusters")
    inside = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    need = classes.select("cls", "rep").join(inside, F.col("cls") == F.col("node")).select("cls", "rep", "root")
    sizes = inside.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    units = paired_blocks(written(full_sets(docs, need, width, key, text), "full-sets"), "root", sizes, cluster_block)
    named = components(confirmed_links(units, percent), "minhash-components")
    by_class = classes.select("cls", F.col("rep.k").alias("low")).join(named, F.col("cls") == F.col("node"), "left").select("cls", "low", F.coalesce("root", "cls").alias("root"))
    lows = by_class.groupBy("root").agg(F.min("low").alias("component_id"))
    found = by_class.join(lows, "root").select(F.col("cls").alias("_cls"), "component_id")
    out = sigs.select("doc_id", "n", "cls").join(found, F.col("cls") == F.col("_cls"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op12_minhash_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))


OP12_SQL = r"""
WITH RECURSIVE
words AS (SELECT row_number() OVER () AS no, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT no, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
named AS (SELECT no, doc_id, len(s) AS n, s, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), chr(10))) END AS cls FROM sets),
classes AS (SELECT cls, min(doc_id) AS low, any_value(n) AS n, any_value(s) AS s FROM named WHERE cls IS NOT NULL GROUP BY cls),
grams AS (SELECT cls, n, unnest(s) AS g FROM classes),
links AS (SELECT a.cls AS a, b.cls AS b FROM grams a JOIN grams b ON a.g = b.g AND a.cls <> b.cls
          GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT cls AS a, cls AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
lows AS (SELECT r.a AS cls, min(c.low) AS component_id FROM reach r JOIN classes c ON c.cls = r.b GROUP BY r.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id,
       coalesce(doc_id = CASE WHEN n > 0 THEN component_id ELSE doc_id END, false) AS kept
FROM named LEFT JOIN lows USING (cls)
"""
