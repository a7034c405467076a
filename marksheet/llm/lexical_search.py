"""Operator 11: ranked lexical search over bags, each distinct bag scored once.

1. The query items' distinct terms are the vocabulary. Each document becomes its number of terms
   and its bag: the vocabulary terms it holds, with their counts.
2. Corpus figures: N documents with a term, L terms, both over all documents; from them each
   document's length figure ``m``. Documents with the same bag and the same ``m`` have the same
   score for every item. They form a class: keyed by a hash, told apart by the bag itself. A class
   keeps its ``K`` smallest ids, as a longer tail can be in no item's first ``K``.
3. Document frequencies are sums over the classes, as every member of a class holds its terms.
4. A class's scores for all items are one product of its term weights with the items' terms, in
   integers (sums stay below 2**53). Each task keeps ``K`` documents an item; classes are expanded
   to their members by ascending id there. A ranking per item merges the tasks.

Scale: the items are the stated query set, read in blocks of at most ``ITEM_BLOCK``; only a
block's vocabulary (term hashes, never texts) is shipped, one block at a time. Rows leave a task
as (id, bag) only; a class that holds a third of the documents sends ``K`` rows a task (the limit
is applied before the shuffle), and document frequencies and class sizes are partial sums.

Terms are told apart by 64-bit hashes. Defined results: null or empty text has no term and is in no
result; neither is a score of zero. Repeated rows are separate documents. A null id is last among
ties. Every row of the items is an item of its own; those without a term have no rows. Extra
columns are ignored. An empty table of either kind gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marksheet.llm.scratch import written
from marksheet.llm.textbatch import LOWER, find_words, hash_words, pieces

K = 10
ITEM_BLOCK = 1024
CLASS_CHUNK = 256
NO_ID = np.iinfo(np.int64).max
# Bytes that are no part of a term (ASCII but for digits and letters).
NO_TERM = np.zeros(256, bool)
NO_TERM[:128] = True
NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def text_terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes, first term of each row)."""
    low = LOWER[data]
    start, end, first = find_words(low, off, NO_TERM)
    return hash_words(low, start, end), first


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(block, item_id, terms): each item's distinct term hashes, in blocks of ITEM_BLOCK rows."""
    def run(batches):
        for batch, data, off in pieces(batches, "_text"):
            h, first = text_terms(data, off)
            own = [np.unique(h[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["item_id", "terms"])

    rows = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("_text")).where("_text is not null")
    table = written(rows.mapInArrow(run, "item_id long, terms binary").where(F.length("terms") > 0), "items")
    return written(table.select(F.floor(F.monotonically_increasing_id() / ITEM_BLOCK).alias("block"), "item_id", "terms"), "item-blocks")


class Items:
    """A block of the query set: its vocabulary, and which items hold which term."""

    def __init__(self, rows):
        terms = [np.frombuffer(r["terms"], np.uint64) for r in rows]
        self.ids = [r["item_id"] for r in rows]
        self.vocabulary, term = np.unique(np.concatenate(terms), return_inverse=True)
        self.holds = np.zeros((len(self.vocabulary), len(rows)), bool)
        self.holds[term, np.repeat(np.arange(len(rows)), [len(t) for t in terms])] = True


def bags(docs: DataFrame, vocabulary: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, bag): all terms of each row counted; ``bag`` has the vocabulary's, as pairs of
    (place in the vocabulary, count), empty if it holds none."""
    def run(batches):
        for batch, data, off in pieces(batches, "_text", 1 << 20):
            h, first = text_terms(data, off)
            rows = len(off) - 1
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            known = np.flatnonzero(vocabulary[at] == h)
            row = np.repeat(np.arange(rows), np.diff(first))[known]
            pair, count = np.unique(row * len(vocabulary) + at[known], return_counts=True)
            flat = np.column_stack([pair % len(vocabulary), count]).astype(np.uint32)
            cut = np.searchsorted(pair, np.arange(rows + 1) * len(vocabulary))
            own = [flat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(own, pa.binary())], names=["doc_id", "n", "bag"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, n long, bag binary")


def bag_classes(table: DataFrame, n_docs: int, n_terms: int, k: int = K) -> DataFrame:
    """(m, bag, members, size): one row per distinct (bag, m), its ``k`` smallest ids in order."""
    m = F.expr(f"100 - 90 + ((90 * n * {n_docs}L) div {max(1, n_terms)}L)")
    rows = table.where(F.length("bag") > 0).select("doc_id", m.alias("m"), "bag", F.xxhash64("bag", m).alias("tag"))
    same = ["tag", "m", "bag"]
    sizes = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("size"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last()))).where(F.col("place") <= k)
    ids = first.groupBy(*same).agg(F.array_sort(F.collect_list(F.coalesce("doc_id", F.lit(int(NO_ID))))).alias("members"))
    return ids.join(sizes, same).select("m", "bag", "members", "size")


def document_frequencies(classes: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each vocabulary term."""
    def run(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            size = batch.column(1).to_numpy()
            for bag, n in zip(batch.column(0), size):
                total[np.frombuffer(bag.as_py(), np.uint32)[::2]] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    counts = classes.select("bag", "size").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counts.collect():  # at most one row for each term of the block
        out[r["term"]] = r["df"]
    return out


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


class Best:
    """The first ``k`` documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)  # a score below it is out
        self.rows = [np.zeros((0, 2), np.int64) for _ in range(items)]

    def add(self, scores: np.ndarray, members: list[np.ndarray]) -> None:
        """``scores``: classes x items; ``members``: each class's first ids."""
        for i in np.flatnonzero((scores >= self.floor).any(axis=0)).tolist():
            hit = np.flatnonzero(scores[:, i] >= self.floor[i])
            if len(hit) > self.k:  # a class has a member at least: lower classes are out
                low = np.partition(scores[hit, i], len(hit) - self.k)[len(hit) - self.k]
                hit = hit[scores[hit, i] >= low]
            new = [np.column_stack([np.full(len(members[c]), scores[c, i]), members[c]]) for c in hit.tolist()]
            rows = np.concatenate([self.rows[i], *new])
            self.rows[i] = rows = rows[np.lexsort((rows[:, 1], -rows[:, 0]))[: self.k]]
            if len(rows) == self.k:
                self.floor[i] = rows[-1, 0]


def _score(items: Items, weight: np.ndarray, k: int):
    """Task function: (item, doc_id, score), the first k of each item in the task."""
    def run(batches):
        best = Best(len(items.ids), k)
        holds = items.holds
        for batch in batches:
            for a in range(0, batch.num_rows, CLASS_CHUNK):
                part = batch.slice(a, CLASS_CHUNK)
                own = [np.frombuffer(x.as_py(), np.uint32).reshape(-1, 2).astype(np.int64) for x in part.column(1)]
                row = np.repeat(np.arange(len(own)), [len(x) for x in own])
                pairs = np.concatenate(own)
                m = part.column(0).to_numpy()[row]
                value = weight[pairs[:, 0]] * ((1_000_000_000 * pairs[:, 1]) // (1000 * pairs[:, 1] + 8 * m))
                used, col = np.unique(pairs[:, 0], return_inverse=True)
                table = np.zeros((len(own), len(used)))  # whole numbers; their sums stay below 2**53
                table[row, col] = value
                scores = (table @ holds[used].astype(np.float64)).astype(np.int64)
                best.add(scores, [x.values.to_numpy() for x in part.column(2)])
        out = np.concatenate([np.column_stack([np.full(len(r), i), r]) for i, r in enumerate(best.rows)])
        ids = pa.array(items.ids, pa.int64()).take(pa.array(out[:, 0]))
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), ids, pa.array(out[:, 1]), pa.array(out[:, 2], mask=out[:, 2] == NO_ID)], names=["item", "item_id", "score", "doc_id"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents."""
    spark = docs.sparkSession
    table = item_terms(items, item, item_text)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for (number,) in table.select("block").distinct().orderBy("block").collect():  # one row for ITEM_BLOCK items
        block = Items(table.where(F.col("block") == number).select("item_id", "terms").collect())
        own = written(bags(docs, block.vocabulary, key, text), "bags")
        n_docs, n_terms = own.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        classes = written(bag_classes(own, n_docs, n_terms, k), "bag-classes")
        weight = term_weights(document_frequencies(classes, len(block.vocabulary)), n_docs)
        found = classes.select("m", "bag", "members").mapInArrow(_score(block, weight, k), "item long, item_id long, score long, doc_id long")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = out.unionByName(written(best.select("item_id", "rank", "doc_id", "score"), "ranked"))
    return out


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    d = sf_dir.rstrip("/")
    return search(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH terms AS (SELECT row_number() OVER () AS no, doc_id, {_TERMS.format('text')} AS t FROM documents WHERE text IS NOT NULL),
docs AS (SELECT no, doc_id, t, len(t) AS n FROM terms WHERE len(t) > 0),
corpus AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM docs),
items AS (SELECT DISTINCT no, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS no, item_id, {_TERMS.format('text')} AS t FROM benchmark WHERE text IS NOT NULL)),
tf AS (SELECT no, term, count(*) AS tf FROM (SELECT no, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY no, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus),
m AS (SELECT no, doc_id, 100 - 90 + ((90 * n * nd) // l) AS m FROM docs, corpus),
scored AS (
  SELECT i.no AS item, i.item_id, m.no, m.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
  FROM items i JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.no = tf.no GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) <= {K}
"""
