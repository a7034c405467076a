"""Operator 13: hard negatives of every anchor, by the threshold algorithm of Fagin.

Vectors become integer vectors. Rows are packed into blocks; a block holds, for each dimension,
its rows sorted by that component. A search of one anchor in one block goes down all lists at
once (*sorted access*), from the top where the anchor's component is positive and from the bottom
where it is negative; lists of a zero component are left out. Rows met for the first time are
scored by their integer inner product (*random access*). The threshold is the inner product of
the anchor with the components last met, so no row still unmet can score above it. The search
stops once the threshold falls strictly below the k-th score of every window (rows that tie with
the k-th are then all met), or below the window's lowest score.

1. Positives: one window without bounds, rows of the anchor's label, the first ``POSITIVES``.
2. Negatives: one window for each positive, rows of other labels whose score lies in
   ``[LOW %, HIGH %]`` of the positive's, the first ``NEGATIVES``.

Scale: the anchors are the stated query set, met by all rows block by block: a task holds one block
of at most ``BLOCK_ROWS`` rows and one of at most ``ANCHOR_BLOCK`` anchors and sends the first k
of each window, which a ranking per window (limited before its shuffle) merges. Nothing passes
through the driver but row counts; no label or vector is a key of a shuffle.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no
part, nor do those with a component beyond +-``LARGEST`` after scaling (sums stay below 2**63 up to
4,096 dimensions). Vectors of different length are compared as if the shorter were filled up with
zeros. A row with a null id is no anchor and comes last among ties. Repeated rows stand for
themselves: the copy of an anchor is another row. Windows of a positive whose score is negative
are empty. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marksheet.llm.scratch import shuffle_width, written

SCALE = 256.0
LARGEST = float(1 << 25)
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
BLOCK_ROWS = 8192
ANCHOR_BLOCK = 256
FIRST_DEPTH = 64
NO_ID = np.iinfo(np.int64).max
SMALLEST, GREATEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def integer_rows(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label=None) -> DataFrame:
    """(no, key, label, v): the rows that take part, numbered, with integer components."""
    v = F.transform(F.col(vector), lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= LARGEST / SCALE))
    label = F.col("label") if label is None else label
    out = rows.where(F.col(vector).isNotNull() & sound).select(F.col(key).cast("long").alias("key"), label.cast("long").alias("label"), v.alias("v"))
    return written(out.where("label is not null").withColumn("no", F.monotonically_increasing_id()), "integer-vectors")


def _matrix(col: pa.ListArray) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    off = col.offsets.to_numpy()
    size = np.diff(off)
    out = np.zeros((len(col), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = col.values.to_numpy(zero_copy_only=False)[off[0]: off[-1]]
    return out


def packed(rows: DataFrame, size: int, extra: list[str] | None = None) -> DataFrame:
    """One row per block of at most ``size`` rows of a partition: columns as binary arrays."""
    extra = extra or []
    names = ["no", "key", "label", "width", "v"] + extra

    def block(cols: list[pa.RecordBatch]):
        t = pa.Table.from_batches(cols).combine_chunks()
        one = lambda c: t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0)
        m = _matrix(one("v"))
        key = one("key").fill_null(NO_ID).to_numpy()
        row = [one("no").to_numpy(), key, one("label").to_numpy(), m]
        data = [row[0].tobytes(), row[1].tobytes(), row[2].tobytes(), m.shape[1], m.astype(np.int32).tobytes()]
        data += [_matrix(one(c)).tobytes() for c in extra]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if n == "width" else pa.binary()) for n, x in zip(names, data)], names=names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - n)
                held.append(part)
                n += part.num_rows
                at += part.num_rows
                if n == size:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return rows.mapInArrow(run, "no binary, key binary, label binary, width int, v binary" + "".join(f", {c} binary" for c in extra))


class Block:
    def __init__(self, r: dict, width: int):
        self.no, self.key, self.label = (np.frombuffer(r[c], np.int64) for c in ("no", "key", "label"))
        own = np.frombuffer(r["v"], np.int32).reshape(len(self.no), r["width"])
        self.v = np.zeros((len(self.no), width), np.int64)
        self.v[:, : r["width"]] = own


def sorted_lists(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, components) of each dimension, largest first; then, for dimensions + d, smallest first."""
    order = np.argsort(-v, axis=0, kind="stable").T
    value = np.take_along_axis(v.T, order, axis=1)
    return np.concatenate([order, order[:, ::-1]]), np.concatenate([value, value[:, ::-1]])


def longest(v: np.ndarray) -> float:
    """An upper bound of the rows' lengths."""
    return float(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)) * 1.001


class Search:
    """A block of rows, ready for anchors."""

    def __init__(self, block: Block):
        self.block = block
        self.lists, self.values = sorted_lists(block.v)
        self.norm = longest(block.v)
        self.v = block.v

    def prepare(self, anchors: np.ndarray) -> None:
        """Sums below 2**24 or 2**53 are exact in floating point, whose products are much faster;
        the product of the norms bounds them, partial sums included."""
        most = self.norm * longest(anchors)
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        if self.v.dtype != kind:
            self.v = self.block.v.astype(kind)

    def run(self, anchor: np.ndarray, eligible: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        """[(row, score)] of each window (low, high): the first k by score, then key."""
        n, key = len(self.block.key), self.block.key
        dims = np.flatnonzero(anchor)
        pick = np.where(anchor[dims] > 0, dims, dims + len(anchor))
        a, weight = anchor.astype(self.v.dtype), anchor[dims]
        seen = np.zeros(n, bool)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]
        open_ = [w for w in range(len(low)) if low[w] <= high[w]]
        at, depth = 0, FIRST_DEPTH
        while open_ and at < n:
            end = min(n, depth)
            met = np.zeros(n, bool)
            if len(dims):
                met[self.lists[pick, at: end]] = True
                limit = int(weight @ self.values[pick, end - 1])
            else:
                met[:], limit, end = True, 0, n  # an anchor of zeros: every score is zero
            new = np.flatnonzero(met & ~seen & eligible)
            seen |= met
            score = (self.v[new] @ a).astype(np.int64)
            still = []
            for w in open_:
                ok = (score >= low[w]) & (score <= high[w])
                rows, scores = np.concatenate([best[w][0], new[ok]]), np.concatenate([best[w][1], score[ok]])
                if len(rows) > k:
                    first = np.lexsort((key[rows], -scores))[:k]
                    rows, scores = rows[first], scores[first]
                best[w] = (rows, scores)
                if not (limit < low[w] or len(rows) == k and limit < scores.min()):
                    still.append(w)
            open_, at, depth = still, end, depth * 2
        return best


RESULT = "anchor_no long, anchor_id long, positive_no long, positive_id long, positive_score long, no long, key long, score long"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _search(units: DataFrame, width: int, k: int, same_label: bool) -> DataFrame:
    """The first k of each window in each (row block, anchor block) unit."""
    def run(batches):
        held: tuple = (None, None)
        for batch in batches:
            for i in range(batch.num_rows):
                u = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                anchors = Block({c: u[f"a_{c}"] for c in ("no", "key", "label", "width", "v")}, width)
                if held[0] != u["no"]:
                    held = (u["no"], Search(Block(u, width)))
                search, block = held[1], held[1].block
                search.prepare(anchors.v)
                if not same_label:  # positives: number, id and score of each, by rank
                    pos = np.frombuffer(u["a_positives"], np.int64).reshape(len(anchors.no), -1, 3)
                    count = np.frombuffer(u["a_count"], np.int64)
                out = []
                for j in range(len(anchors.no)):
                    own = block.label == anchors.label[j]
                    if same_label:
                        low, high = np.array([SMALLEST]), np.array([GREATEST])
                        eligible = own & (block.no != anchors.no[j])
                    else:
                        p = pos[j, : count[j], 2]
                        low, high = -((-LOW * p) // 100), (HIGH * p) // 100
                        eligible = ~own
                    for w, (rows, scores) in enumerate(search.run(anchors.v[j], eligible, low, high, k)):
                        if len(rows):
                            who = (anchors.no[j], anchors.key[j], *((0, 0, 0) if same_label else pos[j, w]))
                            out.append(np.column_stack([np.tile(np.array(who, np.int64), (len(rows), 1)), block.no[rows], block.key[rows], scores]))
                table = np.concatenate(out) if out else np.zeros((0, len(NAMES)), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(table[:, c], mask=table[:, c] == NO_ID if n in ("key", "positive_id") else None) for c, n in enumerate(NAMES)], names=NAMES)

    return units.mapInArrow(run, RESULT)


def _merged(found: DataFrame, group: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("key").asc_nulls_last(), "no")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``vectors`` is
    the table of ``integer_rows``, ``anchors`` some of its rows."""
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width, n_blocks = max(1, width), max(1, -(-n // BLOCK_ROWS))
    lanes = min(n_blocks, max(shuffle_width(vectors), 4 * vectors.sparkSession.sparkContext.defaultParallelism))
    blocks = written(packed(vectors.repartition(n_blocks), BLOCK_ROWS).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes))), "vector-blocks")
    parts = max(1, -(-anchors.count() // ANCHOR_BLOCK))

    def units(queries: DataFrame, extra: list[str] | None = None) -> DataFrame:
        """Every row block beside every block of the stated query set, which goes to each lane once."""
        rows = written(packed(queries.repartition(parts), ANCHOR_BLOCK, extra), "anchor-blocks")
        names = [F.col(c).alias(f"a_{c}") for c in rows.columns]
        return blocks.join(rows.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), *names), "lane")

    found = _search(units(anchors), width, positives, True)
    best = written(_merged(found, ["anchor_no"], positives).select("anchor_no", "rank", "no", F.coalesce("key", F.lit(int(NO_ID))).alias("key"), "score"), "positives")
    lists = best.groupBy("anchor_no").agg(F.array_sort(F.collect_list(F.struct("rank", "no", "key", "score"))).alias("p"))
    fill = F.array_repeat(F.lit(0).cast("long"), 3 * positives)
    flat = F.slice(F.concat(F.flatten(F.transform("p", lambda x: F.array(x["no"], x["key"], x["score"]))), fill), 1, 3 * positives)
    asked = anchors.join(lists, F.col("no") == F.col("anchor_no")).select("no", "key", "label", "v", flat.alias("positives"), F.array(F.size("p").cast("long")).alias("count"))
    found = _search(units(asked, ["positives", "count"]), width, negatives, False)
    out = _merged(found, ["anchor_no", "positive_no"], negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = integer_rows(rows, label=label)
    return mine(vectors, vectors.where("key % 100 = 0"))


OP13_SQL = """
WITH sound AS (
  SELECT row_number() OVER () AS no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.no AS a_no, a.vec_id AS anchor_id, b.no AS no, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM sound a JOIN sound b ON a.no <> b.no WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT a_no, anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a_no ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.a_no, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.a_no = p.a_no AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.a_no, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""
