"""Operator 8: quality rules, a calibrated classifier on hashed n-grams.

A document is described by hashed word n-grams (1 and 2 words) and hashed byte n-grams (3 and 4
bytes, so any script), each as shares of the document's n-grams in ``DIMS`` slots a family. A
logistic regression is trained on labelled rows by Spark ML, its probability calibrated (Platt)
on labelled rows it has not seen, and every document is scored in Arrow batches against the
fixed threshold ``KEEP_AT``. Cheap counts with fixed limits (the base rule) reject before that.

Bounds: the classifier is fitted on at most ``FIT_ROWS`` labelled rows (those of smallest key
hash, a documented sample); the model is 4 * DIMS weights whatever the input, so shipping it to
the tasks is bounded. All documents are scored over their whole texts, row by row: no shuffle.

Defined results: null text counts as empty: no words, so the base rule rejects it. Rows with a
null id are scored like others. Labels that are null, or whose document is missing, are not
trained on; with no labels, or labels of one class only, the base rule alone decides. Repeated
rows give repeated results. Extra columns are ignored by the query and kept by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marksheet.llm.scratch import written
from marksheet.llm.textbatch import SPACE, find_words, hash_words, inside, mix, pieces, row_sums, windows

DIMS = 2048
FIT_ROWS = 8000
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
FAMILIES = 4
SCALE = 100.0


def counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row."""
    start, end, first = find_words(data, off)
    docs = len(off) - 1
    chars = (data & 0xC0) != 0x80
    n_words = np.diff(first)
    lines = np.zeros(docs, np.int64)
    raw = data.tobytes()
    for d in range(docs):
        full = [x for x in raw[off[d]: off[d + 1]].split(b"\n") if x.strip()]
        lines[d] = len(full) - len(set(full))
    h = hash_words(data, start, end)
    w = windows(h, 3)
    row = np.repeat(np.arange(docs), n_words)
    at = np.flatnonzero(inside(first, 3, len(w)))
    own = mix(w[at] ^ mix(row[at].astype(np.uint64) + np.uint64(1)))  # told apart by row
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = at[twice]
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[hit + k] = True
    return {"n_words": n_words, "word_chars": row_sums((chars & ~SPACE[data]).astype(np.int64), off),
            "n_symbols": row_sums(SYMBOLS[data].astype(np.int64), off), "n_dup_lines": lines,
            "n_repeat_words": row_sums(covered.astype(np.int64), first), "_hash": h, "_first": first}


def slots(data: np.ndarray, off: np.ndarray, h: np.ndarray, first: np.ndarray):
    """(slots, row starts) of the four n-gram families, slots in one space of 4 * DIMS."""
    mask = np.uint64(DIMS - 1)
    out = []
    for n in (1, 2):
        w = windows(h, n)
        ok = inside(first, n, len(w))
        part = (mix(w[ok]) & mask).astype(np.int32) + (n - 1) * DIMS
        out.append((part, np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - n + 1, 0))])))
    b = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)  # characters, not bytes
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    for k, n in enumerate((3, 4), start=2):
        if len(b) >= n:
            x = b[: len(b) - n + 1] * np.uint32(1)
            for j in range(1, n):
                x = x * np.uint32(0x01000193) + b[j: len(b) - n + 1 + j]
            x *= np.uint32(0x9E3779B1)
            ok = inside(begins, n, len(x))
            part = (x[ok] >> np.uint32(32 - DIMS.bit_length() + 1)).astype(np.int32) + k * DIMS
        else:
            part = np.zeros(0, np.int32)
        out.append((part, np.concatenate([[0], np.cumsum(np.maximum(np.diff(begins) - n + 1, 0))])))
    return out


def short_pieces(batches):
    """Runs of at most 512 rows: a row's features take 8 * FAMILIES * DIMS bytes, however short it is."""
    for batch, data, off in pieces(batches, "text", 1 << 20):
        for a in range(0, batch.num_rows, 512):
            cut = off[a: a + 513]
            yield batch.slice(a, 512), data[cut[0]: cut[-1]], cut - cut[0]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, y, fold, x array) of labelled documents."""
    def run(batches):
        for batch, data, off in short_pieces(batches):
            start, end, first = find_words(data, off)
            n = len(off) - 1
            x = np.zeros((n, FAMILIES * DIMS), np.float32)
            for part, at in slots(data, off, hash_words(data, start, end), first):
                size = np.diff(at)
                row = np.repeat(np.arange(n), size)
                np.add.at(x, (row, part), (SCALE / np.maximum(size, 1))[row].astype(np.float32))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FAMILIES * DIMS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["y", "fold", "x"])

    return docs.select("y", "fold", "text").mapInArrow(run, "y double, fold int, x array<float>")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality"):
    """(weights, bias, slope, offset) of the calibrated model, or None without two classes.
    One labelled row in five calibrates; the others train."""
    y = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_id")).agg(F.max(F.col(label).cast("double")).alias("y"))
    picked = F.broadcast(y.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows))  # at most fit_rows rows
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("text")).join(picked, "_id")
    # an id that several rows share gives one of them: at most fit_rows rows
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_id").orderBy(F.xxhash64("text")))).where("_nth = 1").drop("_nth")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), F.col("_id")), F.lit(5)).cast("int"))
    table = written(features(rows), "quality-features").select("y", "fold", array_to_vector("x").alias("x"))
    classes = {(r.fold, r.y) for r in table.select((F.col("fold") == 0).alias("fold"), "y").distinct().collect()}
    if not {(False, 0.0), (False, 1.0)} <= classes:
        return None
    lr = LogisticRegression(featuresCol="x", labelCol="y", maxIter=25, regParam=0.002, standardization=False, probabilityCol="p", rawPredictionCol="raw")
    model = lr.fit(table.where("fold <> 0"))
    weights, bias = model.coefficients.toArray().astype(np.float32), float(model.intercept)
    slope, offset = 1.0, 0.0
    if {(True, 0.0), (True, 1.0)} <= classes:
        from pyspark.ml.functions import vector_to_array
        held = model.transform(table.where("fold = 0")).select("y", array_to_vector(F.array(vector_to_array("raw")[1])).alias("x"))
        platt = LogisticRegression(featuresCol="x", labelCol="y", maxIter=50, regParam=0.01, standardization=False).fit(held)
        slope, offset = float(platt.coefficients[0]), float(platt.intercept)
    return weights, bias, slope, offset


def judge(docs: DataFrame, model, keep_at: float = KEEP_AT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content, base counts, base_failed, probability, kept) for every row; the
    probability is null without a model."""
    names = ["doc_id", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]

    def run(batches):
        for batch, data, off in pieces(batches, "_text", 1 << 20):
            c = counts(data, off)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            n = len(off) - 1
            if model is None:
                p, kept = pa.nulls(n, pa.float64()), ~failed
            else:
                weights, bias, slope, offset = model
                z = np.full(n, bias)
                for part, at in slots(data, off, c["_hash"], c["_first"]):
                    z += SCALE * row_sums(weights[part].astype(np.float64), at) / np.maximum(np.diff(at), 1)
                prob = 1.0 / (1.0 + np.exp(-np.clip(slope * z + offset, -500, 500)))
                p, kept = pa.array(prob), ~failed & (prob >= keep_at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)] + [pa.array(c[k]) for k in names[2:7]] + [pa.array(failed), p, pa.array(kept)], names=names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, content long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns. The verdict is made where the row
    is: all columns travel through the Arrow batch, nothing is joined or shuffled."""
    model = fit(docs, labels, key=key, text=text)
    schema = docs.schema

    def run(batches):
        for batch, data, off in pieces(batches, text, 1 << 20):
            c = counts(data, off)
            ok = (c["n_words"] >= MIN_WORDS) & (100 * c["n_repeat_words"] <= MAX_REPEAT_PERCENT * c["n_words"])
            if model is not None:
                weights, bias, slope, offset = model
                z = np.full(len(ok), bias)
                for part, at in slots(data, off, c["_hash"], c["_first"]):
                    z += SCALE * row_sums(weights[part].astype(np.float64), at) / np.maximum(np.diff(at), 1)
                ok &= 1.0 / (1.0 + np.exp(-np.clip(slope * z + offset, -500, 500))) >= KEEP_AT
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(run, schema)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    d = sf_dir.rstrip("/")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return judge(docs, fit(docs, labels)).drop("content")
