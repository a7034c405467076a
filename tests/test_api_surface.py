"""The smaller public operators: one behaviour check each."""

import hashlib
import os
import tempfile

from pyspark.sql import functions as F

from marksheet.functions import extract as X
from marksheet.functions import normalize as N
from marksheet.operators import grade as G
from marksheet.operators import sampling as P
from marksheet.operators import score as A
from marksheet.operators import sequences as T
from marksheet.sources import io as SRC


def test_seeded_shuffle_order(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    got = [r.k for r in P.seeded_shuffle(df, "k", 7).collect()]
    assert got == sorted(range(50), key=lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k))


def test_extract_and_normalize_frames(spark):
    df = spark.createDataFrame([("so \\boxed{0.50}",), ("nothing",)], "t string")
    e = X.extract_answers(df, "t", "boxed").collect()
    assert [(r.answer, r.rule_hit) for r in e] == [("0.50", True), ("", False)]
    n = N.normalize_answers(X.extract_answers(df, "t", "boxed"), "answer", "final").collect()
    assert [r.answer_norm for r in n] == ["0.50", ""]
    assert [r.d for r in df.select(N.is_digit(F.lit("1,5")).alias("d")).collect()] == [True, True]


def test_caps_lookup_keeps_unknown_with_null(spark):
    df = spark.createDataFrame([("a",), ("z",)], "dataset_name string")
    caps = spark.createDataFrame([("a", 3)], "dataset_name string, cap int")
    got = {r.dataset_name: r.cap for r in G.attach_caps(df, caps).collect()}
    assert got == {"a": 3, "z": None}


def test_rejected_records_and_train_rows(spark):
    recs = spark.createDataFrame([("q", "x"), (None, "y")], "instruction string, input string")
    assert [r.input for r in T.rejected_records(recs).collect()] == ["y"]
    log = spark.createDataFrame([(1, 0.5, None), (2, None, 0.4), (3, 0.3, 0.2)], "step long, loss double, eval_loss double")
    assert [r.step for r in A.train_rows(log).collect()] == [1]


def test_summary_written_with_run_stamp(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="ms-sum-"), "summary")
    s = spark.createDataFrame([(3, 0.5)], "total_datasets long, overall_accuracy double")
    SRC.write_summary(s, d, run_stamp="20260101_000000")
    back = spark.read.json(d).collect()[0]
    assert back.run_stamp == "20260101_000000" and back.total_datasets == 3


def test_keep_derived_prunes_columns(spark):
    df = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string")
    assert P.keep_derived(df.withColumn("z", F.concat("x", "y")), ["k", "z"]).columns == ["k", "z"]
