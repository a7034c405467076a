"""Scores with failures, sources/sinks and the streaming scorer."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marksheet.operators import score as A
from marksheet.plans import fixtures as FX
from marksheet.sources import io as SRC
from conftest import SF_SMALL


def test_summary_counts_failed_sets(spark):
    preds = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "dataset_name string, is_correct boolean")
    req = A.requested_frame(spark, ["a", "b", "gone"])
    m = {r.dataset_name: r for r in A.score_with_failures(preds, req).collect()}
    assert m["gone"].error is not None and m["a"].test_accuracy == 0.5
    s = A.summarize(A.score_with_failures(preds, req)).collect()[0]
    assert (s.total_datasets, s.successful_datasets, s.failed_datasets, s.total_samples, s.total_correct) == (3, 2, 1, 3, 2)
    assert abs(s.overall_accuracy - 2 / 3) < 1e-12
    empty = A.summarize(A.score_with_failures(preds.limit(0), A.requested_frame(spark, ["x"]))).collect()[0]
    assert empty.overall_accuracy == 0.0


def test_best_and_newest_steps(spark):
    log = spark.createDataFrame([("r", 1, None, 0.5), ("r", 2, None, 0.3), ("r", 3, 1.0, None), ("r", 4, None, 0.3)],
                                "run string, step long, loss double, eval_loss double")
    assert A.best_step(log).collect()[0].best_step == 2
    assert [r.step for r in A.newest_steps(log, 2).orderBy("step").collect()] == [3, 4]


def test_jsonl_roundtrip_and_failfast(spark):
    d = tempfile.mkdtemp(prefix="ms-test-")
    p = os.path.join(d, "preds")
    df = FX.predictions(spark, SF_SMALL)
    SRC.write_jsonl(df, p)
    back = SRC.read_jsonl(spark, p, "dataset_name string, raw_id string, decoded_prediction string, reference_answer string")
    assert back.exceptAll(df).count() == 0 and back.count() == df.count()
    bad = os.path.join(d, "bad.jsonl")
    with open(bad, "w") as f:
        f.write('{"a": 1}\n{not json\n')
    with pytest.raises(Exception):
        SRC.read_jsonl(spark, bad, "a int").collect()
    with pytest.raises(FileNotFoundError):
        SRC.read_jsonl(spark, os.path.join(d, "absent"), "a int")
    with pytest.raises(ValueError):
        SRC.write_jsonl(df, p, mode="x")


def test_json_array_file_and_missing_eval_set(spark):
    d = tempfile.mkdtemp(prefix="ms-test-")
    with open(os.path.join(d, "train.json"), "w") as f:
        f.write('[{"instruction": "i1", "input": null, "output": "o", "answer": 5}, {"instruction": "i2", "output": "o2", "answer": "x"}]')
    s = SRC.scan_instructions(spark, d, "train")
    rows = sorted(s["train"].collect(), key=lambda r: r.instruction)
    assert [r.answer for r in rows] == ["5", "x"]
    recs, errs = SRC.scan_eval_sets(spark, d, ["train", "nope"])
    assert recs.count() == 2 and [r.dataset_name for r in errs.collect()] == ["nope"]


def test_stream_matches_batch(spark):
    from marksheet.plans.catalog import QUERIES
    batch = {r.dataset_name: r.correct_samples for r in QUERIES["a1_score_by_dataset"](spark, SF_SMALL).collect()}
    rows = QUERIES["m1_stream_score"](spark, SF_SMALL).collect()
    stream = {r.dataset_name: r.correct_samples for r in rows if not r.malformed}
    broken = [r for r in rows if r.malformed]  # the lines that cannot be read: counted, never graded
    assert [(r.dataset_name, r.total_samples, r.correct_samples, r.malformed) for r in broken] == [(None, 0, 0, 25)]
    assert batch == stream


def test_jsonl_dates_epoch_and_text(spark):
    d = tempfile.mkdtemp(prefix="ms-dates-")
    df = spark.createDataFrame([("a", "2024-01-02 03:04:05")], "k string, t string").select("k", F.to_timestamp("t").alias("ts"))
    SRC.write_jsonl(df, os.path.join(d, "epoch"), date_format="epoch")
    back = spark.read.json(os.path.join(d, "epoch")).collect()[0]
    assert back.ts == 1704164645000
    SRC.write_jsonl(df, os.path.join(d, "iso"))
    as_ts = SRC.read_jsonl(spark, os.path.join(d, "iso"), "k string, ts timestamp").collect()[0]
    as_text = SRC.read_jsonl(spark, os.path.join(d, "iso"), "k string, ts timestamp", convert_dates=False).collect()[0]
    assert str(as_ts.ts) == "2024-01-02 03:04:05" and as_text.ts == "2024-01-02T03:04:05.000"


def test_scan_instructions_with_val_file(spark):
    d = tempfile.mkdtemp(prefix="ms-val-")
    for name, n in (("tr", 3), ("va", 2)):
        with open(os.path.join(d, f"{name}.json"), "w") as f:
            f.write("[" + ",".join(f'{{"instruction": "i{i}", "output": "o"}}' for i in range(n)) + "]")
    s = SRC.scan_instructions(spark, d, "tr", "va")
    assert s["train"].count() == 3 and s["val"].count() == 2
