"""End-to-end flows: preparation splits/caps/masks, evaluation with a generator hook and failures."""

import os
import tempfile

from pyspark.sql import functions as F

from marksheet.operators import sequences as T
from marksheet.plans import fixtures as FX
from marksheet.plans.evaluate import evaluate_records, evaluate_sets
from marksheet.plans.prepare import prepare_training
from marksheet.sources import io as SRC
from conftest import SF_SMALL


def test_prepare_training_splits_and_masks(spark):
    recs = FX.instructions(spark, SF_SMALL).select("raw_id", "instruction", "input", "output")
    n = recs.count()
    out = prepare_training(recs, T.template_frame(spark), val_ratio=0.1, max_train=50, max_len=64)
    tr, va = out["train"].collect(), out["val"].collect()
    ids = lambda rows: {r.raw_id for r in rows}
    assert len(ids(va)) == -(-n // 10) and len(ids(tr)) == min(50, n - len(ids(va)))
    whole = {r.raw_id: r for df in prepare_training(recs, T.template_frame(spark), val_ratio=0.1).values() for r in df.collect()}
    assert len(whole) == n  # nothing is capped or cut by default
    for i in ids(tr):  # the records of a long text follow each other without a gap
        parts = sorted((r for r in tr if r.raw_id == i), key=lambda r: r.chunk_no)
        assert sum((p.input_ids for p in parts), []) == whole[i].input_ids and sum((p.labels for p in parts), []) == whole[i].labels
    assert not ({r.raw_id for r in tr} & {r.raw_id for r in va})
    for r in [r for r in tr if r.chunk_no == 0][:20]:
        assert len(r.input_ids) <= 64 and r.labels[: min(r.prompt_len, len(r.labels))] == [-100] * min(r.prompt_len, len(r.labels))


def test_evaluate_with_generator_hook_and_failures(spark):
    d = tempfile.mkdtemp(prefix="ms-eval-")
    recs = FX.predictions(spark, SF_SMALL).select(
        "dataset_name", "raw_id", F.lit("What is it?").alias("instruction"), F.lit(None).cast("string").alias("input"),
        F.col("reference_answer").alias("answer"))
    for name in ("A", "R"):
        recs.where(F.col("dataset_name") == name).drop("dataset_name").write.json(os.path.join(d, f"{name}.json"))
    caps = spark.createDataFrame([("A", 5), ("R", 7)], "dataset_name string, cap int")

    def make_gen():
        return lambda prompts: ["so \\boxed{42}" for _ in prompts]

    out = evaluate_sets(spark, d, ["A", "R", "gone"], caps, make_generator=make_gen,
                        schema="raw_id string, instruction string, input string, answer string", array_file=False)
    m = {r.dataset_name: r for r in out["metrics"].collect()}
    assert m["A"].total_samples == 5 and m["R"].total_samples == 7 and m["gone"].error is not None
    s = out["summary"].collect()[0]
    assert (s.total_datasets, s.successful_datasets, s.failed_datasets, s.total_samples) == (3, 2, 1, 12)
    assert {r.extracted_prediction for r in out["predictions"].collect()} == {"42"}


def test_unknown_cap_is_a_failed_set(spark):
    recs = spark.createDataFrame([("x", "1", "\\boxed{1}", "1")], "dataset_name string, raw_id string, decoded_prediction string, answer string")
    caps = spark.createDataFrame([("y", 3)], "dataset_name string, cap int")
    m = {r.dataset_name: r for r in evaluate_records(spark, recs, ["x"], caps)["metrics"].collect()}
    assert "no cap" in m["x"].error


def test_malformed_eval_file_fails_only_its_dataset(spark):
    d = tempfile.mkdtemp(prefix="ms-bad-")
    with open(os.path.join(d, "good.json"), "w") as f:
        f.write('{"raw_id": "1", "decoded_prediction": "\\\\boxed{3}", "answer": "3"}\n')
    with open(os.path.join(d, "bad.json"), "w") as f:
        f.write('{"raw_id": "1", "decoded_prediction": "\\\\boxed{3}", "answer": "3"}\n{broken\n')
    caps = spark.createDataFrame([("good", 10), ("bad", 10)], "dataset_name string, cap int")
    out = evaluate_sets(spark, d, ["good", "bad"], caps, schema="raw_id string, decoded_prediction string, answer string",
                        array_file=False)
    m = {r.dataset_name: r for r in out["metrics"].collect()}
    assert m["good"].error is None and m["good"].correct_samples == 1
    assert "malformed" in m["bad"].error and m["bad"].total_samples is None


def test_default_sets_and_caps(spark):
    from marksheet.plans.evaluate import DEFAULT_EVAL_SETS, default_caps
    d = tempfile.mkdtemp(prefix="ms-def-")
    rows = [(str(i), "\\\\boxed{1}", "1") for i in range(600)]
    df = spark.createDataFrame(rows, "raw_id string, decoded_prediction string, answer string")
    df.write.json(os.path.join(d, "math500_level3.json"))
    out = evaluate_sets(spark, d, schema="raw_id string, decoded_prediction string, answer string", array_file=False)
    m = {r.dataset_name: r for r in out["metrics"].collect()}
    assert set(m) == set(DEFAULT_EVAL_SETS) and default_caps(spark).count() == 5
    assert m["math500_level3"].total_samples == 600 and m["gpqa"].error is not None  # no cap unless asked for
    out = evaluate_sets(spark, d, caps=default_caps(spark), schema="raw_id string, decoded_prediction string, answer string", array_file=False)
    assert {r.dataset_name: r.total_samples for r in out["metrics"].collect()}["math500_level3"] == 500
