"""Evaluation of question sets: load, cap, render, generate (caller hook), extract, grade, score.

Failures are data: a set whose file is missing, or that has no cap entry, becomes a metrics
row with an ``error``; the other sets go on, and the summary counts both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marksheet.functions.extract import final_answer
from marksheet.operators import grade as G
from marksheet.operators import hooks as H
from marksheet.operators import sampling as P
from marksheet.operators import score as A
from marksheet.operators import sequences as T
from marksheet.session import checked_broadcast
from marksheet.sources import io as SRC

# The per-set row caps and the default evaluation sets of the original setup.
DEFAULT_CAPS = [
    ("gpqa", 200),
    ("mmlupro_chemistry", 200),
    ("mmlupro_economics", 200),
    ("math500_level3", 500),
    ("mmlupro_math", 200),
]
DEFAULT_EVAL_SETS = ["gpqa", "mmlupro_chemistry", "math500_level3", "mmlupro_math", "mmlupro_economics"]

# The columns of a written prediction, as far as the records have them.
RECORD_COLUMNS = ["dataset_name", "instruction", "raw_id", "input", "reference_answer", "reference_solution", "decoded_prediction",
                  "extracted_prediction", "is_correct", "rung", "undecided", "both_empty", "error"]


def default_caps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_CAPS, "dataset_name string, cap int")


def evaluate_records(spark: SparkSession, records: DataFrame, names: list[str], caps: DataFrame | None = None,
                     source_errors: DataFrame | None = None, make_generator=None, template: DataFrame | None = None,
                     key: str = "raw_id", seed: int = 42, exempt: str | None = "math500",
                     gold_col: str = "answer", output_dir: str | None = None, run_stamp: str | None = None, make_embedder=None) -> dict[str, DataFrame]:
    """Records tagged with ``dataset_name`` -> predictions, metrics (one row per requested name), summary.

    Without ``make_generator`` the records must already carry ``decoded_prediction``. Every record
    is scored unless ``caps`` are passed (``default_caps`` has the original ones); a requested set
    that those leave out is then reported as an error, not scored. With ``output_dir`` the
    predictions (one folder per set), metrics and summary are written below it (S6, S7), and the
    scores are computed from the written predictions, so a model's answers are generated once.
    With ``make_embedder`` the rendered prompt's vector reaches the generator as ``external_embedding``.
    """
    requested = A.requested_frame(spark, names)
    capped, errors = records, None if source_errors is None else source_errors.select("dataset_name", "error")
    if caps is not None:
        no_cap = requested.join(checked_broadcast(caps.select("dataset_name")), "dataset_name", "left_anti").select(
            "dataset_name", F.concat(F.lit("no cap configured for dataset "), F.col("dataset_name")).alias("error"))
        known = checked_broadcast(caps.select("dataset_name").distinct())
        capped = P.cap_per_dataset(records.join(known, "dataset_name", "left_semi"), caps, key, seed, exempt=exempt)
        errors = no_cap if errors is None else errors.unionByName(no_cap)
    if make_generator is not None:
        tpl = template if template is not None else T.template_frame(spark)
        prompted = T.render_prompt(capped, tpl, T.build_prompt("instruction", "input"), "prompt_text")
        if make_embedder is not None:
            prompted = prompted.withColumn("external_embedding", H.embed_with("prompt_text", make_embedder))
        capped = H.generate_with(prompted, make_generator, "prompt_text", "decoded_prediction")
    preds = capped.withColumn("extracted_prediction", final_answer("decoded_prediction"))
    preds = preds.withColumn("reference_answer", F.coalesce(F.col(gold_col).cast("string"), F.lit("")))
    if "output" in preds.columns:
        preds = preds.withColumn("reference_solution", F.coalesce(F.col("output").cast("string"), F.lit("")))
    graded = G.grade(preds, "extracted_prediction", "reference_answer")
    if output_dir is not None:
        base = output_dir.rstrip("/")
        record = graded.select(*[c for c in RECORD_COLUMNS if c in graded.columns])
        SRC.write_predictions(record, f"{base}/predictions")
        graded = spark.read.schema(record.schema).parquet(f"{base}/predictions")
    metrics = A.score_with_failures(graded, requested, errors)
    summary = A.summarize(metrics)
    if output_dir is not None:
        SRC.write_metrics(metrics, f"{base}/metrics", run_stamp)
        SRC.write_summary(summary, f"{base}/summary", run_stamp)
    return {"predictions": graded, "metrics": metrics, "summary": summary}


def evaluate_sets(spark: SparkSession, eval_dir: str, names: list[str] | None = None, caps: DataFrame | None = None,
                  make_generator=None,
                  schema: str = SRC.INSTRUCTION_SCHEMA, template: str = "{dir}/{name}.json", array_file: bool = True,
                  **kw) -> dict[str, DataFrame]:
    """One file per set name under ``eval_dir`` (missing files become error rows); by default the
    original five sets. No row is left out unless caps are passed."""
    names = DEFAULT_EVAL_SETS if names is None else names
    records, errors = SRC.scan_eval_sets(spark, eval_dir, names, schema, template, array_file)
    return evaluate_records(spark, records, names, caps, errors, make_generator, **kw)
