"""Scores, summaries and log/parameter reports.

All are hash aggregations (partial aggregation before the shuffle, so a dataset holding a third
of all rows costs one small partial row per map task) or windows with a literal limit (which
Catalyst turns into a partial ``WindowGroupLimit`` before the shuffle).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS_SCHEMA = "dataset_name string, test_accuracy double, total_samples long, correct_samples long, error string"


def score(df: DataFrame, by: str = "dataset_name", correct_col: str = "is_correct") -> DataFrame:
    """A1: rows, correct rows and accuracy per dataset (plus undecided and both-empty counts)."""
    aggs = [
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.coalesce(F.col(correct_col), F.lit(False))).alias("correct_samples"),
    ]
    if "undecided" in df.columns:
        aggs.append(F.count_if(F.coalesce(F.col("undecided"), F.lit(False))).alias("undecided_samples"))
    if "both_empty" in df.columns:
        aggs.append(F.count_if(F.coalesce(F.col("both_empty"), F.lit(False))).alias("both_empty_samples"))
    if "error" in df.columns:  # row-level errors ride along in the same aggregation
        aggs.append(F.max("error").alias("row_error"))
    out = df.groupBy(by).agg(*aggs)
    return out.withColumn(
        "test_accuracy",
        F.coalesce(F.try_divide(F.col("correct_samples").cast("double"), F.col("total_samples").cast("double")), F.lit(0.0)),
    )


def score_answers(
    df: DataFrame,
    pred_col: str = "extracted_prediction",
    gold_col: str = "reference_answer",
    by: str = "dataset_name",
    cfg=None,
) -> DataFrame:
    """A1 over raw answers, grading each distinct (dataset, prediction, gold) once.

    The per-row work is only the count: ``groupBy`` with map-side partial aggregation collapses
    repeated answers before the shuffle (a dataset holding a third of all rows sends one partial
    row per distinct answer pair per task). The grading ladder then runs on the distinct
    triples, and a second tiny aggregation weights the verdicts by their counts.
    """
    from marksheet.operators.grade import GradeConfig, grade

    pairs = df.groupBy(by, pred_col, gold_col).agg(F.count(F.lit(1)).alias("_n"))
    g = grade(pairs, pred_col, gold_col, cfg=cfg or GradeConfig())
    n = F.col("_n")
    out = g.groupBy(by).agg(
        F.sum(n).cast("long").alias("total_samples"),
        F.coalesce(F.sum(F.when(F.col("is_correct"), n)), F.lit(0)).cast("long").alias("correct_samples"),
        F.coalesce(F.sum(F.when(F.col("undecided"), n)), F.lit(0)).cast("long").alias("undecided_samples"),
        F.coalesce(F.sum(F.when(F.col("both_empty"), n)), F.lit(0)).cast("long").alias("both_empty_samples"),
    )
    return out.withColumn(
        "test_accuracy",
        F.coalesce(F.try_divide(F.col("correct_samples").cast("double"), F.col("total_samples").cast("double")), F.lit(0.0)),
    )


def requested_frame(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """The requested dataset names (a handful of literals) as a one-column table."""
    return spark.createDataFrame([(n,) for n in names], "dataset_name string")


def score_with_failures(
    predictions: DataFrame,
    requested: DataFrame,
    source_errors: DataFrame | None = None,
    by: str = "dataset_name",
) -> DataFrame:
    """A3 + J3: one metrics row per requested dataset; a bad dataset becomes an error row.

    Errors come from three places: the source (``source_errors``: dataset_name, error), a
    row-level ``error`` column in the predictions, or no rows at all for a requested name.
    """
    m = score(predictions, by=by, correct_col="is_correct")
    if "row_error" not in m.columns:
        m = m.withColumn("row_error", F.lit(None).cast("string"))
    j = requested.select(by).distinct().join(m, by, "left")
    if source_errors is not None:
        errs = source_errors.groupBy(by).agg(
            F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("source_error"))  # one row per dataset
        j = j.join(errs, by, "left")
    else:
        j = j.withColumn("source_error", F.lit(None).cast("string"))
    err = F.coalesce(
        F.col("source_error"),
        F.col("row_error"),
        F.when(F.col("total_samples").isNull(), F.concat(F.lit("no records for dataset "), F.col(by))),
    )
    ok = err.isNull()
    return j.select(
        F.col(by).alias("dataset_name"),
        F.when(ok, F.col("test_accuracy")).alias("test_accuracy"),
        F.when(ok, F.col("total_samples")).alias("total_samples"),
        F.when(ok, F.col("correct_samples")).alias("correct_samples"),
        err.alias("error"),
    )


def summarize(metrics: DataFrame) -> DataFrame:
    """A2: one row; pooled accuracy by rows (not a mean of accuracies); 0.0 when no rows."""
    ok = F.col("error").isNull()
    total = F.coalesce(F.sum(F.when(ok, F.col("total_samples"))), F.lit(0)).cast("long")
    correct = F.coalesce(F.sum(F.when(ok, F.col("correct_samples"))), F.lit(0)).cast("long")
    return metrics.agg(
        F.count(F.lit(1)).alias("total_datasets"),
        F.count_if(ok).alias("successful_datasets"),
        F.count_if(~ok).alias("failed_datasets"),
        total.alias("total_samples"),
        correct.alias("total_correct"),
    ).withColumn(
        "overall_accuracy",
        F.coalesce(F.try_divide(F.col("total_correct").cast("double"), F.col("total_samples").cast("double")), F.lit(0.0)),
    )


# ------------------------------------------------------------------ training log

def train_rows(log: DataFrame) -> DataFrame:
    """P10: ``loss`` present and ``eval_loss`` absent."""
    return log.where(F.col("loss").isNotNull() & F.col("eval_loss").isNull())


def eval_rows(log: DataFrame) -> DataFrame:
    """P10: ``eval_loss`` present."""
    return log.where(F.col("eval_loss").isNotNull())


def split_history(log: DataFrame) -> DataFrame:
    """A4: one table with a ``phase`` column (train / eval); rows with neither are dropped."""
    phase = (
        F.when(F.col("eval_loss").isNotNull(), F.lit("eval"))
        .when(F.col("loss").isNotNull(), F.lit("train"))
    )
    return log.withColumn("phase", phase).where(F.col("phase").isNotNull())


def history_summary(log: DataFrame) -> DataFrame:
    """A4: per phase row counts and loss range."""
    h = split_history(log)
    v = F.when(F.col("phase") == "eval", F.col("eval_loss")).otherwise(F.col("loss"))
    return h.groupBy("phase").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(v).alias("min_loss"),
        F.max(v).alias("max_loss"),
        F.min("step").alias("first_step"),
        F.max("step").alias("last_step"),
    )


def best_step(log: DataFrame, run_col: str = "run") -> DataFrame:
    """A5: per run, the step with the lowest ``eval_loss`` (ties: lowest step)."""
    e = eval_rows(log)
    return e.groupBy(run_col).agg(
        F.min_by("step", F.struct("eval_loss", "step")).alias("best_step"),
        F.min("eval_loss").alias("best_eval_loss"),
    )


def newest_steps(log: DataFrame, k: int = 3, run_col: str = "run") -> DataFrame:
    """The ``k`` newest steps per run (the ones a save limit keeps)."""
    w = Window.partitionBy(run_col).orderBy(F.col("step").desc())
    return log.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ------------------------------------------------------------------ parameters and penalties

def share_report(
    params: DataFrame,
    adapter_marker: str,
    bank_markers: tuple[str, ...],
    name_col: str = "name",
    size_col: str = "numel",
) -> DataFrame:
    """Size sums by name class in one pass, and the class shares.

    bank = adapter names with a bank marker; adapter = names with the adapter marker; the rest
    of the adapter parameters are the encoder part; total = all parameters. The markers are the
    caller's naming scheme (e.g. an adapter prefix and the names of its two bank matrices).
    """
    name = F.col(name_col)
    size = F.col(size_col).cast("long")
    is_adapter = F.contains(name, F.lit(adapter_marker))
    is_bank = F.lit(False)
    for m in bank_markers:
        is_bank = is_bank | F.contains(name, F.lit(m))
    is_bank = is_adapter & is_bank
    s = params.agg(
        F.coalesce(F.sum(F.when(is_bank, size)), F.lit(0)).cast("long").alias("bank_params"),
        F.coalesce(F.sum(F.when(is_adapter & ~is_bank, size)), F.lit(0)).cast("long").alias("encoder_params"),
        F.coalesce(F.sum(F.when(is_adapter, size)), F.lit(0)).cast("long").alias("adapter_params"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_params"),
    )

    def pct(a, b):
        return F.coalesce(F.try_divide(F.lit(100.0) * F.col(a), F.col(b).cast("double")), F.lit(0.0))

    return (
        s.withColumn("adapter_pct", pct("adapter_params", "total_params"))
        .withColumn("encoder_pct", pct("encoder_params", "adapter_params"))
        .withColumn("bank_pct", pct("bank_params", "adapter_params"))
    )


def total_penalty(penalties: DataFrame, base: DataFrame | None = None, kinds: Iterable[str] | None = None) -> DataFrame:
    """Per step, base loss + the mean over layers of each penalty kind (absent kinds count 0).

    Two hash aggregations: (step, kind) means, then the per-step sum.
    """
    p = penalties
    if kinds is not None:
        p = p.where(F.col("kind").isin(list(kinds)))
    per_kind = p.groupBy("step", "kind").agg(F.avg("value").alias("mean_value"))
    tot = per_kind.groupBy("step").agg(F.sum("mean_value").alias("penalty"), F.count(F.lit(1)).alias("kinds"))
    if base is not None:
        tot = base.select("step", F.col("loss").alias("base_loss")).join(tot, "step", "left")
    else:
        tot = tot.withColumn("base_loss", F.lit(0.0))
    return tot.select(
        "step",
        F.coalesce(F.col("base_loss"), F.lit(0.0)).alias("base_loss"),
        F.coalesce(F.col("penalty"), F.lit(0.0)).alias("penalty"),
        (F.coalesce(F.col("base_loss"), F.lit(0.0)) + F.coalesce(F.col("penalty"), F.lit(0.0))).alias("total_loss"),
    )


def fully_masked_rows(df: DataFrame, labels_col: str = "labels", ignore_id: int = -100) -> DataFrame:
    """How many rows have every label masked (the prompt filled the whole length limit)."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.forall(F.col(labels_col), lambda x: x == ignore_id)).alias("fully_masked_rows"),
    )
