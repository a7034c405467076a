"""M1: grade prediction files as they arrive and keep running accuracy per dataset.

``readStream.json`` over a folder (bounded per trigger by ``maxFilesPerTrigger``) -> answer
extraction and the grading ladder (row-local, so no stream-stream join is needed) -> running
counts. Two forms: ``stream_score`` counts every row (a ``groupBy`` in ``complete`` mode, one state
row a dataset); ``stream_score_keyed`` counts every (dataset, raw_id) once, by its latest prediction.

Each micro-batch publishes a new version of its tables and then a pointer to it; published versions
are never rewritten, so readers always see a whole table, and a repeated batch gives the same
version. Checkpoints live in the shared checkpoint folder so a restarted query resumes exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marksheet.functions.extract import final_answer
from marksheet.operators.grade import grade
from marksheet.session import scratch_path
from marksheet.sources.io import read_jsonl_stream

PREDICTION_SCHEMA = "dataset_name string, raw_id string, decoded_prediction string, reference_answer string"


def running_scores(spark: SparkSession, src_dir: str, schema: str = PREDICTION_SCHEMA, max_files: int = 16) -> DataFrame:
    """The streaming DataFrame of running metrics (not started)."""
    s = read_jsonl_stream(spark, src_dir, schema, max_files)
    s = s.withColumn("extracted_prediction", final_answer("decoded_prediction"))
    g = grade(s).withColumn("_bad", F.col("_corrupt_record").isNotNull())
    return g.groupBy(F.when(~F.col("_bad"), F.col("dataset_name")).alias("dataset_name")).agg(
        F.count_if(~F.col("_bad")).alias("total_samples"),
        F.count_if(F.col("is_correct") & ~F.col("_bad")).alias("correct_samples"),
        F.count_if("_bad").alias("malformed"),
    ).withColumn("test_accuracy", F.when(F.col("total_samples") > 0, F.col("correct_samples") / F.col("total_samples")))


POINTER = "CURRENT"


def publish(spark: SparkSession, out: str, version: int) -> None:
    """Point readers of ``out`` at a version: one small file, written aside and moved over the old one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = hadoop.Path(f"{out}/{POINTER}")
    aside = hadoop.Path(f"{out}/_{POINTER}-{version}")
    stream = path.getFileSystem(conf).create(aside, True)
    stream.write(bytearray(str(version).encode()))
    stream.close()
    option = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(option, 1)
    over[0] = option.OVERWRITE
    hadoop.FileContext.getFileContext(path.getFileSystem(conf).getUri(), conf).rename(aside, path, over)


def published(spark: SparkSession, out: str, table: str = "metrics") -> DataFrame:
    """The current version of a table of ``out``."""
    version = spark.read.text(f"{out}/{POINTER}").first()[0]
    return spark.read.parquet(f"{out}/{table}-{version}")


def _run(stream: DataFrame, mode: str, each, checkpoint: str | None) -> None:
    q = (stream.writeStream.outputMode(mode).foreachBatch(each)
         .option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, "stream-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_score(spark: SparkSession, src_dir: str, out: str | None = None, schema: str = PREDICTION_SCHEMA,
                 max_files: int = 16, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over everything available now (``availableNow``), then return the current
    version of the metrics: one row per dataset, and one that counts malformed lines."""
    out = out or scratch_path(spark, "running-scores")

    def each(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/metrics-{number}")
        publish(spark, out, number)

    _run(running_scores(spark, src_dir, schema, max_files), "complete", each, checkpoint)
    return published(spark, out)


def stream_score_keyed(spark: SparkSession, src_dir: str, out: str | None = None, schema: str = PREDICTION_SCHEMA, max_files: int = 16,
                       checkpoint: str | None = None, sent_col: str | None = None, horizon: str | None = None) -> DataFrame:
    """Like ``stream_score``, but a (dataset, raw_id) that is sent again counts once, by the prediction
    sent last: by ``sent_col`` (a timestamp of the rows; default: the file's time), among equal times the
    correct one.

    State is a table of open keys (dataset, raw_id, verdict, time) and counts of closed ones per
    dataset, a new version a batch. With ``horizon`` (an interval as text) a key closes once the
    newest time seen is later than its own by more than that: its verdict is final, and a later prediction
    for it counts anew. Rows without an id cannot be sent again and are closed at once.
    """
    out = out or scratch_path(spark, "keyed-scores")
    s = read_jsonl_stream(spark, src_dir, schema, max_files)
    s = s.withColumn("_sent", F.col(sent_col).cast("timestamp") if sent_col else F.col("_metadata.file_modification_time"))
    g = grade(s.withColumn("extracted_prediction", final_answer("decoded_prediction")))
    bad = F.col("_corrupt_record").isNotNull()
    rows = g.select(F.when(~bad, F.col("dataset_name")).alias("dataset_name"), F.when(~bad, F.col("raw_id")).alias("raw_id"),
                    (F.col("is_correct") & ~bad).alias("is_correct"), F.col("_sent").alias("sent"), bad.alias("bad"))
    empty_keys = "dataset_name string, raw_id string, is_correct boolean, sent timestamp"
    empty_closed = "dataset_name string, total_samples long, correct_samples long, malformed long"

    def each(batch, number):
        def last(table, schema):
            return spark.read.parquet(f"{out}/{table}-{number - 1}") if number else spark.createDataFrame([], schema)

        def tally(df, bad=F.lit(False)):
            return df.groupBy("dataset_name").agg(F.count_if(~bad).alias("total_samples"), F.count_if(F.col("is_correct")).alias("correct_samples"), F.count_if(bad).alias("malformed"))

        def added(a, b):
            return a.unionByName(b).groupBy("dataset_name").agg(*[F.sum(c).alias(c) for c in ("total_samples", "correct_samples", "malformed")])

        keyed = F.col("raw_id").isNotNull() & ~F.col("bad")
        open_ = last("keys", empty_keys).unionByName(batch.where(keyed).select("dataset_name", "raw_id", "is_correct", "sent"))
        newest = F.max(F.struct("sent", "is_correct")).alias("x")
        open_ = open_.groupBy("dataset_name", "raw_id").agg(newest).select("dataset_name", "raw_id", "x.is_correct", "x.sent")
        open_.write.mode("overwrite").parquet(f"{out}/merged-{number}")
        open_ = spark.read.parquet(f"{out}/merged-{number}")
        gone = F.lit(False)
        if horizon:
            open_ = open_.withColumn("_now", open_.agg(F.max("sent").alias("m")).scalar())
            gone = F.coalesce(F.col("sent") + F.expr(f"INTERVAL {horizon}") < F.col("_now"), F.lit(False))
        open_.where(~gone).drop("_now").write.mode("overwrite").parquet(f"{out}/keys-{number}")
        closed = added(tally(open_.where(gone)), tally(batch.where(~keyed), F.col("bad")))
        added(last("closed", empty_closed), closed).write.mode("overwrite").parquet(f"{out}/closed-{number}")
        total = added(spark.read.parquet(f"{out}/closed-{number}"), tally(spark.read.parquet(f"{out}/keys-{number}")))
        accuracy = F.when(F.col("total_samples") > 0, F.col("correct_samples") / F.col("total_samples"))
        total.withColumn("test_accuracy", accuracy).write.mode("overwrite").parquet(f"{out}/metrics-{number}")
        publish(spark, out, number)

    _run(rows, "append", each, checkpoint)
    return published(spark, out)
