"""Lineage cuts in the shared folder that the session names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marksheet.session import checkpoint_root, scratch_path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the folder of ``spark.checkpoint.dir``: later readers see
    the same rows even if executors are lost, and nothing upstream runs twice."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint (never a local one)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


COPIES = 100_000


def each_copy(rows: DataFrame, n: str, out: str, piece: int = COPIES) -> DataFrame:
    """``rows`` once for each number 0 .. n - 1, as ``out``. Rows of more than ``piece`` copies are first
    dealt over the tasks in runs of ``piece``, so one row with very many copies is no single task."""
    few = rows.where(F.col(n) <= piece).withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)))
    runs = rows.where(F.col(n) > piece).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / piece))))
    last = F.least(F.col(n).cast("long"), (F.col("_run") + 1) * piece) - 1
    many = runs.repartition(shuffle_width(rows)).withColumn(out, F.explode(F.sequence(F.col("_run") * piece, last))).drop("_run")
    return few.where(F.col(n) > 0).unionByName(many)
