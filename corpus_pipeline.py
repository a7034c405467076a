"""The training-data pipeline: quality rules, SimHash near-duplicates, benchmark decontamination,
mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns them
with the columns of ``documents``; the last adds ``shard``. Between stages the rows are written
to the shared folder as Parquet and read again.

Defined results: empty input gives an empty result with the same columns; null and empty texts are
rejected by the quality rules; repeated rows become one in the near-duplicate stage and may be
repeated again by the mix, which the shards keep. Extra columns are kept throughout.
"""

from pyspark.sql import DataFrame, SparkSession

from marksheet.llm.decontamination import without_leaks
from marksheet.llm.mixing import mixed_rows
from marksheet.llm.near_duplicates import keep_one_per_group
from marksheet.llm.quality_rules import keep_good
from marksheet.llm.scratch import written
from marksheet.llm.sharding import assign_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return assign_shards(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix_sources), ("shard", shard)]

# The classifier, the latent space and the connected components have no SQL form; tests/llm holds
# run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
