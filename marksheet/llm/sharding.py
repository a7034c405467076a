"""Operator 1: contiguous shards of near equal bytes.

Rows are put in order of (key, text CRC, size) by a range partitioning; each partition's byte
total gives the prefix in front of it, a running sum inside the partition the prefix of each row,
and a row belongs to the shard in whose equal share of all bytes its prefix falls. The ordered
rows are narrow (no text) and checkpointed, so totals and running sums see the same partitions
whatever is lost or replanned. Equal rows are one row with a count until the end, so a row that
is a third of the table is one entry.

Scale: two shuffles of narrow rows; one total per partition is all that is gathered; no Python.
``assign_shards`` cuts wide rows at the first keys of the shards, without a shuffle.

Defined results: null text has zero bytes (size 1) and CRC 0. Null keys come first. Repeated rows
stand side by side, each with its own slot. Extra columns are ignored by ``shard_rows`` and kept
by ``assign_shards``. An empty table gives an empty result; fewer rows than shards leave shards
empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marksheet.llm.scratch import checkpointed, each_copy, shuffle_width

SHARDS = 8


def text_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row; ``slot`` counts from 0 in a shard."""
    narrow = docs.select(F.col(key).alias("_key"), text_crc(text).alias("_crc"), text_size(text).alias("_size"))
    equal = narrow.groupBy("_key", "_crc", "_size").agg(F.count(F.lit(1)).alias("_n"))
    order = ["_key", "_crc", "_size"]
    placed = checkpointed(equal.repartitionByRange(shuffle_width(docs), *order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum(F.col("_size") * F.col("_n")).alias("_bytes"), F.sum("_n").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select("_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"),
                            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"), F.sum("_bytes").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("_b", F.coalesce(F.sum(F.col("_size") * F.col("_n")).over(inside), F.lit(0))) \
        .withColumn("_r", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    run = run.join(F.broadcast(offsets), "_part").withColumn("_b", F.col("_bytes0") + F.col("_b")).withColumn("_r", F.col("_rows0") + F.col("_r"))
    big = lambda c: c.cast("decimal(38,0)")
    place = lambda copy: F.floor(big(F.col("_b") + copy * F.col("_size")) * shards / F.col("_all")).cast("int")
    # the first row of each shard, from the runs of equal rows: a run's first copy in a shard follows from sizes
    spans = run.select("_b", "_r", "_size", "_n", "_all", F.explode(F.sequence(place(F.lit(0)), place(F.col("_n") - 1))).alias("shard"))
    gap = big(F.col("shard").cast("long")) * F.col("_all") - big(F.col("_b")) * shards
    copy = F.greatest(F.ceil(gap / (big(F.col("_size")) * shards)).cast("long"), F.lit(0).cast("long"))
    spans = spans.withColumn("_copy", copy).where((F.col("_copy") < F.col("_n")) & (place(F.col("_copy")) == F.col("shard")))
    first = spans.groupBy("shard").agg(F.min(F.col("_r") + F.col("_copy")).alias("_first"))  # one row a shard
    rows = each_copy(run.select("_key", "_crc", "_size", "_n", "_b", "_r", "_all"), "_n", "_copy").select(
        "_key", "_crc", "_size", (F.col("_r") + F.col("_copy")).alias("_row"), place(F.col("_copy")).alias("shard"))
    return rows.join(F.broadcast(first), "shard").select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", out: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row: the shards' first (key, CRC) pairs, at most
    ``shards`` of them, are cut points, so the rows themselves do not move."""
    named = shard_rows(docs, shards, key, text)
    spot = F.struct(F.col(key).isNotNull().alias("k0"), F.col(key).alias("k1"), F.col("text_crc32").alias("k2"))
    cuts = named.groupBy("shard").agg(F.min(spot).alias("k")).select("shard", "k.*").orderBy("shard").collect()
    place = F.lit(cuts[0]["shard"] if cuts else 0)
    kind = docs.schema[key].dataType
    for c in cuts[1:]:
        edge = F.struct(F.lit(c["k0"]).alias("k0"), F.lit(c["k1"]).cast(kind).alias("k1"), F.lit(c["k2"]).cast("long").alias("k2"))
        here = F.struct(F.col(key).isNotNull().alias("k0"), F.col(key).alias("k1"), text_crc(text).alias("k2"))
        place = F.when(here >= edge, F.lit(c["shard"])).otherwise(place)
    return docs.withColumn(out, place.cast("int"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return shard_rows(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size FROM documents),
p AS (SELECT doc_id, size, CAST(sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS HUGEINT) - size AS prefix,
      CAST(sum(size) OVER () AS HUGEINT) AS total FROM d)
SELECT doc_id, size, CAST(prefix * {SHARDS} // total AS INTEGER) AS shard FROM p
"""
