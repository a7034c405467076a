"""Positions, splits and caps against brute force on the driver (small fixtures)."""

import hashlib
import math

from pyspark.sql import functions as F

from marksheet.operators import sampling as P
from marksheet.session import read_table
from conftest import SF_LARGE, SF_MID, SF_SMALL


def _order(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


def test_with_position_matches_brute_force_and_partitioning(spark):
    d = read_table(spark, SF_MID, "documents").select("doc_id")
    expected = {k: i for i, k in enumerate(_order([r.doc_id for r in d.collect()]))}
    for parts in (1, 3, 8):
        got = {r.doc_id: r.pos for r in P.with_position(d.repartition(parts), "doc_id").collect()}
        assert got == expected


def test_positions_of_wide_rows_at_scale(spark):
    """All columns, 600,000 rows, with and without exchange reuse: positions are a permutation,
    batches are full, the split is exact."""
    d = read_table(spark, SF_LARGE, "lineitem").withColumn("line_id", F.monotonically_increasing_id()).cache()
    n = d.count()
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            pos = P.with_position(d, "line_id")
            assert tuple(pos.agg(F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()) == (n, 0, n - 1)
            split = {r.split: r["count"] for r in P.holdout_split(d, 0.5, "line_id").groupBy("split").count().collect()}
            assert split == {"val": math.ceil(0.5 * n), "train": n - math.ceil(0.5 * n)}
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
    sizes = P.assign_batches(d, 16, "line_id").groupBy("batch_id").count()
    assert sizes.where("count <> 16").count() <= 1
    ranks = P.group_positions(d, "l_returnflag", "line_id")
    assert ranks.select("l_returnflag", "rank").distinct().count() == n
    for cap in (10, 300_000):
        assert P.cap_rows(d, cap, "line_id").count() == cap
    caps = spark.createDataFrame([("A", 150_000), ("N", 200_000), ("R", 7)], "l_returnflag string, cap int")
    got = {r.l_returnflag: r["count"] for r in P.cap_per_dataset(d, caps, "line_id", group="l_returnflag", exempt=None).groupBy("l_returnflag").count().collect()}
    all_ = {r.l_returnflag: r["count"] for r in d.groupBy("l_returnflag").count().collect()}
    assert got == {"A": min(150_000, all_["A"]), "N": 200_000, "R": 7}
    d.unpersist()


def test_positions_plan_has_no_single_partition_of_rows(spark):
    d = read_table(spark, SF_MID, "documents")
    plan = P.with_position(d, "doc_id")._jdf.queryExecution().executedPlan().toString()
    # only the per-bucket counts meet in one partition
    assert plan.count("SinglePartition") <= 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_holdout_split_exact_disjoint_exhaustive(spark):
    d = read_table(spark, SF_MID, "documents").select("doc_id")
    s = P.holdout_split(d, 0.02, "doc_id").collect()
    n = len(s)
    val = {r.doc_id for r in s if r.split == "val"}
    assert len(val) == math.ceil(0.02 * n) and len(s) == n
    assert val == set(_order([r.doc_id for r in s])[: math.ceil(0.02 * n)])
    assert P.holdout_split(d, 0.0, "doc_id").where(F.col("split") == "val").count() == 0


def test_cap_rows_all_sizes(spark):
    d = read_table(spark, SF_MID, "documents").select("doc_id")
    keys = _order([r.doc_id for r in d.collect()])
    for n in (1, "37", 500, len(keys) - 1, len(keys), 10**9):
        assert {r.doc_id for r in P.cap_rows(d, n, "doc_id").collect()} == set(keys[: int(n)])
    assert P.cap_rows(d, 0, "doc_id").count() == 0 and P.cap_rows(d, None, "doc_id").count() == len(keys)


def test_sets_without_a_cap_stay_whole(spark):
    df = spark.range(300).select("id", F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("dataset_name"))
    caps = spark.createDataFrame([("A", 5), ("X", 1), ("N", None)], "dataset_name string, cap int")
    got = {r.dataset_name: r["count"] for r in P.cap_per_dataset(df, caps, "id").groupBy("dataset_name").count().collect()}
    assert got == {"A": 5, "N": 100, None: 100}


def test_cap_per_dataset_and_exemption(spark):
    d = read_table(spark, SF_SMALL, "documents").select("doc_id", F.col("source").alias("dataset_name"))
    rows = d.collect()
    names = sorted({r.dataset_name for r in rows})
    caps = spark.createDataFrame([(n, 3) for n in names[:-1]] + [(names[-1], 1)], "dataset_name string, cap int")
    got = P.cap_per_dataset(d, caps, "doc_id", exempt=names[0]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.dataset_name, []).append(r.doc_id)
    exp = set()
    for n, ks in by.items():
        ks = _order(ks)
        exp |= set(ks if n == names[0] else ks[: (1 if n == names[-1] else 3)])
    assert {r.doc_id for r in got} == exp


def test_cap_per_category_uses_partial_limit(spark):
    d = read_table(spark, SF_MID, "documents").select("doc_id", F.col("lang").alias("category"))
    c = P.cap_per_category(d, 5, "doc_id")
    assert c.groupBy("category").count().where("count > 5").count() == 0
    assert "WindowGroupLimit" in c._jdf.queryExecution().executedPlan().toString()


def test_assign_batches(spark):
    d = read_table(spark, SF_SMALL, "documents").select("doc_id")
    b = P.assign_batches(d, 8, "doc_id").collect()
    sizes = {}
    for r in b:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    n = len(b)
    assert all(v == 8 for k, v in sizes.items() if k < max(sizes)) and sum(sizes.values()) == n


def test_hot_group_spreads_over_tasks(spark):
    """A dataset holding a third of all rows must not land in one task."""
    n = 30000
    df = spark.range(n).select(F.col("id").cast("string").alias("raw_id"),
                               F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), (F.col("id") % 50).cast("string"))).alias("dataset_name"))
    ranks = P.group_positions(df, "dataset_name", "raw_id").where(F.col("dataset_name") == "hot")
    assert P._bucketed(df.where("dataset_name = 'hot'"), "raw_id", 42).groupBy("_bucket").count().agg(F.max("count")).first()[0] < n / 300
    got = sorted(r.rank for r in ranks.select("rank").collect())
    assert got == list(range(n // 3))
    caps = spark.createDataFrame([("hot", 5)] + [(f"d{i}", 2) for i in range(50)], "dataset_name string, cap int")
    capped = P.cap_per_dataset(df, caps, "raw_id", exempt=None)
    assert capped.where(F.col("dataset_name") == "hot").count() == 5
