"""Operator 10: mixing sources to target weights by pivotal dependent rounding.

Targets: the sources, in code point order with null last, weigh 5, 2, 1, repeating, and share
``SHARE`` times all sizes; a target stops at ``MOST`` times its source's size and the excess goes
to the others by weight until none is above (solved at once over the sources sorted by the ratio
at which they fill up). A document of a source expects target / source size copies.

Rounding: each document gets the whole copies; the fractions are rounded dependently. Two
fractional documents meet; mass moves at random, keeping both expectations, until one of them is
integral, and the other goes on. Documents of one source and similar size meet in blocks of
about ``BLOCK`` (a fold over a bounded array); each block leaves at most one fractional document,
and these meet in the next level of a reduction tree, until each source has one left, which is
rounded by its own chance. So every source's copies are within one of their expected number, and
as partners have similar sizes, its words come near its target.

Scale: narrow rows only; blocks are dealt by a hash of the row within (source, size class), as
many as counts demand, so a source that is a third of the table is many blocks, and equal rows
are one unit with a count. The tree has log_BLOCK(rows) levels, each a small job. The target
table has one row a source. No Python. Random draws are hashes of (seed, level, both units):
reruns agree.

Defined results: null text has no words; size-0 rows take no words however often they are drawn.
A null source is a source of its own. Null ids are units like others. Sources whose size is zero
have target zero. Repeated rows share their copies evenly. Extra columns are ignored by ``mix``
and kept by ``mixed_rows``. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from marksheet.llm.scratch import each_copy, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BLOCK = 512
EPS = 1e-9


def word_count(text: str = "text") -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row a source
    w = sizes.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), ((place - 1) % len(WEIGHTS) + 1).cast("int")))
    w = w.withColumn("cap", MOST * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("w"))
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    w = w.withColumn("left", SHARE * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("level", F.col("left") / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("rate", F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "level"))).over(Window.partitionBy())["level"])
    return w.select("source", "source_size", F.when(F.col("fill") > F.col("level"), F.col("w") * F.col("rate")).otherwise(
        F.least(F.col("cap"), F.col("w") * F.coalesce("rate", F.col("fill")))).cast("double").alias("target"))


def _fold(units: Column, level: int, seed: int) -> Column:
    """One block: (done, rest). ``units`` is an array of structs with a fraction ``p``; ``done``
    has them with ``extra`` 0 or 1, ``rest`` the one that is still fractional, or null."""
    unit = "struct<id:bigint,size:bigint,crc:bigint,n:bigint,whole:bigint,p:double>"
    done = "struct<id:bigint,size:bigint,crc:bigint,n:bigint,whole:bigint,p:double,extra:bigint>"

    def close(u: Column, extra) -> Column:
        return F.array(F.struct(u["id"].alias("id"), u["size"].alias("size"), u["crc"].alias("crc"), u["n"].alias("n"), u["whole"].alias("whole"),
                                u["p"].alias("p"), F.lit(extra).cast("long").alias("extra")))

    def go_on(u: Column, p: Column) -> Column:
        return F.struct(u["id"].alias("id"), u["size"].alias("size"), u["crc"].alias("crc"), u["n"].alias("n"), u["whole"].alias("whole"), p.alias("p"))

    def step(acc: Column, u: Column) -> Column:
        a, both = acc["rest"], acc["rest"]["p"] + u["p"]
        chance = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), a["id"], a["crc"], a["size"], u["id"], u["crc"], u["size"]), F.lit(1 << 40)) / F.lit(float(1 << 40))
        # below one: one of them takes all the mass; else one of them becomes 1
        first = F.when(both <= 1, chance * both < a["p"]).otherwise(chance * (2 - both) < 1 - u["p"])
        win, lose = F.when(first, a).otherwise(u), F.when(first, u).otherwise(a)
        low = F.struct(F.when(both >= 1 - EPS, F.lit(None).cast(unit)).otherwise(go_on(win, both)).alias("rest"),
                       F.when(both >= 1 - EPS, F.concat(close(win, 1), close(lose, 0))).otherwise(close(lose, 0)).alias("out"))
        high = F.struct(go_on(lose, both - 1).alias("rest"), close(win, 1).alias("out"))
        moved = F.when(both <= 1 + EPS, low).otherwise(high)
        return F.when((u["p"] < EPS) | (u["p"] > 1 - EPS), F.struct(a.alias("rest"), F.concat(acc["done"], close(u, 0)).alias("done"))) \
            .when(a.isNull(), F.struct(u.alias("rest"), acc["done"].alias("done"))) \
            .otherwise(F.struct(moved["rest"].alias("rest"), F.concat(acc["done"], moved["out"]).alias("done")))

    start = F.struct(F.lit(None).cast(unit).alias("rest"), F.array().cast(f"array<{done}>").alias("done"))
    return F.aggregate(units, start, step)


def mix(docs: DataFrame, seed: int = 42, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, crc, n, whole, extra, source_size, target): a row for every distinct
    (key, source, size, text CRC); ``n`` equal rows share n * whole + extra copies."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), crc.alias("crc"))
    units = written(rows.groupBy("id", "source", "size", "crc").agg(F.count(F.lit(1)).alias("n")), "mix-units")
    units = units.withColumn("class", F.floor(4 * F.log2(F.col("size") + 1.0)).cast("int"))
    counts = units.groupBy("source", "class").agg(F.count(F.lit(1)).alias("in_class"), F.sum(F.col("size") * F.col("n")).alias("words"))
    goal = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")))
    classes = counts.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select(
        F.col("c.source").alias("_s"), F.col("class").alias("_class"), "in_class", "source_size", "target")
    full = units.join(classes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_class"))).drop("_s", "_class")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # n equal rows expect n * rate copies: `whole` for each, and a remainder for the unit
    mean = F.col("n") * rate
    full = full.withColumn("whole", F.floor(mean + EPS).cast("long")).withColumn("p", F.greatest(mean - F.col("whole"), F.lit(0.0)))
    hash_ = F.xxhash64(F.lit(seed), "id", "crc", "size")
    level0 = full.withColumn("block", F.pmod(hash_, F.ceil(F.col("in_class") / BLOCK))).select(
        "source", "source_size", "target", "class", "block", F.struct("id", "size", "crc", "n", "whole", "p").alias("u"))
    groups, out, level = ["source", "source_size", "target", "class", "block"], None, 0
    cur = level0
    while True:
        folded = cur.groupBy(*groups).agg(F.array_sort(F.collect_list("u"), _by_size).alias("us")) \
            .select(*groups, _fold(F.col("us"), level, seed).alias("f"))
        folded = written(folded, "mix-level")
        part = folded.select("source", "source_size", "target", F.explode("f.done").alias("u"))
        out = part if out is None else out.unionByName(part)
        rest = folded.where("f.rest is not null").select("source", "source_size", "target", F.col("f.rest").alias("u"))
        most = rest.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        level += 1
        if most <= 1:
            break
        per = rest.groupBy("source", F.floor(F.log2(F.col("u.size") + 1.0)).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("m")) \
            if most > BLOCK else rest.groupBy("source", F.lit(0).alias("class")).agg(F.count(F.lit(1)).alias("m"))
        klass = F.floor(F.log2(F.col("u.size") + 1.0)).cast("int") if most > BLOCK else F.lit(0)
        per = per.select(F.col("source").alias("_s"), F.col("class").alias("_c"), "m")
        rest = rest.withColumn("class", klass)
        cur = rest.join(per, F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c"))) \
            .withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), F.col("u.id"), F.col("u.crc"), F.col("u.size")), F.ceil(F.col("m") / BLOCK))) \
            .select(*groups, "u")
    last_draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), F.col("u.id"), F.col("u.crc"), F.col("u.size")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    last = rest.select("source", "source_size", "target", F.struct("u.*", (last_draw < F.col("u.p")).cast("long").alias("extra")).alias("u"))
    return out.unionByName(last).select("source", "source_size", "target", "u.*")


def _by_size(a: Column, b: Column) -> Column:
    """Neighbours have similar sizes; equal sizes in the order of a hash."""
    ha, hb = F.xxhash64(a["id"], a["crc"]), F.xxhash64(b["id"], b["crc"])
    return F.when(a["size"] < b["size"], -1).when(a["size"] > b["size"], 1).when(ha < hb, -1).when(ha > hb, 1).otherwise(0)


def copies_each(mixed: DataFrame) -> DataFrame:
    """One row per input row: ``copies`` of each, the unit's copies spread evenly."""
    total = F.col("whole") + F.col("extra")
    each = each_copy(mixed, "n", "k")
    return each.withColumn("copies", F.floor(((F.col("k") + 1) * total) / F.col("n")) - F.floor((F.col("k") * total) / F.col("n")))


def mixed_rows(docs: DataFrame, seed: int = 42, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it was drawn. Rows of equal
    key, source and text share their copies evenly, whatever their other columns hold."""
    drawn = mix(docs, seed, key, text, source).select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("crc").alias("_crc"), F.col("size").alias("_size"),
                                                     F.col("n").alias("_n"), (F.col("whole") + F.col("extra")).alias("_total")).where("_total > 0")
    drawn = written(drawn, "drawn")
    unit = ["_id", "_source", "_crc", "_size"]
    rows = docs.withColumn("_c", F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))).withColumn("_s", word_count(text))
    same = F.col(key).cast("long").eqNullSafe(F.col("_id")) & F.col(source).eqNullSafe(F.col("_source")) & (F.col("_c") == F.col("_crc")) & (F.col("_s") == F.col("_size"))
    once = rows.join(drawn.where("_n = 1"), same).select(*docs.columns, F.col("_total").alias("_copies"))
    if drawn.where("_n > 1").isEmpty():  # every unit is one row
        return each_copy(once, "_copies", "_k").select(*docs.columns)
    # a unit of several rows: its copies are spread evenly over the rows, equal rows being one with a count.
    # Rows stand in the order of a hash of all their columns, numbered in buckets of it.
    whole = F.xxhash64(*[F.to_json(c) if isinstance(docs.schema[c].dataType, MapType) else F.col(c) for c in docs.columns])
    many = rows.join(drawn.where("_n > 1"), same).withColumn("_row", whole)
    kinds = written(many.groupBy(*unit, "_n", "_total", "_row").agg(F.count(F.lit(1)).alias("_m")).withColumn("_bucket", F.pmod("_row", F.lit(4096))), "row-kinds")
    before = Window.partitionBy(*unit).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*unit, "_bucket").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    starts = kinds.groupBy(*unit, "_bucket").agg(F.sum("_m").alias("_k")).select(*unit, "_bucket", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"))
    starts = starts.select(*[F.col(c).alias(f"s{c}") for c in [*unit, "_bucket"]], "_start")
    placed = kinds.withColumn("_in", F.coalesce(F.sum("_m").over(inside), F.lit(0))).join(
        starts, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"s{c}")) for c in [*unit, "_bucket"]]))
    copies = F.expr("((_start + _in + _m) * _total) div _n") - F.expr("((_start + _in) * _total) div _n")
    placed = placed.select(*[F.col(c).alias(f"k{c}") for c in [*unit, "_row"]], copies.alias("_copies")).where("_copies > 0")
    one = many.select(*docs.columns, *unit, "_row").dropDuplicates([*unit, "_row"])
    more = one.join(placed, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"k{c}")) for c in [*unit, "_row"]])).select(*docs.columns, "_copies")
    return each_copy(once.unionByName(more), "_copies", "_k").select(*docs.columns)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return copies_each(mix(docs)).select(F.col("id").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target",
                                         (F.col("copies") * F.col("size")).cast("long").alias("taken"))
