"""Seeded shuffle, exact positions, splits and caps.

Randomness is an md5 of ``seed:key``, so every result is a function of the data and the seed
only (not of partitioning or task order), and DuckDB's ``md5`` gives the same bytes.

Positions use buckets that the data determine: leading hex digits of the md5, as many as the counts
ask for (a radix tree). Counts per top node and per bucket (map-side combined) give the position at
which each bucket starts; inside a bucket keys are numbered. Both readers of the input see the same
buckets whatever the plan prunes, replans or recomputes, and no key is hot. Only keys are sorted;
wide rows then meet their positions. Splits and caps need no numbering of all rows: the bucket in
which the cut falls is numbered on its own (key columns only), and the (hash, key) found there is
compared with every row in place.

``key`` must be unique (inside its group, for the grouped forms).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marksheet.session import BROADCAST_MAX_ROWS, materialized

BUCKET_DIGITS = 3
BUCKET_ROWS = 1 << 20


def shuffle_key(key: str | Column, seed: int = 42) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows ordered by ``md5(seed:key)``, then key (a distributed range sort)."""
    return df.withColumn("_h", shuffle_key(key, seed)).orderBy("_h", key).drop("_h")


def _bucketed(df: DataFrame, key: str, seed: int) -> DataFrame:
    h = df.withColumn("_h", shuffle_key(key, seed))
    return h.withColumn("_bucket", F.coalesce(F.substring("_h", 1, BUCKET_DIGITS), F.lit("")))  # null keys first


def _starts(df: DataFrame, group: list[str]) -> DataFrame:
    """(group, _bucket, _n, _off, _total): rows of each bucket, rows before it, rows of the group.
    At most 16 ** BUCKET_DIGITS + 1 rows a group."""
    counts = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*group, "_bucket", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                         F.sum("_n").over(Window.partitionBy(*group)).alias("_total"))


def _joined(df: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on null-safe equality; ``side`` has one row per value."""
    renamed = side.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in side.columns])
    cond = None
    for c in on:
        eq = F.col(c).eqNullSafe(F.col(f"__{c}"))
        cond = eq if cond is None else cond & eq
    return df.join(renamed, cond).drop(*[f"__{c}" for c in on])


def _leaves(keys: DataFrame, group: list[str], bound: int) -> DataFrame:
    """``keys`` (with ``_h``) plus ``_top``, ``_bucket`` and ``_before``: a radix tree over the hash.
    A top node is the first BUCKET_DIGITS digits; where its count asks for it, its rows go on to
    longer prefixes, so that a bucket holds about a quarter of ``bound`` rows. ``_before`` counts the
    group's rows in the top nodes before."""
    k = keys.withColumn("_top", F.coalesce(F.substring("_h", 1, BUCKET_DIGITS), F.lit("")))
    tops = k.groupBy(*group, "_top").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)
    more = F.greatest(F.ceil(F.log(F.col("_n") * 4.0 / bound) / F.log(F.lit(16.0))), F.lit(0)).cast("int")
    tops = tops.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    tops = tops.select(*group, "_top", "_before", (more + BUCKET_DIGITS).alias("_digits"))
    b = _joined(k, tops if group else F.broadcast(tops), [*group, "_top"])  # without groups: a row a top node
    return b.withColumn("_bucket", F.coalesce(F.expr("substring(_h, 1, _digits)"), F.lit(""))).drop("_digits")


def _numbered(keys: DataFrame, group: list[str], key: str, bound: int) -> DataFrame:
    """(group, key, _pos): positions in shuffled order, from two levels of prefix sums (top nodes,
    buckets inside a top node) and a numbering inside each bucket."""
    b = _leaves(keys, group, bound)
    counts = b.groupBy(*group, "_top", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    inner = Window.partitionBy(*group, "_top").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_top", "_bucket", F.coalesce(F.sum("_n").over(inner), F.lit(0)).alias("_off"))
    rows = _joined(b, starts, [*group, "_top", "_bucket"])
    inside = F.row_number().over(Window.partitionBy(*group, "_top", "_bucket").orderBy("_h", key))
    return rows.select(*group, key, (F.col("_before") + F.col("_off") + inside - 1).cast("long").alias("_pos"))


def _placed(df: DataFrame, group: list[str], key: str, seed: int, out_col: str, bound: int) -> DataFrame:
    keys = df.select(*group, key).withColumn("_h", shuffle_key(key, seed))
    pos = _numbered(keys, group, key, bound)
    if set(df.columns) == {*group, key}:
        return pos.withColumnRenamed("_pos", out_col)
    return _joined(df, pos.hint("shuffle_hash"), [*group, key]).withColumnRenamed("_pos", out_col)


def with_position(df: DataFrame, key: str, seed: int = 42, out_col: str = "pos", bound: int = BUCKET_ROWS) -> DataFrame:
    """Global 0-based position after the seeded shuffle. Only keys are sorted and numbered, in
    buckets of at most about ``bound`` rows; the wide rows then meet their positions, unsorted."""
    return _placed(df, [], key, seed, out_col, bound)


def group_positions(df: DataFrame, group: str, key: str, seed: int = 42, out_col: str = "rank", bound: int = BUCKET_ROWS) -> DataFrame:
    """W2 without a hot partition: 0-based position inside ``group`` after the seeded shuffle. A
    group is numbered bucket by bucket, so one that holds a third of the table is many tasks."""
    return _placed(df, [group], key, seed, out_col, bound)


def ordered_positions(df: DataFrame, order_cols: list, top: Column, rank: Column, text: str, out_col: str = "pos", bound: int = BUCKET_ROWS) -> DataFrame:
    """0-based position in the total order ``order_cols``, which is that of the strings ``rank`` (of
    one length), then of the distinct strings ``text``. ``top`` is a coarse form of ``rank`` with few values. Buckets are the ranks; where one holds more than ``bound``
    rows, they grow by two characters of ``text`` at a time until none does (one job a level; the
    overfull buckets are a written table of at most a row for ``bound`` rows)."""
    b = df.withColumn("_top", top).withColumn("_rank", rank).withColumn("_bucket", F.col("_rank"))
    length = 0
    while True:
        wide = b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound).select(F.col("_bucket").alias("_wide"))
        wide = materialized(wide, "overfull")
        if wide.isEmpty():
            break
        length += 2
        grown = F.concat("_rank", F.substring(text, 1, length))
        b = b.join(wide, F.col("_bucket") == F.col("_wide"), "left").withColumn("_bucket", F.when(F.col("_wide").isNotNull(), grown).otherwise(F.col("_bucket"))).drop("_wide")
    counts = b.groupBy("_top", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)
    tops = counts.groupBy("_top").agg(F.sum("_n").alias("_m")).select("_top", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_top").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_top", "_bucket", F.coalesce(F.sum("_n").over(inner), F.lit(0)).alias("_off"))
    rows = _joined(_joined(b, starts, ["_top", "_bucket"]), F.broadcast(tops), ["_top"])  # few top values
    inside = F.row_number().over(Window.partitionBy("_top", "_bucket").orderBy(*order_cols))
    return rows.withColumn(out_col, (F.col("_before") + F.col("_off") + inside - 1).cast("long")).select(*df.columns, out_col)


def _cut(b: DataFrame, key: str, first: Column) -> DataFrame:
    """One row with the (hash, key) of the last of the ``first`` rows in shuffled order (``first``
    may use _total), or no row if there is none. Only the bucket of the cut is numbered."""
    starts = _starts(b.select("_bucket"), []).withColumn("_first", first.cast("long"))
    at = starts.where((F.col("_off") < F.col("_first")) & (F.col("_first") <= F.col("_off") + F.col("_n")))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key))
    rows = _joined(b.select("_h", key, "_bucket"), F.broadcast(at.select("_bucket", "_off", "_first")), ["_bucket"])
    return rows.withColumn("_rn", inside).where(F.col("_off") + F.col("_rn") == F.col("_first")).select(_spot(key).alias("_cut"))


def _spot(key: str) -> Column:
    return F.struct(F.col("_h").alias("h"), F.col(key).alias("k"))


def holdout_split(df: DataFrame, ratio: float, key: str, seed: int = 42) -> DataFrame:
    """Exact hold-out of the first ``ceil(ratio * n)`` shuffled rows; adds ``split``.

    A ratio below 1e-5 means no hold-out. Disjoint and exhaustive by construction.
    """
    if abs(ratio) < 1e-5:
        return df.withColumn("split", F.lit("train"))
    b = _bucketed(df, key, seed)
    first = F.least(F.ceil(F.lit(float(ratio)) * F.col("_total")), F.col("_total"))
    cut = _cut(b, key, first).agg(F.max("_cut").alias("_cut"))
    held = b.withColumn("_cut", cut.scalar())
    return held.withColumn("split", F.when(F.col("_cut").isNotNull() & (_spot(key) <= F.col("_cut")), "val").otherwise("train")).drop("_cut", "_h", "_bucket")


def cap_rows(df: DataFrame, n: int | str | None, key: str, seed: int = 42) -> DataFrame:
    """The first ``n`` rows after the seeded shuffle (all rows when n is None or >= count).
    One way for all sizes: the rows up to the cut, found without moving them."""
    if n is None:
        return df
    n = int(n)
    if n <= 0:
        return df.limit(0)
    b = _bucketed(df, key, seed)
    cut = _cut(b, key, F.least(F.lit(n), F.col("_total"))).agg(F.max("_cut").alias("_cut"))
    return b.withColumn("_cut", cut.scalar()).where(_spot(key) <= F.col("_cut")).drop("_cut", "_h", "_bucket")


def cap_per_dataset(
    df: DataFrame, caps: DataFrame, key: str, seed: int = 42, group: str = "dataset_name", exempt: str | None = "math500"
) -> DataFrame:
    """P4 + J1: at most ``cap`` shuffled rows per dataset; the dataset named exactly ``exempt``,
    and datasets without a cap (absent from ``caps``, or a null cap), keep all their rows. Of several
    caps for one dataset the smallest holds.

    One way for all cap sizes. The keys and hashes are written once (one pass over the input). Per
    dataset, the bucket in which its cap falls is numbered (keys only) and gives the dataset's cut,
    one row; every row is then kept or dropped in place by comparison with its dataset's cut.
    """
    caps = caps.groupBy(F.col(group).alias("_capped")).agg(F.min(F.col("cap").cast("long")).alias("_cap")).where(F.col("_cap").isNotNull())
    if exempt is not None:
        caps = caps.where(F.col("_capped") != F.lit(exempt))
    small = F.broadcast if caps.count() <= BROADCAST_MAX_ROWS else (lambda df: df)  # cuts have a row a cap at most
    caps = small(caps)
    b = _bucketed(materialized(df.select(group, key), "cap-keys"), key, seed)
    starts = _starts(b.select(group, "_bucket"), [group]).join(caps, F.col(group) == F.col("_capped")).drop("_capped")
    at = starts.where((F.col("_off") < F.col("_cap")) & (F.col("_cap") <= F.col("_off") + F.col("_n"))).select(group, "_bucket", "_off", "_cap")
    inside = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_h", key))
    rows = _joined(b.select(group, "_h", key, "_bucket"), small(at), [group, "_bucket"]).withColumn("_rn", inside)
    cuts = rows.where(F.col("_off") + F.col("_rn") == F.col("_cap")).select(F.col(group).alias("_g"), _spot(key).alias("_cut"), F.lit(False).alias("_none"))
    # a cap of zero keeps nothing; a cap beyond the dataset's rows has no cut and keeps all
    empty = caps.where("_cap <= 0").select(F.col("_capped").alias("_g"), F.lit(None).alias("_cut"), F.lit(True).alias("_none"))
    cuts = small(cuts.unionByName(empty))
    rows = b.select(*df.columns, "_h") if set(df.columns) == {group, key} else df.withColumn("_h", shuffle_key(key, seed))
    out = rows.join(cuts, F.col(group) == F.col("_g"), "left")
    return out.where(F.col("_g").isNull() | ~F.col("_none") & (_spot(key) <= F.col("_cut"))).select(*df.columns)


def cap_per_category(df: DataFrame, n: int, key: str = "raw_id", seed: int = 42, category: str = "category") -> DataFrame:
    """P5: all rows of small categories, ``n`` shuffled rows of large ones (row_number <= n).

    The literal limit lets Catalyst put a partial ``WindowGroupLimit`` before the shuffle, so
    a category holding a third of the table sends at most ``n`` rows per map task.
    """
    h = df.withColumn("_h", shuffle_key(key, seed))
    w = Window.partitionBy(category).orderBy("_h", key)
    return h.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn", "_h")


def list_categories(df: DataFrame, category: str = "category") -> DataFrame:
    """P6."""
    return df.select(category).distinct()


def filter_category(df: DataFrame, value: str, category: str = "category") -> DataFrame:
    """P7."""
    return df.where(F.col(category) == F.lit(value))


def assign_batches(df: DataFrame, size: int, key: str, seed: int = 42) -> DataFrame:
    """Consecutive batches of ``size`` rows in shuffled order; the last one may be short."""
    pos = with_position(df, key, seed, "pos")
    return pos.withColumn("batch_id", F.floor(F.col("pos") / F.lit(size)).cast("long"))


def keep_derived(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop the source columns after derivation (column pruning reaches the scan)."""
    return df.select(*cols)


def concat_slices(*dfs: DataFrame) -> DataFrame:
    """O1: concatenation, duplicates kept."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out
