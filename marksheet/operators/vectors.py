"""Vector-table operators: pooling, routing against a bank, load balance, penalties.

A bank (the candidate vectors items are routed to) reaches the rows as values of scalar subqueries
(evaluated once, shipped to the tasks: no join, no pairs), in parts of at most ``PART_BYTES``.
Items keep a buffer of their k best entries; a bank of several parts is one pass over the items
each, so its size has no limit. Inside a part, entries form tiles in order of falling norm; a tile
whose largest norm cannot lift any entry above an item's k-th best is passed over (Cauchy-Schwarz).
Items never leave their partition. Aggregations over items (pooling, Gram matrices, load) use
Spark's vector summarizer or hash aggregation with partial combine, so hot groups cost one partial
row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marksheet.session import materialized, scratch_path

PART_BYTES = 32 << 20
TILE = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def squared(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)


def bank_entries(bank: DataFrame) -> DataFrame:
    """(bank_id, vec, bias), typed."""
    bias = F.coalesce(F.col("bias").cast("double"), F.lit(0.0)) if "bias" in bank.columns else F.lit(0.0)
    return bank.select(F.col("bank_id").cast("long").alias("bank_id"), F.col("vec").cast("array<double>").alias("vec"), bias.alias("bias"))


def in_parts(entries: DataFrame, vectors: list[str], fields: list, part_bytes: int = PART_BYTES, form=lambda entries: entries) -> list[Column]:
    """The entries as scalar values (arrays of ``fields``, sorted by them and put into ``form``), each
    of about ``part_bytes`` at most. The parts are a written table; a part is one row of it."""
    width = reduce(lambda x, y: x + y, [F.coalesce(F.max(F.size(c)), F.lit(0)) for c in vectors])
    n, d = entries.agg(F.count(F.lit(1)), width).first()
    parts = max(1, -(-n * max(1, d) * 8 // part_bytes))
    part = F.pmod(F.xxhash64("bank_id"), F.lit(parts)).alias("part")
    rows = entries.select(part, F.struct(*fields).alias("e")).groupBy("part").agg(F.sort_array(F.collect_list("e")).alias("entries"))
    rows = rows.select("part", form(F.col("entries")).alias("entries"))
    table = materialized(rows, "bank") if parts > 1 else rows
    return [table.where(F.col("part") == p).select("entries").scalar() for p in range(parts)]


def in_tiles(entries: Column, tile: int) -> Column:
    """A part (sorted by falling norm) cut into tiles with their largest norm and largest bias."""
    def cut(t):
        own = F.slice(entries, t * tile + 1, F.lit(tile))
        return F.struct((-own[0]["fall"]).alias("norm"), F.array_max(F.transform(own, lambda e: e["bias"])).alias("bias"), own.alias("entries"))
    count = F.ceil(F.size(entries) / F.lit(tile)).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda t: t < count), cut)


def bank_scores(items: DataFrame, bank: DataFrame, vec_col: str = "vec", part_bytes: int = PART_BYTES) -> DataFrame:
    """V3 (array form): ``scores`` = (bank_id, logit = x . v, bias) of every entry, by id."""
    parts = in_parts(bank_entries(bank), ["vec"], ["bank_id", "vec", "bias"], part_bytes)
    out = items.withColumn("scores", F.array().cast("array<struct<bank_id:bigint,logit:double,bias:double>>"))
    for k, part in enumerate(parts):
        scored = F.transform("_part", lambda b: F.struct(b["bank_id"].alias("bank_id"), dot(F.col(vec_col), b["vec"]).alias("logit"), b["bias"].alias("bias")))
        empty = F.array().cast("array<struct<bank_id:bigint,vec:array<double>,bias:double>>")
        out = out.withColumn("_part", F.coalesce(part, empty)).withColumn("scores", F.concat("scores", scored)).drop("_part")
        if k + 1 < len(parts):
            out = materialized(out, "scored")
    return out.withColumn("scores", F.sort_array("scores")) if len(parts) > 1 else out


def score_against_bank(items: DataFrame, bank: DataFrame, key: str = "item_id", vec_col: str = "vec", slot: int = 0, part_bytes: int = PART_BYTES) -> DataFrame:
    """V3 (long form): rows ``(item_id, slot, bank_id, logit)``."""
    s = bank_scores(items.select(key, vec_col), bank, vec_col, part_bytes)
    return s.select(key, F.lit(slot).alias("slot"), F.inline(F.transform("scores", lambda x: F.struct(
        x["bank_id"].alias("bank_id"), x["logit"].alias("logit")))))


def logits_per_item(items: DataFrame, bank: DataFrame, key: str = "item_id", vec_col: str = "vec", slot: int = 0, part_bytes: int = PART_BYTES) -> DataFrame:
    """V3, one row per item and slot: ``(item_id, slot, logits)`` in order of the bank's ids."""
    s = bank_scores(items.select(key, vec_col), bank, vec_col, part_bytes)
    return s.select(key, F.lit(slot).alias("slot"), F.transform("scores", lambda x: x["logit"]).alias("logits"))


def topk_per_row(arr: Column, k: int, score=lambda x: x["logit"] + x["bias"], ident=lambda x: x["bank_id"]) -> Column:
    """K2: the ``k`` best elements by score desc, ties by lowest id."""
    def cmp(a, b):
        sa, sb = score(a), score(b)
        return (F.when(sa > sb, -1).when(sa < sb, 1)
                .when(ident(a) < ident(b), -1).when(ident(a) > ident(b), 1).otherwise(0))
    return F.slice(F.array_sort(arr, cmp), 1, k)


def softmax_weights(chosen: Column, temperature: float = 1.0) -> Column:
    """V5: softmax of the unbiased chosen logits / temperature (max-shifted)."""
    z = F.transform(chosen, lambda c: c["logit"] / F.lit(temperature))
    m = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / s)


_BUFFER = "array<struct<bank_id:bigint,logit:double,bias:double,tile:int,place:int>>"
_CHOSEN = "array<struct<bank_id:bigint,logit:double,bias:double,vec:array<double>>>"


def _best_of(vec: Column, norm: Column, tiles: Column, buffer: Column, k: int) -> Column:
    """The k best of ``buffer`` and the entries of all tiles; ties to the lowest id."""
    def meet(acc, tile, t):
        new = F.transform(tile["entries"], lambda b, i: F.struct(
            b["bank_id"].alias("bank_id"), dot(vec, b["vec"]).alias("logit"), b["bias"].alias("bias"), t.alias("tile"), i.alias("place")))
        last = F.element_at(acc, k)
        # strictly below: an entry that ties with the last one may have a lower id
        out_of_reach = (F.size(acc) >= k) & (norm * tile["norm"] * (1 + 1e-9) + tile["bias"] < last["logit"] + last["bias"])
        return F.when(out_of_reach, acc).otherwise(topk_per_row(F.concat(acc, new), k).cast(_BUFFER))
    numbered = F.transform(tiles, lambda x, t: F.struct(x.alias("x"), t.alias("t")))
    return F.aggregate(numbered, buffer.cast(_BUFFER), lambda acc, n: meet(acc, n["x"], n["t"]))


def route_topk(items: DataFrame, bank: DataFrame, k: int, temperature: float = 1.0, key: str = "item_id",
               vec_col: str = "vec", slot: int = 0, part_bytes: int = PART_BYTES, tile: int = TILE) -> DataFrame:
    """V4 + V5 (array form): ``chosen`` = top-k entries by logit + bias with softmax ``weight``. Banks
    of any size: each part of the bank is one pass that carries the items' k best entries."""
    fall = (-F.sqrt(squared(F.col("vec")))).alias("fall")
    parts = in_parts(bank_entries(bank), ["vec"], [fall, "bank_id", "vec", "bias"], part_bytes, lambda e: in_tiles(e, tile))
    out = items.select(key, vec_col, F.array().cast(_CHOSEN).alias("_best"))
    for p, part in enumerate(parts):
        none = F.array().cast("array<struct<norm:double,bias:double,entries:array<struct<fall:double,bank_id:bigint,vec:array<double>,bias:double>>>>")
        tiled = out.withColumn("_tiles", F.coalesce(part, none)).withColumn("_norm", F.sqrt(squared(F.col(vec_col))))
        held = F.transform("_best", lambda c, i: F.struct(c["bank_id"].alias("bank_id"), c["logit"].alias("logit"), c["bias"].alias("bias"), F.lit(-1).alias("tile"), i.alias("place")))
        s = tiled.withColumn("_c", _best_of(F.col(vec_col), F.col("_norm"), F.col("_tiles"), held, k))
        # the sort moves ids and scores only; the chosen entries' vectors are looked up afterwards
        found = F.transform("_c", lambda c: F.struct(c["bank_id"].alias("bank_id"), c["logit"].alias("logit"), c["bias"].alias("bias"), F.when(
            c["tile"] < 0, F.get("_best", c["place"])["vec"]).otherwise(F.get(F.get("_tiles", c["tile"])["entries"], c["place"])["vec"]).alias("vec")))
        out = s.select(key, vec_col, found.alias("_best"))
        if p + 1 < len(parts):
            out = materialized(out, "best-so-far")
    full = F.when(F.size("_best") >= k, F.col("_best")).otherwise(F.raise_error(F.lit("topk cannot exceed bank size")))
    s = out.withColumn("_c", full)
    routed = F.zip_with("_c", softmax_weights(F.col("_c"), temperature), lambda c, wt: F.struct(
        c["bank_id"].alias("bank_id"), c["logit"].alias("logit"), wt.alias("weight"), c["vec"].alias("vec")))
    return s.select(key, vec_col, F.lit(slot).alias("slot"), routed.alias("chosen"))


def route_given_logits(items: DataFrame, k: int, temperature: float = 1.0, key: str = "item_id", logits_col: str = "logits",
                       bias: list[float] | None = None) -> DataFrame:
    """V4 + V5 over given logits with several slots per item: ``logits_col`` holds one array of
    bank logits per slot (bank ids are the positions); ``bias`` has one value per bank entry.
    One row per (item, slot), ``chosen`` as in ``route_topk`` without the vectors."""
    offsets = F.array(*[F.lit(float(b)) for b in bias]) if bias else None
    rows = items.select(key, F.posexplode(logits_col).alias("slot", "_l"))
    entries = F.transform("_l", lambda x, i: F.struct(
        i.cast("long").alias("bank_id"), x.cast("double").alias("logit"), (F.get(offsets, i) if bias else F.lit(0.0)).alias("bias")))
    best = F.when(F.size("_l") >= k, topk_per_row(entries, k)).otherwise(F.raise_error(F.lit("topk cannot exceed bank size")))
    rows = rows.select(key, "slot", best.alias("_c"))
    routed = F.zip_with("_c", softmax_weights(F.col("_c"), temperature), lambda c, w: F.struct(
        c["bank_id"].alias("bank_id"), c["logit"].alias("logit"), w.alias("weight")))
    return rows.select(key, "slot", routed.alias("chosen"))


def routes(routed: DataFrame, key: str = "item_id") -> DataFrame:
    """V4/V5 long form: ``(item_id, slot, rank, bank_id, logit, weight)``."""
    return routed.select(key, "slot", F.posexplode(F.transform("chosen", lambda c: F.struct(
        c["bank_id"].alias("bank_id"), c["logit"].alias("logit"), c["weight"].alias("weight")))).alias("rank", "r")).select(
        key, "slot", "rank", "r.bank_id", "r.logit", "r.weight")


def combine(routed: DataFrame, key: str = "item_id", out_col: str = "combined") -> DataFrame:
    """V6: weighted sum of the chosen bank vectors, per item and slot (row-local)."""
    def add(acc, c):
        return F.zip_with(acc, c["vec"], lambda a, v: a + c["weight"] * v)
    d = F.size(F.element_at("chosen", 1)["vec"])
    init = F.array_repeat(F.lit(0.0), d)
    return routed.select(key, "slot", F.aggregate("chosen", init, add).alias(out_col))


def bank_load(route_rows: DataFrame, bank: DataFrame) -> DataFrame:
    """V7: selections per bank entry, entries never chosen kept with 0."""
    load = route_rows.groupBy("bank_id").agg(F.count(F.lit(1)).alias("load"))
    return bank.select("bank_id").join(load, "bank_id", "left").select("bank_id", F.coalesce("load", F.lit(0)).cast("long").alias("load"))


def rebalance(load: DataFrame, bias: DataFrame | None = None, gamma: float = 1e-4, tol: float = 0.05,
              max_abs: float | None = None) -> DataFrame:
    """V8: one bias update: over-used entries -gamma, under-used +gamma, optional clamp.

    target = total selections / entries, from a one-row aggregate joined back by broadcast.
    """
    b = load if bias is None else load.join(bias.select("bank_id", "bias"), "bank_id", "left")
    if "bias" not in b.columns:
        b = b.withColumn("bias", F.lit(0.0))
    t = b.agg((F.sum("load") / F.count(F.lit(1))).cast("double").alias("target"))
    b = b.withColumn("target", t.scalar())
    step = (F.when(F.col("load") > F.col("target") * (1 + tol), -gamma)
            .when(F.col("load") < F.col("target") * (1 - tol), gamma).otherwise(0.0))
    nb = F.coalesce(F.col("bias"), F.lit(0.0)) + step
    if max_abs is not None:
        nb = F.least(F.greatest(nb, F.lit(-max_abs)), F.lit(max_abs))
    return b.select("bank_id", "load", "target", nb.alias("bias"))


# ------------------------------------------------------------------ pooling (V1, V2)

def mean_pool(df: DataFrame, group: str, vec_col: str = "vec", out_col: str = "mean") -> DataFrame:
    """V1: element-wise mean per group (vector summarizer, partial aggregation)."""
    v = array_to_vector(F.col(vec_col).cast("array<double>"))
    return df.groupBy(group).agg(vector_to_array(Summarizer.mean(v)).alias(out_col))


def mean_max_pool(df: DataFrame, group: str, vec_col: str = "vec", out_col: str = "pooled") -> DataFrame:
    """V2: mean concatenated with element-wise max, per group."""
    v = array_to_vector(F.col(vec_col).cast("array<double>"))
    g = df.groupBy(group).agg(vector_to_array(Summarizer.mean(v)).alias("_m"), vector_to_array(Summarizer.max(v)).alias("_x"))
    return g.select(group, F.concat("_m", "_x").alias(out_col))


# ------------------------------------------------------------------ penalties

def gaussian_kl(latents: DataFrame, beta: float = 1.0, free_bits: float | None = None) -> DataFrame:
    """V9: clamp mu, logvar to [-10, 10]; sum over dims of -0.5(1 + lv - mu^2 - e^lv); mean over
    rows; times beta. ``free_bits`` is accepted and ignored, as in the original."""
    def term(m, lv):
        m = F.least(F.greatest(m, F.lit(-10.0)), F.lit(10.0))
        lv = F.least(F.greatest(lv, F.lit(-10.0)), F.lit(10.0))
        return F.lit(-0.5) * (F.lit(1.0) + lv - m * m - F.exp(lv))
    per_row = F.aggregate(F.zip_with("mu", "logvar", term), F.lit(0.0), lambda a, v: a + v)
    return latents.agg((F.avg(per_row) * F.lit(beta)).alias("kl"))


def vector_mse(df: DataFrame, a_col: str, b_col: str, beta: float = 1.0) -> DataFrame:
    """Mean over all elements of (a - b)^2, times beta."""
    sq = F.aggregate(F.zip_with(a_col, b_col, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    return df.agg((F.try_divide(F.sum(sq), F.sum(F.size(a_col)).cast("double")) * F.lit(beta)).alias("mse"))


GRAM_TILE = 64
GRAM_SIDE = 15  # tiles a side at most: 120 in the upper half


def gram_tiles(rows: DataFrame, vec_col: str = "vec", tile: int = GRAM_TILE) -> DataFrame:
    """Upper half of the Gram matrix (sum over rows of outer(x, x)) in tiles: (bi, bj, side, d, part),
    ``part`` the tile's values row by row. A row yields one tile product at a time, never a whole
    outer product; a task keeps one partial sum per tile."""
    v = rows.select(F.col(vec_col).cast("array<double>").alias("v"))
    side = F.greatest(F.lit(tile), F.ceil(F.size("v") / GRAM_SIDE).cast("int"))
    v = v.withColumn("side", side).withColumn("n", F.ceil(F.size("v") / F.col("side")).cast("int")).where("n > 0")
    v = v.select("v", "side", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bi"))
    v = v.select("v", "side", "bi", F.explode(F.sequence("bi", F.col("n") - 1)).alias("bj"))
    own = F.slice("v", F.col("bi") * F.col("side") + 1, F.col("side"))
    other = F.slice("v", F.col("bj") * F.col("side") + 1, F.col("side"))
    v = v.select("bi", "bj", "side", F.size("v").alias("d"), own.alias("own"), other.alias("other"))
    product = F.flatten(F.transform("own", lambda a: F.transform("other", lambda b: a * b)))
    return v.groupBy("bi", "bj").agg(F.max("side").alias("side"), F.max("d").alias("d"), vector_to_array(Summarizer.sum(array_to_vector(product))).alias("part"))


def _tile_cells(tiles: DataFrame) -> DataFrame:
    width = F.least(F.col("side"), F.col("d") - F.col("bj") * F.col("side"))
    cells = tiles.select("bi", "bj", "side", width.alias("w"), F.posexplode("part").alias("cell", "value"))
    i, j = F.col("bi") * F.col("side") + F.floor(F.col("cell") / F.col("w")), F.col("bj") * F.col("side") + F.col("cell") % F.col("w")
    return cells.select("bi", "bj", i.cast("int").alias("i"), j.cast("int").alias("j"), "value")


def gram(rows: DataFrame, vec_col: str = "vec", tile: int = GRAM_TILE) -> DataFrame:
    """Gram matrix as ``(i, j, value)``: the tiles of the upper half, and those below the diagonal
    mirrored."""
    cells = _tile_cells(gram_tiles(rows, vec_col, tile))
    below = F.when(F.col("bi") < F.col("bj"), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).otherwise(F.array(F.struct("i", "j")))
    return cells.select(F.explode(below).alias("p"), "value").select("p.i", "p.j", "value")


def orthogonality_penalty(u_rows: DataFrame, v_rows: DataFrame, beta: float = 1.0, vec_col: str = "vec", tile: int = GRAM_TILE) -> DataFrame:
    """Beta * (||G_U - I||_F^2 + ||G_V - I||_F^2), G = sum over rows of outer products."""
    def frob(rows):
        g = _tile_cells(gram_tiles(rows, vec_col, tile))
        diff = F.col("value") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
        return g.agg(F.sum(diff * diff * F.when(F.col("bi") < F.col("bj"), 2.0).otherwise(1.0)).alias("f"))  # both halves
    fu = frob(u_rows).withColumnRenamed("f", "frob_u")
    fv = frob(v_rows).select(F.col("f").alias("frob_v"))
    return fu.withColumn("frob_v", fv.scalar()).select(
        "frob_u", "frob_v", ((F.col("frob_u") + F.col("frob_v")) * F.lit(beta)).alias("penalty"))


# ------------------------------------------------------------------ sampling and projection

def _uniform(seed: int, item: Column, pos: Column, salt: str) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), item.cast("string"), pos.cast("string"), F.lit(salt)))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def gaussian_sample(latents: DataFrame, seed: int = 42, key: str = "item_id", out_col: str = "z") -> DataFrame:
    """``mu + exp(logvar / 2) * eps`` with eps from hash-seeded Box-Muller, so the draw
    depends on (seed, item, position) only, not on partitioning."""
    item = F.col(key)

    def draw(m, lv, i):
        u1 = _uniform(seed, item, i, "a")
        u2 = _uniform(seed, item, i, "b")
        eps = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2)
        return m + F.exp(lv * 0.5) * eps

    z = F.transform(F.arrays_zip(F.col("mu").alias("m"), F.col("logvar").alias("lv")), lambda x, i: draw(x["m"], x["lv"], i))
    return latents.select(key, z.alias(out_col))


def project(items: DataFrame, down: DataFrame, up: DataFrame, scale: float, key: str = "item_id",
            vec_col: str = "vec", part_bytes: int = PART_BYTES) -> DataFrame:
    """``scale * A(Bx)``: ``down`` holds the rows of B (rank_id, vec over inputs), ``up`` the
    columns of A (rank_id, vec over outputs). Factors of any size: each part of them is one pass
    that adds to the items' sums."""
    factors = down.select(F.col("rank_id").cast("long").alias("bank_id"), F.col("vec").cast("array<double>").alias("b")).join(
        up.select(F.col("rank_id").cast("long").alias("bank_id"), F.col("vec").cast("array<double>").alias("a")), "bank_id")
    parts = in_parts(factors, ["a", "b"], ["bank_id", "b", "a"], part_bytes)
    out = items.select(key, vec_col, F.array().cast("array<double>").alias("_y"))
    for p, part in enumerate(parts):
        none = F.array().cast("array<struct<bank_id:bigint,b:array<double>,a:array<double>>>")
        out = out.withColumn("_part", F.coalesce(part, none))
        terms = F.transform("_part", lambda f: F.struct(f["a"].alias("v"), dot(F.col(vec_col), f["b"]).alias("c")))
        start = F.when(F.size("_y") > 0, F.col("_y")).otherwise(F.array_repeat(F.lit(0.0), F.coalesce(F.size(F.get("_part", F.lit(0))["a"]), F.lit(0))))
        y = F.aggregate(terms, start, lambda acc, z: F.zip_with(acc, z["v"], lambda s, v: s + z["c"] * v))
        out = out.select(key, vec_col, y.alias("_y"))
        if p + 1 < len(parts):
            out = materialized(out, "projected")
    return out.select(key, F.transform("_y", lambda v: v * F.lit(scale)).alias("projected"))


BLOCK_BYTES = 16 << 20
_OPEN = "block long, batch_id long, n long, ids array<long>, bias array<double>, sure array<int>, free array<int>, entry array<int>, logit array<double>"


def _settled(k: int, reach: float, max_abs: float | None):
    """Per batch: how often each entry (by its place in the bank) is chosen whatever the course of the
    bias, and per open item its ``free`` places and, ended by -1, the entries that may take them.
    A missing logit counts as NaN, which Spark orders first. Made here, so that it is shipped by value."""
    def run(frames):
        import numpy as np
        import pandas as pd

        for df in frames:
            out = []
            for r in df.itertuples(index=False):
                bias = np.array([e["bias"] for e in r.state], dtype=np.float64)
                logit = np.array([np.array(x, dtype=np.float64) for x in r.rows]).reshape(len(r.rows), len(bias))
                score = logit + bias
                score[np.isnan(score)] = np.inf
                top = min(k, len(bias))
                last = -np.partition(-score, top - 1, axis=1)[:, top - 1:top]
                over = 0.0 if max_abs is None else max(0.0, float(np.abs(bias).max()) - max_abs)
                slack = 2 * (reach + over) + np.minimum(np.abs(last), 1e300) * 1e-9
                sure = score > last + slack
                near = ~sure & (score >= last - slack)
                free = top - sure.sum(axis=1)
                fixed = near.sum(axis=1) <= free  # no more entries than places: settled as well
                sure |= near & fixed[:, None]
                item, entry = np.nonzero(near & ~fixed[:, None])
                ends = np.flatnonzero(np.append(item[1:] != item[:-1], True)) + 1 if len(item) else np.array([], dtype=int)
                out.append((r.block, r.batch_id, len(r.rows) * top, [e["id"] for e in r.state], bias, sure.sum(axis=0).astype("int32"),
                            free[~fixed].astype("int32"), np.insert(entry, ends, -1).astype("int32"), np.insert(logit[item, entry], ends, 0.0)))
            yield pd.DataFrame(out, columns=["block", "batch_id", "n", "ids", "bias", "sure", "free", "entry", "logit"])
    return run


def _replayed(gamma: float, tol: float, max_abs: float | None):
    """The steps of one block, from what ``_settled`` left open: (step, bank_id, load, bias)."""
    def run(block):
        import numpy as np
        import pandas as pd

        ids, bias = list(block.iloc[0]["ids"]), np.array(block.iloc[0]["bias"], dtype=np.float64)
        known = pd.array([None if pd.isna(i) else int(i) for i in ids], dtype="Int64")
        steps, loads, course = [], [], []
        for r in block.sort_values("batch_id").itertuples(index=False):
            load, free = np.array(r.sure, dtype=np.int64), np.asarray(r.free, dtype=np.int64)
            if len(free):
                entry = np.asarray(r.entry, dtype=np.int64)
                item, real = np.cumsum(entry < 0), entry >= 0
                item, entry = item[real], entry[real]
                score = np.asarray(r.logit, dtype=np.float64)[real] + bias[entry]
                score[np.isnan(score)] = np.inf
                order = np.lexsort((entry, -score, item))  # ties to the lowest id
                place = np.arange(len(order)) - np.searchsorted(item, item)
                load += np.bincount(entry[order][place < free[item]], minlength=len(ids))
            target = r.n / len(ids)
            bias = bias + np.where(load > target * (1 + tol), -gamma, np.where(load < target * (1 - tol), gamma, 0.0))
            if max_abs is not None:
                bias = np.minimum(np.maximum(bias, -max_abs), max_abs)
            steps.append(r.batch_id)
            loads.append(load)
            course.append(bias)
        return pd.DataFrame({"step": np.repeat(np.array(steps, dtype=np.int32), len(ids)), "bank_id": known.take(np.tile(np.arange(len(ids)), len(steps))),
                             "load": np.concatenate(loads), "bias": np.concatenate(course)})
    return run


def rebalance_over_batches(items: DataFrame, bank: DataFrame, k: int, batch_size: int, key: str = "item_id",
                           vec_col: str = "vec", seed: int = 42, gamma: float = 1e-4, tol: float = 0.05,
                           max_abs: float | None = None, part_bytes: int = PART_BYTES, speculate: int | None = None,
                           checkpoint_every: int | None = None) -> DataFrame:
    """V8 as the router runs it: one bias update per batch, in batch order: ``(step, bank_id, load,
    bias)``, the bias after each step.

    The recurrence is sequential, but in a block of batches a bias moves by at most ``gamma`` a batch.
    So the tasks settle, for a whole block at once, which entries an item chooses whatever the
    course of the bias, and which may take its last places (their scores lie within reach of the
    k-th best). What is open is then replayed batch by batch, as one bounded group, and the block's
    last bias is the next one's first: one job a block.

    A block has as many batches as ``BLOCK_BYTES`` of scores hold (``speculate``: at most so many).
    Scores do not depend on the bias: they are computed once and written by block, one row per
    batch (bounded by ``batch_size`` and the bank), so a block reads its own rows only. Nothing
    but counts reaches the driver. ``checkpoint_every`` has no effect any more.
    """
    from marksheet.operators.sampling import assign_batches

    spark = items.sparkSession
    scored = bank_scores(items.select(key, vec_col), bank, vec_col, part_bytes).select(
        key, F.transform("scores", lambda s: s["logit"]).alias("s"))
    batched = assign_batches(materialized(scored, "scores"), batch_size, key, seed)
    start = materialized(bank_entries(bank).select("bank_id", "bias"), "bias")
    m = start.count()
    size = max(1, BLOCK_BYTES // (16 * batch_size * max(1, m)))
    size = size if speculate is None else max(1, min(size, speculate))
    rows = batched.groupBy("batch_id").agg(F.collect_list("s").alias("rows")).withColumn("block", F.floor(F.col("batch_id") / size))
    stored = scratch_path(spark, "batches")
    rows.write.partitionBy("block").parquet(stored)
    per_batch = spark.read.schema(rows.schema).parquet(stored)
    steps = batched.select("batch_id").agg(F.max("batch_id")).first()[0]
    path = scratch_path(spark, "bias-history")
    schema = "step int, bank_id long, load long, bias double"
    spark.createDataFrame([], schema).write.parquet(path)
    if steps is None or not m:
        return spark.read.schema(schema).parquet(path)
    for no in range(steps // size + 1):
        state = start.agg(F.sort_array(F.collect_list(F.struct(F.col("bank_id").alias("id"), "bias"))).alias("state"))
        block = per_batch.where(F.col("block") == no).select("block", "batch_id", "rows").withColumn("state", state.scalar())
        left = block.mapInPandas(_settled(k, gamma * size * 1.001, max_abs), _OPEN)
        left.groupBy("block").applyInPandas(_replayed(gamma, tol, max_abs), schema).write.mode("append").parquet(path)
        end = min(steps, (no + 1) * size - 1)
        start = spark.read.schema(schema).parquet(path).where(F.col("step") == end).select("bank_id", "bias")
    return spark.read.schema(schema).parquet(path)
