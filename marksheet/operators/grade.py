"""Grading ladder (G0-G13) and the joins around it.

``grade_expr`` builds one Catalyst expression per row: the ordered rungs, first hit wins. The
recursive comparisons of list elements, matrix cells, option-stripped and ``x=``-stripped
answers are gathered per level into one array of pairs and graded by one copy of the next
level (``transform``), to ``max_depth`` levels like the original rule. Grading is a narrow
(row-local) projection: no shuffle, no Python, no pair explosion at any scale.

Rows that would need computer algebra (both sides equations, or no rung hit) are returned
with ``is_correct = false`` and ``undecided = true``; they stay counted in every score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marksheet.functions import strings as S
from marksheet.functions.extract import last_option
from marksheet.functions.normalize import math_profile, parse_number
from marksheet.session import checked_broadcast, ensure_analyzer_budget

# Option marks a prediction may start with ("(A)", "A.", "A)", "**A**", "A:" for A-E).
OPTION_MARK_RE = r"^(?:\([A-E]\)|[A-E]\.|[A-E]\)|\*\*[A-E]\*\*|[A-E]:)"
OPTION_LETTERS = ("A", "B", "C", "D", "E")
LIST_RE = r"(?d)^[(\[].+[)\]]"
MAT_BEGIN = ("\\begin{pmatrix}", "\\begin{bmatrix}")
MAT_END = ("\\end{pmatrix}", "\\end{bmatrix}")


@dataclass(frozen=True)
class GradeConfig:
    include_percentage: bool = True
    is_close: bool = True
    max_depth: int = 5
    rel_tol: float = 1e-9
    abs_tol: float = 1e-4


def close(a: Column, b: Column, rel_tol: float = 1e-9, abs_tol: float = 1e-4) -> Column:
    """``math.isclose(b, a, abs_tol)``; infinities only equal themselves, NaN never close."""
    inf = F.lit(float("inf"))
    return (
        F.when(F.isnan(a) | F.isnan(b), F.lit(False))
        .when(a == b, F.lit(True))
        .when((F.abs(a) == inf) | (F.abs(b) == inf), F.lit(False))
        .otherwise(F.abs(a - b) <= F.greatest(F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol)))
    )


def str_to_pmatrix(g: Column) -> Column:
    """``{a,b}`` groups of a plain answer rewritten as pmatrix text, joined by ``", "``."""
    groups = F.regexp_extract_all(S.strip(g), F.lit(r"(?d)\{.*,.*\}"), 0)
    return F.array_join(
        F.transform(groups, lambda m: F.concat(
            F.lit("\\begin{pmatrix}"), F.replace(F.btrim(m, F.lit("{}")), F.lit(","), F.lit("\\")), F.lit("\\end{pmatrix}"))),
        ", ",
    )


def _all_true(arr: Column) -> Column:
    return F.coalesce(F.forall(arr, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))


def _result(ok, rung: str, undecided: bool = False) -> Column:
    ok = ok if isinstance(ok, Column) else F.lit(ok)
    return F.struct(ok.alias("ok"), F.lit(rung).alias("rung"), F.lit(undecided).alias("undecided"))


def _numeric(pn: Column, gn: Column, cfg: GradeConfig) -> Column:
    cands = [gn / 100.0, gn, gn * 100.0] if cfg.include_percentage else [gn]
    if cfg.is_close:
        hit = F.exists(F.array(*cands), lambda x: close(pn, x, cfg.rel_tol, cfg.abs_tol))
    else:
        hit = F.exists(F.array(*cands), lambda x: (x == pn) & ~F.isnan(pn))  # NaN equals nothing
    return F.when(pn.isNotNull() & gn.isNotNull(), F.coalesce(hit, F.lit(False)))


_PAIR_TYPE = "array<struct<k:string,p:string,g:string>>"


def _pairs(kind: str, ps: Column, gs: Column) -> Column:
    return F.zip_with(ps, gs, lambda a, b: F.struct(F.lit(kind).alias("k"), a.alias("p"), b.alias("g")))


def _one(kind: str, a: Column, b: Column) -> Column:
    return F.array(F.struct(F.lit(kind).alias("k"), a.alias("p"), b.alias("g")))


def _sorted_parts(x: Column) -> Column:
    return F.array_sort(F.transform(S.split_literal(x, ","), lambda t: S.strip(t)))


def _inner_list(x: Column) -> Column:
    return S.split_literal(F.substring(x, 2, F.char_length(x) - 2), ",")


def _is_mat(x: Column) -> Column:
    return (F.startswith(x, F.lit(MAT_BEGIN[0])) | F.startswith(x, F.lit(MAT_BEGIN[1]))) & (
        F.endswith(x, F.lit(MAT_END[0])) | F.endswith(x, F.lit(MAT_END[1])))


def _mat_rows(x: Column) -> Column:
    inner = F.substring(x, len(MAT_BEGIN[0]) + 1, F.char_length(x) - len(MAT_BEGIN[0]) - len(MAT_END[0]))
    return F.filter(F.transform(S.split_literal(inner, "\\\\"), lambda r: S.strip(r)), lambda r: r != "")


def _sub_pairs(p: Column, g: Column, ps: Column, gs: Column) -> Column:
    """Every comparison the rungs G3, G4, G9, G10, G11 would recurse into, as (kind, p, g) rows.

    ``p``/``g`` are the raw sides, ``ps``/``gs`` the stripped ones (gold possibly rewritten to
    pmatrix text). A kind only contributes when its shape test passes (equal part counts); the
    split/sort work only runs when the cheap applicability test holds.
    """
    g3 = F.when(p.rlike(OPTION_MARK_RE), _one("G3", S.strip(F.regexp_replace(p, OPTION_MARK_RE, "")), g))
    g4 = F.when(S.has(p, ",") & S.has(g, ","), S.let2(_sorted_parts(p), _sorted_parts(g), lambda a, b: F.when(
        F.size(a) == F.size(b), _pairs("G4", a, b))))
    g9 = F.when(ps.rlike(LIST_RE) & gs.rlike(LIST_RE), S.let2(_inner_list(ps), _inner_list(gs), lambda a, b: F.when(
        F.size(a) == F.size(b), _pairs("G9", a, b))))

    def cells(pr, gr):
        shape = (F.size(pr) == F.size(gr)) & _all_true(F.zip_with(
            pr, gr, lambda a, b: F.size(S.split_literal(a, "&")) == F.size(S.split_literal(b, "&"))))
        flat = F.flatten(F.zip_with(pr, gr, lambda a, b: _pairs("G10", S.split_literal(a, "&"), S.split_literal(b, "&"))))
        return F.when(shape, flat)

    g10 = F.when(_is_mat(ps) & _is_mat(gs), S.let2(_mat_rows(ps), _mat_rows(gs), cells))
    has_eq = S.has(ps, "=") | S.has(gs, "=")
    pc = S.count_sub(ps, "=")
    gc = S.count_sub(gs, "=")
    p_side = (pc == 1) & (F.char_length(S.strip(S.before_first(ps, "="))) <= 2) & (gc == 0)
    g_side = (gc == 1) & (F.char_length(S.strip(S.before_first(gs, "="))) <= 2) & (pc == 0)
    eq = F.when(has_eq & p_side, _one("EQ", S.after_first(ps, "="), gs)).when(
        has_eq & g_side, _one("EQ", ps, S.after_first(gs, "=")))
    empty = F.array().cast(_PAIR_TYPE)
    return F.concat(*[F.coalesce(x.cast(_PAIR_TYPE), empty) for x in (g3, g4, g9, g10, eq)])


def _kind_all(res: Column, kind: str) -> Column:
    sel = F.filter(res, lambda r: r["k"] == kind)
    return (F.size(sel) > 0) & _all_true(F.transform(sel, lambda r: r["ok"]))


def _kind_any(res: Column, kind: str) -> Column:
    return F.coalesce(F.exists(res, lambda r: (r["k"] == kind) & r["ok"]), F.lit(False))


def _fixed_gold(ps: Column, gs0: Column) -> Column:
    """Gold rewritten as pmatrix text when only the prediction is a matrix."""
    return F.when(S.has(ps, "pmatrix") & ~S.has(gs0, "pmatrix"), str_to_pmatrix(gs0)).otherwise(gs0)


def _rungs(p: Column, g: Column, kids: Column, cfg: GradeConfig) -> Column:
    """Struct(ok, rung, undecided) of one comparison, given its children's verdicts ``kids``
    (array of (k, ok): the recursive comparisons of rungs G3, G4, G9, G10 and G11)."""

    def late(num, ps, gs):
        bracket = (
            (F.startswith(ps, F.lit("[")) & F.endswith(ps, F.lit("]")) & ~F.startswith(gs, F.lit("(")))
            | (F.startswith(ps, F.lit("(")) & F.endswith(ps, F.lit(")")) & ~F.startswith(gs, F.lit("[")))
        )
        pb = F.translate(F.when(bracket, F.btrim(ps, F.lit("[]()"))).otherwise(ps), "{}()", "")
        gb = F.translate(F.when(bracket, F.btrim(gs, F.lit("[]()"))).otherwise(gs), "{}()", "")
        mat_empty = _is_mat(ps) & _is_mat(gs) & (F.size(_mat_rows(ps)) == 0) & (F.size(_mat_rows(gs)) == 0)
        pc = S.count_sub(ps, "=")
        gc = S.count_sub(gs, "=")
        return (
            F.when(num.isNotNull(), F.struct(num.alias("ok"), F.lit("numeric").alias("rung"), F.lit(False).alias("undecided")))
            .when(p == "", _result(False, "empty"))
            .when(F.lower(pb) == F.lower(gb), _result(True, "brackets"))
            .when(_kind_all(kids, "G9"), _result(True, "ordered_list"))
            .when(_kind_all(kids, "G10") | mat_empty, _result(True, "matrix"))
            .when((pc == 1) & (gc == 1), _result(False, "symbolic_equation", True))
            .when(_kind_any(kids, "EQ"), _result(True, "equation_side"))
            .otherwise(_result(False, "symbolic", True))
        )

    def mid():
        num = S.let2(parse_number(p), parse_number(g), lambda pn, gn: _numeric(pn, gn, cfg))
        sides = S.let2(S.strip(p), S.strip(g), lambda ps, gs0: S.let2(ps, _fixed_gold(ps, gs0), lambda ps, gs: S.let(
            num, lambda num: late(num, ps, gs))))
        return (
            F.when(_kind_any(kids, "G3"), _result(True, "option_mark"))
            .when(_kind_all(kids, "G4"), _result(True, "comma_list"))
            .otherwise(sides)
        )

    return (
        F.when(p.isNull() | g.isNull(), _result(False, "null"))
        .when(F.lower(S.strip(p)) == F.lower(S.strip(g)), _result(True, "exact"))
        .when(g.isin(*OPTION_LETTERS) & (last_option(p) == g), _result(True, "choice"))
        .otherwise(mid())
    )


_NODE = "struct<id:int,parent:int,level:int,k:string,p:string,g:string>"
_VERDICT = "struct<ok:boolean,rung:string,undecided:boolean>"


def _children(x: Column, level: Column) -> Column:
    """The recursive comparisons of node ``x`` as nodes of ``level`` (ids assigned later)."""
    def make(ps, gs):
        return F.transform(_sub_pairs(x["p"], x["g"], ps, gs), lambda c: F.struct(
            F.lit(-1).alias("id"), x["id"].alias("parent"), level.alias("level"), c["k"].alias("k"), c["p"].alias("p"),
            c["g"].alias("g")))
    return S.let2(S.strip(x["p"]), S.strip(x["g"]), lambda ps, gs0: S.let2(ps, _fixed_gold(ps, gs0), make))


def _ladder(p: Column, g: Column, cfg: GradeConfig) -> Column:
    """Struct(ok, rung, undecided) for ``p`` (prediction) and ``g`` (gold).

    1. Expand: all recursive comparisons, level by level up to ``max_depth``, as one array of
       nodes (id, parent, level, kind, p, g) - one ``aggregate`` over the levels.
    2. Evaluate bottom-up: one ``aggregate`` from the deepest level to the root; its body holds
       the single copy of the rung logic, reading each node's children from the previous pass.
    The expression size is independent of ``max_depth``.
    """
    root = F.array(F.struct(F.lit(0).alias("id"), F.lit(-1).alias("parent"), F.lit(0).alias("level"),
                            F.lit("root").alias("k"), p.alias("p"), g.alias("g"))).cast(f"array<{_NODE}>")
    depth = cfg.max_depth

    def grow(acc, lvl):
        kids = F.flatten(F.transform(F.filter(acc, lambda x: x["level"] == lvl - 1), lambda x: _children(x, lvl)))
        n = F.size(acc)
        numbered = F.transform(kids, lambda c, i: F.struct(
            (n + i).alias("id"), c["parent"].alias("parent"), c["level"].alias("level"), c["k"].alias("k"),
            c["p"].alias("p"), c["g"].alias("g")))
        return F.concat(acc, numbered).cast(f"array<{_NODE}>")

    nodes = root if depth < 1 else F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, grow)

    def evaluate(nodes):
        init = F.transform(nodes, lambda x: F.lit(None).cast(_VERDICT))

        def level_pass(res, lvl):
            def kids_of(x):
                z = F.zip_with(nodes, res, lambda nd, r: F.struct(nd["parent"].alias("parent"), nd["k"].alias("k"),
                                                                  r["ok"].alias("ok")))
                return F.filter(z, lambda e: e["parent"] == x["id"])
            return F.transform(nodes, lambda x, i: F.when(x["level"] == lvl, _rungs(x["p"], x["g"], kids_of(x), cfg))
                               .otherwise(F.element_at(res, i + 1))).cast(f"array<{_VERDICT}>")

        res = F.aggregate(F.sequence(F.lit(depth), F.lit(0), F.lit(-1)), init.cast(f"array<{_VERDICT}>"), level_pass)
        return F.element_at(res, 1)

    # The first two rungs need no recursion: answer them before expanding anything.
    return (
        F.when(p.isNull() | g.isNull(), _result(False, "null"))
        .when(F.lower(S.strip(p)) == F.lower(S.strip(g)), _result(True, "exact"))
        .otherwise(S.let(nodes, evaluate))
    )


_LADDER_CACHE: dict = {}


def _math_profile_named(name: str) -> Column:
    from pyspark import SparkContext
    key = ("norm", name, id(SparkContext._gateway))
    if key not in _LADDER_CACHE:
        _LADDER_CACHE[key] = math_profile(F.col(name))
    return _LADDER_CACHE[key]


def _ladder_on_norm_columns(cfg: GradeConfig) -> Column:
    """The ladder over columns ``pred_norm``/``gold_norm``, built once per JVM and config.

    Building the expression costs one JVM call per node; a Column is an unresolved expression
    and can be reused by any number of DataFrames.
    """
    from pyspark import SparkContext
    key = (cfg, id(SparkContext._gateway))
    if key not in _LADDER_CACHE:
        _LADDER_CACHE[key] = grade_expr(F.col("pred_norm"), F.col("gold_norm"), cfg)
    return _LADDER_CACHE[key]


def grade_expr(pred: Column, gold: Column, cfg: GradeConfig = GradeConfig()) -> Column:
    """Struct(ok, rung, undecided) for already-normalized prediction and gold columns."""
    return S.let2(pred, gold, lambda p, g: _ladder(p, g, cfg))


def grade(
    df: DataFrame,
    pred_col: str = "extracted_prediction",
    gold_col: str = "reference_answer",
    normalize: bool = True,
    cfg: GradeConfig = GradeConfig(),
) -> DataFrame:
    """Adds ``pred_norm``, ``gold_norm``, ``is_correct``, ``rung``, ``undecided``, ``both_empty``.

    Row-local: the plan is Scan -> Project (one codegen stage); no exchange is introduced.
    """
    ensure_analyzer_budget(df.sparkSession)
    # a missing side stays missing (the ladder's first rung), it is not normalized to text
    p = F.when(F.col(pred_col).isNotNull(), _math_profile_named(pred_col)) if normalize else F.col(pred_col)
    g = F.when(F.col(gold_col).isNotNull(), _math_profile_named(gold_col)) if normalize else F.col(gold_col)
    # Few, wide selects: each DataFrame step re-analyzes the plan, and the ladder is large.
    base = [c for c in df.columns if c not in ("pred_norm", "gold_norm", "is_correct", "rung", "undecided", "both_empty")]
    out = df.select(*base, p.alias("pred_norm"), g.alias("gold_norm"))
    out = out.select(*base, "pred_norm", "gold_norm", _ladder_on_norm_columns(cfg).alias("_grade"))
    return out.select(
        *base, "pred_norm", "gold_norm",
        F.col("_grade.ok").alias("is_correct"),
        F.col("_grade.rung").alias("rung"),
        F.col("_grade.undecided").alias("undecided"),
        F.coalesce((F.col("pred_norm") == "") & (F.col("gold_norm") == ""), F.lit(False)).alias("both_empty"),
    )


def grade_exact(pred: Column, gold: Column, tol: float = 1e-5) -> Column:
    """Plain equality of normalized text, or numeric distance <= ``tol`` when both parse."""
    def body(p, g):
        pn = parse_number(p)
        gn = parse_number(g)
        return F.coalesce(p == g, F.lit(False)) | F.coalesce(F.abs(pn - gn) <= tol, F.lit(False))
    return S.let2(math_profile(pred), math_profile(gold), body)


def attach_caps(df: DataFrame, caps: DataFrame, on: str = "dataset_name") -> DataFrame:
    """Dataset -> cap lookup; an unknown dataset gets a null cap (reported by the caller).

    The caps table has one row per dataset name; it is broadcast after a size check.
    """
    return df.join(checked_broadcast(caps), on, "left")


def pair_with_sources(pred: DataFrame, src: DataFrame, keys=("dataset_name", "raw_id")) -> DataFrame:
    """Predictions with their source records by key (not by position); a full join keeps
    unmatched ids on either side, flagged by ``match_status``."""
    keys = list(keys)
    p = pred.withColumn("_in_pred", F.lit(True))
    s = src.withColumn("_in_src", F.lit(True))
    j = p.join(s, keys, "full")
    status = (
        F.when(F.col("_in_pred").isNull(), F.lit("source_only"))
        .when(F.col("_in_src").isNull(), F.lit("prediction_only"))
        .otherwise(F.lit("matched"))
    )
    return j.withColumn("match_status", status).drop("_in_pred", "_in_src")


def duplicate_ids(df: DataFrame, keys=("dataset_name", "raw_id")) -> DataFrame:
    """J2 report: the keys that occur more than once, with their row counts. Pairing by key
    multiplies such rows, so callers look here first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def pair_elements(df: DataFrame, left: str, right: str, key_cols) -> DataFrame:
    """Element-wise pairing of two lists: one row per (key, pos). ``length_match`` is false on
    every row of lists of unequal length (the shorter one goes on with nulls) and of a missing
    list (one row, null ``pos``)."""
    z = F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r"))
    same = F.coalesce(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.size(left) == F.size(right)), F.lit(False))
    return (
        df.select(*key_cols, same.alias("length_match"), F.posexplode_outer(z).alias("pos", "pair"))
        .select(*key_cols, "pos", F.col("pair.l").alias(left + "_item"), F.col("pair.r").alias(right + "_item"), "length_match")
    )
