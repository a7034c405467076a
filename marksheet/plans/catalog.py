"""Registered queries: one Spark job per operator group, each with its DuckDB oracle text.

Every query reads the given tables (or tables Spark derives from them) in full. Floating
results are rounded to 6 digits on both sides; columns are aliased identically.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marksheet.functions import extract as X
from marksheet.functions import normalize as N
from marksheet.functions.strings import PY_WHITESPACE
from marksheet.operators import grade as G
from marksheet.operators import sampling as P
from marksheet.operators import score as A
from marksheet.operators import sequences as T
from marksheet.operators import vectors as V
from marksheet.plans import fixtures as FX
from marksheet.plans import oracle_text as OT
from marksheet.session import ensure_parallelism, read_table, scratch_path
from marksheet.sources import io as SRC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


def _sql_ws() -> str:
    """The Python whitespace set as a DuckDB string literal (for trim functions)."""
    return "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"


WS = _sql_ws()

# ------------------------------------------------------------------ grading flagship


def graded_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr = ensure_parallelism(FX.predictions(spark, sf_dir))
    pr = pr.withColumn("extracted_prediction", X.final_answer("decoded_prediction"))
    return G.grade(pr)


# SQL form of the same steps for this fixture's shapes: boxed content without nesting, plain
# numbers through the math normalizer, then exact / numeric (gold, gold/100, gold*100) rungs.
_CLOSE = "(abs(({a}) - ({b})) <= greatest(1e-9 * greatest(abs({a}), abs({b})), 1e-4))"
GRADED_SQL = rf"""
WITH p AS ({FX.PREDICTIONS_SQL}),
x AS (
  SELECT *, CASE WHEN position('boxed' IN decoded_prediction) = 0 THEN ''
                 WHEN string_split(decoded_prediction, 'boxed')[-1] LIKE '{{%'
                   THEN regexp_extract(string_split(decoded_prediction, 'boxed')[-1], '^\{{([^{{}}]*)\}}', 1)
                 ELSE trim(split_part(string_split(decoded_prediction, 'boxed')[-1], '$', 1), {WS}) END AS ex0
  FROM p),
x2 AS (SELECT *, regexp_replace(ex0, '\n\s*', '', 'g') AS ex1 FROM x),
x3 AS (SELECT *, CASE WHEN ex1 LIKE ':%' THEN substr(ex1, 2) ELSE ex1 END AS ex2 FROM x2),
x4 AS (SELECT *, CASE WHEN ex2 LIKE '%.' THEN left(ex2, length(ex2) - 1) ELSE ex2 END AS ex3 FROM x3),
x5 AS (SELECT *, CASE WHEN ex3 LIKE '%/' THEN left(ex3, length(ex3) - 1) ELSE ex3 END AS extracted_prediction FROM x4),
n AS (
  SELECT *,
    CASE WHEN regexp_full_match(extracted_prediction, '[0-9]+') THEN regexp_replace(extracted_prediction, '^0+([0-9])', '\1')
         ELSE extracted_prediction END AS pred_norm,
    CASE WHEN regexp_full_match(reference_answer, '[0-9]+') THEN regexp_replace(reference_answer, '^0+([0-9])', '\1')
         ELSE reference_answer END AS gold_norm
  FROM x5),
g AS (
  SELECT *, TRY_CAST(pred_norm AS DOUBLE) AS pv, TRY_CAST(gold_norm AS DOUBLE) AS gv FROM n),
graded AS (
  SELECT *, CASE WHEN lower(trim(pred_norm, {WS})) = lower(trim(gold_norm, {WS})) THEN true
                 WHEN pv IS NOT NULL AND gv IS NOT NULL THEN
                   ({_CLOSE.format(a='pv', b='gv / 100.0')} OR {_CLOSE.format(a='pv', b='gv')} OR {_CLOSE.format(a='pv', b='gv * 100.0')})
                 ELSE false END AS is_correct
  FROM g)
"""


@register("a1_score_by_dataset", GRADED_SQL + """
SELECT dataset_name, count(*) AS total_samples, CAST(count_if(is_correct) AS BIGINT) AS correct_samples,
       round(count_if(is_correct) / count(*), 6) AS test_accuracy
FROM graded GROUP BY dataset_name""")
def q_a1(spark, sf_dir):
    pr = ensure_parallelism(FX.predictions(spark, sf_dir))
    m = A.score_answers(pr.withColumn("extracted_prediction", X.final_answer("decoded_prediction")))
    return m.select("dataset_name", "total_samples", "correct_samples", r6("test_accuracy").alias("test_accuracy"))


@register("x1_x2_extract_boxed", GRADED_SQL + "SELECT raw_id, extracted_prediction FROM graded")
def q_x1(spark, sf_dir):
    pr = FX.predictions(spark, sf_dir)
    return pr.select("raw_id", X.final_answer("decoded_prediction").alias("extracted_prediction"))


@register("g_grade_rows", GRADED_SQL + "SELECT raw_id, pred_norm, gold_norm, is_correct FROM graded")
def q_grade_rows(spark, sf_dir):
    return graded_predictions(spark, sf_dir).select("raw_id", "pred_norm", "gold_norm", "is_correct")


@register("a2_summary", GRADED_SQL + """
, m AS (SELECT dataset_name, count(*) AS t, count_if(is_correct) AS c FROM graded GROUP BY dataset_name)
SELECT count(*) AS total_datasets, count(*) AS successful_datasets, CAST(0 AS BIGINT) AS failed_datasets,
       CAST(sum(t) AS BIGINT) AS total_samples, CAST(sum(c) AS BIGINT) AS total_correct,
       round(sum(c) / sum(t), 6) AS overall_accuracy FROM m""")
def q_a2(spark, sf_dir):
    # every observed dataset is requested here, so the metrics need no second pass for the names
    m = A.score(graded_predictions(spark, sf_dir)).withColumn("error", F.lit(None).cast("string"))
    s = A.summarize(m)
    return s.withColumn("overall_accuracy", r6("overall_accuracy"))


# ------------------------------------------------------------------ failures isolated

LABELS_SQL = """
lab AS (SELECT d.lang AS dataset_name, CAST(d.doc_id AS VARCHAR) AS raw_id, l.quality = 1 AS is_correct
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
req AS (SELECT DISTINCT lang AS dataset_name FROM documents UNION SELECT 'missing_set'),
met AS (SELECT dataset_name, count(*) AS total_samples, CAST(count_if(is_correct) AS BIGINT) AS correct_samples FROM lab GROUP BY dataset_name),
res AS (SELECT r.dataset_name,
          CASE WHEN m.total_samples IS NULL THEN NULL ELSE round(m.correct_samples / m.total_samples, 6) END AS test_accuracy,
          m.total_samples, m.correct_samples,
          CASE WHEN m.total_samples IS NULL THEN 'no records for dataset ' || r.dataset_name END AS error
        FROM req r LEFT JOIN met m USING (dataset_name))
"""


def _labelled(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents")
    preds = lab.join(docs.select("doc_id", "lang"), "doc_id").select(
        F.col("lang").alias("dataset_name"), F.col("doc_id").cast("string").alias("raw_id"), (F.col("quality") == 1).alias("is_correct"))
    req = docs.select(F.col("lang").alias("dataset_name")).distinct().unionByName(A.requested_frame(spark, ["missing_set"])).distinct()
    return preds, req


@register("a3_j3_score_with_failures", "WITH " + LABELS_SQL + "SELECT * FROM res")
def q_a3(spark, sf_dir):
    preds, req = _labelled(spark, sf_dir)
    m = A.score_with_failures(preds, req)
    return m.withColumn("test_accuracy", r6("test_accuracy"))


@register("a2_summary_with_failures", "WITH " + LABELS_SQL + """
SELECT count(*) AS total_datasets, CAST(count_if(error IS NULL) AS BIGINT) AS successful_datasets, CAST(count_if(error IS NOT NULL) AS BIGINT) AS failed_datasets,
  CAST(coalesce(sum(total_samples) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS total_samples,
  CAST(coalesce(sum(correct_samples) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS total_correct,
  round(coalesce(sum(correct_samples) FILTER (WHERE error IS NULL) / sum(total_samples) FILTER (WHERE error IS NULL), 0.0), 6) AS overall_accuracy
FROM res""")
def q_a2f(spark, sf_dir):
    preds, req = _labelled(spark, sf_dir)
    s = A.summarize(A.score_with_failures(preds, req))
    return s.withColumn("overall_accuracy", r6("overall_accuracy"))


# ------------------------------------------------------------------ positions, splits, caps

_H = "md5('42:' || CAST({k} AS VARCHAR))"


@register("w1_p1_shuffle_positions",
          f"SELECT *, row_number() OVER (ORDER BY {_H.format(k='doc_id')}, doc_id) - 1 AS pos FROM documents")
def q_w1(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return P.with_position(d, "doc_id", 42, "pos")


@register("p2_holdout_split", f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_H.format(k='doc_id')}, doc_id) - 1 < ceil(0.02 * count(*) OVER ())
                    THEN 'val' ELSE 'train' END AS split FROM documents""")
def q_p2(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    return P.holdout_split(d, 0.02, "doc_id", 42).select("doc_id", "split")


@register("p2_holdout_half_of_lineitem", f"""
WITH l AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS line_id FROM lineitem)
SELECT *, CASE WHEN row_number() OVER (ORDER BY {_H.format(k='line_id')}, line_id) - 1 < ceil(0.5 * count(*) OVER ())
               THEN 'val' ELSE 'train' END AS split FROM l""")
def q_p2_half(spark, sf_dir):
    same = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    one = F.row_number().over(Window.partitionBy(*same).orderBy(*same))
    d = read_table(spark, sf_dir, "lineitem").withColumn("line_id", F.concat_ws("-", *same, one))
    return P.holdout_split(d, 0.5, "line_id", 42)


@register("p3_cap_rows", f"SELECT doc_id FROM documents ORDER BY {_H.format(k='doc_id')}, doc_id LIMIT 200")
def q_p3(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    return P.cap_rows(d, 200, "doc_id", 42)


CAPS = [("A", 200), ("N", 500), ("R", 200)]


@register("p4_j1_cap_per_dataset", f"""
WITH p AS ({FX.PREDICTIONS_SQL}),
caps AS (SELECT * FROM (VALUES ('A', 200), ('N', 500), ('R', 200)) t(dataset_name, cap)),
r AS (SELECT p.dataset_name, raw_id, cap,
        row_number() OVER (PARTITION BY p.dataset_name ORDER BY {_H.format(k='raw_id')}, raw_id) AS rn
      FROM p JOIN caps USING (dataset_name))
SELECT dataset_name, raw_id FROM r WHERE rn <= cap OR dataset_name = 'N'""")
def q_p4(spark, sf_dir):
    pr = ensure_parallelism(FX.predictions(spark, sf_dir).select("dataset_name", "raw_id"))
    caps = spark.createDataFrame(CAPS, "dataset_name string, cap int")
    return P.cap_per_dataset(pr, caps, "raw_id", 42, exempt="N").select("dataset_name", "raw_id")


@register("p5_cap_per_category", f"""
SELECT doc_id, category FROM (
  SELECT doc_id, lang AS category,
         row_number() OVER (PARTITION BY lang ORDER BY {_H.format(k='doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= 100""")
def q_p5(spark, sf_dir):
    d = FX.instructions(spark, sf_dir).select("doc_id", "category")
    return P.cap_per_category(d, 100, "doc_id", 42, "category")


@register("p6_list_categories", "SELECT DISTINCT lang AS category FROM documents")
def q_p6(spark, sf_dir):
    return P.list_categories(FX.instructions(spark, sf_dir), "category")


@register("p7_filter_category", "SELECT doc_id FROM documents WHERE lang = 'en'")
def q_p7(spark, sf_dir):
    return P.filter_category(FX.instructions(spark, sf_dir), "en", "category").select("doc_id")


@register("p8_assign_batches", f"""
SELECT doc_id, pos, CAST(floor(pos / 8) AS BIGINT) AS batch_id FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {_H.format(k='doc_id')}, doc_id) - 1 AS pos FROM documents)""")
def q_p8(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    return P.assign_batches(d, 8, "doc_id", 42).select("doc_id", "pos", "batch_id")


@register("o1_concat_slices", "SELECT doc_id, lang FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang FROM documents")
def q_o1(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return P.concat_slices(d.where(F.col("lang") == "en"), d)


# ------------------------------------------------------------------ training log

@register("a4_p10_history_summary", f"""
WITH h AS ({FX.LOG_SQL}),
ph AS (SELECT *, CASE WHEN eval_loss IS NOT NULL THEN 'eval' WHEN loss IS NOT NULL THEN 'train' END AS phase FROM h)
SELECT phase, count(*) AS rows,
  round(min(CASE WHEN phase = 'eval' THEN eval_loss ELSE loss END), 6) AS min_loss,
  round(max(CASE WHEN phase = 'eval' THEN eval_loss ELSE loss END), 6) AS max_loss,
  min(step) AS first_step, max(step) AS last_step
FROM ph WHERE phase IS NOT NULL GROUP BY phase""")
def q_a4(spark, sf_dir):
    s = A.history_summary(FX.log_history(spark, sf_dir))
    return s.withColumn("min_loss", r6("min_loss")).withColumn("max_loss", r6("max_loss"))


@register("a5_best_step", f"""
WITH h AS ({FX.LOG_SQL})
SELECT run, arg_min(step, (eval_loss, step)) AS best_step, round(min(eval_loss), 6) AS best_eval_loss
FROM h WHERE eval_loss IS NOT NULL GROUP BY run""")
def q_a5(spark, sf_dir):
    b = A.best_step(FX.log_history(spark, sf_dir))
    return b.withColumn("best_eval_loss", r6("best_eval_loss"))


@register("a6_newest_steps", f"""
WITH h AS ({FX.LOG_SQL})
SELECT run, step, rank FROM (SELECT run, step, CAST(row_number() OVER (PARTITION BY run ORDER BY step DESC) AS INTEGER) AS rank FROM h) WHERE rank <= 3""")
def q_a6(spark, sf_dir):
    return A.newest_steps(FX.log_history(spark, sf_dir), 3).select("run", "step", "rank")


# ------------------------------------------------------------------ parameters, penalties

@register("a7_share_report", f"""
WITH p AS ({FX.PARAMETERS_SQL}),
c AS (SELECT name, numel, contains(name, 'A') AS ad, contains(name, 'A') AND (contains(name, 'LARGE') OR contains(name, 'SMALL')) AS bk FROM p),
s AS (SELECT CAST(coalesce(sum(numel) FILTER (WHERE bk), 0) AS BIGINT) AS bank_params,
             CAST(coalesce(sum(numel) FILTER (WHERE ad AND NOT bk), 0) AS BIGINT) AS encoder_params,
             CAST(coalesce(sum(numel) FILTER (WHERE ad), 0) AS BIGINT) AS adapter_params,
             CAST(coalesce(sum(numel), 0) AS BIGINT) AS total_params FROM c)
SELECT *, round(100.0 * adapter_params / total_params, 6) AS adapter_pct, round(100.0 * encoder_params / adapter_params, 6) AS encoder_pct,
       round(100.0 * bank_params / adapter_params, 6) AS bank_pct FROM s""")
def q_a7(spark, sf_dir):
    r = A.share_report(FX.parameters(spark, sf_dir), adapter_marker="A", bank_markers=("LARGE", "SMALL"))
    for c in ("adapter_pct", "encoder_pct", "bank_pct"):
        r = r.withColumn(c, r6(c))
    return r


@register("a8_total_penalty", f"""
WITH p AS ({FX.PENALTIES_SQL}),
k AS (SELECT step, kind, avg(value) AS m FROM p GROUP BY step, kind)
SELECT step, CAST(0.0 AS DOUBLE) AS base_loss, round(sum(m), 6) AS penalty, round(sum(m), 6) AS total_loss FROM k GROUP BY step""")
def q_a8(spark, sf_dir):
    t = A.total_penalty(FX.penalties(spark, sf_dir))
    return t.select("step", "base_loss", r6("penalty").alias("penalty"), r6("total_loss").alias("total_loss"))


# ------------------------------------------------------------------ texts, chat, tokens

@register("t1_build_prompts", "SELECT CAST(doc_id AS VARCHAR) AS raw_id, concat('Summarise this ', lang, ' text.', chr(10), coalesce(text, '')) AS prompt FROM documents")
def q_t1(spark, sf_dir):
    i = FX.instructions(spark, sf_dir)
    return i.select("raw_id", T.build_prompt("instruction", "input").alias("prompt"))


_TPL_SQL = "(SELECT * FROM (VALUES ('system', '<|system|>' || chr(10), '<|end|>' || chr(10)), ('user', '<|user|>' || chr(10), '<|end|>' || chr(10)), ('assistant', '<|assistant|>' || chr(10), '<|end|>' || chr(10))) t(role, prefix, suffix))"


def _chat_sql(open_turn: bool) -> str:
    opener = " || '<|assistant|>' || chr(10)" if open_turn else ""
    return f"""
SELECT conv_id, string_agg(coalesce(prefix, '') || coalesce(text, '') || coalesce(suffix, ''), '' ORDER BY turn){opener} AS rendered,
       CAST(count(*) AS INTEGER) AS turns
FROM conversations c LEFT JOIN {_TPL_SQL} t USING (role) GROUP BY conv_id"""


@register("t2_render_chat_open", _chat_sql(True))
def q_t2(spark, sf_dir):
    return T.render_chat(read_table(spark, sf_dir, "conversations"), T.template_frame(spark), open_turn=True)


@register("t3_render_chat_full", _chat_sql(False))
def q_t3(spark, sf_dir):
    return T.render_chat(read_table(spark, sf_dir, "conversations"), T.template_frame(spark), open_turn=False)


@register("t2_render_prompt_records", f"""
SELECT CAST(doc_id AS VARCHAR) AS raw_id,
  '<|user|>' || chr(10) || 'Summarise this ' || lang || ' text.' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) AS prompt_text,
  '<|user|>' || chr(10) || 'Summarise this ' || lang || ' text.' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) || 'Source: ' || source || '<|end|>' || chr(10) AS full_text
FROM documents""")
def q_t2r(spark, sf_dir):
    i = FX.instructions(spark, sf_dir)
    tpl = T.template_frame(spark)
    prompt = T.build_prompt("instruction", "input")
    out = T.render_prompt(i, tpl, prompt, "prompt_text")
    out = T.render_prompt(out, tpl, prompt, "full_text", response=F.col("output"))
    return out.select("raw_id", "prompt_text", "full_text")


_TOK = r"'\w+|[^\w\s]'"
VOCAB_SQL = f"""
toks AS (SELECT unnest(regexp_extract_all(text, {_TOK})) AS token FROM documents),
vocab AS (SELECT token, count(*) AS freq, CAST(row_number() OVER (ORDER BY count(*) DESC, token) AS INTEGER) AS token_id FROM toks GROUP BY token)
"""


@register("t4_vocab", "WITH " + VOCAB_SQL + "SELECT token, freq, token_id FROM vocab")
def q_t4v(spark, sf_dir):
    return T.build_vocab(read_table(spark, sf_dir, "documents"), "text")


TOKENS_SQL = "WITH " + VOCAB_SQL + f""",
ex AS (SELECT doc_id, unnest(regexp_extract_all(text, {_TOK})) AS token,
              unnest(generate_series(0, len(regexp_extract_all(text, {_TOK})) - 1)) AS i FROM documents),
ids AS (SELECT doc_id, list(coalesce(v.token_id, 0) ORDER BY i) AS input_ids FROM ex LEFT JOIN vocab v USING (token) GROUP BY doc_id),
pr AS (SELECT doc_id, 'Continue in ' || lang || ' from ' || source || ':' AS prompt FROM documents),
pl AS (SELECT doc_id, CAST(len(regexp_extract_all(prompt, {_TOK})) AS INTEGER) AS prompt_len FROM pr),
tok AS (SELECT d.doc_id, coalesce(ids.input_ids, []::INTEGER[]) AS input_ids, pl.prompt_len
        FROM documents d LEFT JOIN ids USING (doc_id) JOIN pl USING (doc_id)),
lab AS (SELECT doc_id, input_ids, prompt_len,
          list_transform(input_ids, lambda x, i: CASE WHEN i - 1 < prompt_len THEN -100 ELSE x END) AS labels FROM tok)
"""


def tokenized(spark, sf_dir):
    d = ensure_parallelism(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    vocab = T.build_vocab(d, "text")
    prompt = F.concat(F.lit("Continue in "), F.col("lang"), F.lit(" from "), F.col("source"), F.lit(":"))
    d = d.select("doc_id", "text", T.token_length(prompt).alias("prompt_len"))
    tok = T.tokenize(d, "doc_id", "text", vocab)
    return tok.withColumn("labels", T.mask_prompt("input_ids", "prompt_len"))


@register("t4_t5_tokenize_mask", TOKENS_SQL + "SELECT doc_id, input_ids, prompt_len, labels FROM lab")
def q_t4(spark, sf_dir):
    return tokenized(spark, sf_dir).select("doc_id", "input_ids", "prompt_len", "labels")


@register("t9_token_length", f"SELECT doc_id, CAST(len(regexp_extract_all(text, {_TOK})) AS INTEGER) AS n_tokens FROM documents")
def q_t9(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", T.token_length("text").alias("n_tokens"))


@register("a9_fully_masked_rows", TOKENS_SQL + """
SELECT count(*) AS rows, CAST(count_if(list_bool_and(list_transform(labels, lambda x: x = -100)) OR len(labels) = 0) AS BIGINT) AS fully_masked_rows FROM lab""")
def q_a9(spark, sf_dir):
    return A.fully_masked_rows(tokenized(spark, sf_dir), "labels")


@register("t6_t7_t8_pad_batches", TOKENS_SQL + f""",
pos AS (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY {_H.format(k='doc_id')}, doc_id) - 1) / 8) AS BIGINT) AS batch_id FROM documents),
b AS (SELECT l.doc_id, batch_id, input_ids, labels, CAST(ceil(max(len(input_ids)) OVER (PARTITION BY batch_id) / 8.0) * 8 AS INTEGER) AS target
      FROM lab l JOIN pos USING (doc_id)),
pd AS (SELECT doc_id, batch_id, list_concat(list_transform(range(target - len(input_ids)), lambda x: 0), input_ids) AS input_ids,
              list_concat(list_transform(range(target - len(labels)), lambda x: -100), labels) AS labels FROM b)
SELECT doc_id, batch_id, input_ids, labels, list_transform(input_ids, lambda x: x <> 0) AS attention_mask FROM pd""")
def q_t6(spark, sf_dir):
    tok = tokenized(spark, sf_dir).drop("labels")  # they follow from the ids, which alone are moved
    pos = P.assign_batches(read_table(spark, sf_dir, "documents").select("doc_id"), 8, "doc_id", 42).select("doc_id", "batch_id")
    b = T.pad_batch(tok.join(pos.hint("shuffle_hash"), "doc_id"), "batch_id", "input_ids", "labels", pad_id=0, side="left", multiple_of=8,
                    labels=T.mask_prompt("input_ids", "prompt_len"))
    return b.select("doc_id", "batch_id", "input_ids", "labels", T.attention_mask("input_ids", 0).alias("attention_mask"))


@register("t14_generated_part", TOKENS_SQL + """
SELECT doc_id, input_ids[prompt_len + 1:] AS generated_ids FROM lab""")
def q_t14(spark, sf_dir):
    tok = tokenized(spark, sf_dir)
    return tok.select("doc_id", T.generated_part("input_ids", "prompt_len").alias("generated_ids"))


_THINK_SQL = f"""
WITH c AS (SELECT conv_id, turn, '<think>' || role || '</think>' || chr(10) || '  ' || text AS raw FROM conversations)
SELECT conv_id, turn, CASE WHEN position('</think>' IN raw) > 0 THEN ltrim(substr(raw, position('</think>' IN raw) + 8), {WS}) ELSE raw END AS reply
FROM c"""


@register("t10_strip_reasoning", _THINK_SQL)
def q_t10(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("<think>"), F.col("role"), F.lit("</think>\n  "), F.col("text"))
    return c.select("conv_id", "turn", T.strip_reasoning(raw).alias("reply"))


@register("t11_attach_embeddings", """
SELECT d.doc_id, e.vec_id IS NOT NULL AS has_vector, round(list_sum(CAST(e.embedding AS DOUBLE[])), 6) AS vector_sum
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""")
def q_t11(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    j = T.attach_embeddings(d, read_table(spark, sf_dir, "embeddings"), "doc_id", "vec_id")
    s = F.aggregate("external_embedding", F.lit(0.0), lambda a, v: a + v)
    return j.select("doc_id", F.col("external_embedding").isNotNull().alias("has_vector"), r6(s).alias("vector_sum"))


@register("t12_t13_pick_question_gold", f"""
SELECT CAST(doc_id AS VARCHAR) AS raw_id, trim(text, {WS}) AS question, CAST(n_chars AS VARCHAR) AS gold FROM documents""")
def q_t12(spark, sf_dir):
    i = FX.instructions(spark, sf_dir)
    return i.select("raw_id", T.pick_question(i).alias("question"), T.pick_gold(i).alias("gold"))


# ------------------------------------------------------------------ choice rules (X3-X5, G2) on events

def _x4_sql(t: str) -> str:
    # parser option rule for texts with at most one trigger (the fixture's shape)
    parts = f"regexp_split_to_array({t}, 'choice is|answer is')"
    tail = f"ltrim(trim(rtrim(rtrim(trim({parts}[-1], chr(10)), '.'), '/'), ' '), ':')"
    letters = f"regexp_extract_all(upper({tail}), '\\b(A|B|C|D|E)\\b', 1)"
    pick = (f"CASE WHEN len({letters}) > 0 THEN (CASE WHEN len({parts}) > 1 THEN {letters}[1] ELSE {letters}[-1] END) "
            f"ELSE trim(trim({tail}, {WS}), '.') END")
    return f"rtrim(rtrim({pick}, '.'), '/')"


def _x5_sql(t: str) -> str:
    tail = f"ltrim(trim(rtrim(rtrim(trim({t}, chr(10)), '.'), '/'), ' '), ':')"
    letters = f"regexp_extract_all(upper({tail}), '\\b(A|B|C|D|E)\\b', 1)"
    pick = f"CASE WHEN len({letters}) > 0 THEN {letters}[-1] ELSE trim(trim({tail}, {WS}), '.') END"
    return f"rtrim(rtrim({pick}, '.'), '/')"


@register("x3_x4_x5_g2_choices", f"""
WITH c AS ({FX.CHOICE_SQL}),
e AS (SELECT event_id, text, gold,
  CASE WHEN regexp_extract(lower(replace(text, 'choice is', 'answer is')), 'answer is \\(?([abcde])\\)?', 1) <> ''
       THEN upper(regexp_extract(lower(replace(text, 'choice is', 'answer is')), 'answer is \\(?([abcde])\\)?', 1)) ELSE 'placeholder' END AS phrase,
  {_x4_sql('text')} AS option, {_x5_sql('text')} AS last_option FROM c)
SELECT event_id, phrase, option, last_option, gold IN ('A','B','C','D','E') AND last_option = gold AS choice_correct FROM e""")
def q_x3(spark, sf_dir):
    c = FX.choices(spark, sf_dir)
    out = c.select("event_id", "gold", X.phrase_choice("text").alias("phrase"), X.option_choice("text").alias("option"),
                   X.last_option("text").alias("last_option"))
    return out.select("event_id", "phrase", "option", "last_option",
                      (F.col("gold").isin("A", "B", "C", "D", "E") & (F.col("last_option") == F.col("gold"))).alias("choice_correct"))


@register("x6_x7_orders", f"""
WITH o AS ({FX.ORDER_TEXTS_SQL})
SELECT o_orderkey, nullif(trim(regexp_extract(hash_text, '#### ([-+]?\\d+\\.\\d*|[-+]?\\d+)', 1), {WS}), '') AS hash_answer,
  CASE WHEN regexp_matches(theorem_text, '^-?[\\d\\.]+\\s\\D+$') OR regexp_matches(theorem_text, '^-?[\\d\\.]+\\s[^\\s]+$')
       THEN split_part(theorem_text, ' ', 1) ELSE theorem_text END AS theorem_answer,
  coalesce(regexp_extract_all(theorem_text, '-?\\d*\\.?\\d+')[-1], '') AS last_number
FROM o""")
def q_x6(spark, sf_dir):
    o = FX.order_texts(spark, sf_dir)
    return o.select("o_orderkey", X.hash_mark("hash_text").alias("hash_answer"), X.theorem_answer("theorem_text").alias("theorem_answer"),
                    X.theorem_answer("theorem_text", answer_flag=False).alias("last_number"))


# ------------------------------------------------------------------ every branch of the rules (X1-X5, X7, N2, G0, G5, G7) on part

_RULE_FNS = {"boxed": X.final_answer, "phrase": X.phrase_choice, "option": X.option_choice, "last_option": X.last_option,
             "theorem": X.theorem_answer, "number_words": N.number_words}


@register("x_n_rule_branches", "SELECT p_partkey, " + ", ".join(
    f"{FX.by_case_sql([want for _, want in cases])} AS {rule}" for rule, cases in FX.RULE_CASES.items()) + " FROM part")
def q_rule_branches(spark, sf_dir):
    pt = read_table(spark, sf_dir, "part")
    texts = pt.select("p_partkey", *[FX.by_case([t for t, _ in cases]).alias(rule) for rule, cases in FX.RULE_CASES.items()])
    return texts.select("p_partkey", *[fn(F.col(rule)).alias(rule) for rule, fn in _RULE_FNS.items()])


@register("g0_g5_g7_strict_grades", f"""
SELECT p_partkey, {FX.by_case_sql(["true" if c[2] else "false" for c in FX.STRICT_CASES])} = 'true' AS is_correct,
  {FX.by_case_sql([c[3] for c in FX.STRICT_CASES])} AS rung FROM part""")
def q_strict(spark, sf_dir):
    pt = read_table(spark, sf_dir, "part")
    t = pt.select("p_partkey", FX.by_case([c[0] for c in FX.STRICT_CASES]).alias("pred"), FX.by_case([c[1] for c in FX.STRICT_CASES]).alias("gold"))
    strict = G.GradeConfig(include_percentage=False, is_close=False)
    return G.grade(t, "pred", "gold", normalize=False, cfg=strict).select("p_partkey", "is_correct", "rung")


# ------------------------------------------------------------------ lists and tuples (G4, G8, G9, J4) on part

_ELEM_EQ = ("(lower(trim({a}, {ws})) = lower(trim({b}, {ws})) OR "
            "(TRY_CAST(replace({a}, ',', '') AS DOUBLE) IS NOT NULL AND TRY_CAST(replace({b}, ',', '') AS DOUBLE) IS NOT NULL AND "
            "list_bool_or(list_transform([TRY_CAST({b} AS DOUBLE) / 100.0, TRY_CAST({b} AS DOUBLE), TRY_CAST({b} AS DOUBLE) * 100.0], "
            "lambda y: abs(TRY_CAST({a} AS DOUBLE) - y) <= greatest(1e-9 * greatest(abs(TRY_CAST({a} AS DOUBLE)), abs(y)), 1e-4)))) OR "
            "(NOT (TRY_CAST(replace({a}, ',', '') AS DOUBLE) IS NOT NULL AND TRY_CAST(replace({b}, ',', '') AS DOUBLE) IS NOT NULL) AND {a} <> '' AND "
            "lower(regexp_replace(trim({a}, {ws}), '[{{}}()]', '', 'g')) = lower(regexp_replace(trim({b}, {ws}), '[{{}}()]', '', 'g'))))")


def _elem_eq(a: str, b: str) -> str:
    return _ELEM_EQ.format(a=a, b=b, ws=WS)


@register("g4_g8_g9_tuples", f"""
WITH t AS ({FX.TUPLES_SQL}),
s AS (SELECT p_partkey, pred, gold,
        list_sort(list_transform(string_split(pred, ','), lambda x: trim(x, {WS}))) AS ps,
        list_sort(list_transform(string_split(gold, ','), lambda x: trim(x, {WS}))) AS gs,
        string_split(pred[2:-2], ',') AS pl, string_split(gold[2:-2], ',') AS gl FROM t),
r AS (SELECT p_partkey,
  CASE WHEN lower(trim(pred, {WS})) = lower(trim(gold, {WS})) THEN 'exact'
       WHEN contains(pred, ',') AND contains(gold, ',') AND len(ps) = len(gs)
            AND list_bool_and(list_transform(list_zip(ps, gs), lambda z: {_elem_eq('z[1]', 'z[2]')})) THEN 'comma_list'
       WHEN lower(regexp_replace(pred, '[{{}}()]', '', 'g')) = lower(regexp_replace(gold, '[{{}}()]', '', 'g')) THEN 'brackets'
       WHEN regexp_matches(pred, '^[(\\[].+[)\\]]') AND regexp_matches(gold, '^[(\\[].+[)\\]]') AND len(pl) = len(gl)
            AND list_bool_and(list_transform(list_zip(pl, gl), lambda z: {_elem_eq('z[1]', 'z[2]')})) THEN 'ordered_list'
       ELSE 'symbolic' END AS rung FROM s)
SELECT p_partkey, rung, rung <> 'symbolic' AS is_correct FROM r""")
def q_g4(spark, sf_dir):
    t = FX.tuples(spark, sf_dir)
    g = G.grade(ensure_parallelism(t), "pred", "gold")
    return g.select("p_partkey", "rung", "is_correct")


@register("j4_pair_elements", f"""
WITH t AS ({FX.TUPLES_SQL}),
s AS (SELECT p_partkey, string_split(regexp_replace(pred, '[()]|\\[|\\]', '', 'g'), ',') AS pl,
        string_split(regexp_replace(gold, '[()]|\\[|\\]', '', 'g') || CASE WHEN p_partkey % 5 = 0 THEN ',9' ELSE '' END, ',') AS gl FROM t)
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, pl[i] AS pl_item, gl[i] AS gl_item, len(pl) = len(gl) AS length_match
FROM s, range(1, greatest(len(pl), len(gl)) + 1) r(i)""")
def q_j4(spark, sf_dir):
    bare = lambda c: F.regexp_replace(c, r"[()]|\[|\]", "")
    longer = F.when(F.col("p_partkey") % 5 == 0, F.lit(",9")).otherwise(F.lit(""))
    lists = FX.tuples(spark, sf_dir).select("p_partkey", F.split(bare("pred"), ",").alias("pl"), F.split(F.concat(bare("gold"), longer), ",").alias("gl"))
    return G.pair_elements(lists, "pl", "gl", ["p_partkey"]).withColumn("pos", F.col("pos").cast("int"))


@register("j2_pair_with_sources", f"""
WITH p AS ({FX.PREDICTIONS_SQL}),
s AS (SELECT l_returnflag AS dataset_name,
        concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                  strftime(l_shipdate, '%Y%m%d%H%M%S')) || CASE WHEN l_linestatus = 'O' THEN '' ELSE '-old' END AS raw_id FROM lineitem),
j AS (SELECT CASE WHEN p.raw_id IS NULL THEN 'source_only' WHEN s.raw_id IS NULL THEN 'prediction_only' ELSE 'matched' END AS match_status
      FROM p FULL JOIN s ON p.dataset_name = s.dataset_name AND p.raw_id = s.raw_id)
SELECT match_status, count(*) AS n FROM j GROUP BY match_status""")
def q_j2(spark, sf_dir):
    pr = FX.predictions(spark, sf_dir)
    li = read_table(spark, sf_dir, "lineitem")
    own = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                      F.date_format("l_shipdate", "yyyyMMddHHmmss"))
    src = li.select(F.col("l_returnflag").alias("dataset_name"),
                    F.concat(own, F.when(F.col("l_linestatus") == "O", F.lit("")).otherwise(F.lit("-old"))).alias("raw_id"))
    return G.pair_with_sources(pr, src).groupBy("match_status").agg(F.count(F.lit(1)).alias("n"))


@register("j2_duplicate_ids", """
SELECT l_returnflag AS dataset_name, CAST(l_orderkey AS VARCHAR) AS raw_id, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def q_j2_dup(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return G.duplicate_ids(li.select(F.col("l_returnflag").alias("dataset_name"), F.col("l_orderkey").cast("string").alias("raw_id")))


# ------------------------------------------------------------------ vectors

@register("v1_mean_pool", f"""
WITH v AS ({FX.VECTORS_SQL}), e AS (SELECT label, unnest(vec) AS x, unnest(generate_series(1, len(vec))) AS i FROM v),
a AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i)
SELECT label, list(round(m, 6) ORDER BY i) AS mean FROM a GROUP BY label""")
def q_v1(spark, sf_dir):
    m = V.mean_pool(FX.vectors(spark, sf_dir), "label")
    return m.select("label", F.transform("mean", lambda x: F.round(x, 6)).alias("mean"))


@register("v2_mean_max_pool", f"""
WITH v AS ({FX.VECTORS_SQL}), e AS (SELECT label, unnest(vec) AS x, unnest(generate_series(1, len(vec))) AS i FROM v),
a AS (SELECT label, i, avg(x) AS m, max(x) AS mx FROM e GROUP BY label, i)
SELECT label, list_concat(list(round(m, 6) ORDER BY i), list(round(mx, 6) ORDER BY i)) AS pooled FROM a GROUP BY label""")
def q_v2(spark, sf_dir):
    m = V.mean_max_pool(FX.vectors(spark, sf_dir), "label")
    return m.select("label", F.transform("pooled", lambda x: F.round(x, 6)).alias("pooled"))


_SCORES_SQL = f"""
v AS ({FX.VECTORS_SQL}), b AS ({FX.BANK_SQL}),
sc AS (SELECT v.item_id, b.bank_id, list_dot_product(v.vec, b.vec) AS logit, b.bias, b.vec AS bvec FROM v, b)
"""


@register("v3_score_against_bank", "WITH " + _SCORES_SQL + "SELECT item_id, 0 AS slot, list(round(logit, 6) ORDER BY bank_id) AS logits FROM sc GROUP BY item_id")
def q_v3(spark, sf_dir):
    s = V.logits_per_item(FX.vectors(spark, sf_dir), FX.bank(spark, sf_dir))
    return s.select("item_id", "slot", F.transform("logits", lambda x: F.round(x, 6)).alias("logits"))


_W_SQL = "WITH " + _SCORES_SQL + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY logit + bias DESC, bank_id) - 1 AS rank FROM sc),
ch0 AS (SELECT * FROM rk WHERE rank < 4),
ch AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY item_id)) AS e FROM ch0),
w AS (SELECT *, e / sum(e) OVER (PARTITION BY item_id) AS weight FROM ch)
"""


@register("v4_v5_route_topk", _W_SQL + """
SELECT item_id, 0 AS slot, CAST(rank AS INTEGER) AS rank, bank_id, round(logit, 6) AS logit, round(weight, 6) AS weight FROM w""")
def q_v4(spark, sf_dir):
    r = V.routes(V.route_topk(FX.vectors(spark, sf_dir), FX.bank(spark, sf_dir), k=4))
    return r.select("item_id", "slot", F.col("rank").cast("int").alias("rank"), "bank_id", r6("logit").alias("logit"), r6("weight").alias("weight"))


@register("v5_given_logits_by_slot", """
WITH l AS (SELECT vec_id AS item_id, unnest(CAST(embedding AS DOUBLE[])) AS logit, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings),
rk AS (SELECT item_id, CAST(floor(i / 16) AS INTEGER) AS slot, CAST(i % 16 AS BIGINT) AS bank_id, logit,
         row_number() OVER (PARTITION BY item_id, floor(i / 16) ORDER BY logit + CASE WHEN i % 16 = 3 THEN 0.05 ELSE 0.0 END DESC, i) - 1 AS rank FROM l),
ch AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY item_id, slot)) / 0.5) AS e FROM rk WHERE rank < 3)
SELECT item_id, slot, CAST(rank AS INTEGER) AS rank, bank_id, round(logit, 6) AS logit,
  round(e / sum(e) OVER (PARTITION BY item_id, slot), 6) AS weight FROM ch""")
def q_v4_given(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    per_slot = F.transform(F.sequence(F.lit(0), (F.size("embedding") / 16).cast("int") - 1), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    items = e.select(F.col("vec_id").alias("item_id"), per_slot.alias("logits"))
    r = V.routes(V.route_given_logits(items, k=3, temperature=0.5, bias=[0.05 if i == 3 else 0.0 for i in range(16)]))
    return r.select("item_id", "slot", F.col("rank").cast("int").alias("rank"), "bank_id", r6("logit").alias("logit"), r6("weight").alias("weight"))


@register("v6_combine", _W_SQL + """,
ex AS (SELECT item_id, weight, unnest(bvec) AS x, unnest(generate_series(1, len(bvec))) AS i FROM w),
s AS (SELECT item_id, i, sum(weight * x) AS y FROM ex GROUP BY item_id, i)
SELECT item_id, 0 AS slot, list(round(y, 6) ORDER BY i) AS combined FROM s GROUP BY item_id""")
def q_v6(spark, sf_dir):
    c = V.combine(V.route_topk(FX.vectors(spark, sf_dir), FX.bank(spark, sf_dir), k=4))
    return c.select("item_id", "slot", F.transform("combined", lambda x: F.round(x, 6)).alias("combined"))


@register("v7_bank_load", _W_SQL + """
SELECT b.bank_id, CAST(count(w.item_id) AS BIGINT) AS load FROM b LEFT JOIN w USING (bank_id) GROUP BY b.bank_id""")
def q_v7(spark, sf_dir):
    bank = FX.bank(spark, sf_dir)
    r = V.routes(V.route_topk(FX.vectors(spark, sf_dir), bank, k=4))
    return V.bank_load(r, bank)


@register("v8_rebalance", _W_SQL + """,
ld AS (SELECT b.bank_id, CAST(count(w.item_id) AS BIGINT) AS load FROM b LEFT JOIN w USING (bank_id) GROUP BY b.bank_id),
t AS (SELECT *, sum(load) OVER () / count(*) OVER () AS target FROM ld)
SELECT bank_id, load, round(target, 6) AS target,
  round(CAST(CASE WHEN load > target * 1.05 THEN -0.0001 WHEN load < target * 0.95 THEN 0.0001 ELSE 0.0 END AS DOUBLE), 6) AS bias FROM t""")
def q_v8(spark, sf_dir):
    bank = FX.bank(spark, sf_dir)
    load = V.bank_load(V.routes(V.route_topk(FX.vectors(spark, sf_dir), bank, k=4)), bank)
    r = V.rebalance(load, bank, gamma=1e-4, tol=0.05)
    return r.select("bank_id", "load", r6("target").alias("target"), r6("bias").alias("bias"))


@register("v9_gaussian_kl", f"""
WITH l AS ({FX.LATENTS_SQL}),
r AS (SELECT list_sum(list_transform(list_zip(mu, logvar), lambda z:
        -0.5 * (1 + least(greatest(z[2], -10), 10) - pow(least(greatest(z[1], -10), 10), 2) - exp(least(greatest(z[2], -10), 10))))) AS k FROM l)
SELECT round(avg(k) * 0.1, 6) AS kl FROM r""")
def q_v9(spark, sf_dir):
    k = V.gaussian_kl(FX.latents(spark, sf_dir), beta=0.1)
    return k.select(r6("kl").alias("kl"))


@register("v10_vector_mse", f"""
WITH l AS ({FX.LATENTS_SQL})
SELECT round(sum(list_sum(list_transform(list_zip(mu, logvar), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / sum(len(mu)) * 0.1, 6) AS mse FROM l""")
def q_v10(spark, sf_dir):
    m = V.vector_mse(FX.latents(spark, sf_dir), "mu", "logvar", beta=0.1)
    return m.select(r6("mse").alias("mse"))


@register("v11_orthogonality_penalty", f"""
WITH v AS ({FX.VECTORS_SQL}),
e AS (SELECT item_id, unnest(vec) AS x, unnest(generate_series(1, len(vec))) AS i FROM v),
g AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS value FROM e a JOIN e b USING (item_id) GROUP BY a.i, b.i),
f AS (SELECT sum(pow(value - CASE WHEN i = j THEN 1.0 ELSE 0.0 END, 2)) AS fr FROM g)
SELECT round(fr, 4) AS frob_u, round(fr, 4) AS frob_v, round(2 * fr * 0.1, 4) AS penalty FROM f""")
def q_v11(spark, sf_dir):
    v = FX.vectors(spark, sf_dir)
    o = V.orthogonality_penalty(v, v, beta=0.1)
    return o.select(F.round("frob_u", 4).alias("frob_u"), F.round("frob_v", 4).alias("frob_v"), F.round("penalty", 4).alias("penalty"))


_U = "((('0x' || substr(md5('42:' || CAST(item_id AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR) || ':{s}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


@register("v12_gaussian_sample", f"""
WITH l AS ({FX.LATENTS_SQL})
SELECT item_id, list_transform(list_zip(mu, logvar), lambda z, i:
   round(z[1] + exp(z[2] * 0.5) * sqrt(-2.0 * ln({_U.format(s='a')})) * cos(2.0 * 3.141592653589793 * {_U.format(s='b')}), 6)) AS z
FROM l""")
def q_v12(spark, sf_dir):
    z = V.gaussian_sample(FX.latents(spark, sf_dir), seed=42)
    return z.select("item_id", F.transform("z", lambda x: F.round(x, 6)).alias("z"))


@register("v13_project", f"""
WITH v AS ({FX.VECTORS_SQL}), b AS ({FX.BANK_SQL}),
c AS (SELECT v.item_id, b.bank_id, list_dot_product(v.vec, b.vec) AS coef, b.vec AS bvec FROM v, b),
e AS (SELECT item_id, coef, unnest(bvec) AS x, unnest(generate_series(1, len(bvec))) AS i FROM c),
s AS (SELECT item_id, i, 2.0 * sum(coef * x) AS y FROM e GROUP BY item_id, i)
SELECT item_id, CAST(i - 1 AS INTEGER) AS pos, round(y, 4) + 0.0 AS value FROM s""")
def q_v13(spark, sf_dir):
    bank = FX.bank(spark, sf_dir).select(F.col("bank_id").alias("rank_id"), "vec")
    p = V.project(FX.vectors(spark, sf_dir), bank, bank, scale=2.0)
    return p.select("item_id", F.posexplode("projected").alias("pos", "value")).withColumn("value", F.round("value", 4) + F.lit(0.0))


# ------------------------------------------------------------------ sources and sinks (S1-S8) and streaming (M1)

PRED_SCHEMA = "dataset_name string, raw_id string, decoded_prediction string, reference_answer string"


@register("s3_s5_jsonl_roundtrip", f"SELECT * FROM ({FX.PREDICTIONS_SQL})")
def q_s3(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    SRC.write_jsonl(FX.predictions(spark, sf_dir), path, mode="w")
    return SRC.read_jsonl(spark, path, PRED_SCHEMA)


@register("s1_s2_array_files", "SELECT source, doc_id, text, false AS bad FROM documents UNION ALL SELECT DISTINCT source, NULL, NULL, true FROM documents")
def q_s1_arrays(spark, sf_dir):
    """JSON array files (one a source, each with one malformed record), read by a parallel scan."""
    path = scratch_path(spark, "arrays")
    d = read_table(spark, sf_dir, "documents")
    records = F.array_join(F.collect_list(F.to_json(F.struct("doc_id", "text"))), ", ")
    files = d.groupBy("source").agg(F.concat(F.lit('[ {"doc_id": 1 2},\n'), records, F.lit("]")).alias("value"))
    files.write.partitionBy("source").text(path)
    names = [r["source"] for r in d.select("source").distinct().collect()]  # dataset names: a handful of folders
    records, _ = SRC.scan_eval_sets(spark, path, sorted(names), "doc_id long, text string", "{dir}/source={name}", array_file=True)
    return records.select(F.col("dataset_name").alias("source"), "doc_id", "text", F.col("error").isNotNull().alias("bad"))


@register("s5_ascii_roundtrip", "SELECT doc_id, text, source, true AS ascii_only FROM documents")
def q_s5_ascii(spark, sf_dir):
    path = scratch_path(spark, "ascii")
    SRC.write_jsonl(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path, mode="w", force_ascii=True)
    lines = spark.read.text(path)
    r = lines.select(F.from_json("value", "doc_id long, text string, source string").alias("r"), F.col("value").rlike(r"^[\x00-\x7F]*$").alias("ascii_only"))
    return r.select("r.*", "ascii_only")


@register("s1_scan_instructions", f"SELECT instruction, input, output, answer, raw_id, category FROM ({FX.INSTRUCTIONS_SQL})")
def q_s1(spark, sf_dir):
    path = scratch_path(spark, "instructions")
    i = FX.instructions(spark, sf_dir).select("instruction", "input", "output", "answer", "raw_id", "category")
    i.write.mode("overwrite").json(f"{path}/train.json")
    return SRC.scan_instructions(spark, path, "train", array_file=False)["train"]


@register("s2_scan_eval_sets", f"""
WITH p AS ({FX.PREDICTIONS_SQL}),
c AS (SELECT dataset_name, count(*) AS rows FROM p GROUP BY dataset_name)
SELECT dataset_name, rows, false AS failed FROM c UNION ALL SELECT 'missing_set', NULL, true""")
def q_s2(spark, sf_dir):
    path = scratch_path(spark, "evalsets")
    SRC.write_predictions(FX.predictions(spark, sf_dir), path, fmt="json")
    schema = "raw_id string, decoded_prediction string, reference_answer string"
    names = ["A", "N", "R", "missing_set"]
    recs, errs = SRC.scan_eval_sets(spark, path, names, schema=schema, template="{dir}/dataset_name={name}", array_file=False)
    counts = recs.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("rows")).withColumn("failed", F.lit(False))
    fails = errs.select("dataset_name", F.lit(None).cast("long").alias("rows"), F.lit(True).alias("failed"))
    return counts.unionByName(fails)


@register("s6_s7_write_read_metrics", GRADED_SQL + """
SELECT dataset_name, count(*) AS total_samples, CAST(count_if(is_correct) AS BIGINT) AS correct_samples FROM graded GROUP BY dataset_name""")
def q_s7(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    m = A.score(graded_predictions(spark, sf_dir)).select("dataset_name", "total_samples", "correct_samples")
    SRC.write_metrics(m, path, run_stamp="20260101_000000")
    return spark.read.schema("dataset_name string, total_samples long, correct_samples long").json(path)


@register("s8_write_history", f"""
WITH h AS ({FX.LOG_SQL})
SELECT CASE WHEN eval_loss IS NOT NULL THEN 'eval' ELSE 'train' END AS phase, count(*) AS rows
FROM h WHERE eval_loss IS NOT NULL OR loss IS NOT NULL GROUP BY 1""")
def q_s8(spark, sf_dir):
    path = scratch_path(spark, "history")
    SRC.write_history(FX.log_history(spark, sf_dir), path)
    h = spark.read.schema("run string, step long, loss double, eval_loss double, phase string").json(path)
    return h.groupBy("phase").agg(F.count(F.lit(1)).alias("rows"))


@register("m1_stream_score", GRADED_SQL + """
SELECT dataset_name, count(*) AS total_samples, CAST(count_if(is_correct) AS BIGINT) AS correct_samples,
       round(count_if(is_correct) / count(*), 6) AS test_accuracy, CAST(0 AS BIGINT) AS malformed FROM graded GROUP BY dataset_name
UNION ALL SELECT NULL, CAST(0 AS BIGINT), CAST(0 AS BIGINT), NULL, count(*) FROM nation""")
def q_m1(spark, sf_dir):
    """Predictions as they arrive, among them broken lines (one made from each nation)."""
    from marksheet.streaming.score_stream import stream_score
    src = scratch_path(spark, "stream-src")
    FX.predictions(spark, sf_dir).write.mode("overwrite").json(src)
    broken = F.concat(F.lit('{"dataset_name": "A", "raw_id": "'), F.col("n_name"), F.lit('", "decoded_pre'))
    read_table(spark, sf_dir, "nation").select(broken.alias("value")).write.mode("append").text(src)
    t = stream_score(spark, src)
    return t.select("dataset_name", "total_samples", "correct_samples", r6("test_accuracy").alias("test_accuracy"), "malformed")


@register("m1_keyed_resent", f"""
WITH p AS (SELECT source AS dataset_name, doc_id % 3 = 0 OR doc_id % 5 = 0 AS ok FROM documents)
SELECT dataset_name, count(*) AS total_samples, CAST(count_if(ok) AS BIGINT) AS correct_samples, round(count_if(ok) / count(*), 6) AS test_accuracy, CAST(0 AS BIGINT) AS malformed
FROM p GROUP BY dataset_name""")
def q_m1_keyed(spark, sf_dir):
    """Predictions that arrive in files, all of which are sent twice; a fifth is corrected later."""
    from marksheet.streaming.score_stream import stream_score_keyed
    src = scratch_path(spark, "keyed-src")
    d = read_table(spark, sf_dir, "documents")
    text = lambda right: F.concat(F.lit("so \\boxed{"), (F.col("n_chars") + F.when(right, 0).otherwise(1)).cast("string"), F.lit("}"))
    first = d.select(F.col("source").alias("dataset_name"), F.col("doc_id").cast("string").alias("raw_id"), text(F.col("doc_id") % 3 == 0).alias("decoded_prediction"),
                     F.col("n_chars").cast("string").alias("reference_answer"), F.lit("2024-01-01T00:00:00").alias("sent_at"))
    fixed = first.withColumn("doc_id", F.col("raw_id").cast("long")).where("doc_id % 5 = 0").drop("doc_id").withColumn(
        "decoded_prediction", F.concat(F.lit("so \\boxed{"), F.col("reference_answer"), F.lit("}"))).withColumn("sent_at", F.lit("2024-01-02T00:00:00"))
    for part in (first.repartition(3), fixed, first.repartition(2)):
        part.write.mode("append").json(src)
    t = stream_score_keyed(spark, src, schema="dataset_name string, raw_id string, decoded_prediction string, reference_answer string, sent_at string", max_files=2, sent_col="sent_at")
    return t.select("dataset_name", "total_samples", "correct_samples", r6("test_accuracy").alias("test_accuracy"), "malformed")


# ------------------------------------------------------------------ normalization on derived answers

ANSWERS_SQL = r"""
SELECT p_partkey,
  CASE p_partkey % 12
    WHEN 0 THEN CAST(p_size AS VARCHAR) || ' cm'
    WHEN 1 THEN '\frac' || CAST(p_partkey % 9 + 1 AS VARCHAR) || CAST(p_size % 9 + 1 AS VARCHAR)
    WHEN 2 THEN CAST(p_size AS VARCHAR) || '/' || CAST(p_partkey % 7 + 1 AS VARCHAR)
    WHEN 3 THEN 'x=' || CAST(p_size AS VARCHAR)
    WHEN 4 THEN '\text{' || CAST(p_size AS VARCHAR) || ' dollars}'
    WHEN 5 THEN CAST(p_size AS VARCHAR) || '.00'
    WHEN 6 THEN '\left(' || CAST(p_size AS VARCHAR) || ',' || CAST(p_partkey % 7 AS VARCHAR) || '\right)'
    WHEN 7 THEN CAST(p_size AS VARCHAR) || '\%'
    WHEN 8 THEN '\sqrt' || CAST(p_size AS VARCHAR)
    WHEN 9 THEN CAST(p_size AS VARCHAR) || '^\circ'
    WHEN 10 THEN CAST(p_size AS VARCHAR) || '\pi'
    ELSE '{\pi} + ' || CAST(p_size AS VARCHAR) || ' $' END AS answer
FROM part
"""


def answers(spark, sf_dir):
    pt = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 12
    s = F.col("p_size").cast("string")
    a = (F.when(k == 0, F.concat(s, F.lit(" cm")))
         .when(k == 1, F.concat(F.lit("\\frac"), (F.col("p_partkey") % 9 + 1).cast("string"), (F.col("p_size") % 9 + 1).cast("string")))
         .when(k == 2, F.concat(s, F.lit("/"), (F.col("p_partkey") % 7 + 1).cast("string")))
         .when(k == 3, F.concat(F.lit("x="), s))
         .when(k == 4, F.concat(F.lit("\\text{"), s, F.lit(" dollars}")))
         .when(k == 5, F.concat(s, F.lit(".00")))
         .when(k == 6, F.concat(F.lit("\\left("), s, F.lit(","), (F.col("p_partkey") % 7).cast("string"), F.lit("\\right)")))
         .when(k == 7, F.concat(s, F.lit("\\%")))
         .when(k == 8, F.concat(F.lit("\\sqrt"), s))
         .when(k == 9, F.concat(s, F.lit("^\\circ")))
         .when(k == 10, F.concat(s, F.lit("\\pi")))
         .otherwise(F.concat(F.lit("{\\pi} + "), s, F.lit(" $"))))
    return pt.select("p_partkey", a.alias("answer"))


@register("n7_parse_number", f"""
WITH a AS ({ANSWERS_SQL}), c AS (SELECT p_partkey, replace(answer, ',', '') AS s FROM a)
SELECT p_partkey, CASE WHEN regexp_full_match(s, '\\s*[+-]?([0-9](_?[0-9])*(\\.([0-9](_?[0-9])*)?)?|\\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?\\s*')
                       THEN CAST(replace(s, '_', '') AS DOUBLE)
                       WHEN s LIKE '%\\%' AND regexp_full_match(rtrim(left(s, length(s) - 1), '\\'), '[+-]?[0-9]+(\\.[0-9]*)?')
                       THEN CAST(regexp_replace(left(s, length(s) - 1), '\\\\$', '') AS DOUBLE) / 100 END AS number
FROM c""")
def q_n7(spark, sf_dir):
    a = answers(spark, sf_dir)
    return a.select("p_partkey", N.parse_number("answer").alias("number"))


@register("n1_math_normalize", OT.math_profile_sql(ANSWERS_SQL))
def q_n1(spark, sf_dir):
    a = answers(spark, sf_dir)
    return a.select("p_partkey", "answer", N.math_profile("answer").alias("normalized"))


@register("n6_final_normalize", OT.final_profile_sql(ANSWERS_SQL))
def q_n6(spark, sf_dir):
    a = answers(spark, sf_dir)
    return a.select("p_partkey", "answer", N.final_profile("answer").alias("normalized"))


@register("x8_clean_units", OT.clean_units_sql(ANSWERS_SQL))
def q_x8(spark, sf_dir):
    a = answers(spark, sf_dir)
    return a.select("p_partkey", X.clean_units("answer").alias("cleaned"))


G13_GOLD_SQL = f"""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN answer || ' ' WHEN 1 THEN '0' || answer ELSE answer || '1' END AS answer
FROM ({ANSWERS_SQL})"""


@register("g13_grade_exact", OT.grade_exact_sql(ANSWERS_SQL, G13_GOLD_SQL))
def q_g13(spark, sf_dir):
    a = answers(spark, sf_dir)
    k = F.col("p_partkey") % 3
    gold = (F.when(k == 0, F.concat(F.col("answer"), F.lit(" ")))
            .when(k == 1, F.concat(F.lit("0"), F.col("answer")))
            .otherwise(F.concat(F.col("answer"), F.lit("1"))))
    return a.select("p_partkey", G.grade_exact(F.col("answer"), gold).alias("exact_match"))


# ------------------------------------------------------------------ end-to-end flows (prepare, evaluate)

_PROMPT_SQL = "'<|user|>' || chr(10) || instruction || chr(10) || coalesce(input, '') || '<|end|>' || chr(10)"


@register("e1_prepare_training", f"""
WITH i AS ({FX.INSTRUCTIONS_SQL}),
o AS (SELECT *, row_number() OVER (ORDER BY {_H.format(k='raw_id')}, raw_id) - 1 AS pos, count(*) OVER () AS n FROM i),
s AS (SELECT *, CASE WHEN pos < ceil(0.02 * n) THEN 'val' ELSE 'train' END AS split FROM o),
t AS (SELECT raw_id, split,
        len(regexp_extract_all({_PROMPT_SQL} || '<|assistant|>' || chr(10), {_TOK})) AS prompt_len,
        len(regexp_extract_all({_PROMPT_SQL} || '<|assistant|>' || chr(10) || output || '<|end|>' || chr(10), {_TOK})) AS n_ids
      FROM s)
SELECT raw_id, split, CAST(n_ids AS INTEGER) AS n_ids, CAST(prompt_len AS INTEGER) AS prompt_len, CAST(least(prompt_len, n_ids) AS INTEGER) AS n_masked FROM t""")
def q_e1(spark, sf_dir):
    from marksheet.plans.prepare import prepare_training
    recs = ensure_parallelism(FX.instructions(spark, sf_dir).select("raw_id", "instruction", "input", "output"))
    out = prepare_training(recs, T.template_frame(spark), key="raw_id", val_ratio=0.02)
    parts = []
    for name, df in out.items():
        parts.append(df.select("raw_id", F.lit(name).alias("split"), F.size("input_ids").alias("n_ids"), "prompt_len",
                               F.size(F.filter("labels", lambda x: x == -100)).alias("n_masked")))
    return P.concat_slices(*parts)


@register("e1_prepare_batches", f"""
WITH i AS ({FX.INSTRUCTIONS_SQL}),
t AS (SELECT raw_id,
        len(regexp_extract_all({_PROMPT_SQL} || '<|assistant|>' || chr(10), {_TOK})) AS prompt_len,
        len(regexp_extract_all({_PROMPT_SQL} || '<|assistant|>' || chr(10) || output || '<|end|>' || chr(10), {_TOK})) AS n_ids,
        floor((row_number() OVER (ORDER BY {_H.format(k='raw_id')}, raw_id) - 1) / 16) AS batch_id
      FROM i),
w AS (SELECT *, ceil(max(n_ids) OVER (PARTITION BY batch_id) / 8.0) * 8 AS width FROM t)
SELECT raw_id, CAST(batch_id AS BIGINT) AS batch_id, CAST(width AS INTEGER) AS width, CAST(n_ids AS INTEGER) AS n_attended,
  CAST(least(prompt_len, n_ids) + width - n_ids AS INTEGER) AS n_ignored FROM w""")
def q_e1b(spark, sf_dir):
    from marksheet.plans.prepare import prepare_training, training_batches
    recs = ensure_parallelism(FX.instructions(spark, sf_dir).select("raw_id", "instruction", "input", "output"))
    rows = prepare_training(recs, T.template_frame(spark), key="raw_id", val_ratio=0.0)["train"]
    b = training_batches(rows, 16, "raw_id", multiple_of=8)
    return b.select("raw_id", "batch_id", F.size("input_ids").alias("width"), F.size(F.filter("attention_mask", lambda x: x)).alias("n_attended"),
                    F.size(F.filter("labels", lambda x: x == -100)).alias("n_ignored"))


@register("u1_prepare_with_tokenizer", f"""
WITH i AS ({FX.INSTRUCTIONS_SQL}),
t AS (SELECT raw_id, string_split({_PROMPT_SQL} || '<|assistant|>' || chr(10), ' ') AS p,
        string_split({_PROMPT_SQL} || '<|assistant|>' || chr(10) || output || '<|end|>' || chr(10), ' ') AS f FROM i),
c AS (SELECT raw_id, p, f, unnest(range(0, CAST(ceil(len(f) / 512.0) AS BIGINT))) AS chunk_no FROM t)
SELECT raw_id, CAST(chunk_no AS INTEGER) AS chunk_no, list_transform(f[chunk_no * 512 + 1 : chunk_no * 512 + 512], lambda x: CAST(length(x) AS INTEGER)) AS input_ids,
  CAST(least(greatest(len(p) - chunk_no * 512, 0), len(f[chunk_no * 512 + 1 : chunk_no * 512 + 512])) AS INTEGER) AS n_masked FROM c""")
def q_u1(spark, sf_dir):
    from marksheet.plans.prepare import prepare_training

    def make_tokenizer():
        return lambda texts: [[len(w) for w in t.split(" ")] for t in texts]

    recs = ensure_parallelism(FX.instructions(spark, sf_dir).select("raw_id", "instruction", "input", "output"))
    rows = prepare_training(recs, T.template_frame(spark), key="raw_id", val_ratio=0.0, max_len=512, make_tokenizer=make_tokenizer)["train"]
    return rows.select("raw_id", "chunk_no", "input_ids", F.size(F.filter("labels", lambda x: x == -100)).alias("n_masked"))


@register("e2_evaluate_sets", GRADED_SQL + f"""
, m AS (SELECT dataset_name, count(*) AS total_samples, CAST(count_if(is_correct) AS BIGINT) AS correct_samples FROM graded GROUP BY dataset_name)
SELECT dataset_name, round(correct_samples / total_samples, 6) AS test_accuracy, total_samples, correct_samples, false AS failed FROM m
UNION ALL SELECT 'missing_set', NULL, NULL, NULL, true""")
def q_e2(spark, sf_dir):
    from marksheet.plans.evaluate import evaluate_sets
    path = scratch_path(spark, "evalsets")
    recs = FX.predictions(spark, sf_dir).withColumnRenamed("reference_answer", "answer")
    SRC.write_predictions(recs, path, fmt="json")
    out = evaluate_sets(spark, path, ["A", "N", "R", "missing_set"],
                        schema="raw_id string, decoded_prediction string, answer string",
                        template="{dir}/dataset_name={name}", array_file=False, exempt="N")
    m = out["metrics"]
    return m.select("dataset_name", r6("test_accuracy").alias("test_accuracy"), "total_samples", "correct_samples",
                    F.col("error").isNotNull().alias("failed"))


@register("e2_evaluation_summary", GRADED_SQL + f"""
SELECT CAST(4 AS BIGINT) AS total_datasets, CAST(3 AS BIGINT) AS successful_datasets, CAST(1 AS BIGINT) AS failed_datasets,
  count(*) AS total_samples, CAST(count_if(is_correct) AS BIGINT) AS total_correct, round(count_if(is_correct) / count(*), 6) AS overall_accuracy FROM graded""")
def q_e2s(spark, sf_dir):
    from marksheet.plans.evaluate import evaluate_sets
    path = scratch_path(spark, "evalsets")
    recs = FX.predictions(spark, sf_dir).withColumnRenamed("reference_answer", "answer")
    SRC.write_predictions(recs, path, fmt="json")
    out = evaluate_sets(spark, path, ["A", "N", "R", "missing_set"],
                        schema="raw_id string, decoded_prediction string, answer string",
                        template="{dir}/dataset_name={name}", array_file=False, exempt="N")
    return out["summary"].withColumn("overall_accuracy", r6("overall_accuracy"))


@register("e2_evaluation_outputs", GRADED_SQL + """
SELECT dataset_name, raw_id, 'solution ' || raw_id AS reference_solution, extracted_prediction, is_correct, t.total_samples
FROM graded JOIN (SELECT dataset_name, count(*) AS total_samples FROM graded GROUP BY dataset_name) t USING (dataset_name)""")
def q_e2o(spark, sf_dir):
    from marksheet.plans.evaluate import evaluate_records
    recs = FX.predictions(spark, sf_dir).withColumnRenamed("reference_answer", "answer").withColumn("output", F.concat(F.lit("solution "), F.col("raw_id")))
    path = scratch_path(spark, "evaluation")
    out = evaluate_records(spark, ensure_parallelism(recs), ["A", "N", "R"], output_dir=path, run_stamp="20260101_000000")
    metrics = spark.read.schema("dataset_name string, total_samples long").json(f"{path}/metrics")
    return out["predictions"].join(metrics, "dataset_name").select("dataset_name", "raw_id", "reference_solution", "extracted_prediction", "is_correct",
                                                                   "total_samples")


_REBALANCE_SQL = f"""
WITH RECURSIVE
v AS ({FX.VECTORS_SQL}), b AS ({FX.BANK_SQL}),
sc AS (SELECT v.item_id, list({{'bank_id': b.bank_id, 'logit': list_dot_product(v.vec, b.vec)}} ORDER BY b.bank_id) AS s
       FROM v, b GROUP BY v.item_id),
pos AS (SELECT item_id, CAST((row_number() OVER (ORDER BY {_H.format(k='item_id')}, item_id) - 1) // 64 AS INTEGER) AS batch_id FROM v),
bt AS (SELECT batch_id, list(s) AS rows FROM sc JOIN pos USING (item_id) GROUP BY batch_id),
ids AS (SELECT list(bank_id ORDER BY bank_id) AS ids FROM b),
steps(step, bias, loads) AS (
  SELECT -1, list_transform(ids, lambda x: CAST(0.0 AS DOUBLE)), list_transform(ids, lambda x: CAST(0 AS BIGINT)) FROM ids
  UNION ALL
  SELECT st.step + 1, nb.bias, nb.loads FROM steps st JOIN bt ON bt.batch_id = st.step + 1 CROSS JOIN ids,
  LATERAL (
    SELECT list_transform(list_zip(ids.ids, st.bias), lambda z: z[2] + CASE
             WHEN len(list_filter(pk.picks, lambda x: x = z[1])) > len(pk.picks) / len(ids.ids) * 1.05 THEN -0.0001
             WHEN len(list_filter(pk.picks, lambda x: x = z[1])) < len(pk.picks) / len(ids.ids) * 0.95 THEN 0.0001
             ELSE 0.0 END) AS bias,
           list_transform(ids.ids, lambda i: len(list_filter(pk.picks, lambda x: x = i))) AS loads
    FROM (SELECT flatten(list_transform(bt.rows, lambda r: list_transform(
            list_sort(list_transform(list_zip(r, st.bias), lambda z: {{'neg': -(z[1].logit + z[2]), 'id': z[1].bank_id}}))[1:4],
            lambda t: t.id))) AS picks) pk) nb
)
SELECT step, bank_id, load, round(bias, 6) AS bias
FROM (SELECT step, unnest(ids.ids) AS bank_id, unnest(loads) AS load, unnest(bias) AS bias FROM steps, ids WHERE step >= 0)"""


@register("v8_rebalance_over_batches", _REBALANCE_SQL)
def q_v8b(spark, sf_dir):
    """Sequential per-batch bias updates (the oracle replays them with a recursive query)."""
    h = V.rebalance_over_batches(FX.vectors(spark, sf_dir), FX.bank(spark, sf_dir), k=4, batch_size=64, gamma=1e-4)
    return h.select("step", "bank_id", "load", r6("bias").alias("bias"))


def _ladder_sql(source_sql: str) -> str:
    """The ladder in SQL over a (p_partkey, pred, gold) source: normalized sides, then the rungs
    in order, with element comparisons (option-stripped answer, list parts, matrix cells,
    equation sides) by exact text, number, or bracket-free text (one level: the fixtures'
    elements are plain)."""
    pn = OT.math_profile_sql("SELECT p_partkey, pred AS answer FROM s")
    gn = OT.math_profile_sql("SELECT p_partkey, gold AS answer FROM s")
    opt = r"^(\([A-E]\)|[A-E]\.|[A-E]\)|\*\*[A-E]\*\*|[A-E]:)"
    num = lambda x: OT.parse_number_sql(x)
    close = lambda a, b: f"(abs(({a}) - ({b})) <= greatest(1e-9 * greatest(abs({a}), abs({b})), 1e-4))"
    numeric_hit = (f"({close(num('p'), num('g') + ' / 100.0')} OR {close(num('p'), num('g'))} OR "
                   f"{close(num('p'), num('g') + ' * 100.0')})")
    ismat = lambda x: (f"((starts_with({x}, '\\begin{{pmatrix}}') OR starts_with({x}, '\\begin{{bmatrix}}')) AND "  # noqa: E731
                       f"(ends_with({x}, '\\end{{pmatrix}}') OR ends_with({x}, '\\end{{bmatrix}}')))")
    rows = lambda x: f"list_filter(list_transform(string_split(trim({x}, {WS})[16:-14], '\\\\'), lambda r: trim(r, {WS})), lambda r: r <> '')"
    cells_ok = (f"len({rows('p')}) = len({rows('g')}) AND coalesce(list_bool_and(list_transform(list_zip({rows('p')}, {rows('g')}), "
                f"lambda z: len(string_split(z[1], '&')) = len(string_split(z[2], '&')) AND "
                f"list_bool_and(list_transform(list_zip(string_split(z[1], '&'), string_split(z[2], '&')), lambda c: {_elem_eq('c[1]', 'c[2]')})))), true)")
    pc = "(length(p) - length(replace(p, '=', '')))"
    gc = "(length(g) - length(replace(g, '=', '')))"
    bracket = ("((starts_with(p, '[') AND ends_with(p, ']') AND NOT starts_with(g, '(')) OR "
               "(starts_with(p, '(') AND ends_with(p, ')') AND NOT starts_with(g, '[')))")
    sp = lambda x: f"list_sort(list_transform(string_split({x}, ','), lambda t: trim(t, {WS})))"
    comma_ok = (f"contains(p, ',') AND contains(g, ',') AND len({sp('p')}) = len({sp('g')}) AND "
                f"list_bool_and(list_transform(list_zip({sp('p')}, {sp('g')}), lambda z: {_elem_eq('z[1]', 'z[2]')}))")
    ps, gs = f"trim(p, {WS})", f"trim(g, {WS})"
    il = lambda x: f"string_split({x}[2:-2], ',')"
    list_ok = (f"regexp_matches({ps}, '^[(\\[].+[)\\]]') AND regexp_matches({gs}, '^[(\\[].+[)\\]]') AND "
               f"len({il(ps)}) = len({il(gs)}) AND list_bool_and(list_transform(list_zip({il(ps)}, {il(gs)}), lambda z: {_elem_eq('z[1]', 'z[2]')}))")
    pb = f"translate(CASE WHEN {bracket} THEN trim(p, '[]()') ELSE p END, '{{}}()', '')"
    gb = f"translate(CASE WHEN {bracket} THEN trim(g, '[]()') ELSE g END, '{{}}()', '')"
    rung = f"""CASE
      WHEN p IS NULL OR g IS NULL THEN 'null'
      WHEN lower(trim(p, {WS})) = lower(trim(g, {WS})) THEN 'exact'
      WHEN g IN ('A', 'B', 'C', 'D', 'E') AND {_x5_sql('p')} = g THEN 'choice'
      WHEN regexp_matches(p, '{opt}') AND {_elem_eq(f"trim(regexp_replace(p, '{opt}', ''), {WS})", 'g')} THEN 'option_mark'
      WHEN {comma_ok} THEN 'comma_list'
      WHEN {num('p')} IS NOT NULL AND {num('g')} IS NOT NULL THEN CASE WHEN {numeric_hit} THEN 'numeric_true' ELSE 'numeric_false' END
      WHEN p = '' THEN 'empty'
      WHEN lower({pb}) = lower({gb}) THEN 'brackets'
      WHEN {list_ok} THEN 'ordered_list'
      WHEN {ismat('p')} AND {ismat('g')} AND {cells_ok} THEN 'matrix'
      WHEN {pc} = 1 AND {gc} = 1 THEN 'symbolic_equation'
      WHEN {pc} = 1 AND length(trim(split_part(p, '=', 1), {WS})) <= 2 AND {gc} = 0 AND {_elem_eq("split_part(p, '=', 2)", 'g')} THEN 'equation_side'
      ELSE 'symbolic' END"""
    return f"""
WITH s AS ({source_sql}),
j AS (SELECT pn.p_partkey, pn.normalized AS p, gn.normalized AS g FROM ({pn}) pn JOIN ({gn}) gn USING (p_partkey)),
r AS (SELECT p_partkey, {rung} AS r FROM j)
SELECT p_partkey, CASE WHEN r LIKE 'numeric%' THEN 'numeric' ELSE r END AS rung,
       r IN ('exact', 'choice', 'option_mark', 'comma_list', 'numeric_true', 'brackets', 'ordered_list', 'matrix',
             'equation_side') AS is_correct,
       r IN ('symbolic', 'symbolic_equation') AS undecided
FROM r"""


@register("g_ladder_shapes", _ladder_sql(FX.SHAPES_SQL))
def q_g_shapes(spark, sf_dir):
    g = G.grade(FX.shapes(spark, sf_dir), "pred", "gold")
    return g.select("p_partkey", "rung", "is_correct", "undecided")


ANSWER_GOLD_SQL = f"""
SELECT p_partkey, answer AS pred,
  CASE p_partkey % 5 WHEN 0 THEN ' ' || answer || '.' WHEN 1 THEN '(' || answer || ')'
       WHEN 2 THEN CAST((p_partkey % 50) * 100 AS VARCHAR) WHEN 3 THEN 'y=' || answer ELSE 'A. ' || answer END AS gold
FROM ({ANSWERS_SQL})"""


@register("g_ladder_on_answers", _ladder_sql(ANSWER_GOLD_SQL))
def q_gl(spark, sf_dir):
    """The full ladder on the normalizer's answer shapes against rewritten gold answers."""
    a = answers(spark, sf_dir)
    k = F.col("p_partkey") % 5
    size = F.col("answer")  # varied gold shapes: same, bracketed, scaled number, equation side, option mark
    gold = (F.when(k == 0, F.concat(F.lit(" "), F.col("answer"), F.lit(".")))
            .when(k == 1, F.concat(F.lit("("), F.col("answer"), F.lit(")")))
            .when(k == 2, (F.col("p_partkey") % 50 * 100).cast("string"))
            .when(k == 3, F.concat(F.lit("y="), F.col("answer")))
            .otherwise(F.concat(F.lit("A. "), size)))
    g = G.grade(ensure_parallelism(a.withColumn("gold", gold)), "answer", "gold")
    return g.select("p_partkey", "rung", "is_correct", "undecided")


# ------------------------------------------------------------------ caller model hook (U4) end to end

@register("u2_embed_in_preparation", f"""
SELECT raw_id, [CAST(length(coalesce(input, '')) AS DOUBLE), CAST(length(coalesce(input, '')) - length(replace(coalesce(input, ''), 'e', '')) AS DOUBLE)] AS external_embedding
FROM ({FX.INSTRUCTIONS_SQL})""")
def q_u2(spark, sf_dir):
    """The preparation flow with a stand-in embedder (length and number of e) on each record's input."""
    from marksheet.plans.prepare import prepare_training

    def make_embedder():
        return lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]

    recs = ensure_parallelism(FX.instructions(spark, sf_dir).select("raw_id", "instruction", "input", "output"))
    rows = prepare_training(recs, T.template_frame(spark), key="raw_id", val_ratio=0.0, make_embedder=make_embedder)["train"]
    return rows.select("raw_id", "external_embedding")


@register("u4_generate_grade_score", f"""
WITH r AS (SELECT o_orderpriority AS dataset_name, CAST(o_orderkey AS VARCHAR) AS raw_id,
                  CAST(o_custkey AS VARCHAR) AS custkey,
                  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey + 1 AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS answer
           FROM orders),
g AS (SELECT dataset_name, custkey = answer AS is_correct FROM r)
SELECT dataset_name, count(*) AS total_samples, CAST(count_if(is_correct) AS BIGINT) AS correct_samples,
       round(count_if(is_correct) / count(*), 6) AS test_accuracy FROM g GROUP BY dataset_name""")
def q_u4(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    recs = o.select(
        F.col("o_orderpriority").alias("dataset_name"), F.col("o_orderkey").cast("string").alias("raw_id"),
        F.lit("Which customer placed this order?").alias("instruction"), F.col("o_custkey").cast("string").alias("input"),
        F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_custkey") + 1).cast("string"))
        .otherwise(F.col("o_custkey").cast("string")).alias("answer"))
    prompted = T.render_prompt(ensure_parallelism(recs), T.template_frame(spark), T.build_prompt("instruction", "input"), "prompt_text")
    from marksheet.operators import hooks as H

    def echo_model():
        """Stand-in generator for the hook path: the last number of the prompt, boxed. Defined
        here so it is shipped by value (workers need not import this package)."""
        import re

        def generate(prompts):
            out = []
            for p in prompts:
                nums = re.findall(r"[0-9]+", p)
                out.append("The answer is $\\boxed{" + (nums[-1] if nums else "") + "}$.")
            return out
        return generate

    gen = H.generate_with(prompted, echo_model, "prompt_text", "decoded_prediction")
    preds = gen.withColumn("extracted_prediction", X.final_answer("decoded_prediction"))
    m = A.score_answers(preds, "extracted_prediction", "answer")
    return m.select("dataset_name", "total_samples", "correct_samples", r6("test_accuracy").alias("test_accuracy"))
