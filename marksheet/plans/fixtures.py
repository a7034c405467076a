"""Derived tables built from the given test tables, identically in Spark and in SQL.

Each builder has a Spark form and the equivalent SQL text (used by ``oracle_sql``), so both
engines grade exactly the same inputs. Texts are built from integers cast to string: the
double-to-string rendering differs between engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marksheet.operators.vectors import mean_pool
from marksheet.session import read_table

# ---------------------------------------------------------------- predictions (lineitem)

PREDICTIONS_SQL = r"""
SELECT
  l_returnflag AS dataset_name,
  concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
            CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y%m%d%H%M%S')) AS raw_id,
  concat('The total is $\boxed{', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), '}$.') AS decoded_prediction,
  CAST(CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_quantity AS INTEGER) + 1
            WHEN l_orderkey % 4 = 1 THEN CAST(l_quantity AS INTEGER) * 100
            ELSE CAST(l_quantity AS INTEGER) END AS VARCHAR) AS reference_answer
FROM lineitem
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction records: boxed quantity as the model text; gold equal, +1, or x100 by order key."""
    li = read_table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    gold = (
        F.when(F.col("l_orderkey") % 4 == 0, q + 1)
        .when(F.col("l_orderkey") % 4 == 1, q * 100)
        .otherwise(q)
        .cast("string")
    )
    raw_id = F.concat_ws(
        "-",
        F.col("l_orderkey").cast("string"),
        F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"),
        F.date_format("l_shipdate", "yyyyMMddHHmmss"),
    )
    return li.select(
        F.col("l_returnflag").alias("dataset_name"),
        raw_id.alias("raw_id"),
        F.concat(F.lit("The total is $\\boxed{"), q.cast("string"), F.lit("}$.")).alias("decoded_prediction"),
        gold.alias("reference_answer"),
    )


# ---------------------------------------------------------------- multiple choice (events)

CHOICE_SQL = r"""
SELECT event_id,
  concat('the answer is (', CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'B' WHEN 'purchase' THEN 'C'
         WHEN 'signup' THEN 'D' ELSE 'E' END, ')') AS text,
  CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'E' END AS gold
FROM events
"""


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    letter = (
        F.when(F.col("event_type") == "view", "A").when(F.col("event_type") == "click", "B")
        .when(F.col("event_type") == "purchase", "C").when(F.col("event_type") == "signup", "D").otherwise("E")
    )
    gold = F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (F.col("event_id") % 5).cast("int") + 1)
    return ev.select("event_id", F.concat(F.lit("the answer is ("), letter, F.lit(")")).alias("text"), gold.alias("gold"))


# ---------------------------------------------------------------- tuples / lists (part)

TUPLES_SQL = r"""
SELECT p_partkey,
  concat('(', CAST(p_partkey % 7 AS VARCHAR), ',', CAST(p_size AS VARCHAR), ')') AS pred,
  CASE WHEN p_partkey % 3 = 0 THEN concat('[', CAST(p_partkey % 7 AS VARCHAR), ',', CAST(p_size AS VARCHAR), ']')
       WHEN p_partkey % 3 = 1 THEN concat(CAST(p_size AS VARCHAR), ',', CAST(p_partkey % 7 AS VARCHAR))
       ELSE concat('(', CAST(p_partkey % 7 AS VARCHAR), ',', CAST(p_size + 1 AS VARCHAR), ')') END AS gold
FROM part
"""


def tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuple answers and a permuted (comma list), re-bracketed, or altered copy as gold."""
    pt = read_table(spark, sf_dir, "part")
    a = (F.col("p_partkey") % 7).cast("string")
    b = F.col("p_size").cast("string")
    gold = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("["), a, F.lit(","), b, F.lit("]")))
        .when(F.col("p_partkey") % 3 == 1, F.concat(b, F.lit(","), a))
        .otherwise(F.concat(F.lit("("), a, F.lit(","), (F.col("p_size") + 1).cast("string"), F.lit(")")))
    )
    return pt.select("p_partkey", F.concat(F.lit("("), a, F.lit(","), b, F.lit(")")).alias("pred"), gold.alias("gold"))


# ---------------------------------------------------------------- hash marks / theorem texts (orders)

ORDER_TEXTS_SQL = r"""
SELECT o_orderkey,
  concat('so #### ', CAST(o_orderkey % 1000 AS VARCHAR)) AS hash_text,
  concat('it is ', CAST(o_custkey AS VARCHAR), ' units') AS theorem_text
FROM orders
"""


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.concat(F.lit("so #### "), (F.col("o_orderkey") % 1000).cast("string")).alias("hash_text"),
        F.concat(F.lit("it is "), F.col("o_custkey").cast("string"), F.lit(" units")).alias("theorem_text"),
    )


# ---------------------------------------------------------------- instruction records (documents)

INSTRUCTIONS_SQL = r"""
SELECT CAST(doc_id AS VARCHAR) AS raw_id, doc_id, lang AS category, source AS dataset_name,
  concat('Summarise this ', lang, ' text.') AS instruction,
  text AS input,
  concat('Source: ', source) AS output,
  CAST(n_chars AS VARCHAR) AS answer
FROM documents
"""


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction records: key ``doc_id``, category ``lang``, dataset ``source``."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("raw_id"),
        "doc_id",
        F.col("lang").alias("category"),
        F.col("source").alias("dataset_name"),
        F.concat(F.lit("Summarise this "), F.col("lang"), F.lit(" text.")).alias("instruction"),
        F.col("text").alias("input"),
        F.concat(F.lit("Source: "), F.col("source")).alias("output"),
        F.col("n_chars").cast("string").alias("answer"),
    )


# ---------------------------------------------------------------- training log (events)

LOG_SQL = r"""
SELECT CAST(user_id AS VARCHAR) AS run, event_id AS step,
  CASE WHEN event_type = 'view' THEN value END AS loss,
  CASE WHEN event_type = 'purchase' THEN value END AS eval_loss
FROM events
"""


def log_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").cast("string").alias("run"),
        F.col("event_id").alias("step"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("loss"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("eval_loss"),
    )


# ---------------------------------------------------------------- parameters (part), penalties (lineitem)

PARAMETERS_SQL = "SELECT p_type AS name, CAST(p_size AS BIGINT) AS numel FROM part"


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = read_table(spark, sf_dir, "part")
    return pt.select(F.col("p_type").alias("name"), F.col("p_size").cast("long").alias("numel"))


PENALTIES_SQL = """
SELECT l_orderkey AS step, l_linenumber AS layer, l_returnflag AS kind, l_discount AS value FROM lineitem
"""


def penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("step"), F.col("l_linenumber").alias("layer"),
        F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("value"),
    )


# ---------------------------------------------------------------- vectors (embeddings)

VECTORS_SQL = "SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings"
BANK_SQL = """
SELECT CAST(label AS BIGINT) AS bank_id, list(m ORDER BY i) AS vec, 0.0::DOUBLE AS bias
FROM (SELECT label, i, avg(x) AS m
      FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)
      GROUP BY label, i)
GROUP BY label
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routing bank: one entry per label, the mean of all its embeddings; zero bias."""
    means = mean_pool(vectors(spark, sf_dir), "label")
    return means.select(F.col("label").cast("long").alias("bank_id"), F.col("mean").alias("vec"), F.lit(0.0).alias("bias"))


LATENTS_SQL = """
SELECT vec_id AS item_id, CAST(embedding[1:32] AS DOUBLE[]) AS mu, CAST(embedding[33:64] AS DOUBLE[]) AS logvar FROM embeddings
"""


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    return e.select(F.col("vec_id").alias("item_id"), F.slice(v, 1, 32).alias("mu"), F.slice(v, 33, 32).alias("logvar"))


# ---------------------------------------------------------------- answer shapes for the ladder (part)

SHAPES_SQL = r"""
SELECT p_partkey,
  CASE p_partkey % 6
    WHEN 0 THEN 'A. ' || CAST(p_size AS VARCHAR)
    WHEN 1 THEN '\begin{pmatrix}' || CAST(p_partkey % 7 AS VARCHAR) || '&' || CAST(p_size AS VARCHAR) || '.5\\' || CAST(p_size % 5 AS VARCHAR) || '&1\end{pmatrix}'
    WHEN 2 THEN 'xy = ' || CAST(p_size AS VARCHAR)
    WHEN 3 THEN 'xy = ' || CAST(p_size AS VARCHAR)
    WHEN 4 THEN ''
    ELSE '(' || CASE CAST(p_partkey % 5 AS INTEGER) WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'E' END || ')' END AS pred,
  CASE p_partkey % 6
    WHEN 0 THEN CAST(p_size + p_partkey % 2 AS VARCHAR)
    WHEN 1 THEN '\begin{pmatrix}' || CAST(p_partkey % 7 AS VARCHAR) || '&' || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 4 = 1 THEN '.50' ELSE '.25' END || '\\' || CAST(p_size % 5 AS VARCHAR) || '&1\end{pmatrix}'
    WHEN 2 THEN CAST(p_size AS VARCHAR)
    WHEN 3 THEN 'xy = ' || CAST(p_size + 1 AS VARCHAR)
    WHEN 4 THEN CAST(p_size AS VARCHAR)
    ELSE CASE CAST(p_partkey % 3 AS INTEGER) WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END END AS gold
FROM part
"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer shapes that reach the option-mark, matrix, equation, empty and choice rungs."""
    pt = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    letter5 = F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (F.col("p_partkey") % 5).cast("int") + 1)
    letter3 = F.element_at(F.array(*[F.lit(x) for x in "ABC"]), (F.col("p_partkey") % 3).cast("int") + 1)

    def mat(second):
        return F.concat(F.lit("\\begin{pmatrix}"), (F.col("p_partkey") % 7).cast("string"), F.lit("&"), second,
                        F.lit("\\\\"), (F.col("p_size") % 5).cast("string"), F.lit("&1\\end{pmatrix}"))

    pred = (F.when(k == 0, F.concat(F.lit("A. "), size))
            .when(k == 1, mat(F.concat(size, F.lit(".5"))))
            .when(k.isin(2, 3), F.concat(F.lit("xy = "), size))
            .when(k == 4, F.lit(""))
            .otherwise(F.concat(F.lit("("), letter5, F.lit(")"))))
    gold = (F.when(k == 0, (F.col("p_size") + F.col("p_partkey") % 2).cast("string"))
            .when(k == 1, mat(F.concat(size, F.when(F.col("p_partkey") % 4 == 1, F.lit(".50")).otherwise(F.lit(".25")))))
            .when(k == 2, size)
            .when(k == 3, F.concat(F.lit("xy = "), (F.col("p_size") + 1).cast("string")))
            .when(k == 4, size)
            .otherwise(letter3))
    return pt.select("p_partkey", pred.alias("pred"), gold.alias("gold"))


# ---------------------------------------------------------------- one text per branch of each rule (part)

# (text, expected answer) by rule; ``@`` stands for the row's size. The expectations are worked out
# by hand from the rules, so they also serve as the SQL side.
RULE_CASES = {
    "boxed": [("so $\\boxed{@}$.", "@"), ("\\boxed{\\frac{@}{2}}", "\\frac{@}{2}"), ("\\boxed{a{b{c{d{@}}}}}", "a{b{c{d{@}}}}"),
              ("boxed @ $ rest", "@"), ("no answer @", ""), ("unclosed \\boxed{@", "@"), ("@ boxed", ""),
              ("\\boxed{:@.}", "@"), ("\\boxed{1} then \\boxed{@/}", "@"), ("\\boxed{@\n  0}", "@0")],
    "phrase": [("The Answer Is (b) @", "B"), ("my choice is c, @", "C"), ("nothing here @", "placeholder"), ("answer is F @", "placeholder"),
               ("answer is a Problem: answer is b", "A"), ("Problem: answer is d", "placeholder"), ("answer is d, answer is e", "D")],
    "option": [("B or @ C", "C"), ("answer is B not C @", "B"), ("answer is A. answer is B\n\nanswer is D @", "B"), ("answer is @", "@"),
               ("answer is ", ""), ("it is @.", "it is @"), ("choice is (e)/", "E")],
    "last_option": [("A then D @", "D"), ("@.", "@"), (":x@/", "x@"), ("(c) @", "C"), ("", "")],
    "theorem": [("Yes @", "True"), ("@ is false", "False"), ("(A) @", "(A) @"), ("so \\boxed{@}", "@"), ("x = @", "@"), ("@ cm", "@"),
                ("@ m/s2", "@"), ("@%", "@/100"), ("@\\pi", "@*3.14"), ("$@", "@"), ("it measures @ cm", "it measures @ cm")],
    "number_words": [("twenty-one", "21"), ("Ninety Nine", "99"), ("zero", "0"), ("thirteen", "13"), ("00@", "@"), ("@ sheep", "@ sheep"),
                     ("one hundred and five", "105"), ("two million three thousand and one", "2003001"), ("three point one four", "3.14"), ("point five", "0.5"),
                     ("it takes twelve days or so", "12"), ("two thousand three thousand", "two thousand three thousand"), ("hundred", "100"), ("someone", "someone")],
}

# (prediction, gold, correct in strict mode, rung); None: a missing side.
STRICT_CASES = [(None, "@", False, "null"), ("@", None, False, "null"), ("@", "@", True, "exact"), ("@.000001", "@", False, "numeric"),
                ("+@", "@", True, "numeric"), ("@00", "@", False, "numeric"), ("nan", "+nan", False, "numeric"),
                ("\\begin{pmatrix}@\\7\\end{pmatrix}", "{@,7}", True, "brackets")]


def by_case(values: list, key: str = "p_partkey") -> Column:
    """The value of the row's case (key modulo the number of cases), with ``@`` filled in."""
    pick = F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int") + 1)
    return F.replace(pick, F.lit("@"), F.col("p_size").cast("string"))


def by_case_sql(values: list, key: str = "p_partkey") -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"replace([{quoted}][CAST({key} % {len(values)} AS BIGINT) + 1], '@', CAST(p_size AS VARCHAR))"
