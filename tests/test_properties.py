"""Properties over generated strings: no rule raises on arbitrary text; grade(x, x) holds."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marksheet.functions import extract as X
from marksheet.functions import normalize as N
from marksheet.operators.grade import grade

PIECES = ["\\boxed{", "}", "{", "\\frac", "12", "3.50", "/", "=", "x", ",", "(", ")", "[", "]", "\\begin{pmatrix}",
          "\\end{pmatrix}", "&", "\\\\", " ", "\n", "%", "$", "answer is", "(B)", "A.", "#### ", "-", "\\sqrt", "cm",
          "twenty", "é", "π", "°C", "inf", "\\text{", "ки", "</think>", ":", "."]


def _latexish(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(PIECES) for _ in range(n))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=20, max_size=60), st.integers(0, 10**6))
def test_rules_total_on_arbitrary_text(spark, texts, seed):
    rng = random.Random(seed)
    texts = texts + [_latexish(rng, rng.randint(0, 25)) for _ in range(60)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    cols = [X.final_answer("t"), X.phrase_choice("t"), X.option_choice("t"), X.last_option("t"), X.hash_mark("t"),
            X.theorem_answer("t"), X.clean_units("t"), N.math_profile("t"), N.final_profile("t"), N.parse_number("t")]
    out = df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(cols)]).collect()
    assert len(out) == len(texts)
    g = grade(df.withColumn("u", F.col("t")), "t", "u").collect()
    assert all(r.is_correct for r in g if r.t is not None)
    # random pairs reach every rung (lists, matrices, equations) without raising
    other = [texts[(i * 7 + 3) % len(texts)] for i in range(len(texts))]
    pairs = spark.createDataFrame(list(zip(texts, other)), "t string, u string")
    rows = grade(pairs, "t", "u").collect()
    assert len(rows) == len(texts) and all(r.rung is not None for r in rows)


def test_scores_and_caps_do_not_depend_on_partitioning(spark):
    from marksheet.functions.extract import final_answer
    from marksheet.operators import sampling as P
    from marksheet.operators.score import score_answers
    from marksheet.plans import fixtures as FX
    from conftest import SF_SMALL

    pr = FX.predictions(spark, SF_SMALL)
    caps = spark.createDataFrame([("A", 7), ("N", 11), ("R", 5)], "dataset_name string, cap int")
    results = []
    for n in (1, 5):
        p = pr.repartition(n).withColumn("extracted_prediction", final_answer("decoded_prediction"))
        s = sorted(tuple(r) for r in score_answers(p).select("dataset_name", "total_samples", "correct_samples").collect())
        c = sorted(r.raw_id for r in P.cap_per_dataset(pr.repartition(n), caps, "raw_id", exempt=None).collect())
        results.append((s, c))
    assert results[0] == results[1]
