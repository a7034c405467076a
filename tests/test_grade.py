"""Grading ladder: one case per rung, plus the consequences the scores depend on."""

from marksheet.operators.grade import GradeConfig, grade

CASES = [
    # (pred, gold, is_correct, rung, undecided)
    ("50", "0.5", True, "numeric", False),          # gold x 100
    ("50", "5000", True, "numeric", False),         # gold / 100
    ("51", "50", False, "numeric", False),          # numbers decide false
    ("3,1", "1,3", True, "comma_list", False),      # sorted parts
    ("(1,2)", "[1,2]", True, "ordered_list", False),
    ("[1, 2]", "(1,2)", True, "ordered_list", False),
    ("", "", True, "exact", False),                 # both empty
    ("A. 5", "5", True, "option_mark", False),
    ("(B)", "B", True, "choice", False),
    ("F", "F", True, "exact", False),
    ("x=5", "5", True, "exact", False),             # normalizer strips short lhs
    ("y=2x+1", "y=1+2x", False, "symbolic", True),
    ("abc", "xyz", False, "symbolic", True),
    ("1,000", "1000", True, "numeric", False),
    ("\\begin{pmatrix}1&2\\\\3&4.0\\end{pmatrix}", "\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", True, "exact", False),
    ("\\begin{pmatrix}1&2\\\\3&5\\end{pmatrix}", "\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", False, "symbolic", True),
    ("\\begin{pmatrix}1&2\\\\3&4.5\\end{pmatrix}", "\\begin{pmatrix}1&2\\\\3&4.50\\end{pmatrix}", True, "matrix", False),
    ("{1,2}", "(1,2)", True, "brackets", False),  # sorted parts "2}","{1" vs "(1","2)" differ; brackets rung decides
    ("{1}", "(1)", True, "brackets", False),
]


def test_rungs(spark):
    df = spark.createDataFrame([(i, p, g) for i, (p, g, *_r) in enumerate(CASES)], "i int, p string, g string")
    got = {r.i: r for r in grade(df, "p", "g").collect()}
    for i, (p, g, ok, rung, und) in enumerate(CASES):
        r = got[i]
        assert (r.is_correct, r.rung, r.undecided) == (ok, rung, und), (p, g, r)


def test_null_and_self(spark):
    df = spark.createDataFrame([(None, "1"), ("7", None), ("x^2", "x^2"), ("\\frac{1}{2}", "\\frac{1}{2}")], "p string, g string")
    rows = grade(df, "p", "g").collect()
    # a null side is normalized to the text "None" (like the original); grade(x, x) is true
    assert [r.is_correct for r in rows] == [False, False, True, True]


def test_strict_mode(spark):
    df = spark.createDataFrame([("50", "0.5"), ("0.50001", "0.5")], "p string, g string")
    loose = [r.is_correct for r in grade(df, "p", "g").collect()]
    strict = [r.is_correct for r in grade(df, "p", "g", cfg=GradeConfig(include_percentage=False, is_close=False)).collect()]
    assert loose == [True, True] and strict == [False, False]


def test_grading_is_row_local(spark):
    df = spark.createDataFrame([("1", "1")], "p string, g string")
    plan = grade(df, "p", "g")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PythonUDF" not in plan and "BatchEvalPython" not in plan
