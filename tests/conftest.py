import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
SF_LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="session")
def spark():
    from marksheet.session import build_session
    s = build_session("local[*]", shuffle_partitions=8)
    yield s


def one_col(spark, values, expr_fn, schema="v string"):
    """Evaluate a Column function on literal rows; returns the outputs in input order."""
    from pyspark.sql import functions as F
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    out = df.select("i", expr_fn(F.col(schema.split()[0])).alias("o")).collect()
    return [r.o for r in sorted(out, key=lambda r: r.i)]
