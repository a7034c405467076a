"""Plan checks over every registered query."""

import re

import __spark_entry__ as E
from marksheet.plans import catalog
from conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_registered_plans(spark):
    for name, fn in E.queries().items():
        if name.startswith(("m1_", "v8_rebalance_over")):
            continue  # streaming and the sequential driver loop have no single plan
        hook_query = name.startswith(("u1_", "u2_", "u4_"))  # the caller hooks (tokenizer, embedder, model) are the one place Python runs
        plan = _plan(fn(spark, SF_SMALL))
        if name in catalog.QUERIES:  # the training-data operators that are not native choose their own style
            assert hook_query or not any(n in plan for n in PYTHON_NODES), name
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
        lines = plan.split("\n")
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                child = next((l for l in lines[i + 1:] if l.strip()), "")
                # a single partition only ever receives partial aggregates (bounded by task count)
                assert re.search(r"(Hash|ObjectHash|Sort)Aggregate", child), (name, line, child)
