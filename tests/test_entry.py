"""Driver contract: entry runs, every oracle key is a registered query, a sample of oracles match."""

import os
import subprocess
import sys

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and set(df.columns) == {"dataset_name", "total_samples", "correct_samples", "test_accuracy"}


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


def test_oracle_sample_matches():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, os.path.join(root, "scripts", "compare_oracle.py"), "/root/testdata/sf0.001",
                          "a1_", "p4_", "t4_t5", "v4_", "a3_"], capture_output=True, text=True, timeout=900)
    assert "FAIL" not in out.stdout, out.stdout[-3000:]
    assert "5 oracle matches" in out.stdout, out.stdout[-3000:]
