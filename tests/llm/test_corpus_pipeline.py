"""run() against a brute-force version of its stages, and the entry's contract."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from marksheet.llm import catalog, mixing, quality_rules

from tests.llm.test_llm_brute import brute_components, fingerprint, lcs, norm, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        out[name] = docs.collect()
        assert docs.columns == (names if name != "shard" else names + ["shard"])
        have = {tuple(r) for r in before.select(*names).collect()}
        assert {tuple(r)[: len(names)] for r in out[name]} <= have
    # near-duplicates: one row of each component of what quality kept
    fps = {r.text: fingerprint(r.text) for r in out["quality"]}
    root = brute_components(fps.values())
    assert Counter(root[fps[r.text]] for r in out["near_duplicates"]) == Counter(set(root.values()))
    # decontamination: what is gone holds an item, what stays holds none whole
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in out["decontaminate"]}
    for r in out["near_duplicates"]:
        text = " ".join(norm(r.text))
        if r.doc_id in kept:
            assert not any(" ".join(x) in text for x in items)
        else:
            assert any(lcs(x, norm(r.text)) >= 0.6 * len(x) for x in items)
    # mix: whole copies, at most two; shards: contiguous in key order, near equal bytes
    assert max(Counter(r.doc_id for r in out["mix"]).values()) <= 2
    rows = sorted(out["shard"], key=lambda r: r.doc_id)
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows) and len(rows) == len(out["mix"])


def test_run_repeats(spark):
    one, two = corpus_pipeline.run(spark, SF).collect(), corpus_pipeline.run(spark, SF).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, two)) and one


def test_rejected_by_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()}
    judged = quality_rules.judge(docs, quality_rules.fit(docs, labels)).collect()
    assert kept == {r.doc_id for r in judged if r.kept}


def test_every_operator_has_a_query(spark):
    import __spark_entry__
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in __spark_entry__.queries()) == 1
    assert "pipeline" in __spark_entry__.queries()
    for name, sql in catalog.ORACLE.items():
        assert name in catalog.QUERIES and "SELECT" in sql


def test_word_count_matches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", mixing.word_count("text").alias("n"))
    assert all(r.n == len(words(r.text)) for r in docs.collect())


def test_mix_without_repeated_rows_numbers_none(spark):
    rows = [(i, "word " * (i % 7 + 1) + str(i), "abc"[i % 3], -i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    mixed = mixing.mixed_rows(docs)
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    want = Counter({r.id: r.whole + r.extra for r in mixing.mix(docs).collect()})
    got = mixed.collect()
    assert Counter(r.doc_id for r in got) == +want and all(r.extra == -r.doc_id for r in got)
