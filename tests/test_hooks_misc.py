"""Caller hooks (U1, U2, U4), Unicode word classes, projection and pairing checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marksheet.functions import normalize as N
from marksheet.operators import hooks as H
from marksheet.operators import grade as G
from marksheet.operators import sequences as T
from marksheet.operators import vectors as V
from marksheet.plans import fixtures as FX
from conftest import SF_SMALL, one_col


def test_hooks_batch_python_only_at_edges(spark):
    df = spark.createDataFrame([("a b",), ("c",), (None,)], "t string")
    tok = df.select(H.tokenize_with("t", lambda: (lambda texts: [[len(w) for w in s.split()] for s in texts])).alias("ids"))
    assert sorted(map(lambda r: r.ids, tok.collect()), key=len) == [[], [1], [1, 1]]
    emb = df.select(H.embed_with("t", lambda: (lambda texts: [[float(len(s))] for s in texts]), batch_size=2).alias("v"))
    assert sorted(r.v[0] for r in emb.collect()) == [0.0, 1.0, 3.0]
    gen = H.generate_with(df.withColumnRenamed("t", "prompt_text"), lambda: (lambda ps: [p.upper() for p in ps]))
    assert sorted(r.decoded_prediction for r in gen.collect()) == ["", "A B", "C"]
    m = H.map_batches(df, lambda pdf: pdf.assign(n=pdf["t"].fillna("").str.len()), "t string, n long")
    assert sorted(r.n for r in m.collect()) == [0, 1, 3]


def test_unicode_word_classes_follow_python(spark):
    # unit "a" must not be cut out of a word with non-ASCII letters around it (ASCII \W would)
    assert one_col(spark, ["éaé", "é a"], N.math_profile) == ["éaé", "é"]


def test_projection_matches_numpy(spark):
    items = FX.vectors(spark, SF_SMALL)
    bank = FX.bank(spark, SF_SMALL).select(F.col("bank_id").alias("rank_id"), "vec")
    got = {r.item_id: r.projected for r in V.project(items, bank, bank, scale=2.0).collect()}
    B = np.array([r.vec for r in bank.orderBy("rank_id").collect()])
    for r in items.limit(20).collect():
        y = 2.0 * B.T @ (B @ np.array(r.vec))
        assert np.allclose(got[r.item_id], y, rtol=1e-9, atol=1e-9)


def test_banks_of_any_size(spark):
    """Many parts and tiles of 4 entries route, score and project as one part does; ties go to the
    lowest id, with biases too."""
    items = FX.vectors(spark, SF_SMALL).limit(60)
    rng = np.random.default_rng(2)
    d = len(items.first().vec)
    bank = [(k, [float(x) for x in np.round(rng.standard_normal(d) * (1 + k % 5), 1)], float(k % 3) / 10) for k in range(50)]
    bank += [(k + 100, v, b) for k, v, b in bank[:20]]  # equal entries under higher ids
    bank = spark.createDataFrame(bank, "bank_id long, vec array<double>, bias double")
    rows = {(r.bank_id): (np.array(r.vec), r.bias) for r in bank.collect()}
    for part, tile in ((1 << 25, 256), (1 << 25, 4), (20 * d * 8, 4)):
        got = V.route_topk(items, bank, k=6, part_bytes=part, tile=tile).collect()
        assert len(got) == 60
        for r in got:
            best = sorted(((-(float(np.dot(np.array(r.vec), v)) + b), i) for i, (v, b) in rows.items()), key=lambda x: (round(x[0], 9), x[1]))[:6]
            assert [c.bank_id for c in r.chosen] == [i for _, i in best]
            assert all(np.allclose(c.vec, rows[c.bank_id][0]) for c in r.chosen) and abs(sum(c.weight for c in r.chosen) - 1) < 1e-9
    one, many = (V.logits_per_item(items, bank, part_bytes=p).collect() for p in (1 << 25, 9 * d * 8))
    assert sorted((r.item_id, tuple(r.logits)) for r in one) == sorted((r.item_id, tuple(r.logits)) for r in many)
    f = bank.select(F.col("bank_id").alias("rank_id"), "vec")
    a, b = ({r.item_id: r.projected for r in V.project(items, f, f, 2.0, part_bytes=p).collect()} for p in (1 << 25, 15 * d * 8))
    assert all(np.allclose(a[i], b[i], rtol=1e-9, atol=1e-9) for i in a) and len(a) == len(b) == 60
    with pytest.raises(Exception, match="topk cannot exceed"):
        V.route_topk(items, bank, k=71, part_bytes=20 * d * 8).collect()


def test_gram_of_wide_vectors_in_tiles(spark):
    rng = np.random.default_rng(4)
    for d, tile in ((2048, 64), (70, 8), (5, 64)):
        x = np.round(rng.standard_normal((6, d)), 2)
        df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "item_id long, vec array<double>")
        tiles = V.gram_tiles(df, "vec", tile).collect()
        assert max(len(t.part) for t in tiles) <= max(tile, -(-d // 15)) ** 2 and all(t.bi <= t.bj for t in tiles)
        want = x.T @ x
        if d < 100:
            got = np.zeros((d, d))
            for r in V.gram(df, "vec", tile).collect():
                got[r.i, r.j] += r.value
            assert np.allclose(got, want)
        frob = float(((want - np.eye(d)) ** 2).sum())
        p = V.orthogonality_penalty(df, df, 0.5, tile=tile).first()
        assert np.isclose(p.frob_u, frob) and np.isclose(p.penalty, frob)


def test_rebalance_blocks_agree_with_single_steps(spark):
    items, bank = FX.vectors(spark, SF_SMALL), FX.bank(spark, SF_SMALL)
    for gamma in (1e-4, 0.3):  # the second changes the choice of almost every batch
        runs = [sorted((r.step, r.bank_id, r.load, round(r.bias, 9)) for r in V.rebalance_over_batches(items, bank, 4, 8, gamma=gamma, max_abs=0.5, speculate=w).collect()) for w in (1, 5, 64)]
        assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 0


def test_rebalance_runs_one_job_a_block(spark):
    rng = np.random.default_rng(5)
    vecs = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(238)] + [(238, None), (239, [float("nan")] * 6)]
    items = spark.createDataFrame(vecs, "item_id long, vec array<double>").repartition(3)
    bank = spark.createDataFrame([(b, [float(x) for x in rng.integers(-3, 4, 6)]) for b in range(5)], "bank_id long, vec array<double>")
    sc, runs = spark.sparkContext, []
    for w in (None, 7):
        sc.setJobGroup(f"rebalance-{w}", "rebalance")
        got = V.rebalance_over_batches(items, bank, 2, 4, gamma=0.5, max_abs=20.0, speculate=w)
        sc.setJobGroup("other", "other")
        runs.append(sorted((r.step, r.bank_id, r.load, round(r.bias, 9)) for r in got.collect()))
    assert runs[0] == runs[1] and len(runs[0]) == 60 * 5 and sum(r[2] for r in runs[0]) == 480
    assert len(sc.statusTracker().getJobIdsForGroup("rebalance-None")) < 45  # 60 batches


def test_pair_with_sources_flags_unmatched(spark):
    p = spark.createDataFrame([("d", "1"), ("d", "2")], "dataset_name string, raw_id string")
    s = spark.createDataFrame([("d", "2"), ("d", "3")], "dataset_name string, raw_id string")
    got = sorted((r.raw_id, r.match_status) for r in G.pair_with_sources(p, s).collect())
    assert got == [("1", "prediction_only"), ("2", "matched"), ("3", "source_only")]


def test_generated_part_and_tokens(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], 3), ([1], 3)], "ids array<int>, n int")
    assert [r.g for r in df.select(T.generated_part("ids", "n").alias("g")).collect()] == [[4], []]
    assert one_col(spark, ["Hello, world!", ""], T.token_length) == [4, 0]


def test_ship_package_lets_workers_import_it(spark):
    from marksheet.session import ship_package
    ship_package(spark)

    def run(it):
        import marksheet  # resolvable on the workers only once the package is shipped
        for pdf in it:
            yield pdf.assign(v=marksheet.__version__)

    got = spark.range(2).mapInPandas(run, "id long, v string").collect()
    assert {r.v for r in got} == {"0.1.0"}
