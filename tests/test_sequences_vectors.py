"""Sequences (T) and vector operators (V): properties and small brute-force checks."""

import math

import numpy as np
from pyspark.sql import functions as F

from marksheet.operators import sequences as T
from marksheet.operators import vectors as V
from marksheet.plans import fixtures as FX
from conftest import SF_SMALL


def test_pad_then_unpad_roundtrip(spark):
    rows = [(1, 0, [5, 6, 7]), (2, 0, [8]), (3, 1, [1, 2])]
    df = spark.createDataFrame(rows, "k int, batch_id long, input_ids array<int>")
    df = df.withColumn("labels", T.mask_prompt("input_ids", F.lit(1))).withColumn("n", F.size("input_ids"))
    for side in ("left", "right"):
        p = T.pad_batch(df, "batch_id", "input_ids", "labels", pad_id=0, side=side, multiple_of=4)
        got = {r.k: r for r in p.select("k", "input_ids", "labels", T.unpad("input_ids", "n", side).alias("u"),
                                        T.attention_mask("input_ids", 0).alias("m")).collect()}
        assert all(len(got[k].input_ids) == 4 for k in got)
        assert got[1].u == [5, 6, 7] and got[2].u == [8] and got[3].u == [1, 2]
        assert sum(got[2].m) == 1
        assert got[1].labels.count(-100) == 1 + 1


def test_render_chat_orders_turns(spark):
    conv = spark.createDataFrame([(1, 2, "assistant", "hi"), (1, 1, "user", "hello"), (1, 0, "system", "s")],
                                 "conv_id long, turn long, role string, text string")
    r = T.render_chat(conv, T.template_frame(spark), open_turn=True).collect()[0]
    assert r.rendered == "<|system|>\ns<|end|>\n<|user|>\nhello<|end|>\n<|assistant|>\nhi<|end|>\n<|assistant|>\n"


def test_strip_reasoning(spark):
    df = spark.createDataFrame([("<think>x</think>\n  ans",), ("plain",)], "t string")
    assert [r.o for r in df.select(T.strip_reasoning("t").alias("o")).collect()] == ["ans", "plain"]


def test_routing_weights_and_topk(spark):
    items = FX.vectors(spark, SF_SMALL)
    bank = FX.bank(spark, SF_SMALL)
    r = V.route_topk(items, bank, k=4).collect()
    bank_np = {b.bank_id: np.array(b.vec) for b in bank.collect()}
    for row in r[:50]:
        w = [c.weight for c in row.chosen]
        assert abs(sum(w) - 1.0) < 1e-9
        x = np.array(row.vec)
        scores = sorted(((float(x @ v), -k) for k, v in bank_np.items()), reverse=True)[:4]
        assert [c.bank_id for c in row.chosen] == [-s[1] for s in scores]


def test_rebalance_moves_bias(spark):
    load = spark.createDataFrame([(0, 10), (1, 0), (2, 5)], "bank_id long, load long")
    got = {r.bank_id: r.bias for r in V.rebalance(load, gamma=0.5, tol=0.05, max_abs=0.2).collect()}
    assert got == {0: -0.2, 1: 0.2, 2: 0.0}


def test_kl_and_gram_against_numpy(spark):
    lat = FX.latents(spark, SF_SMALL).collect()
    mu = np.clip(np.array([r.mu for r in lat]), -10, 10)
    lv = np.clip(np.array([r.logvar for r in lat]), -10, 10)
    kl = float((-0.5 * (1 + lv - mu ** 2 - np.exp(lv))).sum(axis=1).mean())
    got = V.gaussian_kl(FX.latents(spark, SF_SMALL)).collect()[0].kl
    assert math.isclose(got, kl, rel_tol=1e-9)
    vec = FX.vectors(spark, SF_SMALL)
    x = np.array([r.vec for r in vec.collect()])
    g = x.T @ x
    pen = V.orthogonality_penalty(vec, vec, beta=0.5).collect()[0]
    assert math.isclose(pen.frob_u, float(((g - np.eye(g.shape[0])) ** 2).sum()), rel_tol=1e-9)


def test_rebalance_over_batches_matches_sequential_replay(spark):
    import hashlib
    items, bank = FX.vectors(spark, SF_SMALL), FX.bank(spark, SF_SMALL)
    got = sorted((r.step, r.bank_id, r.load, round(r.bias, 9)) for r in
                 V.rebalance_over_batches(items, bank, k=3, batch_size=32, gamma=0.01, checkpoint_every=2).collect())
    it = sorted(((hashlib.md5(f"42:{r.item_id}".encode()).hexdigest(), r.item_id), np.array(r.vec)) for r in items.collect())
    B = {r.bank_id: np.array(r.vec) for r in bank.collect()}
    ids = sorted(B)
    bias = {i: 0.0 for i in ids}
    exp = []
    for step in range((len(it) + 31) // 32):
        picks = []
        for _, x in it[step * 32:(step + 1) * 32]:
            picks += [-s[1] for s in sorted(((float(x @ B[i]) + bias[i], -i) for i in ids), reverse=True)[:3]]
        tgt = len(picks) / len(ids)
        for i in ids:
            n = picks.count(i)
            bias[i] += -0.01 if n > tgt * 1.05 else (0.01 if n < tgt * 0.95 else 0.0)
            exp.append((step, i, n, round(bias[i], 9)))
    assert got == sorted(exp)


def test_render_messages_and_token_length_types(spark):
    import pytest
    df = spark.createDataFrame([([("user", "hi there")], "hi there", 3)],
                               "msgs array<struct<role:string,content:string>>, t string, n int")
    r = df.select(T.render_messages("msgs").alias("r"), T.token_length_of(df, "msgs").alias("a"),
                  T.token_length_of(df, "t").alias("b")).collect()[0]
    assert r.r == "<|user|>\nhi there<|end|>\n<|assistant|>\n"
    assert r.b == 2 and r.a == len(["<", "|", "user", "|", ">", "hi", "there", "<", "|", "end", "|", ">",
                                    "<", "|", "assistant", "|", ">"])
    with pytest.raises(TypeError):
        T.token_length_of(df, "n")


def test_length_mask_keeps_real_pad_ids(spark):
    df = spark.createDataFrame([([0, 5, 0, 0], 2)], "ids array<int>, n int")
    r = df.select(T.length_mask("ids", "n").alias("m"), T.length_mask("ids", "n", "left").alias("l"),
                  T.attention_mask("ids", 0).alias("p")).collect()[0]
    assert r.m == [True, True, False, False] and r.l == [False, False, True, True] and r.p == [False, True, False, False]


def test_topk_larger_than_bank_is_rejected(spark):
    import pytest
    items, bank = FX.vectors(spark, SF_SMALL).limit(3), FX.bank(spark, SF_SMALL)
    with pytest.raises(Exception, match="topk cannot exceed bank size"):
        V.route_topk(items, bank, k=17).collect()
