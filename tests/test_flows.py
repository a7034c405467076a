"""Flows and operators added to preparation, evaluation, routing and pairing."""

import tempfile

from pyspark.sql import functions as F

from marksheet.operators import grade as G
from marksheet.operators import sequences as T
from marksheet.operators import vectors as V
from marksheet.plans import fixtures as FX
from marksheet.plans.evaluate import evaluate_records
from marksheet.plans.prepare import prepare_training, training_batches
from conftest import SF_SMALL


def _records(spark):
    return FX.instructions(spark, SF_SMALL).select("raw_id", "instruction", "input", "output")


def test_rare_tokens_take_the_shuffle_path_and_get_the_same_ids(spark, monkeypatch):
    d = _records(spark).select("raw_id", F.col("input").alias("text"), F.col("output").alias("kept"))
    d = d.unionByName(spark.createDataFrame([("none", None, "a"), ("empty", "", "b")], d.schema))
    vocab = T.build_vocab(d, "text").where(F.col("token_id") != 5)  # one frequent token is unknown
    whole = {r.raw_id: r for r in T.tokenize(d, "raw_id", "text", vocab).collect()}
    monkeypatch.setattr(T, "HEAD_TOKENS", 40)
    monkeypatch.setattr(T, "HEAD_TOKEN_CHARS", 3)
    split = {r.raw_id: r for r in T.tokenize(d, "raw_id", "text", vocab).collect()}
    assert whole == split and len(whole) == d.count()
    assert whole["none"].input_ids == [] == whole["empty"].input_ids and whole["none"].kept == "a"
    import re
    ids = {r.token: r.token_id for r in vocab.collect()}
    for r in d.where("text is not null").collect():
        assert split[r.raw_id].input_ids == [ids.get(t, 0) for t in re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", r.text)] or not r.text.isascii()


def test_tokenize_joins_no_records_back(spark):
    d = _records(spark)
    vocab = spark.createDataFrame([("the", 1)], "token string, token_id int")
    plan = T.tokenize(d, "raw_id", "input", vocab)._jdf.queryExecution().optimizedPlan().toString()
    # the head's ids (in both readers of one exchange), the rare ids, and these beside the record's dictionary
    assert plan.count("Join ") == 4
    assert plan.count("Join LeftOuter") == 4


def test_windows_lose_nothing(spark):
    df = spark.createDataFrame([(1, list(range(10))), (2, []), (3, [7, 8, 9, 10])], "k int, input_ids array<int>")
    rows = sorted(T.in_windows(df, "input_ids", 4).collect())
    assert [(r.k, r.chunk_no, r.input_ids) for r in rows] == [
        (1, 0, [0, 1, 2, 3]), (1, 1, [4, 5, 6, 7]), (1, 2, [8, 9]), (2, 0, []), (3, 0, [7, 8, 9, 10])]


def test_prepare_with_a_tokenizer_and_batches(spark):
    recs = _records(spark)

    def make_tokenizer():
        return lambda texts: [[len(w) + 1 for w in t.split(" ")] for t in texts]

    rows = prepare_training(recs, T.template_frame(spark), val_ratio=0.0, max_len=128, make_tokenizer=make_tokenizer)["train"]
    got = training_batches(rows, 8, multiple_of=4, side="left").collect()
    assert len(got) == rows.count() and {r.raw_id for r in got} == {r.raw_id for r in recs.collect()}
    batches = {}
    for r in got:
        batches.setdefault(r.batch_id, []).append(r)
    assert sorted(batches) == list(range(len(batches))) and all(len(batches[b]) == 8 for b in range(len(batches) - 1))
    for b in batches.values():
        assert len({len(r.input_ids) for r in b}) == 1 and len(b[0].input_ids) % 4 == 0
        for r in b:
            n = sum(r.attention_mask)
            assert r.attention_mask == [False] * (len(r.input_ids) - n) + [True] * n
            assert r.labels[:len(r.input_ids) - n] == [-100] * (len(r.input_ids) - n)


def test_evaluation_outputs(spark):
    d = tempfile.mkdtemp(prefix="ms-out-")
    recs = spark.createDataFrame([("a", "1", "\\boxed{4}", "4", "two and two"), ("a", "2", "\\boxed{5}", "4", None), ("b", "1", "none", None, "x")],
                                 "dataset_name string, raw_id string, decoded_prediction string, answer string, output string")
    out = evaluate_records(spark, recs, ["a", "b", "gone"], output_dir=d, run_stamp="s")
    preds = {(r.dataset_name, r.raw_id): r for r in spark.read.parquet(f"{d}/predictions").collect()}
    assert preds["a", "1"].reference_solution == "two and two" and preds["a", "2"].reference_solution == ""
    assert preds["a", "1"].is_correct and not preds["a", "2"].is_correct
    m = {r.dataset_name: r for r in spark.read.json(f"{d}/metrics").collect()}
    assert (m["a"].correct_samples, m["a"].total_samples) == (1, 2) and m["gone"].error
    s = spark.read.json(f"{d}/summary").first()
    assert (s.total_datasets, s.failed_datasets, s.run_stamp) == (3, 1, "s")
    assert out["summary"].first().total_correct == s.total_correct


def test_routing_over_given_logits(spark):
    items = spark.createDataFrame([(1, [[1.0, 3.0, 2.0], [0.0, 0.0, 0.0]]), (2, [[5.0, 5.5, 5.4], [1.0, -1.0, 9.0]])],
                                  "item_id int, logits array<array<double>>")
    rows = V.routes(V.route_given_logits(items, k=2, bias=[0.2, 0.0, 0.2])).collect()
    got = {(r.item_id, r.slot, r.rank): r.bank_id for r in rows}
    assert got == {(1, 0, 0): 1, (1, 0, 1): 2, (1, 1, 0): 0, (1, 1, 1): 2, (2, 0, 0): 2, (2, 0, 1): 1, (2, 1, 0): 2, (2, 1, 1): 0}
    assert abs(sum(r.weight for r in rows) - 4) < 1e-9  # one per item and slot


def test_pairs_of_unequal_lists_are_flagged(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["c", "d"]), (2, ["a"], ["b", "c"]), (3, None, ["x"])], "k int, l array<string>, r array<string>")
    got = sorted(((x.k, x.pos, x.l_item, x.r_item, x.length_match) for x in G.pair_elements(df, "l", "r", ["k"]).collect()), key=str)
    assert got == [(1, 0, "a", "c", True), (1, 1, "b", "d", True), (2, 0, "a", "b", False), (2, 1, None, "c", False), (3, None, None, None, False)]


def test_duplicate_ids(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", "1")], "dataset_name string, raw_id string")
    assert [tuple(r) for r in G.duplicate_ids(df).collect()] == [("a", "1", 2)]
