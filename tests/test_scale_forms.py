"""Forms that grow with the data: array files in pieces, radix buckets, dictionaries, keyed stream state."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from marksheet.functions import normalize as N
from marksheet.operators import sampling as P
from marksheet.operators import sequences as T
from marksheet.session import read_table
from marksheet.sources import io as SRC
from marksheet.streaming import score_stream as M
from conftest import SF_LARGE, SF_MID, SF_SMALL, one_col


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def test_array_files_in_many_pieces(spark, small_splits):
    d = tempfile.mkdtemp(prefix="run-")
    recs = [{"instruction": f'say "{i}" }} {{ [x] \\ é𝄞 \n', "input": None if i % 3 else "a}", "output": "{" * (i % 4), "answer": i if i % 2 else str(i), "raw_id": str(i)} for i in range(200)]
    want = {str(i): (r["instruction"], r["input"], r["output"], str(r["answer"])) for i, r in enumerate(recs)}
    for name, style in (("a", {}), ("b", {"indent": 1}), ("c", {"ensure_ascii": False})):
        path = os.path.join(d, f"{name}.json")
        with open(path, "w") as f:
            json.dump(recs, f, **style)
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 5
        got = SRC.read_records(spark, path).collect()
        assert len(got) == 200 and {r.raw_id: (r.instruction, r.input, r.output, r.answer) for r in got} == want


def test_array_files_with_odd_content(spark):
    d = tempfile.mkdtemp(prefix="run-")
    texts = {"none": " [ ]\n", "one": '{"raw_id": "1", "instruction": "x{}"}', "bad": '[{"raw_id": "1"}, {"raw_id": 2 3}, {"raw_id": "3"}, 7]', "cut": '[{"raw_id": "1"}, {"raw_id": "2'}
    for name, t in texts.items():
        with open(os.path.join(d, f"{name}.json"), "w") as f:
            f.write(t)
    read = lambda n: sorted((r.raw_id or "", r["_bad"]) for r in SRC.read_records_permissive(spark, f"{d}/{n}.json").collect())
    assert read("none") == [] and read("one") == [("1", False)]
    assert read("bad") == [("", True), ("", True), ("1", False), ("3", False)]
    assert [x for x in read("cut") if not x[1]] == [("1", False)] and len(read("cut")) == 2
    for action in (lambda x: x.collect(), lambda x: x.count()):
        with pytest.raises(Exception, match="malformed"):
            action(SRC.read_records(spark, f"{d}/bad.json"))
    rows, errors = SRC.scan_eval_sets(spark, d, ["one", "bad", "gone"])
    assert [r.dataset_name for r in errors.collect()] == ["gone"]
    assert sorted((r.dataset_name, r.error is None) for r in rows.collect()) == [("bad", False), ("bad", False), ("bad", True), ("bad", True), ("one", True)]


def test_ascii_json(spark):
    d = tempfile.mkdtemp(prefix="run-")
    df = spark.createDataFrame([(1, 'é𝄞 \\ " x', None), (2, "plain", "ü"), (3, "", " ")], "a int, b string, c string")
    SRC.write_jsonl(df, f"{d}/out", force_ascii=True)
    lines = [r.value for r in spark.read.text(f"{d}/out").collect()]
    assert all(x.isascii() for x in lines) and any("\\u00e9\\ud834\\udd1e" in x for x in lines)
    assert sorted(json.loads(x)["b"] for x in lines) == sorted(r.b for r in df.collect())
    assert sorted(SRC.read_jsonl(spark, f"{d}/out", "a int, b string, c string").collect()) == sorted(df.collect())


def test_number_words(spark):
    cases = {"seven": "7", "Twenty-One": "21", "one hundred": "100", "hundred": "100", "two hundred and five": "205", "thousand": "1000", "two billion": "2000000000",
             "one million two hundred thousand and forty two": "1200042", "two point five": "2.5", "three point one four zero": "3.14", "point five": "0.5",
             "three point": "3.0", "it takes twelve days": "12", "007": "7", "x": "x", "": "", "someone": "someone", "five point twelve": "5",
             "two thousand three thousand": "two thousand three thousand", "one thousand two million": "one thousand two million",
             "one point two point three": "one point two point three", "one hundred twenty three thousand four hundred fifty six": "123456"}
    assert one_col(spark, list(cases), N.number_words) == list(cases.values())


def test_radix_buckets_keep_to_their_bound(spark):
    d = read_table(spark, SF_LARGE, "lineitem").select(F.monotonically_increasing_id().alias("line_id"), "l_returnflag").cache()
    n = d.count()
    assert n > 500_000
    keys = d.select("line_id").withColumn("_h", P.shuffle_key("line_id"))
    sizes = P._leaves(keys, [], 50).groupBy("_bucket").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] <= 50 and sizes[1] > n / 50
    one, many = (P.with_position(d, "line_id", bound=b).select("line_id", "pos") for b in (50, 1 << 20))
    assert one.exceptAll(many).count() == 0 and one.agg(F.count_distinct("pos")).first()[0] == n
    d.unpersist()


def test_vocabulary_buckets_grow_by_prefix(spark):
    d = read_table(spark, SF_MID, "documents")
    counts = d.select(F.explode(T.word_tokens("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq")).cache()
    rank = F.lpad((F.lit(2**62) - F.col("freq")).cast("string"), 19, "0")
    got = P.ordered_positions(counts, [F.col("freq").desc(), F.col("token")], F.lpad((F.lit(62) - F.floor(F.log2("freq"))).cast("string"), 2, "0"), rank, "token", "pos", bound=40)
    rows = sorted(got.collect(), key=lambda r: r.pos)
    want = sorted(((-r.freq, r.token.encode()) for r in counts.collect()))
    assert [(-r.freq, r.token.encode()) for r in rows] == want and [r.pos for r in rows] == list(range(len(rows)))
    counts.unpersist()


def test_texts_are_split_once(spark):
    d = read_table(spark, SF_SMALL, "documents")
    vocab = T.build_vocab(d)
    assert "regexp_extract_all" not in vocab._jdf.queryExecution().optimizedPlan().toString()  # a written table
    rare = vocab.withColumn("token_id", F.when(F.length("token") > 4, F.col("token_id") + 70_000).otherwise(F.col("token_id")))
    for v in (vocab, rare):  # with rare tokens the readers of the dictionaries share one exchange
        out = T.tokenize(d, "doc_id", "text", v)
        out.collect()
        final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("regexp_extract_all") == 1 and ("ReusedExchange" in final) == (v is rare)


def test_tokenize_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "b a b , a", "y"), (4, "unknown a", None), (5, "a " * 3000 + "b", "z")]
    df = spark.createDataFrame(rows, "k long, text string, tok string")
    vocab = spark.createDataFrame([("a", 1), ("b", 70_000), (",", 2), ("z", -5)], "token string, token_id int")
    got = {r.k: (r.ids, r.tok) for r in T.tokenize(df, "k", "text", vocab, out_col="ids", unk_id=-1).collect()}
    assert got == {1: ([], "x"), 2: ([], "x"), 3: ([70_000, 1, 70_000, 2, 1], "y"), 4: ([-1, 1], None), 5: ([1] * 3000 + [70_000], "z")}
    kept = T.tokenize(df, "k", "text", vocab, out_col="ids", keep_text=True).where("k = 3").first()
    assert kept.text == "b a b , a"


def test_tokens_are_gathered_where_they_are(spark):
    rows = [(1, "a b zz"), (2, "b yy a yy"), (None, "zz"), (3, None), (4, "a"), (4, "a")]
    df = spark.createDataFrame(rows, "k long, text string").coalesce(1)
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("yy", 70_000), ("zz", 70_001)], "token string, token_id int")
    out = T.tokenize(df, "k", "text", vocab)
    assert {r.k: r.input_ids for r in out.collect()} == {1: [1, 2, 70_001], 2: [2, 70_000, 1, 70_000], None: [70_001], 3: [], 4: None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Aggregate") == 2  # of records and of rare ids: no row per token is aggregated


def test_words_reach_the_lookup_by_record(spark):
    n = T.PIECE_WORDS
    texts = ["a b zz a", None, "a " * (2 * n) + "b", "zz " * n, "", "b yy"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(4)
    rows = T._word_pieces(df, "k", "text", False).collect()  # a row a record or piece, and one a task: none a token
    assert len(rows) == 18 + 3 * 2 + sum(r.no < 0 for r in rows) and 1 <= sum(r.no < 0 for r in rows) <= 4
    assert max(len(r.words or []) for r in rows) <= n
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("yy", 70_000)], "token string, token_id int")
    ids = {"a": 1, "b": 2, "yy": 70_000}
    for v, known in ((vocab, ids), (vocab.where("token_id > 5"), {"yy": 70_000}), (vocab.limit(0), {})):
        got = {r.k: r.input_ids for r in T.tokenize(df, "k", "text", v).collect()}
        assert got == {k: [known.get(w, 0) for w in (t or "").split()] for k, t in enumerate(texts)}


def test_labels_of_batches_are_made_after_the_window(spark):
    df = spark.createDataFrame([(i, i // 3, list(range(1, i + 2)), i % 4) for i in range(10)], "k int, batch_id long, input_ids array<int>, n int")
    labels = T.mask_prompt("input_ids", "n")
    for side in ("left", "right"):
        made = T.pad_batch(df, side=side, multiple_of=4, labels=labels)
        want = T.pad_batch(df.withColumn("labels", labels), side=side, multiple_of=4)
        assert made.columns == want.columns and sorted(made.collect()) == sorted(want.collect())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "-100" not in plan[plan.index("Window"):]  # only ids are below


def test_repeated_cap_names(spark):
    df = spark.range(100).select("id", F.lit("A").alias("dataset_name"), F.col("id").cast("string").alias("wide"))
    for cols in (["id", "dataset_name"], ["id", "dataset_name", "wide"]):
        caps = spark.createDataFrame([("A", 20), ("A", 10), ("A", None)], "dataset_name string, cap int")
        got = P.cap_per_dataset(df.select(*cols), caps, "id")
        assert got.columns == cols and got.count() == 10 and got.distinct().count() == 10
        none = spark.createDataFrame([("A", 0)], "dataset_name string, cap int")
        assert P.cap_per_dataset(df.select(*cols), none, "id").count() == 0


def test_keyed_stream_counts_ids_once(spark):
    d = tempfile.mkdtemp(prefix="run-")
    src, out = f"{d}/src", f"{d}/out"
    schema = "dataset_name string, raw_id string, decoded_prediction string, reference_answer string, sent_at string"
    row = lambda i, a, day: ("A", i, f"\\boxed{{{a}}}", "1", f"2024-01-{day:02d}T00:00:00")

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        m = M.stream_score_keyed(spark, src, out, schema, checkpoint=f"{d}/ckpt", sent_col="sent_at", horizon="3 days")
        return [(r.total_samples, r.correct_samples, r.malformed) for r in m.collect()]

    assert arrive([row("1", 1, 1), row("2", 2, 1), row(None, 1, 1)]) == [(3, 2, 0)]
    assert arrive([row("1", 1, 1), row("2", 2, 1)]) == [(3, 2, 0)]  # sent again
    assert arrive([row("2", 1, 2), row("1", 5, 1)]) == [(3, 3, 0)]  # corrected later; an equal time keeps the correct one
    assert arrive([row("3", 1, 9)]) == [(4, 4, 0)]  # closes 1 and 2
    assert spark.read.parquet(f"{out}/keys-3").count() == 1 and M.published(spark, out).count() == 1
    assert arrive([row("3", 2, 10)]) == [(4, 3, 0)]


def test_rows_that_keep_every_core_busy_are_not_moved(spark, tmp_path):
    from marksheet.session import ensure_parallelism
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 100 * cores, 1, cores).selectExpr("id", "repeat('a b ', 5) AS text").write.parquet(f"{tmp_path}/even")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a file is a partition
    try:
        even = spark.read.parquet(f"{tmp_path}/even")
        kept = ensure_parallelism(even)
        assert even.rdd.getNumPartitions() == cores == kept.rdd.getNumPartitions()
        assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
        # as many partitions, but all rows in one of them: moved, none lost
        one = ensure_parallelism(even.where("id < 100"))
        assert one.rdd.getNumPartitions() == 2 * cores and one.count() == 100
        assert ensure_parallelism(even, 3 * cores).rdd.getNumPartitions() == 3 * cores
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ensure_parallelism(spark.range(0, 9, 1, 1)).rdd.getNumPartitions() == 2 * cores
    assert ensure_parallelism(spark.range(0, 0, 1, cores)).count() == 0
