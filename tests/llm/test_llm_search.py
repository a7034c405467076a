"""Operators 11 to 13 against brute-force versions: ranked search, MinHash components, hard negatives."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marksheet.llm import hard_negatives, lexical_search, minhash_duplicates
from tests.llm.test_llm_brute import EDGE, LOWER, SF, multiset, pairs_of, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, s, f"v{k}", k, 9, k * 2, k, "x") for k, (i, t, s) in enumerate(EDGE)]
    names = "doc_id long, text string, source string, bag string, n int, key int, cls long, rank int, comp string"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---------------------------------------------------------------- 11 ranked lexical search


def ranked(docs, items, k=10):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    bags = [(i, split(t)) for i, t in docs]
    bags = [(i, Counter(t), len(t)) for i, t in bags if t]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    for item, text in items:
        rows = []
        for i, b, n in bags:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(split(text)) if t in b)
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(rows)[:k], 1):
            yield item, rank, i, -s


ITEMS = [(1, "same words of PASSAGE1, Passage2"), (1, "same"), (2, None), (3, ""), (4, " .,; "), (5, "É 𝄞𝄞 x"), (None, "w1x1 lead out"), (6, "nowhere-to-be-found"), (7, "one two THREE four; one")]


def test_ranked_search(spark, edge, small, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for docs, queries in ((edge, items), (small, bench), (small.unionByName(small), items)):
        got = lexical_search.search(docs, queries).select("item_id", "rank", "doc_id", "score").collect()
        want = ranked(pairs_of(docs), [(r.item_id, r.text) for r in queries.collect()])
        assert multiset(got) == Counter(want)
    monkeypatch.setattr(lexical_search, "ITEM_BLOCK", 3)  # several blocks give the same rows
    got = lexical_search.search(small, bench, k=4).select("item_id", "rank", "doc_id", "score").collect()
    assert multiset(got) == Counter(ranked(pairs_of(small), [(r.item_id, r.text) for r in bench.collect()], 4))


def test_ranked_search_ties_and_classes(spark):
    """Many copies are one class, expanded by ascending id; other classes tie with it."""
    rows = [(i, "alpha beta") for i in range(500, 0, -1)] + [(i, "beta Alpha") for i in range(1000, 1040)] + [(0, "alpha gamma"), (9999, "beta")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "item_id long, text string")
    assert multiset(lexical_search.search(docs, items).select("item_id", "rank", "doc_id", "score").collect()) == Counter(ranked(rows, [(1, "alpha beta"), (2, "gamma")]))
    block = lexical_search.Items(lexical_search.item_terms(items).collect())
    classes = lexical_search.bag_classes(lexical_search.bags(docs, block.vocabulary), 542, 1083).collect()
    assert sorted(r["size"] for r in classes) == [1, 1, 540] and all(len(r.members) <= 10 for r in classes)


# ---------------------------------------------------------------- 12 MinHash


def shingles(t, width=5):
    w = words((t or "").translate(LOWER))
    return frozenset(" ".join(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([" ".join(w)] if w else [])


def linked(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    for k, (i, _) in enumerate(rows):
        c = low.get(find(k))
        yield i, len(sets[k]), c, i is not None and i == c


def test_minhash_components(edge, small):
    for df in (edge, small):
        assert multiset(minhash_duplicates.near_duplicates(df).collect()) == Counter(linked(pairs_of(df)))


@pytest.mark.parametrize("block", [4096, 24])
def test_minhash_chains_and_dense_groups(spark, block):
    """A chain of small changes, and a star of changes to one text: pairs lie on both sides of the
    threshold, buckets are larger than a block."""
    rng = np.random.default_rng(3)
    base, rows = [f"t{k}" for k in range(240)], []
    text = list(base)
    for k in range(60):
        rows.append((k, " ".join(text)))
        text[int(rng.integers(240))] = f"c{k}"
    for k in range(100, 180):
        text = list(base)
        for at in rng.integers(0, 240, int(rng.integers(1, 9))):
            text[at] = f"s{k}"
        rows.append((k, " ".join(text)))
    rows += [(1000 + k, " ".join(f"z{k}y{j}" for j in range(50))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert multiset(minhash_duplicates.near_duplicates(df, block=block, cluster_block=block).collect()) == Counter(linked(rows))


def test_signature_estimate():
    """Unequal places estimate the similarity; the margin keeps pairs at the threshold."""
    rng = np.random.default_rng(5)
    most = minhash_duplicates.most_differences()
    for _ in range(40):
        size = int(rng.integers(20, 800))
        both, rest = int(np.ceil(0.85 * size)), size - int(np.ceil(0.85 * size))
        pool = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        half = rest // 2
        a, b = np.sort(pool[: both + half]), np.sort(np.concatenate([pool[:both], pool[both + half:]]))
        minima = minhash_duplicates.minima_of(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        sig = minhash_duplicates.signatures_of(minima)
        far = int(minhash_duplicates.unequal_places(sig[:1], sig[1:])[0, 0])
        places = [(int(sig[0, w]) >> s & 3) != (int(sig[1, w]) >> s & 3) for w in range(sig.shape[1]) for s in range(0, 64, 2)]
        estimate = ((1 - far / 256) - 0.25) / 0.75
        assert far == sum(places) <= most and abs(estimate - both / size) < 0.16


# ---------------------------------------------------------------- 13 hard negatives


def mined(rows):
    out = []
    use = []
    for no, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((no, i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    for no, i, v, label in use:
        if i is None or i % 100:
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w)), j, m, lab) for m, j, w, lab in use if m != no), key=order)
        for p, pid, _, _ in [s for s in scored if s[3] == label][:5]:
            window = [s for s in scored if s[3] != label and 30 * p <= 100 * s[0] <= 90 * p][:10]
            out += [(i, pid, rank, s[1], p, s[0]) for rank, s in enumerate(window, 1)]
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, no int, key string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, x, 1, "k", 2) for i, v, x in rows], SCHEMA).repartition(4)


def mine(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.integer_rows(df, label=label)
    return hard_negatives.mine(rows, rows.where("key % 100 = 0"))


@pytest.mark.parametrize("block", [8192, 37])
def test_hard_negatives(spark, block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 5)
    rng = np.random.default_rng(13)
    for dims, spread in ((64, 0.2), (4, 0.02), (3, 40.0)):  # the second gives many ties, the third large sums
        v = (rng.standard_normal((700, dims)) * spread).astype(np.float32).astype(float)
        rows = [(int(i), x.tolist(), int(rng.integers(10))) for i, x in enumerate(v)]
        rows += [(i, x, c) for i, x, c in rows[:150:3]]  # copies of anchors and of others
        assert multiset(mine(frame(spark, rows)).collect()) == Counter(mined(rows))


def test_hard_negatives_edges(spark):
    one, nan = [0.5, 0.25], float("nan")
    rows = [(100, one, 1), (1, [0.4, 0.3], 1), (2, [0.3, 0.1], 2), (3, [0.1, 0.6, 0.2], 3), (4, None, 1), (5, [nan, 1.0], 1), (6, [math.inf, 0.0], 2),
            (8, [None, 0.2], 2), (9, one, None), (None, [0.2, 0.2], 4), (None, one, 1), (200, [0.0, 0.0], 4), (10, [0.0, 0.0], 4), (300, [], 5), (11, [0.1], 5),
            (12, [-0.5, -0.5], 1), (400, [-0.1, -0.4], 1), (13, [0.3, 0.1], 2), (13, [0.3, 0.1], 2)]
    assert multiset(mine(frame(spark, rows)).collect()) == Counter(mined(rows))
    assert mine(frame(spark, rows).limit(0)).count() == 0


# ---------------------------------------------------------------- empty tables


def test_empty(spark, edge):
    none, items = edge.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0 and lexical_search.search(edge, items.limit(0)).count() == 0
    assert minhash_duplicates.near_duplicates(none).count() == 0
