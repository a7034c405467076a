"""Operator 2: language-model scores from a weighted backoff automaton.

Model: n-grams up to ``ORDER`` words over lower-cased (A-Z) words, each text closed by an end
token, which also opens the next (the start history). States are the histories seen in training;
a state's arcs are its seen successors, and a failure arc leads to the history without its first
word. Weights are Dirichlet-smoothed counts, so every state's probabilities sum to one:
    seen arc       (c(hw) + MU * p(w | shorter h)) / (c(h) + MU)
    failure arc    MU / (c(h) + MU)
    base state     (c(w) + 1) / (N + V + 1), the unseen word included
No states or arcs are built: what a walk would add up is computed from count lookups, level by
level (``walk``), as the history of a word is fixed by the words before it.

Scale: counts of all n-grams of all training texts are gathered in hash ranges; a block of texts
gets back the part of the automaton that its own n-grams can reach (``llm.blocks``), so the model
is never whole in one place and nothing is broadcast but N and V. Hashes and counts have 64 bits.

Defined results: null or empty text is the end token alone. A null id is not held out. With no
training text N = V = 0 and every token has probability one. Repeated rows count each time.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marksheet.llm.blocks import MESSAGE_SCHEMA, Block, answers, block_of, block_table, messages, places, reply_array, spans_of
from marksheet.llm.scratch import written
from marksheet.llm.textbatch import LOWER, find_words, hash_words, join_hash, row_sums

ORDER = 3
MU = 10.0
END = np.uint64(0xD1B54A32D192ED03)


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, end tokens included, and the index of each text's first token."""
    data = LOWER[block.data]
    start, end, first = find_words(data, block.off)
    h = hash_words(data, start, end)
    out = np.full(len(h) + len(first) - 1, END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = h
    return out, first + np.arange(len(first))


def grams(tok: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order: (n-gram hash ending at each token, whether it lies in the text). The end
    token of the text before stands for the start history of a text."""
    place = np.arange(len(tok)) - np.repeat(first[:-1], np.diff(first))
    out = [(tok, np.ones(len(tok), bool))]
    for n in range(2, order + 1):
        shorter = out[-1][0]
        before = np.concatenate([[END], shorter[:-1]]) if len(shorter) else shorter
        out.append((join_hash(before, tok), place >= n - 2))
    return out


def _distinct(h: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, count = np.unique(h, return_counts=True)
    held, less = np.unique(h[~train], return_counts=True)
    count[np.searchsorted(keys, held)] -= less
    return keys, count


def walk(tok: np.ndarray, first: np.ndarray, counts: list[np.ndarray], n_all: int, n_distinct: int, mu: float, order: int):
    """(base, model) log10 probability of each token. ``counts[n-1]`` has the corpus count of the
    n-gram that ends at each token; the walk over a block's texts goes level by level for all
    tokens at once, as the state before a token is fixed by the words before it."""
    p = (counts[0] + 1.0) / (n_all + n_distinct + 1.0)
    base = np.log10(p)
    for n in range(2, order + 1):
        # the state's own count: of the history, which ends one token earlier
        state = np.concatenate([[counts[n - 2][0] if len(p) else 0], counts[n - 2][:-1]]) if len(p) else counts[n - 2]
        if n == 2 and len(p):
            starts = first[:-1]
            state[starts] = counts[0][first[1:] - 1]  # the end token opens a text
        inside = grams_inside(first, len(tok), n)
        p = np.where(inside, (counts[n - 1] + mu * p) / (state + mu), p)
    return base, np.log10(p)


def grams_inside(first: np.ndarray, n_tokens: int, n: int) -> np.ndarray:
    place = np.arange(n_tokens) - np.repeat(first[:-1], np.diff(first))
    return place >= n - 2


def score(docs: DataFrame, train, order: int = ORDER, mu: float = MU, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row;
    ``train`` is a boolean column that says which rows the model learns from."""
    table = block_table(docs, key, text, flag=train)
    spans = spans_of(table)

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = block_of(batch, i)
                tok, first = tokens(block)
                learn = np.repeat(block.flags, np.diff(first))
                number = batch.column(batch.schema.get_field_index("block"))[i].as_py()
                for n, (h, ok) in enumerate(grams(tok, first, order), start=1):
                    yield messages(n, number, *_distinct(h[ok], learn[ok]), spans)

    replies = written(answers(table.mapInArrow(ask, MESSAGE_SCHEMA)), "lm-counts")
    sums = replies.where("kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n_all, n_distinct = int(sums[0]), int(sums[1])

    def read(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in left.itertuples(index=False):
            block = Block(r.ids, r.has_id, r.flags, r.offsets, r.texts)
            tok, first = tokens(block)
            counts = []
            for n, (h, ok) in enumerate(grams(tok, first, order), start=1):
                got = reply_array(right, n, np.uint64)
                c = np.zeros(len(h))
                c[ok] = got[places(h[ok])] if len(got) else 0
                counts.append(c)
            base, model = walk(tok, first, counts, n_all, n_distinct, mu, order)
            out.append(pd.DataFrame({
                "doc_id": pd.array(block.ids, "Int64"), "held_out": ~block.flags, "n_tokens": np.diff(first),
                "n_known": row_sums((counts[0] > 0).astype(np.int64), first), "train_tokens": n_all,
                "base_score": row_sums(base, first), "score": row_sums(model, first)}))
            out[-1].loc[~block.has_id, "doc_id"] = pd.NA
        return pd.concat(out)

    return table.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(
        read, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score(docs, ~held_out)
