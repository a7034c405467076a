"""Operator 6: benchmark decontamination by latent semantic retrieval.

1. Words (lower-cased, outer punctuation cut) are hashed into ``DIMS`` slots. Document
   frequencies are counted over all documents, one partial vector a task.
2. A distributed randomised SVD of the benchmark's TF-IDF passages gives a whitened latent space
   of ``RANK`` dimensions: random start, power rounds that sum A'(A q) over the tasks, an
   orthogonal basis between rounds. Matrices have at most DIMS x (RANK + EXTRA) entries.
3. An item can only be verified at a place that holds enough of its rare words (an exact bound of the
   common subsequence, see ``Items``). An inverted list from words to items finds these places. The
   passages there (``WIDTH`` words, every ``STEP`` words; for short items the lengths and steps of
   ``SHORT``) are folded in and compared with the item's passages. Cosines of ``MIN_COSINE`` or more
   are candidates. Passages elsewhere are passed over: no pair that step 4 would accept is lost.
4. A candidate is verified against the whole item: longest common word subsequence (bit-parallel)
   between the item and the text around the passage, at least ``MIN_LCS`` of the item; and the
   answer check: the item's closing sentence must be there to ``MIN_ANSWER``.

Scale: rows never meet. The benchmark's texts are folded in on the tasks; the query set is read in
blocks of at most ``ITEM_BLOCK`` items (word hashes), one at a time, each a bounded closure and one
pass over the documents. Driver matrices have a fixed bound. Whole texts are searched, however
long; no shuffle but the sums of fixed-size partials.

Defined results: null or empty text, and benchmark items without a word, match nothing. Short
items (under WIDTH words) are one passage, met by passages of the next length in ``SHORT``. Repeated rows give repeated results; every pair over
the thresholds is returned, so ties play no part. Null ids are kept. Extra columns are ignored
by the search and kept by ``without_leaks``. An empty benchmark or table matches nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marksheet.llm.scratch import written
from marksheet.llm.textbatch import LOWER, find_words, hash_words, pieces

DIMS = 1 << 16
RANK, EXTRA, ROUNDS = 96, 8, 2
WIDTH, STEP = 24, 8
PART = 4  # words; document passages are put together from the sums of such parts
SHORT = {8: 4, 12: 4, 16: 4}  # passage length and step for items of at most so many words
MIN_COSINE = 0.6
MIN_LCS, MIN_ANSWER = 0.6, 0.5
ITEM_BLOCK = 4096
SEED = 7
MARKS = np.isin(np.arange(256), list(b".,;:!?\"'()[]"))


def normal_words(data: np.ndarray, off: np.ndarray):
    """(word hashes, first word of each row, words that close a sentence)."""
    low = LOWER[data]
    start, end, first = find_words(low, off)
    stop = np.isin(low[end - 1], list(b".!?")) if len(end) else np.zeros(0, bool)
    for _ in range(3):  # outer punctuation, at most three marks a side; a bare mark stays
        end = end - (MARKS[low[end - 1]] & (end - start > 1)) if len(end) else end
        start = start + (MARKS[low[start]] & (end - start > 1)) if len(end) else start
    return hash_words(low, start, end), first, stop


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - DIMS.bit_length() + 1)).astype(np.int64)


def passages(first: np.ndarray, width: int = WIDTH, step: int = STEP, flush: bool = True):
    """(row, begin, end) of each row's passages: every ``step`` words, the last one flush (or cut
    off at the end)."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(np.ceil((n - width) / step), 0).astype(np.int64) + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[row] + (np.minimum(k * step, np.maximum(n[row] - width, 0)) if flush else k * step)
    return row, begin, np.minimum(begin + width, first[row + 1])


def entries(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word positions of all passages one after the other, where each passage starts in them)."""
    size = end - begin
    at = np.cumsum(size) - size
    return np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(at, size), at


def folded(rows: np.ndarray, begin: np.ndarray, end: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Latent vectors of passages; ``rows`` has each word's row of ``basis`` (0: none)."""
    out = [np.zeros((0, basis.shape[1]), np.float32)]
    for a in range(0, len(begin), 2048):
        word, at = entries(begin[a: a + 2048], end[a: a + 2048])
        out.append(np.add.reduceat(basis[rows[word]], at, axis=0))
    return np.concatenate(out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]


def _parts(total: np.ndarray) -> pa.RecordBatch:
    """A partial matrix in packed runs of 1024 rows."""
    runs = [total[k: k + 1024].tobytes() for k in range(0, len(total), 1024)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(runs), dtype=np.int32)), pa.array(runs, pa.binary())], names=["at", "part"])


def _added(parts: DataFrame, dtype) -> np.ndarray:
    """The sum of partial matrices, flat: added up on the tasks, run by run; the result has a
    fixed bound (DIMS rows)."""
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype) for x in frame["part"])
        return pd.DataFrame({"at": [frame["at"].iloc[0]], "part": [np.asarray(total, dtype).tobytes()]})

    rows = parts.groupBy("at").applyInPandas(add, "at int, part binary").collect()
    return np.concatenate([np.zeros(0, dtype)] + [np.frombuffer(r["part"], dtype) for r in sorted(rows, key=lambda r: r["at"])])


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Smoothed idf of each slot over all documents."""
    def run(batches):
        total = np.zeros(DIMS + 1, np.int64)  # the last entry counts documents
        for _, data, off in pieces(batches, text, 1 << 20):
            h, first, _ = normal_words(data, off)
            own = np.unique(np.repeat(np.arange(len(off) - 1), np.diff(first)) * DIMS + slot(h))
            total[:DIMS] += np.bincount(own & (DIMS - 1), minlength=DIMS)
            total[DIMS] += len(off) - 1
        yield _parts(total)

    df = _added(docs.select(text).mapInArrow(run, "at int, part binary"), np.int64)
    return np.log((df[DIMS] + 1.0) / (df[:DIMS] + 1.0)).astype(np.float32) + np.float32(1e-3) if len(df) else np.ones(DIMS, np.float32)


def latent_basis(benchmark: DataFrame, idf: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(row of each slot, whitened idf-weighted basis): randomised SVD of the benchmark's
    passages. Row 0 stands for all slots that the benchmark does not use."""
    table = benchmark.select(F.col(text).alias("text")).where("text is not null")

    def used(batches):
        total = np.zeros(DIMS, np.int64)
        for _, data, off in pieces(batches, "text", 1 << 18):
            total += np.bincount(slot(normal_words(data, off)[0]), minlength=DIMS)
        yield _parts(total)

    row_of = np.zeros(DIMS, np.int32)
    slots = np.flatnonzero(_added(table.mapInArrow(used, "at int, part binary"), np.int64))
    row_of[slots] = np.arange(1, len(slots) + 1)
    height = len(slots) + 1

    def power(q: np.ndarray, gram: bool):
        """A'(A q), or (A q)'(A q), summed over the passages of all tasks."""
        def run(batches):
            total = np.zeros((q.shape[1] if gram else height, q.shape[1]))
            for _, data, off in pieces(batches, "text", 1 << 17):
                h, first, _ = normal_words(data, off)
                row, begin, end = passages(first)
                if not len(row):
                    continue
                word, at = entries(begin, end)
                s = slot(h)[word]
                p = np.repeat(np.arange(len(row)), end - begin)
                value = idf[s] / np.sqrt(np.add.reduceat(idf[s] ** 2, at))[p]
                y = np.add.reduceat(value[:, None] * q[row_of[s]], at, axis=0)
                if gram:
                    total += y.T @ y
                else:
                    np.add.at(total, row_of[s], value[:, None] * y[p])
            yield _parts(total)
        return _added(table.mapInArrow(run, "at int, part binary"), np.float64).reshape(-1, q.shape[1])

    width = min(RANK + EXTRA, height)
    q = np.random.default_rng(SEED).standard_normal((height, width))
    for _ in range(ROUNDS):
        q, _ = np.linalg.qr(power(q, False))
    value, vector = np.linalg.eigh(power(q, True))
    best = np.argsort(-value)[:RANK]
    best = best[value[best] > 1e-6 * value.max()]
    basis = q @ (vector[:, best] / np.sqrt(value[best]))
    weight = np.zeros(height)
    weight[1:] = idf[slots]
    return row_of, (weight[:, None] * basis).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def item_words(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(block, item_id, words, answer): each item's word hashes, folded in on the tasks, and the
    place of the first word of its closing sentence; blocks of at most ITEM_BLOCK items."""
    def run(batches):
        for batch, data, off in pieces(batches, "_text", 1 << 18):
            h, first, stop = normal_words(data, off)
            own, answer = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                ends = np.flatnonzero(stop[a: max(a, b - 1)])
                own.append(h[a:b].tobytes())
                answer.append(int(ends[-1]) + 1 if len(ends) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), pa.array(answer, pa.int64())], names=["item_id", "words", "answer"])

    rows = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("_text")).where("_text is not null")
    table = written(rows.mapInArrow(run, "item_id long, words binary, answer long").where(F.length("words") > 0), "items")
    return written(table.withColumn("block", F.floor(F.monotonically_increasing_id() / ITEM_BLOCK)), "item-blocks")


class Items:
    """A block of the query set: words, latent passages, and an inverted list of rare words.

    A text that shares a subsequence of ``need`` words with an item holds, of any ``j`` words of the
    item, at least ``need - (size - j)``. Each item lists the slots of its ``j`` rarest words; a
    text must hold ``hits`` of them."""

    def __init__(self, rows, idf: np.ndarray, row_of: np.ndarray, basis: np.ndarray):
        self.ids = [r["item_id"] for r in rows]
        self.words = [np.frombuffer(r["words"], np.uint64) for r in rows]
        self.answers = [w[r["answer"]:] for w, r in zip(self.words, rows)]
        self.size = np.array([len(w) for w in self.words])
        first = np.concatenate([[0], np.cumsum(self.size)])
        every = slot(np.concatenate(self.words))
        owner, begin, end = passages(first)
        self.queries = unit(folded(row_of[every], begin, end, basis))
        self.offset = begin - first[owner]  # of a passage in its item
        self.q_first = np.searchsorted(owner, np.arange(len(rows) + 1))
        limits = np.array(sorted(SHORT))
        self.kind = np.searchsorted(limits, self.size)  # which length of passage meets the item
        self.shapes = [(int(n), SHORT[int(n)]) for n in limits] + [(WIDTH, STEP)]
        need = np.ceil(MIN_LCS * self.size).astype(np.int64)
        listed = self.size - need + (need + 3) // 4
        self.hits = need - (self.size - listed)
        own = [every[a:b] for a, b in zip(first[:-1], first[1:])]
        slots = [np.unique(x[np.argsort(-idf[x], kind="stable")[:j]]) for x, j in zip(own, listed)]
        owners = np.repeat(np.arange(len(rows)), [len(x) for x in slots])
        slots = np.concatenate(slots)
        order = np.argsort(slots, kind="stable")
        self.listed, self.starts = owners[order], np.searchsorted(slots[order], np.arange(DIMS + 1))

    def runs(self, s: np.ndarray, row: np.ndarray):
        """(item, first hit, last hit): runs of ``hits`` neighbouring listed words of an item that
        one verification of it can cover; by item, then position. ``s``: slots of the words."""
        count = self.starts[s + 1] - self.starts[s]
        at = np.flatnonzero(count)
        count = count[at]
        pos = np.repeat(at, count)
        place = np.arange(len(pos)) - np.repeat(np.cumsum(count) - count, count)
        k = self.listed[np.repeat(self.starts[s[at]], count) + place]
        order = np.argsort(k, kind="stable")
        k, pos = k[order], pos[order]
        last = np.arange(len(k)) + self.hits[k] - 1
        i = np.flatnonzero(last < len(k))
        j = last[i]
        i = i[(k[j] == k[i]) & (row[pos[j]] == row[pos[i]]) & (pos[j] - pos[i] < self.size[k[i]] + 2 * WIDTH)]
        return k[i], pos[i], pos[last[i]]

    def candidates(self, k: np.ndarray, a: np.ndarray, b: np.ndarray, row: np.ndarray, begin: np.ndarray, p_first: np.ndarray):
        """(passage, query) pairs, each once: the passages (starting at ``begin``; those of a text from
        ``p_first``) whose verification against the query's item would cover one of the runs."""
        count = self.q_first[k + 1] - self.q_first[k]
        run = np.repeat(np.arange(len(k)), count)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        order = np.lexsort((run, nth, row[a[run]], k[run]))  # runs of one (item, text, query) side by side
        run, nth = run[order], nth[order]
        q, item, text = self.q_first[k[run]] + nth, k[run], row[a[run]]
        low = np.searchsorted(begin, b[run] - self.size[item] - WIDTH + self.offset[q] + 1)
        high = np.searchsorted(begin, a[run] + self.offset[q] + WIDTH, "right")
        low, high = np.maximum(low, p_first[text]), np.minimum(high, p_first[text + 1])
        same = np.flatnonzero((q[1:] == q[:-1]) & (text[1:] == text[:-1])) + 1
        low[same] = np.maximum(low[same], high[same - 1])  # what the run before has covered
        count = np.maximum(high - low, 0)
        p = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return p, np.repeat(q, count), np.repeat(item, count)


def _search(idf: np.ndarray, row_of: np.ndarray, basis: np.ndarray, rows):
    """Task function: verified pairs of LEAK_SCHEMA."""
    def run(batches):
        items = Items(rows, idf, row_of, basis)
        for batch, data, off in pieces(batches, "_text", 1 << 20):
            h, starts, _ = normal_words(data, off)
            s = slot(h)
            text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            k, a, b = items.runs(s, text)
            part_row, part_a, part_b = passages(starts, PART, PART, flush=False)
            part_first = np.searchsorted(part_row, np.arange(len(starts)))
            found: dict = {}
            for c in np.unique(items.kind[k]).tolist():
                width, step = items.shapes[c]
                row, x, y = passages(part_first, width // PART, step // PART)
                begin, end = part_a[x], part_b[y - 1]
                own = np.flatnonzero(items.kind[k] == c)
                p, q, item = items.candidates(k[own], a[own], b[own], text, begin, np.searchsorted(row, np.arange(len(starts))))
                for g in range(0, len(p), 65536):
                    cut = slice(g, g + 65536)
                    used, place = np.unique(p[cut], return_inverse=True)
                    latent = unit(folded(row_of[s], begin[used], end[used], basis))
                    cos = np.einsum("ij,ij->i", latent[place], items.queries[q[cut]])
                    for i in (np.flatnonzero(cos >= MIN_COSINE)).tolist():
                        spot = int(begin[p[g + i]] - items.offset[q[g + i]])  # where the item would begin
                        spots = found.setdefault((int(row[p[g + i]]), int(item[g + i])), {})
                        spots[spot] = max(float(cos[i]), spots.get(spot, 0.0))
            out = []
            for (d, k), spots in found.items():
                words, answer = items.words[k], items.answers[k]
                best = None
                for at, c in sorted(spots.items(), key=lambda x: -x[1]):
                    lo = max(int(starts[d]), at - WIDTH)
                    near = h[lo: min(int(starts[d + 1]), at + len(words) + WIDTH)]
                    n = common_subsequence(words, near)
                    if n >= MIN_LCS * len(words) and common_subsequence(answer, near) >= MIN_ANSWER * len(answer):
                        best = max(best or (0,), (n, c, max(0, at - int(starts[d]))))
                        if n == len(words):
                            break
                if best:
                    out.append((d, items.ids[k], float(best[1]), best[0], len(words), best[2]))
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(pa.array(cols[0], pa.int64())) for k in (0, 1)]
                + [pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())] + [pa.array(cols[k], pa.int64()) for k in (3, 4, 5)],
                names=["doc_id", "content", "item_id", "cosine", "lcs_words", "item_words", "first_word"])
    return run


LEAK_SCHEMA = "doc_id long, content long, item_id long, cosine double, lcs_words long, item_words long, first_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document row, benchmark item found in it). The items are the stated query set:
    one bounded block at a time meets all documents, and its pairs are written before the next."""
    items = item_words(benchmark, item, item_text)
    numbers = [r["block"] for r in items.select("block").distinct().orderBy("block").collect()]  # one for ITEM_BLOCK items
    out = docs.sparkSession.createDataFrame([], LEAK_SCHEMA)
    if not numbers:
        return out
    idf = inverse_frequencies(docs, text)
    row_of, basis = latent_basis(benchmark, idf, item_text)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).alias("_text"))
    for number in numbers:
        block = items.where(F.col("block") == number).select("item_id", "words", "answer").collect()
        out = out.unionByName(written(rows.mapInArrow(_search(idf, row_of, basis, block), LEAK_SCHEMA), "leaks"))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, all columns."""
    bad = written(leaks(docs, benchmark, key, text).select(F.col("doc_id").alias("_id"), F.col("content").alias("_c")).distinct(), "leaks")
    return docs.join(bad, F.col(key).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_c")), "left_anti")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    d = sf_dir.rstrip("/")
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    return leaks(docs, items).drop("content")
