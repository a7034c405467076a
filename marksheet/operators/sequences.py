"""Prompt rendering, tokenization, masking and padding.

The built-in tokenizer is a word tokenizer (word runs and single punctuation marks) with a
vocabulary ranked by corpus frequency; trained tokenizers plug in through ``hooks.tokenize_with``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marksheet.functions import strings as S
from marksheet.operators.sampling import ordered_positions
from marksheet.session import checked_broadcast, materialized

IGNORE_INDEX = -100
TOKEN_RE = r"\w+|[^\w\s]"

# The default chat template (role, prefix, suffix) and the generation opener.
# Model templates are external; pass your own table to the render functions.
DEFAULT_TEMPLATE = [
    ("system", "<|system|>\n", "<|end|>\n"),
    ("user", "<|user|>\n", "<|end|>\n"),
    ("assistant", "<|assistant|>\n", "<|end|>\n"),
]
DEFAULT_OPENER = "<|assistant|>\n"
TEMPLATE_MAX_ROLES = 64


def template_frame(spark: SparkSession, rows=DEFAULT_TEMPLATE) -> DataFrame:
    return spark.createDataFrame(rows, "role string, prefix string, suffix string")


# ------------------------------------------------------------------ T1, T10, T12, T13, T14

def build_prompt(instruction: str | Column = "instruction", inp: str | Column = "input") -> Column:
    """``instruction + "\\n" + input`` with a null input read as empty."""
    return F.concat(S.col_(instruction), F.lit("\n"), F.coalesce(S.col_(inp), F.lit("")))


def strip_reasoning(c) -> Column:
    """The text after the first ``</think>``, left-trimmed; unchanged without the tag."""
    tag = "</think>"
    return S.let(c, lambda c: F.when(S.has(c, tag), S.lstrip(S.after_first(c, tag))).otherwise(c))


QUESTION_KEYS = ("question", "problem", "Question", "input")


def pick_question(df: DataFrame) -> Column:
    """The first existing column of question/problem/Question/input (case-sensitive), stripped."""
    for k in QUESTION_KEYS:
        if k in df.columns:
            return S.strip(F.col(f"`{k}`"))
    return F.lit("")


def pick_gold(df: DataFrame, col: str = "answer") -> Column:
    """``answer`` as a string, else null."""
    return F.col(col).cast("string") if col in df.columns else F.lit(None).cast("string")


def generated_part(ids: str | Column, n: str | Column) -> Column:
    """Drop the first ``n`` ids (the prompt) from the output ids."""
    ids, n = S.col_(ids), (S.col_(n) if not isinstance(n, int) else F.lit(n))
    return F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0)))


# ------------------------------------------------------------------ T2, T3 chat rendering

def render_prompt(df: DataFrame, template: DataFrame, prompt: Column, out_col: str = "prompt_text",
                  opener: str = DEFAULT_OPENER, response: Column | None = None) -> DataFrame:
    """T2/T3 for single-turn records: user turn (+ assistant turn when ``response`` is given,
    else the generation opener). The template has one row per role; it is broadcast."""
    rows = template.limit(TEMPLATE_MAX_ROLES + 1).collect()  # a handful of roles
    if len(rows) > TEMPLATE_MAX_ROLES:
        raise ValueError(f"a chat template has at most {TEMPLATE_MAX_ROLES} roles")
    t = {r["role"]: (r["prefix"], r["suffix"]) for r in rows}
    up, us = t["user"]
    text = F.concat(F.lit(up), prompt, F.lit(us))
    if response is None:
        text = F.concat(text, F.lit(opener))
    else:
        ap, as_ = t["assistant"]
        text = F.concat(text, F.lit(ap), F.coalesce(response, F.lit("")), F.lit(as_))
    return df.withColumn(out_col, text)


def render_turns(conversations: DataFrame, template: DataFrame) -> DataFrame:
    """T2/T3 long form: each turn rendered on its own row (no grouping); concatenating the
    pieces in ``turn`` order gives the dialogue. For conversations too long for one row."""
    j = conversations.join(checked_broadcast(template, TEMPLATE_MAX_ROLES), "role", "left")
    piece = F.concat(F.coalesce(F.col("prefix"), F.lit("")), F.coalesce(F.col("text"), F.lit("")),
                     F.coalesce(F.col("suffix"), F.lit("")))
    return j.select(*[c for c in conversations.columns], piece.alias("piece"))


def render_chat(conversations: DataFrame, template: DataFrame, open_turn: bool = True,
                opener: str = DEFAULT_OPENER, conv_col: str = "conv_id", out_col: str = "rendered") -> DataFrame:
    """T2/T3 on long-form turns (conv_id, turn, role, text): one rendered string per conversation.

    Turn order comes from ``turn`` (sorted inside the group); unknown roles render with empty
    prefix/suffix. One group is one conversation, bounded by the dialogue length.
    """
    g = render_turns(conversations, template).groupBy(conv_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn"), F.col("piece")))).alias("_t"))
    body = F.array_join(F.transform(F.col("_t"), lambda x: x["piece"]), "")
    if open_turn:
        body = F.concat(body, F.lit(opener))
    return g.select(conv_col, body.alias(out_col), F.size("_t").alias("turns"))


def render_messages(messages: str | Column, template_rows=DEFAULT_TEMPLATE, open_turn: bool = True,
                    opener: str = DEFAULT_OPENER) -> Column:
    """T2/T3 on a message-list column ``array<struct<role, content>>`` (row-local).

    The template is a handful of (role, prefix, suffix) literals, inlined as two maps."""
    pre = F.create_map(*[F.lit(x) for r in template_rows for x in (r[0], r[1])])
    suf = F.create_map(*[F.lit(x) for r in template_rows for x in (r[0], r[2])])
    pieces = F.transform(S.col_(messages), lambda m: F.concat(
        F.coalesce(F.try_element_at(pre, m["role"]), F.lit("")), F.coalesce(m["content"], F.lit("")),
        F.coalesce(F.try_element_at(suf, m["role"]), F.lit(""))))
    body = F.array_join(pieces, "")
    return F.concat(body, F.lit(opener)) if open_turn else body


# ------------------------------------------------------------------ T4 word tokenizer

def word_tokens(c) -> Column:
    return F.regexp_extract_all(S.col_(c), F.lit(TOKEN_RE), 0)


def build_vocab(texts: DataFrame, text_col: str = "text", first_id: int = 1) -> DataFrame:
    """Vocabulary over whole texts: distinct tokens ranked by count desc, then token; ids from
    ``first_id`` (0 stays free for padding). Token counts use partial aggregation and are written
    once (the texts are split once); the ranking numbers tokens inside buckets of similar count,
    which grow by a prefix of the token where many share a count (see ``ordered_positions``)."""
    counts = texts.select(F.explode(word_tokens(text_col)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    counts = materialized(counts, "token-counts")
    rank = F.lpad((F.lit(2**62) - F.col("freq")).cast("string"), 19, "0")  # ascending with falling counts
    top = F.lpad((F.lit(62) - F.floor(F.log2("freq"))).cast("string"), 2, "0")
    ranked = ordered_positions(counts, [F.col("freq").desc(), F.col("token")], top, rank, "token", "_pos")
    return materialized(ranked.select("token", "freq", (F.col("_pos") + first_id).cast("int").alias("token_id")), "vocabulary")


# The part of a vocabulary that is broadcast: this many ids at most, tokens of this length at most.
HEAD_TOKENS = 65_536
HEAD_TOKEN_CHARS = 64


# Words of one row on the way to the lookup; a longer record is a run of rows.
PIECE_WORDS = 1024


def _word_pieces(df: DataFrame, key: str, text_col: str, keep_text: bool) -> DataFrame:
    """Each record as a run of rows (no, words, own): its words in text order, ``PIECE_WORDS`` a row, ``no``
    from 0. ``own`` (where ``no`` is 0) holds the record's columns and its name ``k`` (the key as a string that
    is never null). Before the first record of a task comes a row with ``no`` -1 and ``all`` 0, which the
    head of the vocabulary meets. The text is split once."""
    own = df.columns if keep_text else [c for c in df.columns if c != text_col]
    record = F.struct(F.struct(*own).alias("rec"), F.coalesce(F.concat(F.lit(":"), F.col(key).cast("string")), F.lit("")).alias("k"))
    rows = df.select(record.alias("own"), F.coalesce(word_tokens(text_col), F.array().cast("array<string>")).alias("w"),
                     (F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)) == 0).alias("first"))
    last = F.greatest(F.ceil(F.size("w") / F.lit(PIECE_WORDS)).cast("int"), F.lit(1)) - 1
    rows = rows.select("own", "w", F.explode(F.sequence(F.when(F.col("first"), -1).otherwise(0), last)).alias("no"))
    words = F.when(F.col("no") >= 0, F.slice("w", F.col("no") * PIECE_WORDS + 1, F.lit(PIECE_WORDS)))
    return rows.select("no", words.alias("words"), F.when(F.col("no") == 0, F.col("own")).alias("own"), F.when(F.col("no") < 0, F.lit(0)).alias("all"))


def _looked_up():
    """Rows of ``_word_pieces``, of which the first of a task came with the head (tok, id), as one row a
    record: own, ``ids`` in text order and ``rare``, the distinct tokens outside the head; -1, -2, ...
    in ``ids`` stand for them. The function is made here, so that it is shipped by value."""
    def records(t, tokens, numbers):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        no = t.column("no").to_numpy()
        first = np.flatnonzero(no == 0)
        record = np.cumsum(no == 0) - 1
        if no[0] != 0 or not np.array_equal(no, np.arange(len(no)) - first[record]):
            raise RuntimeError("the rows of a record came apart")
        words = t.column("words")
        record = np.repeat(record, pc.list_value_length(words).to_numpy())  # of each word
        words = words.flatten().dictionary_encode()
        code = words.indices.to_numpy()
        at = pc.index_in(words.dictionary, value_set=tokens)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        id_of = np.zeros(len(known), np.int32)
        id_of[known] = numbers[at.drop_null().to_numpy()]
        ids = id_of[code]
        open_ = np.flatnonzero(~known[code])
        n = max(1, len(known))
        pairs, slot = np.unique(record[open_] * n + code[open_], return_inverse=True)
        starts = np.searchsorted(pairs // n, np.arange(len(first) + 1))
        ids[open_] = starts[record[open_]] - slot - 1
        ends = np.searchsorted(record, np.arange(len(first) + 1))
        return pa.RecordBatch.from_arrays([
            t.column("own").take(pa.array(first)),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
            pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), words.dictionary.take(pa.array(pairs % n)))], ["own", "ids", "rare"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        head, lookup = [], None
        held = []  # the batches of a record that is not over yet
        for batch in batches:
            no = batch.column("no").to_numpy()
            lead = int((no < 0).sum())
            if (no[:lead] >= 0).any() or (lead and lookup) or not (lead or head):
                raise RuntimeError("the vocabulary did not come first")
            if lead:
                head.append(batch.select(["tok", "id"]).slice(0, lead))
                batch, no = batch.slice(lead), no[lead:]
            if not len(no):
                continue
            if lookup is None:
                known = pa.Table.from_batches(head).combine_chunks().drop_null()
                lookup = pa.array(known.column("tok").to_pylist(), pa.string()), known.column("id").to_numpy()
            starts = np.flatnonzero(no == 0)
            if len(starts):
                held.append(batch.slice(0, starts[-1]))
                yield from (records(b, *lookup) for b in pa.Table.from_batches(held).combine_chunks().to_batches() if b.num_rows)
                held = []
            held.append(batch.slice(starts[-1]) if len(starts) else batch)
        if held:
            yield from (records(b, *lookup) for b in pa.Table.from_batches(held).combine_chunks().to_batches() if b.num_rows)

    return run


def tokenize(df: DataFrame, key: str, text_col: str, vocab: DataFrame, max_len: int | None = None,
             out_col: str = "input_ids", unk_id: int = 0, keep_text: bool = False) -> DataFrame:
    """T4: token ids of ``text_col`` via the vocabulary; all tokens of whole texts.

    No row per token is made, sorted or shuffled. A record keeps its words as an array; the tokens with the
    lowest ids (the most frequent ones of ``build_vocab``, which distinct ids bound to ``HEAD_TOKENS`` rows)
    are broadcast and meet one row at the beginning of each task, which looks its records' words up in them,
    a batch at a time. It gives one row a record, with an array of ids in which negative numbers stand for
    the distinct tokens outside the head. Only these rows and those tokens are shuffled; a hot one of the
    latter is split by Spark's skew join. ``key`` is unique per record; records that share one become one,
    without ids. The text itself is not shuffled unless ``keep_text``. With ``max_len`` see ``in_windows``.
    """
    v = vocab.select(F.col("token").alias("_tok"), F.col("token_id").cast("int").alias("_id"))
    frequent = (F.col("_id") >= 0) & (F.col("_id") < HEAD_TOKENS) & (F.length("_tok") <= HEAD_TOKEN_CHARS)
    head = v.where(frequent).select(F.col("_tok").alias("tok"), F.col("_id").alias("id"), F.least("_id", F.lit(0)).alias("_all"))  # _all is 0
    rows = _word_pieces(df, key, text_col, keep_text).join(F.broadcast(head), F.col("all") == F.col("_all"), "left").select("no", "words", "own", "tok", "id")
    own = rows.schema["own"].dataType.simpleString()
    docs = rows.mapInArrow(_looked_up(), f"own {own}, ids array<int>, rare array<string>")
    # one array, and a name whose type is never null, so that both readers below share one exchange
    docs = docs.select(F.concat_ws("", F.col("own")["k"]).alias("_k"), F.array(F.struct("own", "ids", "rare")).alias("_l")).repartition("_k")
    # a key of its own is an exchange of its own: where that is empty, the join is planned away
    rare = docs.select(F.concat("_k", F.lit("")).alias("_key"), F.posexplode(F.flatten(F.transform("_l", lambda x: x["rare"]))).alias("no", "tok"))
    rare = rare.join(v.where(~frequent), F.col("tok") == F.col("_tok"), "left")
    # (no, id) as one long, sorted by no
    found = F.shiftleft(F.col("no").cast("long"), 32) + F.coalesce("_id", F.lit(unk_id)).cast("long") + F.lit(2**31)
    rare = rare.groupBy("_key").agg(F.sort_array(F.collect_set(found)).alias("_r"))
    rare = rare.withColumn("_r", F.transform("_r", lambda x: (x.bitwiseAND(F.lit(2**32 - 1)) - F.lit(2**31)).cast("int")))
    out = docs.groupBy("_k").agg(F.flatten(F.collect_list("_l")).alias("_l"))
    out = out.join(rare.hint("shuffle_hash"), F.col("_k") == F.col("_key"), "left")
    merged = F.exists(F.slice("_l", 2, F.size("_l")), lambda x: F.size(x["ids"]) > 0)  # a key that repeats: one record, without ids
    out = out.select(F.get("_l", F.lit(0))["own"].alias("own"), F.when(~merged, F.get("_l", F.lit(0))["ids"]).alias("ids"), "_r")
    ids = F.transform("ids", lambda x: F.when(x < 0, F.get("_r", -x - 1)).otherwise(x))
    return in_windows(out.select("own.rec.*", ids.alias(out_col)), out_col, max_len)


def in_windows(df: DataFrame, ids_col: str = "input_ids", max_len: int | None = None) -> DataFrame:
    """Token rows of at most ``max_len`` ids: a longer one becomes consecutive records numbered by
    ``chunk_no`` from 0, so no token is lost; an empty one stays one record. None: unchanged."""
    if max_len is None:
        return df
    n = F.greatest(F.ceil(F.size(ids_col) / F.lit(max_len)).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(ids_col, i * max_len + 1, F.lit(max_len)))
    others = [c for c in df.columns if c != ids_col]
    return df.select(*others, F.posexplode(parts).alias("chunk_no", ids_col))


def token_length(c) -> Column:
    """Number of tokens of a whole text (no truncation)."""
    return F.size(word_tokens(c))


def token_length_of(df: DataFrame, col: str, template_rows=DEFAULT_TEMPLATE) -> Column:
    """T9 with the type check done at analysis time from the schema: a string column is
    tokenized as is; a message list is rendered with the generation opener first; any other
    type raises."""
    from pyspark.sql.types import ArrayType, StringType, StructType
    t = df.schema[col].dataType
    if isinstance(t, StringType):
        return token_length(F.col(col))
    if isinstance(t, ArrayType) and isinstance(t.elementType, StructType) and {"role", "content"} <= set(t.elementType.names):
        return token_length(render_messages(F.col(col), template_rows, open_turn=True))
    raise TypeError(f"token_length needs a string or a message list, got {t.simpleString()}")


# ------------------------------------------------------------------ T5-T8, W3

def mask_prompt(ids: str | Column, prompt_len: str | Column, ignore_id: int = IGNORE_INDEX) -> Column:
    """T5: labels = ids with the first ``min(prompt_len, len)`` positions set to -100."""
    n = S.col_(prompt_len)
    return F.transform(S.col_(ids), lambda x, i: F.when(i < n, F.lit(ignore_id)).otherwise(x))


def pad_batch(df: DataFrame, batch_col: str = "batch_id", ids_col: str = "input_ids", labels_col: str | None = "labels",
              pad_id: int = 0, side: str = "right", multiple_of: int | None = None, ignore_id: int = IGNORE_INDEX,
              labels: Column | None = None) -> DataFrame:
    """Pad ids with ``pad_id`` and labels with -100 to the batch maximum (rounded up to
    ``multiple_of``). The window is per batch (a bounded group of batch-size rows). ``labels`` says what
    ``labels_col`` holds before the padding, for rows that don't have it: labels which follow from the ids
    are then neither shuffled nor sorted."""
    w = Window.partitionBy(batch_col)
    target = F.max(F.size(ids_col)).over(w)
    if multiple_of:
        target = (F.ceil(target / F.lit(multiple_of)) * F.lit(multiple_of)).cast("int")
    out = df.withColumn("_target", target)
    out = out.withColumn("_k", F.greatest(F.col("_target") - F.size(ids_col), F.lit(0)))
    if labels is not None:
        out = out.withColumn(labels_col, labels)

    def pad(col, value):
        fill = F.array_repeat(F.lit(value), F.col("_k"))
        return F.concat(fill, F.col(col)) if side == "left" else F.concat(F.col(col), fill)

    out = out.withColumn(ids_col, pad(ids_col, pad_id))
    if labels_col:
        out = out.withColumn(labels_col, pad(labels_col, ignore_id))
    return out.drop("_target", "_k")


def attention_mask(ids: str | Column, pad_id: int = 0) -> Column:
    """``id != pad_id`` (a real token equal to the pad id is masked too, as in the original)."""
    return F.transform(S.col_(ids), lambda x: x != F.lit(pad_id))


def length_mask(ids: str | Column, length: str | Column, side: str = "right") -> Column:
    """T8 (length form): true on the first/last ``length`` positions (real tokens), so a real
    token equal to the pad id stays visible."""
    ids, n = S.col_(ids), S.col_(length)
    if side == "left":
        return F.transform(ids, lambda x, i: i >= F.size(ids) - n)
    return F.transform(ids, lambda x, i: i < n)


def rejected_records(df: DataFrame, instruction: str = "instruction") -> DataFrame:
    """Records whose prompt cannot be built (null instruction), reported instead of dropped silently."""
    return df.where(F.col(instruction).isNull())


def unpad(ids: str | Column, length: str | Column, side: str = "right") -> Column:
    """Inverse of padding given the original length (used by the property tests)."""
    ids, n = S.col_(ids), S.col_(length)
    if side == "left":
        return F.slice(ids, F.size(ids) - n + 1, n)
    return F.slice(ids, 1, n)


# ------------------------------------------------------------------ T11

def attach_embeddings(df: DataFrame, emb: DataFrame, key: str, emb_key: str, emb_col: str = "embedding",
                      out_col: str = "external_embedding") -> DataFrame:
    """One precomputed vector per record by key (left join; missing vectors stay null)."""
    e = emb.select(F.col(emb_key).alias(key), F.col(emb_col).cast("array<double>").alias(out_col))
    return df.join(e, key, "left")
