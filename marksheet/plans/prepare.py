"""Training-data preparation: split, cap, render, tokenize, mask (the data half of training).

Composition only: every step is an operator of ``marksheet.operators``; Catalyst plans the
whole thing as one job per output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marksheet.operators import hooks as H
from marksheet.operators import sampling as P
from marksheet.operators import sequences as T
from marksheet.session import materialized


def split_and_cap(train: DataFrame, val: DataFrame | None, key: str, seed: int = 42, val_ratio: float = 0.02,
                  max_train: int | str | None = None, max_val: int | str | None = None) -> dict[str, DataFrame]:
    """Seeded shuffle; hold-out from train when no val table is given (ratio ~0: no val);
    then the first ``max_*`` shuffled rows of each split."""
    if val is None:
        if abs(val_ratio) < 1e-5:
            tr, va = train, None
        else:
            s = P.holdout_split(train, val_ratio, key, seed)
            tr = s.where(F.col("split") == "train").drop("split")
            va = s.where(F.col("split") == "val").drop("split")
    else:
        tr, va = train, val
    out = {"train": P.cap_rows(tr, max_train, key, seed)}
    if va is not None:
        out["val"] = P.cap_rows(va, max_val, key, seed)
    return out


def token_rows(records: DataFrame, template: DataFrame, vocab: DataFrame | None, key: str = "raw_id",
               max_len: int | None = None, make_tokenizer=None, make_embedder=None, embed_col: str = "input") -> DataFrame:
    """Render prompt-only and full texts, tokenize the full text (whole; with ``max_len``
    in consecutive records, see ``tokenize``) and mask the prompt part of the labels; keep only the derived columns (P9).

    The prompt contributes only its token count, so it needs no
    vocabulary lookup: one tokenization pass per record. With ``make_tokenizer`` (see
    ``hooks.tokenize_with``) a trained tokenizer takes the place of the vocabulary for both texts.
    With ``make_embedder`` (see ``hooks.embed_with``) each record gets the vector of its ``embed_col``
    as ``external_embedding`` (T11, U2).
    """
    if make_embedder is not None:
        records = records.withColumn("external_embedding", H.embed_with(embed_col, make_embedder))
    prompt = T.build_prompt("instruction", "input")
    r = T.render_prompt(records, template, prompt, "_prompt_text")
    r = T.render_prompt(r, template, prompt, "_full_text", response=F.col("output"))
    extra = [c for c in records.columns if c not in (key, "instruction", "input", "output")]
    if make_tokenizer is not None:
        r = r.select(key, *extra, H.tokenize_with("_full_text", make_tokenizer).alias("input_ids"),
                     F.size(H.tokenize_with("_prompt_text", make_tokenizer)).alias("prompt_len"))
        f = T.in_windows(r, "input_ids", max_len)
    else:
        r = r.select(key, *extra, "_full_text", T.token_length("_prompt_text").alias("prompt_len"))
        f = T.tokenize(r, key, "_full_text", vocab, max_len, "input_ids")
    if max_len is None:
        return f.select(key, *extra, "input_ids", T.mask_prompt("input_ids", "prompt_len").alias("labels"), "prompt_len")
    left = F.col("prompt_len") - F.col("chunk_no") * max_len  # prompt tokens from this record on
    return f.select(key, *extra, "chunk_no", "input_ids", T.mask_prompt("input_ids", left).alias("labels"), "prompt_len")


def prepare_training(train: DataFrame, template: DataFrame, val: DataFrame | None = None, key: str = "raw_id",
                     seed: int = 42, val_ratio: float = 0.02, max_train=None, max_val=None, max_len: int | None = None,
                     vocab: DataFrame | None = None, make_tokenizer=None, make_embedder=None, embed_col: str = "input") -> dict[str, DataFrame]:
    """Token rows per split. Ids come from ``make_tokenizer`` (a trained tokenizer, see
    ``hooks.tokenize_with``), from ``vocab``, or from a word vocabulary built over the rendered
    full texts of all records.
    No record is cut or dropped unless the caller passes a limit."""
    splits = split_and_cap(train, val, key, seed, val_ratio, max_train, max_val)
    if vocab is None and make_tokenizer is None:
        prompt = T.build_prompt("instruction", "input")
        rendered = T.render_prompt(train if val is None else train.unionByName(val), template, prompt, "_t",
                                   response=F.col("output"))
        vocab = T.build_vocab(rendered, "_t")
    tagged = None
    for name, df in splits.items():  # one tokenization pass over all splits
        part = df.select(key, "instruction", "input", "output", F.lit(name).alias("_split"))
        tagged = part if tagged is None else tagged.unionByName(part)
    rows = token_rows(tagged, template, vocab, key, max_len, make_tokenizer, make_embedder, embed_col)
    return {name: rows.where(F.col("_split") == name).drop("_split") for name in splits}


def training_batches(rows: DataFrame, size: int, key: str = "raw_id", seed: int = 42, pad_id: int = 0, side: str = "right",
                     multiple_of: int | None = None) -> DataFrame:
    """Token rows as padded batches (P8, T6-T8): ``batch_id`` in shuffled order, ids and labels
    padded to the longest of the batch, ``attention_mask``. Windows of one record (``chunk_no``)
    are rows of their own. The rows are a written table, as their keys are read several times."""
    rows = materialized(rows, "token-rows")
    parts = [F.col(key).cast("string")] + ([F.col("chunk_no").cast("string")] if "chunk_no" in rows.columns else [])
    placed = P.assign_batches(rows.withColumn("_row", F.concat_ws(":", *parts)), size, "_row", seed).drop("pos", "_row")
    padded = T.pad_batch(placed, "batch_id", "input_ids", "labels", pad_id, side, multiple_of)
    return padded.withColumn("attention_mask", T.attention_mask("input_ids", pad_id))
