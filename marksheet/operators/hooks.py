"""Caller-supplied models (U1, U2, U4): the only places Python runs per batch.

Each hook is an Arrow-batched ``pandas_udf`` (iterator form, so a model or tokenizer is built
once per task, not once per batch) or a ``mapInPandas``. Nothing here ships a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A batched map function over columns that replaces the schema."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def tokenize_with(col: str | Column, make_tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Column:
    """U1 tokenizer hook: ``make_tokenizer()`` returns ``texts -> id lists``; built once per task."""
    @F.pandas_udf("array<int>")
    def _tok(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = make_tokenizer()
        for s in batches:
            yield pd.Series(tok(s.fillna("").tolist()))
    return _tok(F.col(col) if isinstance(col, str) else col)


def embed_with(col: str | Column, make_embedder: Callable[[], Callable[[list[str]], list[list[float]]]],
               batch_size: int = 128) -> Column:
    """``make_embedder()`` returns ``texts -> vectors``; called in sub-batches of ``batch_size``."""
    @F.pandas_udf("array<double>")
    def _emb(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        emb = make_embedder()
        for s in batches:
            texts = s.fillna("").tolist()
            out: list = []
            for i in range(0, len(texts), batch_size):
                out.extend(np.asarray(emb(texts[i:i + batch_size]), dtype="float64"))
            yield pd.Series(out)
    return _emb(F.col(col) if isinstance(col, str) else col)


def generate_with(df: DataFrame, make_generator: Callable[[], Callable[[list[str]], list[str]]], prompt_col: str = "prompt_text",
                  out_col: str = "decoded_prediction") -> DataFrame:
    """U4: records in, generated text out (``make_generator`` builds the model once per task)."""
    schema = StructType(list(df.schema.fields) + [StructField(out_col, StringType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = make_generator()
        for pdf in it:
            pdf[out_col] = gen(pdf[prompt_col].fillna("").tolist())
            yield pdf
    return df.mapInPandas(run, schema)
