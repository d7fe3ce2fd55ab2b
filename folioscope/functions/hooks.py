"""Places where a user plugs a model in.

Models are Python callables over batches of strings; Spark feeds them Arrow
batches. Prompts are built and replies parsed by columns, so a table of
pre-computed replies can stand in for a generator.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope import config
from folioscope.functions.text import chunk_pieces, tokens

EmbedFn = Callable[[list[str]], Sequence[Sequence[float]]]
GenerateFn = Callable[[list[str]], Sequence[str]]

#: Tokens that a worker counts at once, beyond those of one text.
TOKENS_AT_ONCE = 500_000


def with_embedding(
    df: DataFrame, text: str, out: str, embed: EmbedFn | None = None, dim: int = 64, batch: int = config.EMBED_BATCH
) -> DataFrame:
    """Add ``array<float>`` vectors of a text column.

    Without a model, token counts hashed into ``dim`` buckets are used.
    """
    if embed is None:
        return df.withColumn(out, hashed_embedding(tokens(F.col(text)), dim))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            vectors: list[Sequence[float]] = []
            for at in range(0, len(series), batch):
                vectors.extend(embed(series.iloc[at : at + batch].tolist()))
            yield pd.Series(vectors)

    return df.withColumn(out, run(F.col(text)))


def hashed_embedding(token_column: Column, dim: int = 64) -> Column:
    """Token counts per bucket; the bucket is md5(token) modulo ``dim``."""

    @F.arrow_udf("array<float>")
    def run(lists: pa.Array) -> pa.Array:
        rows = [np.zeros((0, dim), np.float32)]
        for part, owner, codes, distinct in coded_tokens(lists):
            # each distinct token of the stretch is hashed once
            bucket = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:3]) % dim for t in distinct.to_pylist()], np.int64)
            counts = np.bincount(owner * dim + bucket[codes], minlength=len(part) * dim)
            rows.append(counts.reshape(len(part), dim).astype(np.float32))
        flat = np.concatenate(rows).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), pa.array(flat))

    return run(token_column)


def coded_tokens(lists: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """Stretches of rows of about ``TOKENS_AT_ONCE`` tokens: (their lists, row of each token in the stretch, its number, the
    different tokens by number). A null list has no tokens."""
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    stretch = np.cumsum(sizes) // TOKENS_AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), len(lists)]
    for first, last in zip(edges, edges[1:]):
        part = lists.slice(first, last - first)
        words = part.flatten().cast(pa.string()).dictionary_encode()
        yield part, np.repeat(np.arange(last - first), sizes[first:last]), words.indices.to_numpy().astype(np.int64), words.dictionary


def with_reply(df: DataFrame, prompt: str, out: str, generate: GenerateFn, batch: int = config.EMBED_BATCH) -> DataFrame:
    """Add a model's reply to a prompt column."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            replies: list[str] = []
            for at in range(0, len(series), batch):
                replies.extend(generate(series.iloc[at : at + batch].tolist()))
            yield pd.Series(replies)

    return df.withColumn(out, run(F.col(prompt)))


def join_replies(df: DataFrame, replies: DataFrame, on: Sequence[str], stage: str, out: str) -> DataFrame:
    """Attach pre-computed replies of one stage; missing ones stay null."""
    chosen = replies.filter(F.col("stage") == stage).select(*on, F.col("reply").alias(out))
    return df.join(chosen, list(on), "left")


def register_chunk_udtf(spark: SparkSession, name: str = "chunk_text") -> None:
    """SQL table function ``chunk_text(text, size, overlap, min_chars)``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_no: int, char_pos: int, chunk: string")
    class ChunkText:
        def eval(self, text: str, size: int, overlap: int, min_chars: int):
            for number, (at, piece) in enumerate(chunk_pieces(text, size, overlap, min_chars=min_chars), 1):
                yield number, at, piece

    spark.udtf.register(name, ChunkText)
