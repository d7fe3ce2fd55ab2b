"""Okapi BM25 over the chunks of each book, from stored postings.

A posting is a term of a chunk with its count and the chunk's length; all a search needs of a chunk. They are counted once, in
the pass that cuts and embeds the chunks, and stored as a list with the chunk; statistics, term lookup and scores come from
these lists alone, without Python and without another look at texts or tokens. Questions meet them by block: the terms asked in a block are few enough to be broadcast, the
postings they match are shuffled once, by chunk, so that a chunk's score and each task's best k per question need no further
exchange, whatever book is hot.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope import config
from folioscope.functions.hooks import coded_tokens
from folioscope.functions.text import tokens
from folioscope.operators.skew import lookup_join, null_safe_join
from folioscope.sources.storage import materialise

CHUNK_KEY = ["chapter_order", "chunk_no"]
#: About as many (question, term) rows are broadcast at once.
ASKED_PER_BLOCK = 100_000


def chunk_terms(chunks: DataFrame, text: str = "chunk") -> DataFrame:
    """Keyword index rows: the tokens of each chunk and their number."""
    keep = [c for c in chunks.columns if c != text]
    return chunks.select(*keep, tokens(F.col(text)).alias("tokens")).withColumn("n_tokens", F.size("tokens"))


def book_statistics(index: DataFrame) -> DataFrame:
    """Number of chunks and mean chunk length per book."""
    return index.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), (F.sum("n_tokens") / F.count(F.lit(1))).alias("avg_tokens")
    )


def term_counts(words: Column) -> Column:
    """(term, tf) of each different token of a list, in one pass over batches of lists."""

    @F.arrow_udf("array<struct<term:string,tf:int>>")
    def run(lists: pa.Array) -> pa.Array:
        sizes, terms, counts = [np.zeros(1, np.int64)], [pa.array([], pa.string())], [np.zeros(0, np.int64)]
        for part, owner, codes, distinct in coded_tokens(lists):
            width = max(1, len(distinct))
            found, times = np.unique(owner * width + codes, return_counts=True)
            sizes.append(np.bincount(found // width, minlength=len(part)))
            terms.append(distinct.take(pa.array(found % width)))
            counts.append(times)
        pairs = pa.StructArray.from_arrays([pa.concat_arrays(terms), pa.array(np.concatenate(counts).astype(np.int32))], ["term", "tf"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pairs)

    return run(words)


def postings(index: DataFrame) -> DataFrame:
    """Inverted index: (book_id, term, chunk key, location, n_tokens, tf) of every term of every chunk.

    From the stored ``terms`` of each chunk, if it has them; otherwise counted within each chunk's row. Nothing is shuffled or sorted.
    """
    counted = F.col("terms") if "terms" in index.columns else term_counts(F.col("tokens"))
    rows = index.select("book_id", *CHUNK_KEY, "location", "n_tokens", F.explode(counted).alias("p"))
    return rows.select("book_id", "p.term", *CHUNK_KEY, "location", "n_tokens", "p.tf")


def document_frequency(lists: DataFrame) -> DataFrame:
    """Chunks containing each term, per book; from postings."""
    return lists.groupBy("book_id", "term").agg(F.count(F.lit(1)).alias("df"))


def _idf(n, df):
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def idf_floor(frequency: DataFrame, books: DataFrame, epsilon: float = config.BM25_EPSILON) -> DataFrame:
    """Book statistics with the floor for negative idf: epsilon times the mean idf.

    Terms are first counted per frequency, which leaves few rows per book.
    """
    shapes = frequency.groupBy("book_id", "df").agg(F.count(F.lit(1)).alias("_terms"))
    weighed = shapes.join(books, "book_id").withColumn("_idf", _idf(F.col("n_chunks"), F.col("df")))
    means = weighed.groupBy("book_id").agg((F.sum(F.col("_idf") * F.col("_terms")) / F.sum("_terms")).alias("mean_idf"))
    return books.join(means, "book_id").withColumn("idf_floor", F.col("mean_idf") * F.lit(epsilon))


def with_idf(frequency: DataFrame, books: DataFrame) -> DataFrame:
    """``idf`` of (book, term) rows; negative values are raised to the floor."""
    joined = lookup_join(frequency, books, ["book_id"])
    idf = _idf(F.col("n_chunks"), F.col("df"))
    return joined.withColumn("idf", F.when(idf < 0, F.col("idf_floor")).otherwise(idf))


def keyword_statistics(index: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book statistics, term statistics) of an index and its postings."""
    frequency = document_frequency(lists)
    books = idf_floor(frequency, book_statistics(index))
    return books, with_idf(frequency, books)


def question_terms(questions: DataFrame, books: DataFrame, frequency: DataFrame, text: str = "question") -> DataFrame:
    """(question_id, book_id, boundary, term, weight, avg_tokens): indexed terms of each question, repeats times idf.

    Only the distinct terms asked for are looked up in the term statistics.
    """
    asked = questions.select("question_id", "book_id", "boundary", F.explode(tokens(F.col(text))).alias("term"))
    repeats = asked.groupBy("question_id", "book_id", "boundary", "term").agg(F.count(F.lit(1)).alias("qtf"))
    needed = null_safe_join(frequency, repeats.select("book_id", "term").distinct(), ["book_id", "term"])
    weighed = with_idf(needed, books).select("book_id", "term", "idf", "avg_tokens")
    hits = lookup_join(repeats, weighed, ["book_id", "term"])
    return hits.select("question_id", "book_id", "boundary", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "avg_tokens")


def _of_terms(lists: DataFrame, asks: DataFrame) -> DataFrame:
    """Postings that ``asks`` (bounded by its block) names by book and term; null books meet null books."""
    named = F.broadcast(asks.withColumnsRenamed({"book_id": "_book", "term": "_term"}))
    same = (F.col("term") == F.col("_term")) & F.col("book_id").eqNullSafe(F.col("_book"))
    return lists.join(named, same).drop("_book", "_term")


def _best_of_block(asked: DataFrame, lists: DataFrame, limit: int, k1: float, b: float) -> DataFrame:
    """Best ``limit`` chunks per question of one block of ``question_terms``."""
    asks = asked.groupBy("book_id", "term").agg(
        F.max("boundary").alias("_reach"), F.first("avg_tokens").alias("avg_tokens"),
        F.collect_list(F.struct("question_id", "boundary", "weight")).alias("asks"),
    )
    matched = _of_terms(lists, asks.select("book_id", "term", "_reach")).filter(F.col("location") <= F.col("_reach")).drop("_reach")
    spread = matched.repartition("book_id", *CHUNK_KEY)
    relative = F.col("n_tokens") / F.col("avg_tokens")
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * relative))
    rows = _of_terms(spread, asks.drop("_reach")).select(
        "book_id", *CHUNK_KEY, "location", part.alias("part"), F.explode("asks").alias("a")
    )
    scored = (
        rows.filter(F.col("location") <= F.col("a.boundary"))
        .groupBy("book_id", *CHUNK_KEY, "location", F.col("a.question_id").alias("question_id"))
        .agg(F.sum(F.col("a.weight") * F.col("part")).alias("score")).filter(F.col("score") > 0)
    )
    best_first = W.partitionBy("question_id").orderBy(F.round("score", 9).desc(), *CHUNK_KEY)
    return scored.withColumn("rank_in_method", F.row_number().over(best_first)).filter(F.col("rank_in_method") <= limit)


def keyword_search(
    questions: DataFrame,
    index: DataFrame,
    limit: int = config.BM25_LIMIT,
    payload: tuple[str, ...] = ("location",),
    lists: DataFrame | None = None,
    frequency: DataFrame | None = None,
    books: DataFrame | None = None,
    k1: float = config.BM25_K1,
    b: float = config.BM25_B,
    scale: float = config.BM25_SCALE,
    asked_per_block: int = ASKED_PER_BLOCK,
) -> DataFrame:
    """Best chunks per question up to its boundary, scores scaled to ``scale``.

    Statistics cover the whole book, the boundary applies to the hits only. ``questions`` has question_id, book_id, boundary
    and question; ``lists`` are the postings of ``index``. Blocks hold whole questions, dealt by a hash of their id.
    """
    lists = postings(index) if lists is None else lists
    frequency = document_frequency(lists) if frequency is None else frequency
    books = idf_floor(frequency, book_statistics(index)) if books is None else books
    asked = materialise(question_terms(questions, books, frequency), "asked")
    blocks = max(1, -(-asked.count() // asked_per_block))
    part = lambda n: asked.filter(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == n) if blocks > 1 else asked
    best = reduce(DataFrame.unionAll, [_best_of_block(part(n), lists, limit, k1, b) for n in range(blocks)])
    rest = [c for c in payload if c not in ("book_id", "location")]
    if rest:  # fetched for the few hits only
        best = null_safe_join(best, index.select("book_id", *CHUNK_KEY, *rest), ["book_id", *CHUNK_KEY])
    top = F.max("score").over(W.partitionBy("question_id"))
    columns = dict.fromkeys(["question_id", *CHUNK_KEY, *payload, "score", "rank_in_method"])
    return best.select(*columns).withColumn("score", F.col("score") / top * F.lit(scale))
