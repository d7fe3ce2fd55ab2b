"""Exact top-k search by tiled matrix products.

Queries and candidates are dealt into tiles by a hash of their id; every pair of a query tile and a candidate shard is
one bounded task group, in which one matrix product scores all pairs and a partial selection keeps the best k per query.
The lists of the shards are merged as a tree, ``FAN`` lists at a time, so no query ever gathers more than ``FAN * k``
rows. Both tiles hold at most about ``TILE`` vectors: the volume moved is rows times tiles of the other side.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part; vectors of different lengths
are never compared; every row is a candidate of every other row, also of one with the same id, and is known by a number
given when it is read; ties go to the smaller id; fewer candidates than k give fewer rows; no queries or no candidates
give no rows; whole components beyond 64 bits become the nearest number that fits, and so do scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from folioscope.sources.storage import materialise

TILE = 8192
SMALLEST = 256
FAN = 32
SCALE = 256


def quantised(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, dim, v): components as floor(256 * x) of x as double; unusable vectors left out.

    ``row`` tells rows of one id apart. The table is stored, so that queries and candidates taken from it agree on it.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    rows = vectors.select("vec_id", "embedding").where(F.coalesce(usable, F.lit(False)))
    whole = rows.select("vec_id", F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v"))
    return materialise(whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dim"), "v"), "vectors")


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point while every sum stays below 2**53, in 64-bit integers while it fits; the
    rows that may go beyond are multiplied as Python numbers, and what does not fit becomes the nearest number that does."""
    size = [np.abs(m.astype(np.float64)).max(axis=1, initial=0) for m in (left, right)]
    dim = max(1, left.shape[1])
    if size[0].max(initial=0) * size[1].max(initial=0) * dim < 2**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    scores = left @ right.T
    large = (2**62 / dim) ** 0.5
    rows, columns = (np.flatnonzero(s > large) for s in size)
    if len(rows):
        scores[rows] = _clipped(left[rows], right)
    if len(columns):
        scores[:, columns] = _clipped(left, right[columns])
    return scores


def _clipped(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.clip(left.astype(object) @ right.astype(object).T, -(2**63 - 1), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query positions, candidate positions) of each query's k best by score, then smaller id; ``own`` is its row."""
    found, columns = [], []
    for q in range(len(scores)):
        line = scores[q]
        usable = np.flatnonzero(rows != own[q])
        if len(usable) > k:
            part = line[usable]
            edge = np.partition(part, len(part) - k)[len(part) - k]
            usable = usable[part >= edge]  # all ties of the k-th score, to be settled by id
        order = usable[np.lexsort((ids[usable], -line[usable]))][:k]
        found.append(np.full(len(order), q))
        columns.append(order)
    return np.concatenate(found or [np.empty(0, np.int64)]), np.concatenate(columns or [np.empty(0, np.int64)])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score) from queries and candidates that are rows of one ``quantised`` table."""
    spark = queries.sparkSession
    candidates = candidates.select(*[F.col(c).alias(c) for c in candidates.columns])  # columns of its own, though both are one table
    n_queries, n = queries.count(), candidates.count()
    tasks = 4 * spark.sparkContext.defaultParallelism
    tiles = max(1, -(-n_queries // tile))
    shards = max(-(-n // tile), min(-(-n // SMALLEST), -(-tasks // tiles)), 1)
    wanted = queries.select(
        F.col("vec_id").alias("query_id"), "row", "v", "dim", F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int").alias("tile"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    offered = candidates.select(
        "vec_id", "row", "v", "dim", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"),
    )

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": [], "list": []}).astype("int64")
        a, b = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        own, names, ids, rows = left["row"].to_numpy(), left["query_id"].to_numpy(), right["vec_id"].to_numpy(), right["row"].to_numpy()
        found = []
        for at in range(0, len(a), 512):
            table = products(a[at : at + 512], b)
            q, c = best(table, ids, rows, own[at : at + 512], k)
            found.append(pd.DataFrame({"query_row": own[at + q], "query_id": names[at + q], "vec_id": ids[c], "score": table[q, c], "list": int(key[1])}))
        return pd.concat(found)

    lists = (
        wanted.groupBy("tile", "shard", "dim").cogroup(offered.groupBy("tile", "shard", "dim"))
        .applyInPandas(score, "query_row long, query_id long, vec_id long, score long, list long")
    )
    count = shards
    while count > 1:
        lists = lists.withColumn("list", F.floor(F.col("list") / FAN).cast("long"))
        w = Window.partitionBy("query_row", "list").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
        count = -(-count // FAN)
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
), scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
