"""Top-k of many probes against many items of the same book.

Probes and items of a book are split into bounded blocks by a hash of their ids.
Every (probe block, item block) tile is scored by one vectorised kernel that hands
back only its best k per probe, so no probe-item pairs are ever emitted, a hot book
becomes many equal tiles, and the result is the exact top-k.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T, Window as W

from folioscope.operators.skew import lookup_join

PROBES_PER_BLOCK = 2048
ITEMS_PER_BLOCK = 8192

# kernel(probes, items) yields (probe row number, item row numbers, scores)
Kernel = Callable[[pd.DataFrame, pd.DataFrame], object]


def tiled_topk(
    probes: DataFrame,
    items: DataFrame,
    kernel: Kernel,
    probe_ids: Sequence[str],
    item_ids: Sequence[str],
    max_k: int,
    item_payload: Sequence[str] = (),
    probes_per_block: int = PROBES_PER_BLOCK,
    items_per_block: int = ITEMS_PER_BLOCK,
    layout_of: DataFrame | None = None,
) -> DataFrame:
    """Best ``k`` items per probe, numbered by ``rank_in_method``.

    ``probes`` has book_id, boundary, k (at most ``max_k``) and the ``probe_ids``; ``items`` has
    book_id, location and the ``item_ids``. Items past every boundary of their
    book are dropped before anything is shuffled to a tile. Ties are broken by the
    item ids in ascending order. ``layout_of`` may name a cheaper table with the
    probes' book_id and boundary to plan the blocks from.
    """
    probe_ids, item_ids, payload = list(probe_ids), list(item_ids), list(item_payload)
    reach = (probes if layout_of is None else layout_of).groupBy("book_id").agg(
        F.max("boundary").alias("_max_boundary"),
        F.ceil(F.count(F.lit(1)) / probes_per_block).cast("int").alias("_n_pb"),
    )
    open_items = lookup_join(items, reach, ["book_id"]).filter(F.col("location") <= F.col("_max_boundary"))
    sizes = open_items.groupBy("book_id").agg(F.ceil(F.count(F.lit(1)) / items_per_block).cast("int").alias("_n_ib"))
    block_of = lambda ids, n: F.pmod(F.xxhash64(*[F.col(c) for c in ids]), F.col(n)).cast("int")
    all_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    item_side = lookup_join(open_items, sizes, ["book_id"]).select(
        *items.columns, block_of(item_ids, "_n_ib").alias("_ib"), all_blocks("_n_pb").alias("_pb")
    )
    layout = reach.join(sizes, "book_id")
    probe_side = lookup_join(probes, layout, ["book_id"]).select(
        *probes.columns, block_of(probe_ids, "_n_pb").alias("_pb"), all_blocks("_n_ib").alias("_ib")
    )
    out_cols = probe_ids + item_ids + payload
    types = {f.name: f.dataType for f in list(items.schema) + list(probes.schema)}
    schema = T.StructType(
        [T.StructField(c, types[c]) for c in out_cols] + [T.StructField("k", T.IntegerType()), T.StructField("score", T.DoubleType())]
    )

    def score_tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        # ascending ids, so a stable sort by score breaks ties by id
        right = right.sort_values(item_ids, kind="stable").reset_index(drop=True)
        left = left.reset_index(drop=True)
        at_p, at_i, scores = [], [], []
        for row, hits, values in kernel(left, right):
            at_p.append(np.full(len(hits), row))
            at_i.append(hits)
            scores.append(values)
        if not at_p:
            return pd.DataFrame({f.name: [] for f in schema})
        at_p, at_i = np.concatenate(at_p), np.concatenate(at_i)
        best = pd.concat(
            [left.loc[at_p, probe_ids + ["k"]].reset_index(drop=True), right.loc[at_i, item_ids + payload].reset_index(drop=True)],
            axis=1,
        )
        best["score"] = np.concatenate(scores)
        return best[[f.name for f in schema]]

    tile = ["book_id", "_pb", "_ib"]
    # fresh column identities: probes and items may come from the same table
    probe_side, item_side = probe_side.toDF(*probe_side.columns), item_side.toDF(*item_side.columns)
    scored = probe_side.groupBy(*tile).cogroup(item_side.groupBy(*tile)).applyInPandas(score_tile, schema)
    best_first = W.partitionBy(*probe_ids).orderBy(F.round("score", 9).desc(), *item_ids)
    ranked = scored.withColumn("rank_in_method", F.row_number().over(best_first))
    # the fixed bound lets Spark cut before the shuffle, k then cuts each probe
    return ranked.filter((F.col("rank_in_method") <= max_k) & (F.col("rank_in_method") <= F.col("k"))).drop("k")


def top_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the best k allowed scores, earlier first on ties."""
    where = np.flatnonzero(allowed)
    if len(where) == 0:
        return where, scores[where]
    values = scores[where]
    keys = -np.round(values, 9)
    if len(where) > k:
        limit = np.partition(keys, k - 1)[k - 1]
        near = np.flatnonzero(keys <= limit)
        order = near[np.argsort(keys[near], kind="stable")][:k]
    else:
        order = np.argsort(keys, kind="stable")
    return where[order], values[order]
