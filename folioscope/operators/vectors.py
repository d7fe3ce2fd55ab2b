"""Cosine search over vectors of the same book, gated by reading position."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions.scoring import norm
from folioscope.operators.tiles import tiled_topk, top_of

_ROWS_AT_ONCE = 256


def metadata_filter(conditions: dict[str, object]) -> Column:
    """All ``key == value`` conditions at once; no condition keeps every row."""
    out = F.lit(True)
    for name, value in conditions.items():
        out = out & (F.col(name) == F.lit(value))
    return out


def _cosine_kernel(probes: pd.DataFrame, items: pd.DataFrame):
    matrix = np.stack(items["vector"].to_numpy()).astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    location = items["location"].to_numpy()
    kinds = items["content_type"].to_numpy()
    own = items["item_key"].to_numpy()
    for at in range(0, len(probes), _ROWS_AT_ONCE):
        part = probes.iloc[at : at + _ROWS_AT_ONCE]
        asked = np.stack(part["vector"].to_numpy()).astype(np.float64)
        asked_length = np.sqrt(np.einsum("ij,ij->i", asked, asked))
        scale = np.outer(asked_length, length)
        cosines = np.divide(asked @ matrix.T, scale, out=np.full(scale.shape, -2.0), where=scale > 0)
        details = zip(part["boundary"], part["threshold"], part["kind"], part["exclude_key"], part["k"])
        for i, (boundary, threshold, kind, exclude, k) in enumerate(details):
            allowed = (location <= boundary) & (np.round(cosines[i], 9) >= threshold)
            if kind is not None:
                allowed &= kinds == kind
            if exclude is not None:
                allowed &= own != exclude
            hits, values = top_of(cosines[i], allowed, int(k))
            yield at + i, hits, values


def similar_vectors(
    probes: DataFrame,
    vectors: DataFrame,
    probe_ids: Sequence[str],
    item_ids: Sequence[str],
    payload: Sequence[str] = (),
    limit: int | Column = 15,
    threshold: float | Column = 0.6,
    content_type: str | Column | None = None,
    exclude_key: Column | None = None,
    conditions: dict[str, object] | None = None,
    max_limit: int | None = None,
    **blocks,
) -> DataFrame:
    """Exact top-``limit`` vectors per probe with cosine at least ``threshold``.

    Same book, location not past the probe's boundary, optionally one content type
    and further equality conditions on the vectors. Limits, thresholds and content
    types may differ by probe, so several searches share one pass over the vectors;
    ``max_limit`` then names the largest limit.
    """
    if max_limit is None:
        if isinstance(limit, Column):
            raise ValueError("limits that differ by probe need max_limit")
        max_limit = limit
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    asked = probes.select(
        *probe_ids, "book_id", F.col("boundary").cast("int").alias("boundary"), "vector",
        as_col(limit).cast("int").alias("k"), as_col(threshold).cast("double").alias("threshold"),
        as_col(content_type).cast("string").alias("kind"),
        (exclude_key if exclude_key is not None else F.lit(None)).cast("string").alias("exclude_key"),
    )
    if conditions:
        vectors = vectors.filter(metadata_filter(conditions))
    offered = vectors.select(
        *dict.fromkeys([*item_ids, *payload, "book_id", "location", "content_type", "vector"]),
        F.concat_ws("|", *[F.col(c).cast("string") for c in item_ids]).alias("item_key"),
    )
    return tiled_topk(asked, offered, _cosine_kernel, probe_ids, item_ids, max_limit, payload, **blocks)


def normalised(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """Unit-length vectors, to store once and compare by dot product."""
    length = norm(F.col(column))
    return vectors.withColumn("_n", length).withColumn(
        column, F.transform(column, lambda x: (x / F.col("_n")).cast("float"))
    ).drop("_n")
