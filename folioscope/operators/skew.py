"""Building blocks that keep one hot key from landing in one task.

A book, reader or model may own a third of all rows, so nothing here sorts or
collects a whole group:

* ``segmented_*`` window helpers cut every group into order-preserving segments,
  summarise the segments, and only run windows inside one segment or over the
  short list of segment summaries;
* ``lookup_join`` joins a large table with a one-row-per-key table, null keys
  included, and leaves hot keys to Spark's adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, Window as W

_SEG = "_seg"


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the key columns, those of ``left``, come first."""
    names = {k: f"_r_{k}" for k in on}
    renamed = right.withColumnsRenamed(names)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()])
    joined = left.join(renamed, same, how)
    return joined.select(*on, *[c for c in joined.columns if c not in on and c not in names.values()])


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``big`` with ``small`` (few rows per key); null keys meet null keys.

    Spark broadcasts a ``small`` within the session's limit. Otherwise both sides are shuffled once, and adaptive
    execution splits the partitions of hot keys by their real size, repeating only the rows of ``small`` they meet.
    """
    return null_safe_join(big, small, list(on), how)


def segmented_running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    sums: dict[str, Column],
) -> DataFrame:
    """Running sums over the preceding rows of the group (exclusive).

    ``sums`` maps each output name to its addend. ``segment`` must never decrease
    along ``order``. Sums per segment are built with map-side aggregation, so only
    segment totals meet per group.
    """
    keys, outs = list(keys), list(sums)
    rows = df.withColumns({_SEG: segment, **{f"_v_{o}": v for o, v in sums.items()}})
    totals = rows.groupBy(*keys, _SEG).agg(*[F.sum(f"_v_{o}").alias(f"_t_{o}") for o in outs])
    before = W.partitionBy(*keys).orderBy(_SEG).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, _SEG, *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in outs]
    )
    inside = W.partitionBy(*keys, _SEG).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"_w_{o}": F.coalesce(F.sum(f"_v_{o}").over(inside), F.lit(0)) for o in outs})
    joined = null_safe_join(rows, offsets, keys + [_SEG])
    return joined.withColumns({o: F.col(f"_b_{o}") + F.col(f"_w_{o}") for o in outs}).drop(
        _SEG, *[f"{p}{o}" for o in outs for p in ("_v_", "_b_", "_w_")]
    )


def segmented_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, out: str
) -> DataFrame:
    """``row_number()`` per group, computed segment by segment."""
    numbered = segmented_running_sums(df, keys, order, segment, {out: F.lit(1).cast("long")})
    return numbered.withColumn(out, F.col(out) + 1)


def segmented_lag(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    values: Sequence[str],
    out: str,
    lead: bool = False,
) -> DataFrame:
    """Struct of ``values`` from the previous (or next) row of the group.

    The row is found inside the segment, or is the last (first) row of the
    nearest non-empty segment before (after) it.
    """
    keys, order, values = list(keys), list(order), list(values)
    rows = df.withColumn(_SEG, segment)
    payload = F.struct(*values)
    position = F.struct(*order)
    edge = (F.min_by if lead else F.max_by)(payload, position)
    edges = rows.groupBy(*keys, _SEG).agg(edge.alias("_edge"))
    along = W.partitionBy(*keys).orderBy(_SEG)
    shift = F.lead if lead else F.lag
    edges = edges.select(*keys, _SEG, shift("_edge").over(along).alias("_beyond"))
    inside = W.partitionBy(*keys, _SEG).orderBy(*order)
    rows = rows.withColumn("_near", shift(payload).over(inside))
    return (
        null_safe_join(rows, edges, keys + [_SEG])
        .withColumn(out, F.coalesce("_near", "_beyond"))
        .drop(_SEG, "_near", "_beyond")
    )


def segmented_extremes(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, so_far: dict[str, Column], to_come: dict[str, Column]
) -> DataFrame:
    """Largest values of the rows at or before each row of the group, smallest ones of the rows at or after it.

    Both are carried inside the segment and chained from the segments before and after it.
    """
    keys, outs = list(keys), [*so_far, *to_come]
    rows = df.withColumns({_SEG: segment, **{f"_v_{o}": v for o, v in {**so_far, **to_come}.items()}})
    turned = lambda o, columns: [F.col(c).asc() if o in so_far else F.col(c).desc() for c in columns]
    pick = lambda o: F.max if o in so_far else F.min
    edges = rows.groupBy(*keys, _SEG).agg(*[pick(o)(f"_v_{o}").alias(f"_e_{o}") for o in outs])
    along = {o: W.partitionBy(*keys).orderBy(*turned(o, [_SEG])).rowsBetween(W.unboundedPreceding, -1) for o in outs}
    edges = edges.select(*keys, _SEG, *[pick(o)(f"_e_{o}").over(along[o]).alias(f"_b_{o}") for o in outs])
    inside = {o: W.partitionBy(*keys, _SEG).orderBy(*turned(o, order)).rowsBetween(W.unboundedPreceding, 0) for o in outs}
    rows = rows.withColumns({f"_w_{o}": pick(o)(f"_v_{o}").over(inside[o]) for o in outs})
    joined = null_safe_join(rows, edges, keys + [_SEG])
    ends = {o: (F.greatest if o in so_far else F.least)(f"_w_{o}", f"_b_{o}") for o in outs}
    return joined.withColumns(ends).drop(_SEG, *[f"{p}{o}" for o in outs for p in ("_v_", "_w_", "_b_")])
