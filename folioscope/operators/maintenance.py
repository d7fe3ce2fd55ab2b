"""Keyed table upkeep: upserts, cascades, resumption, patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def upsert(base: DataFrame, incoming: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Newest row per key; incoming rows need a higher version to replace.

    A max-by aggregation, so repeated versions of one key shrink before the shuffle.
    """
    rows = base.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r"))
    return newest.select(*key, "_r.*")


def content_id(*columns: str):
    """Stable id of a row from its natural key."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)


def delete_books(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of deleted books."""
    gone = deleted.select("book_id").distinct()
    return {name: table.join(gone, "book_id", "left_anti") for name, table in tables.items()}


def not_yet_in(arriving: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Arriving rows whose key has no existing row."""
    return arriving.join(existing.select(*key).distinct(), list(key), "left_anti")


def present_in(rows: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(existing.select(*key).distinct(), list(key), "left_semi")


def unfinished(grid: DataFrame, results: DataFrame) -> DataFrame:
    """(model, query) pairs without a result, for resuming a run."""
    return not_yet_in(grid, results, ["model", "query_id"])


def merge_patch(base: DataFrame, patch: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Non-null patch fields win over the base, the base over the defaults."""
    fields = list(defaults)
    renamed = patch.select(key, *[F.col(f).alias(f"_p_{f}") for f in fields if f in patch.columns])
    joined = base.join(renamed, key, "full")
    pick = lambda f: ([F.col(f"_p_{f}")] if f in patch.columns else []) + [F.col(f), F.lit(defaults[f])]
    return joined.select(key, *[F.coalesce(*pick(f)).alias(f) for f in fields])


def reset_to_defaults(base: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    return base.select(key, *[F.lit(v).alias(f) for f, v in defaults.items()])


def match_titles(wanted: DataFrame, books: DataFrame) -> DataFrame:
    """Wanted titles (with or without .txt) to book ids; the last of equals wins.

    ``wanted``: title; ``books``: book_id, title, added_no.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\.txt", "")))
    known = books.groupBy(F.lower(F.trim("title")).alias("_t")).agg(F.max_by("book_id", "added_no").alias("book_id"))
    return wanted.withColumn("_t", norm(F.col("title"))).join(known, "_t").drop("_t")
