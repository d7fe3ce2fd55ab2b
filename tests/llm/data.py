"""Small tables that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, quality_score string, fp int, removed_lines string, probability string, component string, `key` int, n int"


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(pick.randint(2, 9))) for _ in range(words))


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``rows``: (doc_id, text); the other columns are filled, some with nulls."""
    full = [
        (i, t, None if k % 7 == 3 else "en", None if k % 5 == 4 else f"src{k % 3}", len(t or ""), "x", 1, "y", "z", "c", 3, 4) for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, DOCS)


def awkward(spark: SparkSession) -> DataFrame:
    long_text = "\n".join(prose(k, 12) for k in range(3000))
    shared = "\n".join(prose(90_000 + k, 9) for k in range(24))
    rows = [
        (1, prose(1, 80)), (2, prose(1, 80)), (2, prose(1, 80)), (3, None), (4, ""), (5, ""), (6, "  \n\t\n "), (None, prose(2, 30)), (None, None),
        (7, long_text), (8, shared + "\n" + prose(3, 20)), (9, prose(4, 20) + "\n" + shared), (10, "one"), (11, "é" * 5000), (12, "same word " * 400),
    ]
    return documents(spark, rows)


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)
