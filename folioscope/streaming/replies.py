"""Replies that arrive as lines of JSON, each with a piece of the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def reply_pieces(lines: DataFrame) -> DataFrame:
    """Text of each line's ``response`` field; unreadable lines are dropped."""
    piece = F.get_json_object("line", "$.response")
    return lines.withColumn("piece", piece).filter(F.col("piece").isNotNull()).drop("line")


def joined_replies(lines: DataFrame, key: list[str], order: str, per_block: int | None = None) -> DataFrame:
    """Reply per key: its pieces in arrival order.

    One row (block 0) per key, whatever its order values. With ``per_block`` (batch only) the
    pieces are numbered within the key and given out in blocks of so many.
    """
    rows = reply_pieces(lines).withColumn("block", F.lit(0))
    if per_block is not None:
        number = F.row_number().over(W.partitionBy(*key).orderBy(order)) - 1
        rows = rows.withColumn("block", F.floor(number / per_block).cast("int"))
    pieces = rows.groupBy(*key, "block").agg(F.sort_array(F.collect_list(F.struct(order, "piece"))).alias("_p"))
    return pieces.select(
        *key, "block", F.array_join(F.transform("_p", lambda p: p["piece"]), "").alias("reply"), F.size("_p").alias("n_pieces")
    )
