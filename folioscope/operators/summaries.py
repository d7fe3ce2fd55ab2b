"""Summary segments: stretches of a book at least ``interval`` locations long.

A segment is closed by the first chunk whose location is ``interval`` or more past
the location that closed the previous one. Each close depends on the one before,
through the whole book, yet only through a small number: how far into the next
block of locations the threshold reaches. Blocks are therefore summarised as tables
from entry state to exit state, the tables are chained in two levels, and every
block then emits on its own. No task ever holds a whole book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope import config
from folioscope.functions.text import is_blank
from folioscope.operators.skew import lookup_join, segmented_lag

BLOCK = 1024   # locations per block
FAN = 1024     # blocks per super-block


def _next_threshold(threshold: Column, location: Column, interval: int) -> Column:
    return F.when(location >= threshold, location + interval).otherwise(threshold)


def _walk(members: Column, entry: Column, parent: Column) -> Column:
    """Run the members' tables from ``entry``; collects the entry of each.

    A missing member spans more than any threshold, so the state after it is 0.
    """
    kind = "struct<state:int,prev:bigint,seen:array<struct<part:bigint,entry:int>>>"
    begin = F.struct(
        entry.cast("int").alias("state"), (parent * FAN - 1).cast("bigint").alias("prev"),
        F.array().cast("array<struct<part:bigint,entry:int>>").alias("seen"),
    ).cast(kind)

    def step(acc: Column, m: Column) -> Column:
        arrived = F.when(m["part"] == acc["prev"] + 1, acc["state"]).otherwise(F.lit(0))
        return F.struct(
            F.get(m["exits"], arrived).alias("state"), m["part"].alias("prev"),
            F.concat(acc["seen"], F.array(F.struct(m["part"].alias("part"), arrived.alias("entry")))).alias("seen"),
        ).cast(kind)

    return F.aggregate(members, begin, step)


def _group(parts: DataFrame, interval: int) -> DataFrame:
    """Up to FAN consecutive parts as one part with a composed table."""
    grouped = parts.groupBy("book_id", F.floor(F.col("part") / FAN).alias("parent")).agg(
        F.sort_array(F.collect_list(F.struct("part", "exits"))).alias("members")
    )
    ends = F.transform(
        F.sequence(F.lit(0), F.lit(interval)),
        lambda e: F.transform(
            F.array(_walk(F.col("members"), e, F.col("parent"))),
            lambda w: F.when(w["prev"] == (F.col("parent") + 1) * FAN - 1, w["state"]).otherwise(F.lit(0)),
        )[0],
    )
    return grouped.withColumn("exits", ends)


def _entries(parents: DataFrame) -> DataFrame:
    """(book, part, entry) of every member, from parents with known entries."""
    walked = _walk(F.col("members"), F.col("entry"), F.col("parent"))["seen"]
    return parents.select("book_id", F.explode(walked).alias("_s")).select("book_id", "_s.part", "_s.entry")


def closing_locations(locations: DataFrame, interval: int = config.SUMMARY_INTERVAL) -> DataFrame:
    """Locations (per book) at which a segment closes, given those with a chunk."""
    spots = locations.select("book_id", F.col("location").cast("int")).distinct()
    blocks = spots.groupBy("book_id", F.floor(F.col("location") / BLOCK).alias("part")).agg(
        F.sort_array(F.collect_list((F.col("location") % BLOCK).cast("int"))).alias("present")
    )
    exits = F.transform(
        F.sequence(F.lit(0), F.lit(interval)),
        lambda e: F.aggregate(
            "present", e, lambda t, x: _next_threshold(t, x, interval), lambda t: F.greatest(t - BLOCK, F.lit(0))
        ),
    )
    blocks = blocks.withColumn("exits", exits)
    supers = _group(blocks, interval)
    tops = _group(supers.select("book_id", F.col("parent").alias("part"), "exits"), interval)
    # the top level has a handful of rows per book; chain them along the book
    chained = tops.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct(F.col("parent").alias("part"), "exits"))).alias("_all"))
    first = _walk(F.col("_all"), F.lit(interval), F.lit(0))["seen"]
    top_entries = chained.select("book_id", F.explode(first).alias("_s")).select("book_id", F.col("_s.part").alias("parent"), "_s.entry")
    super_entries = _entries(tops.join(top_entries, ["book_id", "parent"])).withColumnRenamed("part", "parent")
    block_entries = _entries(supers.join(super_entries, ["book_id", "parent"]))
    kind = "struct<t:int,out:array<int>>"
    closes = F.aggregate(
        "present",
        F.struct(F.col("entry").alias("t"), F.array().cast("array<int>").alias("out")).cast(kind),
        lambda acc, x: F.when(
            x >= acc["t"], F.struct((x + interval).alias("t"), F.concat(acc["out"], F.array(x)).alias("out")).cast(kind)
        ).otherwise(acc),
        lambda acc: acc["out"],
    )
    closed = blocks.join(block_entries, ["book_id", "part"]).select("book_id", "part", F.explode(closes).alias("_x"))
    return closed.select("book_id", (F.col("_x") + F.col("part") * BLOCK).cast("int").alias("location"))


def summary_segments(
    chunks: DataFrame, interval: int = config.SUMMARY_INTERVAL, emit_tail: bool = True
) -> DataFrame:
    """One row per segment with its closing location and joined chunk text.

    Chunks after the last close of a book are its last segment, ``segment_no`` 1, at
    their own last location; all others have 0. Without ``emit_tail`` they are left out.
    """
    closes = closing_locations(chunks, interval)
    spans = segmented_lag(closes, ["book_id"], ["location"], F.floor(F.col("location") / BLOCK), ["location"], "_prev")
    # axis of half locations: the first chunk of a location may close a segment,
    # its later chunks belong to the next one
    slots = spans.select(
        "book_id", F.col("location").alias("segment_end"),
        F.explode(F.sequence(F.coalesce(F.col("_prev.location"), F.lit(0)) * 2 + 1, F.col("location") * 2)).alias("_slot"),
    )
    halves = slots.groupBy("book_id", F.floor(F.col("_slot") / 2).cast("int").alias("location")).agg(
        F.max(F.when(F.col("_slot") % 2 == 0, F.col("segment_end"))).alias("_first_end"),
        F.max(F.when(F.col("_slot") % 2 == 1, F.col("segment_end"))).alias("_rest_end"),
    )
    # found without the texts, which then move twice only: to their place and to their segment
    number = F.struct("chapter_order", "chunk_no", F.xxhash64("chunk"))
    firsts = chunks.groupBy("book_id", "location").agg(F.min(number).alias("_first"))
    places = firsts.join(halves, ["book_id", "location"], "left")
    joined = lookup_join(chunks, places, ["book_id", "location"]).withColumn(
        "segment_end", F.when(number == F.col("_first"), F.col("_first_end")).otherwise(F.col("_rest_end"))
    )
    if not emit_tail:
        joined = joined.filter(F.col("segment_end").isNotNull())
    grouped = joined.groupBy("book_id", "segment_end").agg(
        F.sort_array(F.collect_list(F.struct("chapter_order", "chunk_no", "chunk", "chapter_title"))).alias("_c"),
        F.max("location").alias("_last"), F.count(F.lit(1)).alias("n_chunks"),
    )
    text = F.concat(F.array_join(F.transform("_c", lambda c: c["chunk"]), " "), F.lit(" "))
    return grouped.select(
        "book_id", F.coalesce("segment_end", "_last").alias("location"), F.col("segment_end").isNull().cast("int").alias("segment_no"), "n_chunks",
        F.element_at("_c", -1)["chapter_title"].alias("chapter_title"), text.alias("text"),
    ).filter(~is_blank(F.col("text")))


def summary_id(book: Column, location: Column) -> Column:
    """Stable id, so a re-run overwrites its own rows."""
    return F.sha2(F.concat_ws("_sum_", book, location.cast("string")), 256)
