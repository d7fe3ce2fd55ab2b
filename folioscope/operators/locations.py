"""Where a chapter, chunk or reader is inside a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope import config
from folioscope.functions.location import locations_of_length, percentage_of
from folioscope.functions.text import window_at_location
from folioscope.operators.skew import lookup_join, segmented_extremes, segmented_lag, segmented_running_sums

SEGMENT_IDS = 4096   # ids per window segment
NOWHERE = -(1 << 62)  # stands for a missing location, before every chapter


def id_segment(column: str) -> Column:
    return F.floor(F.col(column) / SEGMENT_IDS)


def locate_chapters(chapters: DataFrame, sort_id: str, length: Column, book: str = "book_id") -> DataFrame:
    """Number the chapters of each book and give them contiguous locations.

    ``sort_id`` is a unique number giving the chapter order. Adds ``order``,
    ``n_locations``, ``start_location`` and ``end_location`` (1-based, inclusive).
    """
    sized = chapters.withColumn("n_locations", locations_of_length(length))
    placed = segmented_running_sums(
        sized, [book], [sort_id], id_segment(sort_id),
        {"_rank": F.lit(1).cast("long"), "_used": F.col("n_locations").cast("long")},
    )
    return placed.withColumns(
        {
            "order": (F.col("_rank") + 1).cast("int"),
            "start_location": (F.col("_used") + 1).cast("int"),
            "end_location": (F.col("_used") + F.col("n_locations")).cast("int"),
        }
    ).drop("_rank", "_used")


def book_totals(chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """Chapters, locations and characters per book."""
    return chapters.groupBy(book).agg(
        F.count(F.lit(1)).cast("int").alias("total_chapters"),
        F.sum("n_locations").cast("int").alias("total_locations"),
        F.sum("n_chars").alias("content_length"),
    )


_CHAPTER = ["chapter_id", "order", "title", "start_location", "end_location"]


def _cover(spots: DataFrame, chapters: DataFrame) -> DataFrame:
    """``spots`` (book_id, _at: distinct) with ``_found``, the chapter they get.

    An as-of join: spots, starts and ends lie on one line per book, cut into segments of locations. As chapters start in
    their order, the first by order that ends at or after a spot contains it or none does; the last by order to start
    by then precedes it. No chapter is repeated, whatever its length.
    """
    own = F.struct("order", *(c for c in _CHAPTER if c != "order"))
    none = F.lit(None).cast(chapters.select(own.alias("c")).schema["c"].dataType)
    mark = lambda at, kind, start, end: ["book_id", F.col(at).cast("long").alias("_at"), F.lit(kind).alias("_kind"), start.alias("_start"), end.alias("_end")]
    line = (
        chapters.select(*mark("start_location", 0, own, none))
        .unionByName(spots.select(*mark("_at", 1, none, none)))
        .unionByName(chapters.select(*mark("end_location", 2, none, own)))
    )
    seen = segmented_extremes(
        line, ["book_id"], ["_at", "_kind"], id_segment("_at"), {"_before": F.col("_start")}, {"_next": F.col("_end"), "_later": F.col("_start")}
    )
    held = F.when(F.col("_next.start_location") <= F.col("_at"), F.col("_next"))
    return seen.filter(F.col("_kind") == 1).select("book_id", "_at", F.coalesce(held, "_before", "_later").alias("_found"))


def chapter_at(points: DataFrame, chapters: DataFrame, point_ids: list[str], location: str = "location") -> DataFrame:
    """Chapter of each (book, location) point, never missing while a book has one.

    The containing chapter wins (the first by order, if several do); otherwise the latest one starting before the location;
    otherwise the first by order. Chapters start in their order. Points of one place share its look-up (``_cover``), and a
    point without location gets the first chapter.
    """
    placed = points.withColumn("_at", F.coalesce(F.col(location).cast("long"), F.lit(NOWHERE)))
    found = lookup_join(placed, _cover(placed.select("book_id", "_at").distinct(), chapters), ["book_id", "_at"], "left")
    return (
        found.withColumns({name: F.col(f"_found.{name}") for name in _CHAPTER})
        .withColumns(
            {
                "location_in_chapter": F.col(location) - F.col("start_location"),
                "chapter_locations": F.col("end_location") - F.col("start_location") + 1,
                "match": F.when(F.col("chapter_id").isNull(), F.lit(None).cast("string"))
                .when(F.col(location).between(F.col("start_location"), F.col("end_location")), "containing")
                .when(F.col("start_location") <= F.col(location), "preceding")
                .otherwise("first"),
            }
        )
        .select(*points.columns, *_CHAPTER, "location_in_chapter", "chapter_locations", "match")
    )


def chapter_neighbours(chapters: DataFrame) -> DataFrame:
    """Previous and next chapter ids in reading order."""
    rows = chapters.select("book_id", "chapter_id", "order")
    back = segmented_lag(rows, ["book_id"], ["order"], id_segment("order"), ["chapter_id"], "_p")
    both = segmented_lag(back, ["book_id"], ["order"], id_segment("order"), ["chapter_id"], "_n", lead=True)
    return both.select(
        "book_id", "chapter_id", "order",
        F.col("_p.chapter_id").alias("prev_chapter_id"), F.col("_n.chapter_id").alias("next_chapter_id"),
    )


def chunk_location(mode: str) -> Column:
    """Location of a chunk from its row (see ``chunk_table``).

    ``offset``: start of the chapter plus whole locations before the chunk.
    ``batch_interpolated``: spread evenly over the chapter within each batch of
    ``EMBED_BATCH`` chunks.
    """
    start, end = F.col("start_location"), F.col("end_location")
    if mode == "offset":
        raw = start + F.floor(F.col("char_pos") / config.LOCATION_CHARS)
    elif mode == "batch_interpolated":
        at = (F.col("chunk_no") - 1) % config.EMBED_BATCH
        batch = F.floor((F.col("chunk_no") - 1) / config.EMBED_BATCH)
        size = F.least(F.lit(config.EMBED_BATCH), F.col("n_chunks") - batch * config.EMBED_BATCH)
        raw = F.floor(start + (end - start) / (size + 1) * (at + 1))
    else:
        raise ValueError(f"unknown location mode {mode!r}")
    return F.greatest(start, F.least(end, raw)).cast("int")


def text_at(points: DataFrame, chapters: DataFrame, texts: DataFrame, point_ids: list[str], context: int = 100) -> DataFrame:
    """Text around each point, cut from the chapter that contains it.

    Each distinct (chapter, location) fetches its window once, so the readers of a
    popular chapter share it and no text is repeated per reader.
    """
    located = chapter_at(points, chapters, point_ids)
    spots = located.select("chapter_id", "location", "start_location").distinct()
    inside = F.col("location") - F.col("start_location") + 1
    windows = spots.join(texts.select("chapter_id", "text"), "chapter_id").select(
        "chapter_id", "location", window_at_location(F.col("text"), inside, context).alias("window")
    )
    return lookup_join(located, windows, ["chapter_id", "location"], "left")


def with_percentage(df: DataFrame, totals: DataFrame, ids: list[str], location: str = "location") -> DataFrame:
    joined = lookup_join(df, totals.select("book_id", "total_locations"), ["book_id"], "left")
    total = F.coalesce(F.col("total_locations"), F.lit(config.DEFAULT_TOTAL_LOCATIONS))
    return joined.withColumn("completion_percentage", percentage_of(F.col(location), total)).drop("total_locations")
