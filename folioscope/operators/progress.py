"""Reading progress from update events.

An event carries ``reader_id, book_id, ts, event_id`` and any of ``location``,
``chapter_id``, ``completion_percentage``, or ``reset = true``; an event with none
of them only creates the row. Events of one reader and book apply in (ts, event_id)
order. The final state needs no replay: it follows from the last and first events
of a few kinds, so each pass is a partial aggregation and a hot reader costs no
more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.functions.location import clamp_location, percentage_of, truncated_location_of_percentage
from folioscope.operators.locations import chapter_at
from folioscope.operators.skew import lookup_join, segmented_lag

KEY = ["reader_id", "book_id"]
DAY = 86_400


def _prepared(events: DataFrame, totals: DataFrame, chapters: DataFrame | None) -> DataFrame:
    """Events with their effective location, percentage and chapter."""
    if chapters is not None and "chapter_id" in events.columns:
        known = chapters.select("book_id", "chapter_id", F.col("start_location").alias("_start"))
        events = lookup_join(events, known, ["book_id", "chapter_id"], "left")
        explicit = F.when(F.col("_start").isNotNull(), F.col("chapter_id"))
    else:
        events = events.withColumn("_start", F.lit(None).cast("int"))
        explicit = F.lit(None).cast("long")
    sized = lookup_join(events, totals.select("book_id", "total_locations"), ["book_id"])
    total = F.col("total_locations")
    asked = F.coalesce(F.col("location").cast("double").cast("long"), F.col("_start"))
    pct = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("completion_percentage").cast("double")))
    return sized.select(
        *KEY, "event_id", "total_locations", F.struct("ts", "event_id").alias("pos"),
        F.coalesce("reset", F.lit(False)).alias("reset"), explicit.alias("explicit"),
        F.when(asked.isNotNull(), clamp_location(asked, total)).alias("loc"),
        # least and greatest skip nulls, so an absent percentage needs its own test
        F.when(asked.isNull() & F.col("completion_percentage").isNotNull(), pct).alias("pct"),
    )


def progress_state(events: DataFrame, totals: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Current location, percentage and chapter per reader and book.

    * a location (or a chapter's start) sets location and percentage;
    * a percentage alone sets the percentage, and moves the location only while
      that is still at most 1, rounding towards zero;
    * a reset returns to location 1, 0 percent, no chapter;
    * the chapter is the last one named since the reset, else the chapter at the
      first location set since the reset.
    """
    rows = _prepared(events, totals, chapters)
    reset, loc, pct, pos = F.col("reset"), F.col("loc"), F.col("pct"), F.col("pos")
    total = F.col("total_locations")
    moves = reset | loc.isNotNull()
    base_loc = F.when(reset, F.lit(1)).otherwise(loc)
    new_pct = F.when(reset, F.lit(0.0)).when(loc.isNotNull(), percentage_of(loc, total)).otherwise(pct)
    state = rows.groupBy(*KEY).agg(
        F.max(F.when(moves, F.struct("pos", base_loc.alias("loc")))).alias("base"),
        F.max(F.when(reset, pos)).alias("reset_pos"),
        F.max(F.when(new_pct.isNotNull(), F.struct("pos", new_pct.alias("pct")))).alias("last_pct"),
    )
    later = rows.filter(loc.isNotNull() | pct.isNotNull() | F.col("explicit").isNotNull())
    later = lookup_join(later, state.select(*KEY, F.col("base.pos").alias("base_pos"), "reset_pos"), KEY)
    after_base = F.col("base_pos").isNull() | (pos > F.col("base_pos"))
    after_reset = F.col("reset_pos").isNull() | (pos > F.col("reset_pos"))
    from_pct = truncated_location_of_percentage(pct, total)
    found = later.groupBy(*KEY).agg(
        F.min(F.when(after_base & pct.isNotNull() & (from_pct > 1), F.struct("pos", from_pct.alias("loc")))).alias("moved"),
        F.max(F.when(after_reset & F.col("explicit").isNotNull(), F.struct("pos", F.col("explicit").alias("chapter_id")))).alias("named"),
        F.min(F.when(after_reset & loc.isNotNull(), F.struct("pos", loc.alias("loc")))).alias("first_loc"),
    )
    start = F.coalesce(F.col("base.loc"), F.lit(1))
    out = state.join(found, KEY, "left").select(
        *KEY,
        F.when(start > 1, start).otherwise(F.coalesce("moved.loc", start)).cast("int").alias("current_location"),
        F.coalesce("last_pct.pct", F.lit(0.0)).alias("completion_percentage"),
        F.col("last_pct.pos.ts").alias("last_read_at"),
        F.col("named.chapter_id").alias("_named"), F.col("first_loc.loc").alias("_first_loc"),
    )
    if chapters is None:
        return out.drop("_named", "_first_loc")
    held = chapter_at(out.select(*KEY, "_first_loc"), chapters, KEY, "_first_loc").select(
        *KEY, F.when(F.col("_first_loc").isNotNull(), F.col("chapter_id")).alias("_held")
    )
    return out.join(held, KEY, "left").withColumn("current_chapter_id", F.coalesce("_named", "_held")).drop("_named", "_held", "_first_loc")


def progress_view(progress: DataFrame, chapters: DataFrame) -> DataFrame:
    """Progress with its chapter: the stored one, else the one at the location."""
    stored = chapters.select(
        F.col("chapter_id").alias("current_chapter_id"), F.col("title").alias("_title"), F.col("order").alias("_order")
    )
    named = lookup_join(progress, stored, ["current_chapter_id"], "left")
    at = chapter_at(progress.select(*KEY, "current_location"), chapters, KEY, "current_location").select(
        *KEY, F.col("chapter_id").alias("resolved_chapter_id"), F.col("order").alias("_r_order"), F.col("title").alias("_r_title")
    )
    joined = named.join(at, KEY, "left")
    return joined.withColumns(
        {
            "chapter_id": F.coalesce("current_chapter_id", "resolved_chapter_id"),
            "chapter_order": F.coalesce("_order", "_r_order"),
            "chapter_title": F.coalesce("_title", "_r_title"),
        }
    ).drop("_order", "_title", "_r_order", "_r_title")


def _time_segment(seconds: int = DAY):
    return F.floor(F.unix_seconds("ts") / seconds)


def debounced_positions(events: DataFrame, gap_seconds: int = 2) -> DataFrame:
    """Last position of each burst: nothing follows within ``gap_seconds``."""
    rows = segmented_lag(
        events.select(*KEY, "ts", "event_id", "location"), KEY, ["ts", "event_id"], _time_segment(), ["ts"], "_next", lead=True
    )
    wait = F.unix_micros("_next.ts") - F.unix_micros("ts")
    return rows.filter(F.col("_next").isNull() | (wait > gap_seconds * 1_000_000)).drop("_next")


def throttled_positions(events: DataFrame, interval: str = "150 milliseconds") -> DataFrame:
    """One position, the last, per clock-aligned interval."""
    grouped = events.groupBy(*KEY, F.window("ts", interval).alias("_w")).agg(
        F.max(F.struct("ts", "event_id", "location")).alias("_last"), F.count(F.lit(1)).alias("n_positions")
    )
    return grouped.select(*KEY, F.col("_w.start").alias("window_start"), "n_positions", "_last.ts", "_last.event_id", "_last.location")


def changed_positions(events: DataFrame) -> DataFrame:
    """Positions that differ from the one before."""
    rows = segmented_lag(
        events.select(*KEY, "ts", "event_id", "location"), KEY, ["ts", "event_id"], _time_segment(), ["location"], "_prev"
    )
    return rows.filter(F.col("_prev").isNull() | ~F.col("location").eqNullSafe(F.col("_prev.location"))).drop("_prev")
