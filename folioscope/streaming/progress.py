"""Reading progress as a stream.

Event time rules: events carry a watermark, and an event not newer than the stored
state of its reader and book is dropped, so replays and stragglers change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.operators.progress import KEY

WATERMARK = "10 minutes"

_STATE = "current_location int, completion_percentage double, chapter_location int, chapter_id long, last_us long, last_event long"
_OUT = (
    "reader_id long, book_id string, current_location int, completion_percentage double, "
    "chapter_location int, chapter_id long, last_read_at timestamp"
)


def _advance(state: tuple, rows: pd.DataFrame) -> tuple:
    """State after a batch of one reader's events, already in time order."""
    location, percentage, held, named, _, _ = state
    reset = rows["reset"].fillna(False).to_numpy(dtype=bool)
    has_loc = rows["loc"].notna().to_numpy()
    last = len(rows) - 1
    # position: last reset or location, then the first percentage that moves it
    moves = (reset | has_loc).nonzero()[0]
    tail = rows
    if len(moves):
        at = moves[-1]
        location = 1 if reset[at] else int(rows["loc"].iloc[at])
        tail = rows.iloc[at + 1 :]
    if location <= 1:
        jumped = tail.loc[tail["pct"].notna() & (tail["pct_location"] > 1), "pct_location"]
        location = int(jumped.iloc[0]) if len(jumped) else location
    new_pct = rows["new_pct"].dropna()
    percentage = float(new_pct.iloc[-1]) if len(new_pct) else percentage
    # chapter: since the last reset, the last one named, else the first location
    resets = reset.nonzero()[0]
    since = rows
    if len(resets):
        held, named, since = None, None, rows.iloc[resets[-1] + 1 :]
    locs, names = since["loc"].dropna(), since["chapter_id"].dropna()
    if held is None and len(locs):
        held = int(locs.iloc[0])
    named = int(names.iloc[-1]) if len(names) else named
    return location, percentage, held, named, int(rows["us"].iloc[last]), int(rows["event_id"].iloc[last])


def progress_stream(events: DataFrame, totals: DataFrame, chapters: DataFrame | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Updated progress rows per reader and book; run in update mode.

    ``totals`` and ``chapters`` are static tables. ``chapter_location`` is the
    location that decides the chapter unless one was named (``chapter_id``).
    """
    rows = events.withWatermark("ts", watermark)
    if "chapter_id" not in rows.columns:
        rows = rows.withColumn("chapter_id", F.lit(None).cast("long"))
    rows = rows.withColumn("_start", F.lit(None).cast("int"))
    if chapters is not None:
        known = chapters.select("book_id", "chapter_id", F.col("start_location").alias("_start"))
        rows = rows.drop("_start").join(known, ["book_id", "chapter_id"], "left")
    rows = rows.join(totals.select("book_id", "total_locations"), "book_id")
    total = F.col("total_locations")
    asked = F.coalesce(F.col("location").cast("double").cast("int"), F.col("_start"))
    loc = F.least(F.greatest(F.lit(1), asked), total)
    pct = F.when(asked.isNull() & F.col("completion_percentage").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("completion_percentage").cast("double"))))
    known_chapter = F.when(F.col("_start").isNotNull(), F.col("chapter_id")) if chapters is not None else F.lit(None).cast("long")
    prepared = rows.select(
        *KEY, "ts", "event_id", F.unix_micros("ts").alias("us"), F.coalesce("reset", F.lit(False)).alias("reset"),
        F.when(asked.isNotNull(), loc).cast("double").alias("loc"), pct.alias("pct"), known_chapter.alias("chapter_id"),
        F.greatest(F.lit(1), F.least(total, (pct / 100.0 * total).cast("int"))).cast("double").alias("pct_location"),
        F.when(F.col("reset"), F.lit(0.0)).when(asked.isNotNull(), F.least(F.lit(100.0), loc / total * 100.0)).otherwise(pct).alias("new_pct"),
    )

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get if state.exists else (1, 0.0, None, None, -1, -1)
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        rows = rows[(rows["us"] > current[4]) | ((rows["us"] == current[4]) & (rows["event_id"] > current[5]))]
        if rows.empty:
            return
        current = _advance(current, rows)
        state.update(current)
        yield pd.DataFrame(
            {
                "reader_id": [key[0]], "book_id": [key[1]], "current_location": [current[0]], "completion_percentage": [current[1]],
                "chapter_location": pd.array([current[2]], dtype="Int32"), "chapter_id": pd.array([current[3]], dtype="Int64"),
                "last_read_at": pd.to_datetime([current[4]], unit="us"),
            }
        )

    return prepared.groupBy(*KEY).applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def debounced_stream(events: DataFrame, gap: str = "2 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Last position of each burst once the gap has passed; append mode."""
    bursts = events.withWatermark("ts", watermark).groupBy(*KEY, F.session_window("ts", gap).alias("_w")).agg(
        F.max(F.struct("ts", "event_id", "location")).alias("_last")
    )
    return bursts.select(*KEY, "_last.ts", "_last.event_id", "_last.location")


def throttled_stream(events: DataFrame, interval: str = "150 milliseconds", watermark: str = WATERMARK) -> DataFrame:
    """Last position of each clock-aligned interval; append mode."""
    grouped = events.withWatermark("ts", watermark).groupBy(*KEY, F.window("ts", interval).alias("_w")).agg(
        F.max(F.struct("ts", "event_id", "location")).alias("_last"), F.count(F.lit(1)).alias("n_positions")
    )
    return grouped.select(*KEY, F.col("_w.start").alias("window_start"), "n_positions", "_last.ts", "_last.event_id", "_last.location")


def changed_stream(events: DataFrame) -> DataFrame:
    """Positions that differ from the reader's previous one; append mode."""
    out = "reader_id long, book_id string, ts timestamp, event_id long, location int"

    def changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        before = state.get[0] if state.exists else None
        previous = rows["location"].shift(1, fill_value=-1 if before is None else before)
        changed = rows[rows["location"] != previous]
        state.update((int(rows["location"].iloc[-1]),))
        yield changed[["reader_id", "book_id", "ts", "event_id", "location"]]

    chosen = events.select(*KEY, "ts", "event_id", F.col("location").cast("int").alias("location"))
    return chosen.groupBy(*KEY).applyInPandasWithState(changes, out, "location int", "append", GroupStateTimeout.NoTimeout)
