"""Streams over files give what the batch forms give."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.operators import progress as batch, summaries
from folioscope.sources import tables
from folioscope.streaming import ingest as stream_ingest, progress as stream, replies
from tests.conftest import SMALL
from tests.test_skew import EVENTS, as_set, progress_case, replay


def as_files(df, path, order, parts):
    """Write in ``parts`` appended files, in event order."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        df.sparkSession.createDataFrame(rows[i : i + size], df.schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, tmp_path, mode, name):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return df.sparkSession.table(name)


@pytest.fixture
def positions(spark, tmp_path):
    """Reading positions plus one far later one, which closes all open windows."""
    rows = tables.progress_events(spark, SMALL).filter(F.col("location").isNotNull()).select("reader_id", "book_id", "ts", "event_id", "location")
    path = str(tmp_path / "positions")
    as_files(rows, path, "event_id", 3)
    sentinel = spark.createDataFrame([(-1, "none", pd.Timestamp("2030-01-01").to_pydatetime(), -1, 1)], rows.schema)
    sentinel.coalesce(1).write.mode("append").parquet(path)
    return rows, source(spark, path, rows.schema)


def test_debounce(spark, tmp_path, positions):
    rows, arriving = positions
    got = run(stream.debounced_stream(arriving, "2 hours"), tmp_path, "append", "debounced").filter("reader_id >= 0")
    assert as_set(got) == as_set(batch.debounced_positions(rows, 7200).select(got.columns))


def test_throttle(spark, tmp_path, positions):
    rows, arriving = positions
    got = run(stream.throttled_stream(arriving, "6 hours"), tmp_path, "append", "throttled").filter("reader_id >= 0")
    assert as_set(got) == as_set(batch.throttled_positions(rows, "6 hours").select(got.columns))


def test_changes(spark, tmp_path, positions):
    rows, arriving = positions
    coarse = lambda df: df.withColumn("location", F.floor(F.col("location") / 20).cast("int"))
    got = run(stream.changed_stream(coarse(arriving)), tmp_path, "append", "changes").filter("reader_id >= 0")
    assert as_set(got) == as_set(batch.changed_positions(coarse(rows)).select(got.columns))


def test_progress(spark, tmp_path):
    events, starts = progress_case(9)
    # arrival in event time: the stream drops events older than the stored state
    events = sorted(events, key=lambda e: (e["ts"], e["event_id"]))
    edf = spark.createDataFrame([tuple(e.values()) for e in events], EVENTS)
    totals = spark.createDataFrame([("b", 80)], "book_id string, total_locations int")
    cdf = spark.createDataFrame([("b", c, i, "t", s, e) for i, (c, (s, e)) in enumerate(starts.items())], "book_id string, chapter_id long, order int, title string, start_location int, end_location int")
    path = str(tmp_path / "events")
    as_files(edf.withColumn("_o", F.struct("ts", "event_id")), path, "_o", 4)
    updates = run(stream.progress_stream(source(spark, path, edf.schema), totals, cdf), tmp_path, "update", "progress_now")
    find = lambda at: next(c for c, (s, e) in starts.items() if s <= at <= e)
    last = {}
    for r in updates.collect():
        last[r["reader_id"]] = max(last.get(r["reader_id"], r), r, key=lambda x: x["last_read_at"])
    # several batches may end on one timestamp; later rows of the sink win then
    for r in updates.collect():
        if r["last_read_at"] == last[r["reader_id"]]["last_read_at"]:
            last[r["reader_id"]] = r
    by_reader = {}
    for e in events:
        by_reader.setdefault(e["reader_id"], []).append(e)
    for reader, own in by_reader.items():
        r = last[reader]
        chapter = r["chapter_id"] if r["chapter_id"] is not None else find(r["chapter_location"]) if r["chapter_location"] else None
        assert (r["current_location"], round(r["completion_percentage"], 9), chapter) == replay(own, 80, starts)


def test_summaries(spark, tmp_path):
    chunks = tables.chunks(spark, SMALL)
    path = str(tmp_path / "chunks")
    as_files(chunks.withColumn("_o", F.struct("chapter_order", "chunk_no")), path, "_o", 4)
    got = run(stream_ingest.summary_stream(source(spark, path, chunks.schema)), tmp_path, "append", "summaries_now")
    assert as_set(got) == as_set(summaries.summary_segments(chunks, emit_tail=False).select(got.columns))  # tails are not closed yet


def test_ingest_is_incremental_and_repeatable(spark, tmp_path):
    chapters = tables.chapter_texts(spark, SMALL).join(tables.chapters(spark, SMALL), "chapter_id")
    path, folder = str(tmp_path / "chapters"), str(tmp_path / "library")
    as_files(chapters.withColumn("_o", F.struct("book_id", "chapter_id")), path, "_o", 3)
    arriving = source(spark, path, chapters.schema)
    for attempt in ("first", "again"):  # a second checkpoint replays everything
        stream_ingest.ingest_stream(arriving, folder, str(tmp_path / attempt)).awaitTermination(240)
    stored = spark.read.parquet(f"{folder}/chunks")
    columns = ["book_id", "chapter_id", "chunk_no", "location", "chunk"]
    assert as_set(stored.select(columns)) == as_set(tables.chunks(spark, SMALL).select(columns))


def test_replies(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", i, '{"response": "%s"}' % w) for i, w in enumerate(["Call ", "me ", "Ishmael"])] + [("a", 9, "{bad"), ("b", 0, '{"response": "x"}'), ("b", 5000, '{"response": "y"}')],
        "k string, n int, line string",
    )
    path = str(tmp_path / "lines")
    as_files(rows, path, "n", 2)
    want = [("a", 0, "Call me Ishmael", 3), ("b", 0, "xy", 2)]
    assert as_set(replies.joined_replies(rows, ["k"], "n")) == want
    got = run(replies.joined_replies(source(spark, path, rows.schema), ["k"], "n"), tmp_path, "complete", "replies_now")
    assert as_set(got) == want
