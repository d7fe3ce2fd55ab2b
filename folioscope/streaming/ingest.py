"""Arriving chapters: incremental chunking and indexing, running summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope import config
from folioscope.functions.hooks import EmbedFn
from folioscope.operators.chunks import chunk_table
from folioscope.operators.maintenance import not_yet_in
from folioscope.plans.ingest import embedded_chunks


def ingest_stream(
    arriving: DataFrame, folder: str, checkpoint: str, key: tuple[str, ...] = ("book_id", "chapter_id"), embed: EmbedFn | None = None
) -> StreamingQuery:
    """Append chunks of located chapters (with text) to ``folder/chunks``.

    Chapters whose key is stored already are skipped. Every micro-batch owns one
    folder and overwrites it when it is run again, so a restart neither loses nor
    doubles rows.
    """
    target = f"{folder}/chunks"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            stored = spark.read.parquet(target).filter(F.col("batch_id") != batch_id)
            fresh = not_yet_in(batch, stored, list(key))
        rows = embedded_chunks(chunk_table(fresh.drop("text"), fresh.select("chapter_id", "text")), embed)
        rows.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary_stream(chunks: DataFrame, interval: int = config.SUMMARY_INTERVAL) -> DataFrame:
    """Summary segments as soon as they close; append mode.

    State per book: location of the last close and the text since then. Chunks of
    a book must arrive in reading order across micro-batches.
    """
    out = "book_id string, location int, n_chunks long, chapter_title string, text string"

    def segments(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count, text = state.get if state.exists else (0, 0, "")
        rows = pd.concat(list(batches)).sort_values(["chapter_order", "chunk_no"])
        location, chunk, title = (rows[c].to_numpy() for c in ("location", "chunk", "chapter_title"))
        closed, begin = [], 0
        while True:
            # locations never fall, so the next close is found by bisection
            at = max(begin, int(location.searchsorted(last + interval)))
            if at >= len(location):
                break
            text += " ".join(chunk[begin : at + 1]) + " "
            closed.append((key[0], int(location[at]), count + at + 1 - begin, title[at], text))
            last, count, text, begin = int(location[at]), 0, "", at + 1
        if begin < len(chunk):
            text += " ".join(chunk[begin:]) + " "
            count += len(chunk) - begin
        state.update((last, count, text))
        yield pd.DataFrame(closed, columns=["book_id", "location", "n_chunks", "chapter_title", "text"])

    chosen = chunks.select("book_id", "chapter_order", "chunk_no", "location", "chunk", "chapter_title")
    return chosen.groupBy("book_id").applyInPandasWithState(
        segments, out, "last int, n long, text string", "append", GroupStateTimeout.NoTimeout
    )
