"""Chapter text to located, overlapping chunks."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F

from folioscope import config
from folioscope.functions.text import chunk_pieces
from folioscope.operators.locations import chunk_location

#: Texts cut at once by a worker.
ROWS = 256


def cut_pieces(
    texts: DataFrame,
    text: str = "text",
    size: int = config.CHUNK_SIZE,
    overlap: int = config.CHUNK_OVERLAP,
    min_chars: int = config.MIN_CHUNK_CHARS,
    mode: str = "document",
    min_bytes: int = config.MIN_CHAPTER_BYTES,
) -> DataFrame:
    """Replace each text by the array of its chunks and their positions.

    Works on each text alone, without a shuffle, in Arrow batches.
    """
    import pyarrow as pa

    keep = [c for c in texts.columns if c != text]

    def run(batches):
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            found = [chunk_pieces(t, size, overlap, mode, min_chars, min_bytes) for t in batch.column(text).to_pylist()]
            ends = pa.array(itertools.accumulate(map(len, found), initial=0), pa.int32())
            flat = pa.StructArray.from_arrays(
                [pa.array((p for own in found for p, _ in own), pa.int32()), pa.array((c for own in found for _, c in own), pa.string())],
                names=["char_pos", "chunk"],
            )
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(ends, flat)], names=[*keep, "_pieces"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.select(*keep).schema)
    return texts.select(*keep, text).mapInArrow(run, f"{kinds}_pieces array<struct<char_pos: int, chunk: string>>")


def explode_pieces(rows: DataFrame) -> DataFrame:
    """One row per chunk: ``chunk_no`` (1-based), ``char_pos``, ``chunk``, ``n_chunks``."""
    keep = [c for c in rows.columns if c != "_pieces"]
    sized = rows.select(*keep, "_pieces", F.size("_pieces").alias("n_chunks"))  # first, or every chunk's row carries all of them
    listed = sized.select(*keep, "n_chunks", F.posexplode("_pieces").alias("_i", "_p"))
    return listed.select(
        *keep, "n_chunks", (F.col("_i") + 1).alias("chunk_no"), "_p.char_pos", "_p.chunk"
    )


def cut_chunks(texts: DataFrame, **cut) -> DataFrame:
    """Chunks of every text, numbered within it."""
    return explode_pieces(cut_pieces(texts, **cut))


def chunk_table(chapters: DataFrame, texts: DataFrame, location_mode: str = "offset", **cut) -> DataFrame:
    """Chunks of located chapters, each with its location in the book.

    ``chapters`` holds book_id, chapter_id, order, title, start_location and
    end_location; ``texts`` chapter_id and text. Texts are cut where they are read;
    each meets its one chapter row afterwards.
    """
    placed = cut_pieces(texts, **cut).join(
        chapters.select("book_id", "chapter_id", "order", "title", "start_location", "end_location"), "chapter_id"
    )
    return explode_pieces(placed).withColumn("location", chunk_location(location_mode)).select(
        "book_id", "chapter_id", F.col("order").alias("chapter_order"), F.col("title").alias("chapter_title"),
        "chunk_no", "n_chunks", "char_pos", "location", "chunk", F.lit("content").alias("content_type"),
    )
