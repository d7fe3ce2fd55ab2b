"""The logical tables (books, chapters, questions, ...) over the given files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions.location import boundary_of
from folioscope.operators.chunks import chunk_table
from folioscope.operators.locations import book_totals, locate_chapters, id_segment
from folioscope.operators.skew import lookup_join, segmented_row_number
from folioscope.sources.storage import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chapters of the book named by their source, without text.

    Lengths come from the stored count, so the texts are not scanned for them.
    """
    docs = read(spark, sf_dir, "documents").select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_id"), F.col("n_chars").cast("long").alias("n_chars")
    )
    placed = locate_chapters(docs, "chapter_id", F.col("n_chars"))
    return placed.withColumn("title", F.concat(F.lit("Chapter "), F.col("order").cast("string")))


def chapter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter_id"), "text")
    return spread(docs, "chapter_id")


def chunks(spark: SparkSession, sf_dir: str, location_mode: str = "offset") -> DataFrame:
    return chunk_table(chapters(spark, sf_dir), chapter_texts(spark, sf_dir), location_mode)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_totals(chapters(spark, sf_dir))


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading events: clicks and views move, purchases report a percentage,
    errors reset, sign-ups only create the row."""
    kind, value = F.col("event_type"), F.col("value")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("reader_id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("book_id"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.when(kind.isin("click", "view"), F.floor(value).cast("int")).alias("location"),
        F.when(kind == "purchase", value).alias("completion_percentage"),
        (kind == "error").alias("reset"),
    )


def questions(spark: SparkSession, sf_dir: str, totals: DataFrame | None = None) -> DataFrame:
    """Benchmark items as questions of readers half-way through a book."""
    totals = books(spark, sf_dir) if totals is None else totals
    asked = read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("book_id"),
        F.col("text").alias("question"),
    )
    half = F.floor(F.col("total_locations") / 2).cast("int")
    return lookup_join(asked, totals.select("book_id", "total_locations"), ["book_id"]).withColumn(
        "boundary", boundary_of(half, F.col("total_locations"))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as vectors of the book named by their label."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("book_id"), F.col("embedding").alias("vector"))
    numbered = segmented_row_number(rows, ["book_id"], ["vec_id"], id_segment("vec_id"), "location")
    kind = F.when(F.col("vec_id") % 11 == 0, "summary").otherwise("content")
    return numbered.withColumns({"location": F.col("location").cast("int"), "content_type": kind})


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns followed by an assistant turn, with a ground truth to compare."""
    turns = read(spark, sf_dir, "conversations")
    asked = spread(turns, "conv_id", "turn").filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    replied = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    pairs = asked.join(replied, ["conv_id", "turn"])
    bench = read(spark, sf_dir, "benchmark")
    n_items = bench.agg(F.count(F.lit(1))).scalar()
    keyed = pairs.withColumn("item_id", F.col("conv_id") % n_items)
    truth = bench.select("item_id", F.col("text").alias("ground_truth"))
    return lookup_join(keyed, truth, ["item_id"]).withColumn(
        "model", F.concat(F.lit("m"), (F.col("conv_id") % 5).cast("string"))
    )


def spoiler_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per benchmark item: its long words as forbidden ones and the progress they guard."""
    from folioscope.functions.text import words

    long_words = F.filter(F.array_distinct(words(F.col("text"))), lambda w: F.length(w) > 3)
    return read(spark, sf_dir, "benchmark").select(
        "item_id", (F.lit(25) + (F.col("item_id") % 14) * 5).cast("int").alias("percentage_of_book_read"),
        long_words.alias("forbidden_keywords"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of an evaluation run."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind, event, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
    rows = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("result_id"), F.concat(F.lit("m"), (user % 5).cast("string")).alias("model"),
        F.when(event % 2 == 0, "regular").otherwise("spoiler").alias("evaluation_type"),
        F.col("value").alias("response_time"),
        F.when(kind == "error", "api_error").when(kind == "signup", "empty_response").otherwise("none").alias("error_type"),
        (event % 7).cast("int").alias("context_count"), (F.lit(25) + (event % 14) * 5).cast("int").alias("progress_stage"),
        (k / 100.0).alias("bert_f1"), ((event % 97) / 97.0).alias("bert_precision"), ((user % 89) / 89.0).alias("bert_recall"),
        (1 + event % 5).cast("int").alias("contextual_fidelity"), (event % 6).cast("int").alias("factual_grounding"),
        (user % 2).cast("int").alias("instruction_following"), F.when(kind == "error", 0).otherwise(1).alias("spoiler_prevention_flag"),
        ((k % 11) / 10.0).alias("retrieval_effectiveness"), ((k % 13) / 1000.0).alias("bleu"),
    )
    return rows.withColumn("paas_score", F.col("contextual_fidelity") * F.col("spoiler_prevention_flag"))
