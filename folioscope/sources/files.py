"""Readers and writers for chapter files, query files, results and book metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from folioscope.operators.library import is_book_file

QUERY_SCHEMA = "book string, query string, ground_truth string"
RULE_SCHEMA = (
    "book string, query string, percentage_of_book_read int, evaluation_rules struct<forbidden_keywords: array<string>>"
)

RESULT_SCHEMA = (
    "evaluation_type string, model string, book string, query string, progress_stage int, generated_answer string, "
    "response_time double, error_type string, context_count int, bert_precision double, bert_recall double, bert_f1 double, "
    "bleu double, factual_grounding int, retrieval_effectiveness double, sentence_count int, avg_sentence_length double, "
    "unique_word_ratio double, contextual_fidelity int, relevance int, helpfulness int, coherence int, "
    "instruction_following int, paas_score int, spoiler_prevention_flag int"
)


def comprehension_queries(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of {book, query, ground_truth}."""
    return spark.read.schema(QUERY_SCHEMA).option("multiLine", True).json(path)


def spoiler_rules(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of rules, the keyword list flattened to a column."""
    rows = spark.read.schema(RULE_SCHEMA).option("multiLine", True).json(path)
    return rows.withColumn("forbidden_keywords", F.col("evaluation_rules.forbidden_keywords")).drop("evaluation_rules")


def results_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Evaluation results with header; column names are trimmed.

    Give ``RESULT_SCHEMA`` (or another) for large files; without one the types are
    inferred by an extra pass.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    rows = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return rows.toDF(*[c.strip() for c in rows.columns])


def append_results(rows: DataFrame, path: str) -> None:
    """Add finished rows to a growing result set."""
    rows.write.mode("append").option("header", True).csv(path)


def replace_results(rows: DataFrame, path: str) -> None:
    """Write the final result set over the partial one."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def chapter_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per chapter file: its path and whole UTF-8 text."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def chapter_file_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream of newly arriving files."""
    rows = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).text(path)
    return rows.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def uploaded_books(spark: SparkSession, path: str) -> DataFrame:
    """Listing of accepted book files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = files.select("path", "length", "modificationTime", F.element_at(F.split("path", "/"), -1).alias("name"))
    return listed.filter(is_book_file(F.col("name"), F.lit(None).cast("string")))


def book_metadata(books: DataFrame, chapters: DataFrame, per_page: int | None = None) -> DataFrame:
    """``{book: {...}, chapters: [...]}`` documents, chapters in order.

    One document per book, or with ``per_page`` one per page of so many chapters.
    """
    from folioscope.operators.library import book_detail

    detail = book_detail(books, chapters, per_page)
    fields = [c for c in books.columns if c != "book_id"]
    return detail.select(F.struct("book_id", *fields).alias("book"), "page", "chapters")


def save_book_metadata(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)
