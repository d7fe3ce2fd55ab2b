"""Listing, detail and construction of books and chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope import config
from folioscope.operators.skew import lookup_join



def library_listing(books: DataFrame, progress: DataFrame) -> DataFrame:
    """Every book with the progress of each of its readers, or defaults.

    Written as matched readers plus unread books, so that a book with very many
    readers is spread like any other.
    """
    matched = lookup_join(progress, books, ["book_id"])
    unread = books.join(progress.select("book_id").distinct(), "book_id", "left_anti")
    rows = matched.unionByName(unread, allowMissingColumns=True)
    return rows.select(
        "book_id", "reader_id", "total_chapters", "total_locations",
        F.coalesce("current_location", F.lit(0)).alias("current_location"),
        F.coalesce("completion_percentage", F.lit(0.0)).alias("completion_percentage"), "last_read_at",
    )


def page_of(rows: DataFrame, order: list[str], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of an explicitly ordered listing."""
    return rows.orderBy(*order).offset(skip).limit(limit)


def book_detail(books: DataFrame, chapters: DataFrame, per_page: int | None = None) -> DataFrame:
    """Books with their ordered chapters nested.

    One row per book, page 0. A caller with books too long for one row asks for
    pages of ``per_page`` chapters.
    """
    page = F.lit(0) if per_page is None else F.floor((F.col("order") - 1) / per_page).cast("int")
    entry = F.struct("order", "chapter_id", "title", "start_location", "end_location")
    nested = chapters.groupBy("book_id", page.alias("page")).agg(
        F.sort_array(F.collect_list(entry)).alias("chapters")
    )
    return lookup_join(nested, books, ["book_id"])


def book_content(chapters: DataFrame, texts: DataFrame) -> DataFrame:
    """Chapters with their text; a missing text gets a placeholder."""
    return chapters.join(texts, "chapter_id", "left").withColumn("text", F.coalesce("text", F.lit(config.MISSING_CHAPTER_HTML)))


def chapter_of(chapters: DataFrame, wanted: DataFrame) -> DataFrame:
    """Point lookups by (book_id, chapter_id); unknown keys give no row."""
    return chapters.join(wanted.select("book_id", "chapter_id").distinct(), ["book_id", "chapter_id"], "left_semi")


def new_rows(uploads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Book, chapter and progress rows of uploaded chapters, with defaults.

    ``uploads`` has one row per chapter: book_id, book_title, author, chapter_id,
    chapter_title, order, n_chars, n_locations.
    """
    books = uploads.groupBy("book_id").agg(
        F.coalesce(F.max("book_title"), F.lit("Unknown Title")).alias("title"),
        F.coalesce(F.max("author"), F.lit("Unknown Author")).alias("author"),
        F.count("chapter_id").cast("int").alias("total_chapters"),
        F.coalesce(F.sum("n_locations"), F.lit(0)).cast("int").alias("total_locations"),
        F.coalesce(F.sum("n_chars"), F.lit(0)).alias("content_length"),
    )
    chapters = uploads.select(
        "book_id", "chapter_id", F.coalesce("chapter_title", F.lit("Untitled Chapter")).alias("title"), "order"
    )
    progress = books.select(
        "book_id", F.lit(1).alias("current_location"), F.lit(0.0).alias("completion_percentage"),
        F.lit(None).cast("long").alias("current_chapter_id"),
    )
    return books, chapters, progress


def is_book_file(name: Column, mime: Column) -> Column:
    """Accepted uploads: an .epub name in any case, or the EPUB media type."""
    return F.coalesce(F.lower(name).endswith(".epub"), F.lit(False)) | F.coalesce(mime == "application/epub+zip", F.lit(False))


def contents_order(entries: DataFrame, manifest: DataFrame, spine: DataFrame) -> DataFrame:
    """Contents entries that resolve to a spine item, with their sort order.

    ``entries``: book_id, parent_order, n, title, href. An entry needs a manifest
    item for its href and a place of that item in the spine (the first one).
    """
    first_place = spine.groupBy("book_id", "item_id").agg(F.min("idx").alias("spine_index"))
    return (
        entries.filter(F.col("href").isNotNull())
        .join(manifest, ["book_id", "href"])
        .join(first_place, ["book_id", "item_id"])
        .withColumn("order", F.col("parent_order") * 100 + F.col("n"))
    )


def readable_spine(spine: DataFrame) -> DataFrame:
    """Spine without navigation documents."""
    return spine.filter(~F.lower("item_id").startswith("nav"))


def image_names(images: DataFrame) -> DataFrame:
    """Stored file name under each of its three keys: path, id and #id."""
    safe = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"[^\w.\-]", "_")
    keys = F.array(F.col("path"), F.col("image_id"), F.concat(F.lit("#"), F.col("image_id")))
    return images.select("book_id", F.explode(keys).alias("key"), safe.alias("file_name"))


def find_images(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Stored file of each requested name, trying spelling variants in turn:
    as given, lower case, upper case, dashes for underscores, and the reverse."""
    name = F.col("name")
    variants = F.array(name, F.lower(name), F.upper(name), F.translate(name, "_", "-"), F.translate(name, "-", "_"))
    tried = requests.select("book_id", "name", F.posexplode(variants).alias("try_no", "file_name"))
    hits = tried.join(files.select("book_id", "file_name").distinct(), ["book_id", "file_name"])
    return hits.groupBy("book_id", "name").agg(F.min_by("file_name", "try_no").alias("file_name"), F.min("try_no").alias("try_no"))
