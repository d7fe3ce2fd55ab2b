"""Tables kept between stages and between runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

from folioscope.session import ensure_checkpoint_dir


def materialise(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder, in folders by column ``by``, read it back.

    ``options`` are those of the writer. Later branches then scan only the columns they need instead of repeating the
    work, and a lost executor costs nothing but its own tasks.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_table(df: DataFrame, path: str, mode: str = "overwrite", buckets: int | None = None) -> None:
    """Write a table; with ``buckets``, in folders by a hash of the book id."""
    if buckets is None:
        df.write.mode(mode).parquet(path)
        return
    from pyspark.sql import functions as F

    bucketed = df.withColumn("book_bucket", F.pmod(F.xxhash64("book_id"), F.lit(buckets)).cast("int"))
    # a hot book is spread over several writers by row content before it is written
    bucketed.repartition(F.col("book_bucket"), F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.mode(mode).partitionBy(
        "book_bucket"
    ).parquet(path)


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A stored table; with its ``schema``, also one without any row and so without a file to read it from."""
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give heavy per-row work enough tasks when the input has few splits.

    A large input already has more splits than cores and is returned untouched, so
    this never shuffles big data.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
