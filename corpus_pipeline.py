"""The corpus pipeline: documents pass the stages in order, each a Parquet table that the next one reads.

All stages but the last return the columns they get. A null text is an empty document to every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.llm import decontaminate, lines, mixing, quality, simhash
from folioscope.llm.common import read
from folioscope.session import ship_package
from folioscope.sources.storage import materialise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    ship_package(spark)
    return quality.filter_quality(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated chunks of lines; those of which nothing is left go."""
    counts = ("__removed_chunks", "__removed_lines")
    left = lines.dedup_lines(docs, counts).where(f"not ({counts[1]} > 0 and text = '')").select(*docs.columns)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    ship_package(spark)
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by calibrated probabilities, with topic, tokens, probability and copies, the times each document counts."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_classifier), ("line dedup", line_dedup), ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_decontamination), ("mixing sources to target weights", source_mixing),
]

#: A trained model and fingerprints are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
