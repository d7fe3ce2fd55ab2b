"""The operators applied to their whole tables with production parameters, and the same results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.llm import alignment, counts, decontaminate, lines, mixing, passages, pii, quality, simhash, topk, urls, warc, whitening
from folioscope.llm.common import read
from folioscope.session import ship_package

def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op10_quality(spark, sf_dir):
    """Every document's quality, learned from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.scores(docs, model, keep=["doc_id"]).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.ACCEPT).cast("int").alias("predicted"),
    )


@query
def op1_line_dedup(spark, sf_dir):
    """What line dedup leaves of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    return lines.dedup_lines(docs).select(
        "doc_id", "n_lines", F.col("removed_chunks").cast("long").alias("removed_chunks"),
        F.col("removed_lines").cast("long").alias("removed_lines"), F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


ORACLE_SQL["op1_line_dedup"] = lines.ORACLE_SQL


@query
def op7_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op2_decontaminate(spark, sf_dir):
    """Every benchmark item found in a document."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op9_mixing(spark, sf_dir):
    """The documents of a mixture with tempered source, language and topic weights, and their copies in it."""
    sample = mixing.mix(read(spark, sf_dir, "documents"))
    return sample.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "copies")


ORACLE_SQL["op9_mixing"] = mixing.oracle_sql()


@query
def op6_topk(spark, sf_dir):
    """The five best other vectors of every fiftieth id, by integer inner product."""
    vectors = topk.quantised(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


ORACLE_SQL["op6_topk"] = topk.ORACLE_SQL


@query
def op3_warc(spark, sf_dir):
    """Every page as its archive record says."""
    found = warc.round_trip(read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op3_warc"] = warc.ORACLE_SQL


@query
def op8_pii(spark, sf_dir):
    """The personal data of every document: base entities, and the terms that give them away."""
    found = pii.sanitise(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


@query
def op4_urls(spark, sf_dir):
    """The verdict on every page's url: the longest rule that fits, else trees fitted on the urls that rules decide."""
    pages = read(spark, sf_dir, "pages")
    return urls.judge(pages, urls.fit(urls.rule_labels(pages)))


@query
def op5_substring_dedup(spark, sf_dir):
    """Every document that shares a passage with another one."""
    return passages.repeats(read(spark, sf_dir, "documents"))


@query
def op11_whitening(spark, sf_dir):
    """Every usable vector on the leading components, whitened."""
    found = whitening.whiten(read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


@query
def op12_token_counts(spark, sf_dir):
    """The length of every document in bytes and tokens."""
    return counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), keep=["doc_id"])


@query
def op13_alignment(spark, sf_dir):
    """How the tokens of two tokenizers meet in every document."""
    found = alignment.align(
        read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), digests=True
    )
    return alignment.scored(found).withColumnRenamed("groups", "groups_sha256")
