"""Near-duplicate removal inside one question's passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope import config
from folioscope.functions.scoring import jaccard, word_set
from folioscope.functions.text import strip


def keep_dissimilar(passages: Column, limit: int | None = config.EVALUATION_LIMIT) -> Column:
    """Greedy walk over an ordered ``array<struct<..., text>>``.

    Blank texts and exact repeats go; so does a text whose word set overlaps that
    of a kept one by more than the limit, when both are long enough. The list is
    one question's retrieved passages, so it is short.
    """
    enriched = F.transform(
        passages,
        lambda p: F.struct(strip(p["text"]).alias("t"), word_set(strip(p["text"])).alias("w"), p.alias("p")),
    )

    def walk(rows: Column) -> Column:
        nothing = F.slice(rows, 1, 0)

        def step(kept: Column, p: Column) -> Column:
            same = F.exists(kept, lambda k: k["t"] == p["t"])
            near = F.exists(
                kept,
                lambda k: (F.length(p["t"]) > config.NEAR_DUPLICATE_MIN_CHARS)
                & (F.length(k["t"]) > config.NEAR_DUPLICATE_MIN_CHARS)
                & (jaccard(p["w"], k["w"]) > config.NEAR_DUPLICATE_JACCARD),
            )
            return F.when((p["t"] == "") | same | near, kept).otherwise(F.concat(kept, F.array(p)))

        kept = F.transform(F.aggregate(rows, nothing, step), lambda k: k["p"])
        return kept if limit is None else F.slice(kept, 1, limit)

    return F.transform(F.array(enriched), walk)[0]


def dedupe_context(passages: DataFrame, limit: int | None = config.EVALUATION_LIMIT) -> DataFrame:
    """First ``limit`` dissimilar passages per question, in rank order."""
    listed = passages.groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.struct("final_rank", "text"))).alias("_p")
    )
    kept = listed.select("question_id", F.posexplode(keep_dissimilar(F.col("_p"), limit)).alias("_i", "_k"))
    return kept.select("question_id", (F.col("_i") + 1).alias("passage_no"), F.col("_k.final_rank").alias("final_rank"), F.col("_k.text").alias("text"))
