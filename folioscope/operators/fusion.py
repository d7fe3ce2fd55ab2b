"""Merging the hit lists of several searches into one ranking per question.

All windows here run over one question's hits, whose number is fixed by the heads
of the searches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope import config
from folioscope.config import RetrievalParams
from folioscope.functions.parsing import rating_of, ratings
from folioscope.functions.text import passage_block, split_words


def _method_order(params: RetrievalParams) -> Column:
    out = F.lit(len(params.method_order))
    for name, order in params.method_order.items():
        out = F.when(F.col("search_method") == name, order).otherwise(out)
    return out


def weigh_scores(hits: DataFrame, params: RetrievalParams = RetrievalParams()) -> DataFrame:
    """Scores relative to the best of their method, times the method's weight.

    Keyword and vector scores are weighed only where a question has both; alone
    they keep their raw scale.
    """
    by_method, by_question = W.partitionBy("question_id", "search_method"), W.partitionBy("question_id")
    method, top = F.col("search_method"), F.max("score").over(by_method)
    has = lambda name: F.max((method == name).cast("int")).over(by_question) == 1
    relative = F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0))
    both = has("vector") & has("bm25")
    weighed = (
        F.when(method == "summary", relative * params.summary_weight)
        .when(method == "expanded_vector", relative * params.expanded_weight)
        .when((method == "vector") & both, relative * (1 - params.bm25_weight))
        .when((method == "bm25") & both, relative * params.bm25_weight)
        .otherwise(F.col("score"))
    )
    return hits.withColumns({"original_score": F.col("score"), "score": weighed})


def rank_unique(hits: DataFrame, params: RetrievalParams = RetrievalParams()) -> DataFrame:
    """Best hit per distinct text start, ranked by score.

    Ties keep the order of the searches, then of the expansions, then their ranks.
    """
    arrival = [_method_order(params), F.col("probe_no"), F.col("rank_in_method")]
    best = W.partitionBy("question_id", "text_key").orderBy(F.round("score", 9).desc(), *arrival)
    overall = W.partitionBy("question_id").orderBy(F.round("score", 9).desc(), *arrival)
    kept = hits.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return kept.withColumns({"rank": F.row_number().over(overall), "n_unique": F.count(F.lit(1)).over(W.partitionBy("question_id"))})


def wants_rerank(question: Column, n_unique: Column) -> Column:
    return (n_unique > config.RERANK_MIN_RESULTS) & (F.size(split_words(question)) > config.RERANK_MIN_WORDS)


def rerank_prompts(ranked: DataFrame, questions: DataFrame, params: RetrievalParams = RetrievalParams(), chars: int | None = None) -> DataFrame:
    """Rating prompt per question over its first passages (or their first ``chars`` characters); ``ranked`` has text."""
    shown = F.col("text") if chars is None else F.substring("text", 1, chars)
    lines = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", shown.alias("t")))),
            lambda p: F.concat(F.lit("["), p["rank"].cast("string"), F.lit("] "), p["t"], F.lit("...")),
        ),
        "\n",
    )
    listed = ranked.filter(F.col("rank") <= params.rerank_head).groupBy("question_id").agg(lines.alias("_p"))
    ask = F.concat(
        F.lit("Rate each passage from 1 (unrelated) to 10 (answers it) for the query: '"), F.col("question"),
        F.lit("'\n\n"), F.col("_p"), F.lit("\n\nFORMAT: [index]: [score]"),
    )
    return listed.join(questions, "question_id").select("question_id", ask.alias("prompt"))


def apply_ratings(
    ranked: DataFrame, questions: DataFrame, replies: DataFrame, params: RetrievalParams = RetrievalParams()
) -> DataFrame:
    """Final hits per question: the rated head re-sorted, then cut.

    Questions with enough results and words are re-sorted by (rating, score) over
    their first passages and cut to ``reranked_limit``; others to ``plain_limit``.
    ``replies`` has question_id and reply; a reply without ratings changes nothing.
    """
    asked = questions.select("question_id", "question").join(replies.select("question_id", "reply"), "question_id", "left")
    rows = ranked.join(asked, "question_id", "left")
    parsed = ratings(F.coalesce("reply", F.lit("")), F.least(F.lit(params.rerank_head), F.col("n_unique")))
    rows = rows.withColumns({"_wants": wants_rerank(F.col("question"), F.col("n_unique")), "_r": parsed})
    in_head = F.col("_wants") & (F.size("_r") > 0) & (F.col("rank") <= params.rerank_head)
    rows = rows.withColumn("rerank_score", F.when(in_head, rating_of(F.col("_r"), F.col("rank"))))
    order = W.partitionBy("question_id").orderBy(
        F.col("rerank_score").desc_nulls_last(), F.when(in_head, F.round("score", 9)).desc_nulls_last(), "rank"
    )
    limit = F.when(F.col("_wants"), params.reranked_limit).otherwise(params.plain_limit)
    return rows.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= limit).drop(
        "_wants", "_r", "reply", "question"
    )


def context_blocks(final: DataFrame) -> DataFrame:
    """Context text and snippet list per question, summaries first."""
    entry = F.struct(
        F.col("final_rank").alias("n"), (F.col("search_method") == "summary").alias("is_summary"),
        passage_block(F.col("final_rank"), F.col("search_method"), F.col("chapter_title"), F.col("location"), F.col("text")).alias("block"),
        F.struct(
            "text", F.coalesce("chapter_title", F.lit("Unknown Chapter")).alias("chapter_title"), "location",
            F.bround("score", 2).alias("relevance_score"), "search_method", "content_type",
        ).alias("snippet"),
    )
    grouped = final.groupBy("question_id").agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    summaries = F.filter("_e", lambda e: e["is_summary"])
    blocks = lambda part: F.transform(part, lambda e: e["block"])
    none = F.array().cast("array<string>")
    head = F.when(
        F.size(summaries) > 0,
        F.concat(F.array(F.lit("--- SECTION SUMMARIES ---")), blocks(summaries), F.array(F.lit("--- DETAILED PASSAGES ---"))),
    ).otherwise(none)
    passages = blocks(F.filter("_e", lambda e: ~e["is_summary"]))
    return grouped.select(
        "question_id", F.array_join(F.concat(head, passages), "\n").alias("context"),
        F.transform("_e", lambda e: e["snippet"]).alias("context_used"),
    )
