"""Progress-aware hybrid retrieval for a table of questions.

Keyword, vector, summary and expanded-query search, each limited to what the
reader has read, fused, deduplicated, re-ranked and laid out as context.
``questions`` has question_id, book_id, boundary and question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope import config
from folioscope.config import RetrievalParams
from folioscope.functions.hooks import EmbedFn, with_embedding
from folioscope.functions.parsing import numbered_items
from folioscope.functions.text import answer_prompt
from folioscope.operators import fusion
from folioscope.operators.keyword import keyword_search
from folioscope.operators.skew import lookup_join
from folioscope.operators.vectors import similar_vectors
from folioscope.plans.ingest import ITEM, Corpus, item_texts, search_items
from folioscope.sources.storage import materialise


def search_probes(
    questions: DataFrame, expansions: DataFrame | None, params: RetrievalParams, embed: EmbedFn | None, dim: int = 64
) -> DataFrame:
    """One vector probe per question and search.

    ``expansions`` has question_id and reply, the numbered list of rewritten
    queries; each becomes a probe of its own.
    """
    base = questions.select("question_id", "book_id", "boundary", F.col("question").alias("probe"))
    kinds = [
        ("vector", params.vector_limit, params.vector_threshold, None),
        ("summary", params.summary_limit, params.summary_threshold, "summary"),
    ]
    wanted = F.array(
        *[
            F.struct(F.lit(m).alias("search_method"), F.lit(k).alias("k"), F.lit(t).alias("threshold"), F.lit(c).cast("string").alias("kind"))
            for m, k, t, c in kinds
        ]
    )
    plain = with_embedding(base, "probe", "vector", embed, dim)
    probes = plain.select("question_id", "book_id", "boundary", "vector", F.lit(0).alias("probe_no"), F.explode(wanted).alias("_w")).select(
        "question_id", "book_id", "boundary", "vector", "probe_no", "_w.*"
    )
    if expansions is None:
        return probes
    listed = base.drop("probe").join(expansions.select("question_id", "reply"), "question_id").select(
        "question_id", "book_id", "boundary", F.posexplode(numbered_items(F.col("reply"))).alias("probe_no", "probe")
    )
    expanded = with_embedding(listed, "probe", "vector", embed, dim).select(
        "question_id", "book_id", "boundary", "vector", "probe_no", F.lit("expanded_vector").alias("search_method"),
        F.lit(params.expanded_limit).alias("k"), F.lit(params.expanded_threshold).alias("threshold"), F.lit(None).cast("string").alias("kind"),
    )
    return probes.unionByName(expanded)


def hits_of_all_searches(
    questions: DataFrame,
    corpus: Corpus,
    expansions: DataFrame | None = None,
    params: RetrievalParams = RetrievalParams(),
    embed: EmbedFn | None = None,
    dim: int = 64,
) -> DataFrame:
    """Hits of the four searches; the vector searches share one pass."""
    keyword_hits = keyword_search(
        questions, corpus.chunks, params.bm25_limit, ("book_id", "location", "content_type", "text_key"),
        corpus.postings, corpus.frequency, corpus.statistics,
    ).select(
        "question_id", "book_id", F.lit("bm25").alias("search_method"), F.lit(0).alias("probe_no"), "rank_in_method", "score",
        F.lit(0).alias("kind_no"), "chapter_order", "chunk_no", "location", "content_type", "text_key",
    )
    probes = search_probes(questions, expansions, params, embed, dim)
    vector_hits = similar_vectors(
        probes, search_items(corpus), ["question_id", "search_method", "probe_no"], ITEM,
        ["book_id", "location", "content_type", "text_key"], F.col("k"), F.col("threshold"), F.col("kind"),
        max_limit=max(params.vector_limit, params.summary_limit, params.expanded_limit),
    )
    return keyword_hits.unionByName(vector_hits)


def retrieve(
    questions: DataFrame,
    corpus: Corpus,
    expansions: DataFrame | None = None,
    params: RetrievalParams = RetrievalParams(),
    embed: EmbedFn | None = None,
    dim: int = 64,
) -> DataFrame:
    """Ranked, deduplicated hits with chapter title and text.

    The ranking is stored first: its true size then lets Spark decide whether the
    texts can be fetched without shuffling the corpus.
    """
    hits = hits_of_all_searches(questions, corpus, expansions, params, embed, dim)
    ranked = materialise(fusion.rank_unique(fusion.weigh_scores(hits, params), params), "ranked")
    return ranked.join(item_texts(corpus), ["book_id", *ITEM])


def answer_contexts(final: DataFrame, questions: DataFrame, totals: DataFrame) -> DataFrame:
    """Context, snippets and answer prompt per question.

    A question without hits has no prompt but already its ``response``.
    """
    asked = lookup_join(
        questions.select("question_id", "book_id", "boundary", "question"), totals.select("book_id", "total_locations"), ["book_id"]
    )
    joined = asked.join(fusion.context_blocks(final), "question_id", "left")
    percentage = F.col("boundary") / F.col("total_locations") * 100.0
    nothing = F.col("context_used").isNull()
    return joined.select(
        "question_id", "book_id", F.col("boundary").alias("location_boundary"), percentage.alias("progress_boundary"), "context", "context_used",
        F.when(~nothing, answer_prompt(F.col("context"), percentage, F.col("question"))).alias("prompt"),
        F.when(nothing, F.lit(config.NO_CONTEXT_REPLY)).alias("response"),
    )
