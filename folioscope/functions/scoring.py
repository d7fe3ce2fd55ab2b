"""Similarity and answer-quality scores as columns of one row."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

from folioscope import config
from folioscope.functions.text import bind, is_blank, split_words, strip, words



def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_set(text: Column) -> Column:
    """Distinct lower-case whitespace-separated words."""
    return F.array_distinct(split_words(F.lower(text)))


def overlap_share(wanted: Column, present: Column, stopwords: list[str]) -> Column:
    """Share of the wanted non-stop words that are present; null if none wanted."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    return bind(
        F.array_except(wanted, stop),
        lambda need: F.size(F.array_intersect(need, present)) / F.nullif(F.size(need), F.lit(0)),
    )


def is_refusal(answer: Column) -> Column:
    return F.lower(answer).contains(config.REFUSAL_PHRASE)


def factual_grounding(answer: Column, truth: Column) -> Column:
    """0 for no answer, else 1..5 by share of ground-truth words in the answer."""

    def grade(share: Column) -> Column:
        score = F.when(share.isNull(), 3)
        for limit, value in ((0.7, 5), (0.5, 4), (0.3, 3), (0.1, 2)):
            score = score.when(share >= limit, value)
        return score.otherwise(1)

    return (
        F.when(is_blank(answer), 0)
        .when(answer.contains(config.ERROR_MARKER) | is_refusal(answer), 5)
        .otherwise(bind(overlap_share(words(truth), words(answer), config.GROUNDING_STOPWORDS), grade))
    )


def retrieval_effectiveness(question: Column, context: Column) -> Column:
    """Share of question words found in the retrieved text; 0 without context."""
    share = overlap_share(words(question), words(context), config.RETRIEVAL_STOPWORDS)
    return F.when(context.isNull(), F.lit(0.0)).otherwise(F.coalesce(share, F.lit(0.5)))


def classify_error(answer: Column, error: Column) -> Column:
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "api_error")
        .when(is_blank(answer), "empty_response")
        .when(answer.contains(config.ERROR_MARKER), "generation_error")
        .when(is_refusal(answer), "insufficient_context")
        .otherwise("none")
    )


def sentence_count(answer: Column) -> Column:
    parts = F.filter(F.split(strip(answer), r"[.!?]+"), lambda s: ~is_blank(s))
    return F.when(is_blank(answer), 0).otherwise(F.size(parts))


def avg_sentence_length(answer: Column) -> Column:
    ratio = F.size(words(answer)) / F.nullif(sentence_count(answer), F.lit(0))
    return F.when(is_blank(answer), F.lit(0.0)).otherwise(F.coalesce(ratio, F.lit(0.0)))


def unique_word_ratio(answer: Column) -> Column:
    ratio = bind(words(answer), lambda found: F.size(F.array_distinct(found)) / F.nullif(F.size(found), F.lit(0)))
    return F.when(is_blank(answer), F.lit(0.0)).otherwise(F.coalesce(ratio, F.lit(0.0)))


def contains_any(answer: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda k: F.lower(answer).contains(F.lower(k)))


def spoiler_flag(answer: Column, keywords: Column) -> Column:
    """1 when safe: blank answer, no rule, or no forbidden keyword inside."""
    unsafe = F.coalesce(contains_any(answer, keywords), F.lit(False))
    return F.when(is_blank(answer) | ~unsafe, 1).otherwise(0)


def paas(contextual_fidelity: Column, flag: Column) -> Column:
    return contextual_fidelity * flag


def clipped_log10(x: Column, floor: float = 1e-6) -> Column:
    return F.log10(F.greatest(x, F.lit(floor)))


def relevance_band(score: Column) -> Column:
    return F.when(score > 0.8, "high").when(score > 0.5, "medium").otherwise("low")


# --- BLEU -------------------------------------------------------------------


def sentence_bleu(hyp: Sequence[str], ref: Sequence[str]) -> float:
    """BLEU-4 of word lists, in time linear in their length."""
    logs, first = 0.0, 0
    for n in (1, 2, 3, 4):
        own, other = (Counter(zip(*(words[i:] for i in range(n)))) for words in (hyp, ref))
        hits = (own & other).total()
        first = hits if n == 1 else first
        logs += 0.25 * math.log((hits or 0.1) / max(1, len(hyp) - n + 1))
    if not first:
        return 0.0
    return math.exp(logs) * (1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp)))


def bleu4(answer: Column, truth: Column) -> Column:
    """Sentence BLEU-4 against one reference.

    Zero n-gram matches count as 0.1; without any common word the score is 0.
    """

    @F.pandas_udf("double")
    def run(hyp: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([0.0 if h is None or r is None else sentence_bleu(list(h), list(r)) for h, r in zip(hyp, ref)], dtype="float64")

    score = F.coalesce(run(split_words(F.lower(answer)), split_words(F.lower(truth))), F.lit(0.0))
    return F.when(is_blank(answer) | answer.contains(config.ERROR_MARKER), F.lit(0.0)).otherwise(score)
