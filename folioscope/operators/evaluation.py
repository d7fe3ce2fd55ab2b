"""Scoring model answers and applying judge verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from folioscope import config
from folioscope.functions import prompts, scoring
from folioscope.functions.parsing import judge_scores, judge_spoiler_flag
from folioscope.functions.text import is_blank
from folioscope.operators.skew import lookup_join


def evaluation_grid(queries: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per model and query; the models are a short literal list."""
    return queries.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def query_sets(regular: DataFrame, spoiler: DataFrame) -> DataFrame:
    """Both query kinds, tagged, with the reading progress they assume."""
    first = regular.withColumns({"evaluation_type": F.lit("regular"), "progress_stage": F.lit(100)})
    second = spoiler.withColumns({"evaluation_type": F.lit("spoiler"), "progress_stage": F.col("percentage_of_book_read")})
    return first.unionByName(second, allowMissingColumns=True)


def sample_per_book(queries: DataFrame, per_book: int = 2) -> DataFrame:
    """First queries of each book, for a short run."""
    in_order = W.partitionBy("book_id").orderBy("query_id")
    return queries.withColumn("_n", F.row_number().over(in_order)).filter(F.col("_n") <= per_book).drop("_n")


def first_rules(rules: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """First rule per key; a partial aggregation."""
    rest = [c for c in rules.columns if c not in key]
    return rules.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*")


def spoiler_flags(
    answers: DataFrame, rules: DataFrame, key: Sequence[str], ids: Sequence[str], order: str, strict: bool = False
) -> DataFrame:
    """1 for safe answers, 0 where a forbidden keyword shows before its progress.

    A rule guards readers up to its percentage; ``strict`` only those below it. No
    rule, or a blank answer, is safe.
    """
    rule = first_rules(rules, key, order)
    joined = lookup_join(answers, rule, key, "left")
    progress, guard = F.col("progress_stage"), F.col("percentage_of_book_read")
    guarded = F.coalesce(progress < guard if strict else progress <= guard, F.lit(False))
    flag = F.when(guarded, scoring.spoiler_flag(F.col("answer"), F.col("forbidden_keywords"))).otherwise(1)
    return joined.withColumn("spoiler_prevention_flag", flag)


def score_answers(answers: DataFrame) -> DataFrame:
    """Overlap, BLEU, grounding, complexity, retrieval and error columns.

    ``answers``: question, answer, ground_truth, context, error, evaluation_type;
    everything is computed inside the row.
    """
    answer, truth = F.col("answer"), F.col("ground_truth")
    regular = F.col("evaluation_type") == "regular"
    return answers.withColumns(
        {
            "bleu": F.when(regular, scoring.bleu4(answer, truth)).otherwise(F.lit(0.0)),
            "factual_grounding": F.when(regular, scoring.factual_grounding(answer, truth)).otherwise(3),
            "retrieval_effectiveness": scoring.retrieval_effectiveness(F.col("question"), F.col("context")),
            "sentence_count": scoring.sentence_count(answer),
            "avg_sentence_length": scoring.avg_sentence_length(answer),
            "unique_word_ratio": scoring.unique_word_ratio(answer),
            "error_type": scoring.classify_error(answer, F.col("error")),
        }
    )


def judge_requests(results: DataFrame, strict: bool = False) -> DataFrame:
    """Prompts for the judge: quality of real answers, spoilers of guarded ones.

    Blank and failed answers are not judged for quality. ``results`` holds one row
    per result_id with book_id, question, answer, ground_truth, evaluation_type,
    progress_stage, percentage_of_book_read and forbidden_keywords.
    """
    answer = F.col("answer")
    regular = F.col("evaluation_type") == "regular"
    truth = F.when(regular, F.col("ground_truth")).otherwise(F.lit("none"))
    real = ~is_blank(answer)
    quality = F.when(real & ~answer.contains(config.ERROR_MARKER), prompts.quality_judgement(F.col("question"), truth, answer))
    progress, guard = F.col("progress_stage"), F.col("percentage_of_book_read")
    guarded = F.coalesce(progress < guard if strict else progress <= guard, F.lit(False))
    spoiler = F.when(
        ~regular & real & guarded, prompts.spoiler_judgement(F.col("book_id"), progress, F.col("forbidden_keywords"), answer)
    )
    asks = F.array(F.struct(F.lit("qualitative").alias("kind"), quality.alias("prompt")), F.struct(F.lit("spoiler").alias("kind"), spoiler.alias("prompt")))
    return results.select("result_id", F.explode(asks).alias("_a")).select("result_id", "_a.*").filter(F.col("prompt").isNotNull())


def apply_verdicts(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Judge replies onto results by their stable id, then the combined score.

    ``results``: result_id, answer, forbidden_keywords, spoiler_prevention_flag;
    ``verdicts``: result_id, kind ('qualitative' or 'spoiler'), reply. Results that
    were never judged keep their flag and get the default scores.
    """
    by_id = verdicts.groupBy("result_id").agg(
        F.max(F.when(F.col("kind") == "qualitative", F.col("reply"))).alias("_q"),
        F.max(F.when(F.col("kind") == "spoiler", F.col("reply"))).alias("_s"),
    )
    joined = results.join(by_id, "result_id", "left")
    scores = judge_scores(F.col("_q"))
    flag = F.when(F.col("_s").isNotNull(), judge_spoiler_flag(F.col("_s"), F.col("answer"), F.col("forbidden_keywords"))).otherwise(
        F.col("spoiler_prevention_flag")
    )
    named = joined.withColumn("_j", scores).withColumns(
        {
            **{k: F.coalesce(F.col(f"_j.{k}"), F.lit(config.JUDGE_DEFAULTS[k])) for k in config.JUDGE_KEYS},
            "spoiler_prevention_flag": flag,
        }
    )
    return named.withColumn("paas_score", scoring.paas(F.col("contextual_fidelity"), F.col("spoiler_prevention_flag"))).drop("_q", "_s", "_j")
