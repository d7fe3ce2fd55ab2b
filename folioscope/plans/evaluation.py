"""An evaluation run: grid, answers, scores, verdicts, timing columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from folioscope.operators import analytics, evaluation
from folioscope.operators.maintenance import unfinished


def pending_work(queries: DataFrame, models: Sequence[str], results: DataFrame | None = None) -> DataFrame:
    """(model, query) pairs still to be answered."""
    grid = evaluation.evaluation_grid(queries, models)
    return grid if results is None else unfinished(grid, results)


def evaluate(
    answers: DataFrame,
    rules: DataFrame,
    verdicts: DataFrame | None = None,
    rule_key: Sequence[str] = ("item_id",),
    rule_order: str = "item_id",
    strict: bool = False,
) -> DataFrame:
    """Scored rows, one per model and query.

    ``answers``: result_id, model, evaluation_type, question, answer, ground_truth,
    context, error, progress_stage, response_time and the rule key. Without
    ``verdicts`` the judge columns get their defaults.
    """
    scored = evaluation.score_answers(answers)
    keyed = rules.select(*rule_key, "percentage_of_book_read", "forbidden_keywords", F.col(rule_order).alias("_rule_no"))
    flagged = evaluation.spoiler_flags(scored, keyed, list(rule_key), ["result_id"], "_rule_no", strict).drop("_rule_no")
    regular = F.col("evaluation_type") == "regular"
    flagged = flagged.withColumn("spoiler_prevention_flag", F.when(regular, 1).otherwise(F.col("spoiler_prevention_flag")))
    if verdicts is None:
        verdicts = flagged.sparkSession.createDataFrame([], "result_id long, kind string, reply string")
    return evaluation.apply_verdicts(flagged, verdicts)


def with_timing(results: DataFrame, regular_seconds: float, spoiler_seconds: float) -> DataFrame:
    """All timing, rank and percentile columns of a finished run."""
    total = regular_seconds + spoiler_seconds
    rows = analytics.with_speed(results).withColumns(
        {
            "evaluation_regular_duration": F.lit(float(regular_seconds)),
            "evaluation_spoiler_duration": F.lit(float(spoiler_seconds)),
            "evaluation_total_duration": F.lit(float(total)),
        }
    )
    ranks = analytics.with_speed_rank(results).select("result_id", "model_speed_rank")
    percentiles = analytics.with_speed_percentile(results).select("result_id", "response_speed_percentile")
    rates = F.broadcast(analytics.run_rates(results, total))  # a single row
    return rows.join(ranks, "result_id").join(percentiles, "result_id").crossJoin(rates)
