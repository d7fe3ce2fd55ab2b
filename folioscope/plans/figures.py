"""The tables behind the evaluation figures, from one result table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.operators import analytics

BERT = ("bert_precision", "bert_recall", "bert_f1")
RADAR = ("contextual_fidelity", "factual_grounding", "instruction_following", "paas_score")


def figure_tables(results: DataFrame) -> dict[str, DataFrame]:
    """Precision/recall plane, speed and quality, guides, robustness, errors, radar."""
    regular = results.filter(F.col("evaluation_type") == "regular")
    return {
        "precision_recall": analytics.metric_means(regular, ["model"], BERT),
        "speed_quality": analytics.speed_quality(regular),
        "guides": analytics.median_guides(regular),
        "robustness": analytics.robustness(regular, BERT),
        "error_counts": analytics.error_counts(regular),
        "error_shares": analytics.error_shares(regular),
        "radar": analytics.min_max_normalised(analytics.metric_means(regular, ["model"], RADAR), RADAR),
    }
