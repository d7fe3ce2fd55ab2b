"""Statistics, ranks and figure tables over evaluation results.

Results have few models and types but any number of rows, so groups are reduced by
partial aggregation first, and ranks over rows are derived from those reductions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.functions.scoring import clipped_log10
from folioscope.operators.skew import lookup_join, null_safe_join, segmented_row_number, segmented_running_sums

HOT_SHARE = 1000  # a key with over 1/1000 of the rows is hot: at most 1000 of them


def scaled_columns(results: DataFrame) -> DataFrame:
    """Log and scaled copies used by the figures."""
    return results.withColumns(
        {
            "response_time_log": clipped_log10(F.col("response_time")),
            "retrieval_effectiveness_log": clipped_log10(F.col("retrieval_effectiveness")),
            "bleu_scaled": F.col("bleu") * 1000,
        }
    )


def model_stats(results: DataFrame) -> DataFrame:
    time = F.col("response_time")
    return results.groupBy("model").agg(
        F.count(time).alias("model_query_count"), F.bround(F.sum(time), 2).alias("model_total_time"),
        F.bround(F.avg(time), 2).alias("model_avg_time"), F.bround(F.stddev_samp(time), 2).alias("model_time_stddev"),
    )


def type_stats(results: DataFrame) -> DataFrame:
    time = F.col("response_time")
    return results.groupBy("evaluation_type").agg(
        F.count(time).alias("type_query_count"), F.bround(F.sum(time), 2).alias("type_total_time"),
        F.bround(F.avg(time), 2).alias("type_avg_time"),
    )


def run_rates(results: DataFrame, total_seconds: float) -> DataFrame:
    """Rows, average time per query and queries per minute of a whole run."""
    n = F.count(F.lit(1))
    return results.agg(
        n.alias("total_queries_in_run"),
        F.when(n > 0, F.lit(total_seconds) / n).otherwise(F.lit(0.0)).alias("avg_time_per_query"),
        F.when((n > 0) & F.lit(total_seconds > 0), F.lit(60.0) / (F.lit(total_seconds) / n)).otherwise(F.lit(0.0)).alias("queries_per_minute"),
    )


def throughput(results: DataFrame) -> DataFrame:
    """Per model: total time, mean time, queries per minute, number of queries."""
    time = F.col("response_time")
    return results.groupBy("model").agg(
        F.sum(time).alias("total_time"), F.avg(time).alias("avg_time"),
        (F.lit(60.0) / F.nullif(F.avg(time), F.lit(0.0))).alias("queries_per_minute"), F.count(F.lit(1)).alias("n_queries"),
    )


def with_speed(results: DataFrame) -> DataFrame:
    """Rows with group statistics, efficiency and relative speed."""
    rows = lookup_join(results, model_stats(results), ["model"])
    rows = lookup_join(rows, type_stats(results), ["evaluation_type"])
    return rows.withColumns(
        {
            "model_efficiency_score": F.col("model_query_count") / F.nullif(F.col("model_total_time"), F.lit(0.0)),
            "relative_speed_vs_avg": F.col("response_time") / F.nullif(F.col("model_avg_time"), F.lit(0.0)),
        }
    )


def with_speed_rank(results: DataFrame) -> DataFrame:
    """Minimum rank of the model's mean time among the rows of the same type.

    The rank of a row is one plus the rows of faster models, so it is found on the
    table of row counts per type and model.
    """
    counts = results.groupBy("evaluation_type", "model").agg(F.count("response_time").alias("_n"))
    timed = null_safe_join(counts, model_stats(results).select("model", "model_avg_time"), ["model"])
    faster = W.partitionBy("evaluation_type").orderBy("model_avg_time").rangeBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy("evaluation_type", "model_avg_time")
    ranked = timed.select(
        "evaluation_type", "model", "model_avg_time",
        (F.sum("_n").over(faster) - F.sum("_n").over(same) + 1).alias("model_speed_rank"),
    )
    return lookup_join(results, ranked, ["evaluation_type", "model"])


def time_segment(column: str) -> Column:
    """Order-preserving segment of a non-negative number: 200 per power of ten."""
    return F.floor(clipped_log10(F.col(column)) * 200)


def with_speed_percentile(results: DataFrame) -> DataFrame:
    """Percentile of the response time within its model, ties at their mean rank.

    Rows without a time keep no percentile and do not count; rows without a model are a group of their own.
    Rows are reduced to counts per (model, time), accumulated segment by segment.
    Joining back, the few values repeated in over a thousandth of all rows are
    broadcast (there can be at most a thousand), the rest meet by plain equality.
    """
    key = ["model", "response_time"]
    counts = results.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    timed = F.when(F.col("response_time").isNotNull(), F.col("_n")).otherwise(0)
    placed = segmented_running_sums(counts, ["model"], ["response_time"], time_segment("response_time"), {"_before": timed})
    totals = counts.where("response_time is not null").groupBy("model").agg(F.sum("_n").alias("_all"))
    everything = counts.agg(F.sum("_n")).scalar()
    share = F.when(F.col("response_time").isNotNull(), (F.col("_before") + (F.col("_n") + 1) / 2) / F.col("_all") * 100)
    values = lookup_join(placed, totals, ["model"], "left").select(
        *key, share.alias("response_speed_percentile"), (F.col("_n") * HOT_SHARE > everything).alias("_hot")
    )
    hot = F.broadcast(values.filter("_hot").drop("_hot"))
    cold = values.filter("not _hot").drop("_hot")
    return null_safe_join(results, hot, key).unionByName(null_safe_join(null_safe_join(results, hot, key, "left_anti"), cold, key))


def error_counts(results: DataFrame) -> DataFrame:
    """(model, error_type, n) of every error type that occurs; error-free models are left out."""
    return results.filter(F.col("error_type") != "none").groupBy("model", "error_type").agg(F.count(F.lit(1)).alias("n"))


def error_shares(results: DataFrame) -> DataFrame:
    """Share of each error type among all of a model's errors, in percent; one row per model and type."""
    everything = F.sum("n").over(W.partitionBy("model"))
    return error_counts(results).select("model", "error_type", (F.col("n") / everything * 100).alias("share"))


def metric_means(results: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return results.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def summary_line(results: DataFrame) -> DataFrame:
    """Safe answers, their share, and mean quality of a whole run."""
    safe = F.count_if(F.col("spoiler_prevention_flag") == 1)
    return results.agg(
        safe.alias("spoiler_safe"), F.count(F.lit(1)).alias("n_results"),
        (safe / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100).alias("spoiler_safe_pct"),
        F.avg("bert_f1").alias("mean_f1"), F.avg("paas_score").alias("mean_paas"),
    )


def model_summary(results: DataFrame) -> DataFrame:
    metrics = ["bert_f1", "paas_score", "spoiler_prevention_flag", "response_time"]
    return results.groupBy("model").agg(*[F.bround(F.avg(m), 3).alias(m) for m in metrics])


def speed_quality(results: DataFrame) -> DataFrame:
    """Per model: mean time, quality and context, efficiency, frontier membership.

    One row per model reaches the running maximum.
    """
    means = metric_means(results, ["model"], ["response_time", "bert_f1", "context_count"])
    before = W.orderBy("response_time", F.col("bert_f1").desc(), "model").rowsBetween(W.unboundedPreceding, -1)
    best = F.max("bert_f1").over(before)
    return means.withColumns(
        {
            "efficiency": F.col("bert_f1") / F.nullif(F.col("response_time"), F.lit(0.0)),
            "on_frontier": best.isNull() | (F.col("bert_f1") > best),
        }
    )


def median_guides(results: DataFrame) -> DataFrame:
    """Medians of the model means."""
    means = metric_means(results, ["model"], ["response_time", "bert_f1"])
    return means.agg(F.median("response_time").alias("median_time"), F.median("bert_f1").alias("median_f1"))


def min_max_normalised(means: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Each metric scaled to 0..1 over the rows; constant metrics stay as they are."""
    ends = means.agg(*[f(m).alias(f"_{n}_{m}") for m in metrics for n, f in (("lo", F.min), ("hi", F.max))])
    rows = means.crossJoin(F.broadcast(ends))  # a single row
    scaled = {
        m: F.when(F.col(f"_hi_{m}") > F.col(f"_lo_{m}"), (F.col(m) - F.col(f"_lo_{m}")) / (F.col(f"_hi_{m}") - F.col(f"_lo_{m}"))).otherwise(F.col(m))
        for m in metrics
    }
    return rows.withColumns(scaled).select(*means.columns)


_LABELS = ("low", "mid", "high")


def context_bins(results: DataFrame) -> DataFrame:
    """Thirds of the context count: low, mid, high.

    Edges are the exact third quantiles over counts per value. When two edges
    coincide, rows are ranked by (count, id) and the ranks cut into thirds; with a
    single row everything is in one bin.
    """
    counts = results.groupBy("context_count").agg(F.count(F.lit(1)).alias("_n"))
    edges = counts.agg(
        F.expr("percentile(context_count, array(0D, 1D/3, 2D/3, 1D), _n)").alias("_e"), F.sum("_n").alias("_rows")
    )
    e0, e1, e2, e3, n = edges.select(*[F.col("_e")[i] for i in range(4)], "_rows").first()
    value = F.col("context_count")
    if e0 is not None and e0 < e1 < e2 < e3:
        bin_of = F.when(value <= e1, _LABELS[0]).when(value <= e2, _LABELS[1]).otherwise(_LABELS[2])
        return results.withColumn("context_bin", bin_of)
    if n is None or n < 2:
        return results.withColumn("context_bin", F.lit("all"))
    smaller = counts.withColumn("_below", F.coalesce(F.sum("_n").over(W.orderBy("context_count").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = segmented_row_number(results, ["context_count"], ["result_id"], F.floor(F.col("result_id") / 4096), "_within")
    ranked = lookup_join(numbered, smaller.select("context_count", "_below"), ["context_count"])
    rank = F.col("_below") + F.col("_within")
    bin_of = F.when(rank <= 1 + (n - 1) / 3, _LABELS[0]).when(rank <= 1 + 2 * (n - 1) / 3, _LABELS[1]).otherwise(_LABELS[2])
    return ranked.withColumn("context_bin", bin_of).drop("_within", "_below")


def robustness(results: DataFrame, metrics: Sequence[str], min_stages: int = 3) -> DataFrame:
    """Metric means per model and reading stage.

    With at most ``min_stages`` different stages the context count, in thirds,
    stands in for the stage.
    """
    stages = results.agg(F.count_distinct("progress_stage")).first()[0]
    if stages > min_stages:
        staged = results.withColumn("stage", F.col("progress_stage").cast("string"))
    else:
        staged = context_bins(results).withColumn("stage", F.col("context_bin"))
    return metric_means(staged, ["model", "stage"], metrics)
