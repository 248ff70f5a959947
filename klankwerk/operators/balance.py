"""Sampling probabilities, class-balance weights and dataset summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klankwerk.functions.text import not_blank
from klankwerk.schemas import ALPHA, BETA, P_MAX, P_MIN, TAU, UNIT_SEC, W_MAX, W_MIN


def sampling_probability(totals: DataFrame, seconds: str = "duration_sec", name: str = "sample_prob", alpha: float = ALPHA, tau: float = TAU, low: float = P_MIN, high: float = P_MAX) -> DataFrame:
    """Probability of each row in proportion to (seconds + tau) ** alpha, clamped, and normalised once more.

    The last step may carry values past the bounds again; they sum to 1. Null seconds count as 0.
    """
    smooth = totals.withColumn("_w", F.pow(F.coalesce(F.col(seconds), F.lit(0.0)) + F.lit(tau), F.lit(alpha)))
    clamped = smooth.withColumn("_c", F.greatest(F.least(F.col("_w") / smooth.select(F.sum("_w")).scalar(), F.lit(high)), F.lit(low)))
    return clamped.withColumn(name, F.col("_c") / clamped.select(F.sum("_c")).scalar()).drop("_w", "_c")


def class_balance_weight(seconds: Column, beta: float = BETA, unit: float = UNIT_SEC, low: float = W_MIN, high: float = W_MAX) -> Column:
    """(1 - beta) / (1 - beta ** n) for n = seconds / unit, at least 1; clamped."""
    n = F.greatest(seconds / unit, F.lit(1.0))
    return F.greatest(F.least((1 - beta) / (1 - F.pow(F.lit(beta), n)), F.lit(high)), F.lit(low))


def speaker_stats(totals: DataFrame) -> DataFrame:
    """``speaker_id, duration_sec, sample_prob, cb_weight``."""
    rows = sampling_probability(totals)
    return rows.select("speaker_id", "duration_sec", F.round("sample_prob", 9).alias("sample_prob"), F.round(class_balance_weight(F.col("duration_sec")), 9).alias("cb_weight"))


def dataset_summary(shard: DataFrame) -> DataFrame:
    """One row: rows, ranges of duration, probability and weight, rows with a transcription, distinct sources."""
    spread = [f(c).alias(f"{n}_{c}") for c in ("duration_ms", "sample_prob", "cb_weight") for n, f in (("min", F.min), ("max", F.max))]
    texts = [F.count_if(not_blank(F.col(c))).alias(f"with_{c}") for c in ("transcription", "transcription_clean")]
    return shard.agg(F.count("*").alias("row_count"), *spread, *texts, F.count_distinct("source_file").alias("source_files"))


def value_histogram(df: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """``value, row_count, percent`` of the rounded values; nulls are left out of both."""
    rows = df.where(F.col(column).isNotNull()).groupBy(F.round(column, digits).alias("value")).agg(F.count("*").alias("row_count"))
    return rows.withColumn("percent", F.round(100 * F.col("row_count") / rows.select(F.sum("row_count")).scalar(), 6))
