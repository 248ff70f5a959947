"""Masked training metrics and token sampling over long-form rows.

``sample, t, channel, target, predicted, loss`` is one prediction; padding targets do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from klankwerk.functions.training import gumbel
from klankwerk.schemas import PAD

FIRST_CHANNEL_WEIGHT = 4.0
FLOOR = 1e-8


def _mask(pad: int) -> Column:
    return F.when(F.col("target") != pad, 1.0).otherwise(0.0)


def loss_summary(rows: DataFrame, pad: int = PAD, first: float = FIRST_CHANNEL_WEIGHT) -> DataFrame:
    """One row: weighted loss, unweighted loss, accuracy, unpadded tokens and their share."""
    m = _mask(pad)
    w = m * F.when(F.col("channel") == 0, first).otherwise(1.0)
    hit = m * F.when(F.col("predicted") == F.col("target"), 1.0).otherwise(0.0)
    ratio = lambda a, b: F.round(F.coalesce(F.sum(a), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(b), F.lit(0.0)), F.lit(FLOOR)), 6)
    return rows.agg(
        ratio(F.col("loss") * w, w).alias("loss"), ratio(F.col("loss") * m, m).alias("mean_masked_loss"), ratio(hit, m).alias("accuracy"),
        F.coalesce(F.sum(m), F.lit(0.0)).cast("long").alias("tokens"), ratio(m, F.lit(1.0)).alias("non_pad_ratio"),
    )


def channel_summary(rows: DataFrame, pad: int = PAD) -> DataFrame:
    """``channel, loss, accuracy, tokens``; 0 where a channel is all padding."""
    m = _mask(pad)
    hit = m * F.when(F.col("predicted") == F.col("target"), 1.0).otherwise(0.0)
    part = lambda a: F.round(F.coalesce(F.sum(a) / F.nullif(F.sum(m), F.lit(0.0)), F.lit(0.0)), 6)
    return rows.groupBy("channel").agg(part(F.col("loss") * m).alias("loss"), part(hit).alias("accuracy"), F.sum(m).cast("long").alias("tokens"))


def mean_over_steps(rows: DataFrame, step: str, metric: str, value: str, accumulation: int) -> DataFrame:
    """Means of each metric over the completed runs of ``accumulation`` steps; a run that is not full is left out."""
    runs = rows.withColumn("run", F.floor(F.col(step) / accumulation)).groupBy("run", metric)
    return runs.agg(F.round(F.avg(value), 6).alias("mean"), F.count_distinct(step).alias("_n")).where(F.col("_n") == accumulation).drop("_n")


def top_k(logits: DataFrame, group: list[str], token: str, logit: str, k: int) -> DataFrame:
    """The ``k`` greatest logits of each group; ties go to the lower token."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(logit), token))
    return logits.where(F.col(logit).isNotNull()).withColumn("rank", rank).where(F.col("rank") <= k)


def top_p(logits: DataFrame, group: list[str], token: str, logit: str, p: float) -> DataFrame:
    """The most probable tokens until what comes before a token exceeds ``p``; the first always stays."""
    w = W.partitionBy(*group)
    probs = logits.where(F.col(logit).isNotNull()).withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(w)))
    probs = probs.withColumn("prob", F.col("_e") / F.sum("_e").over(w))
    before = F.coalesce(F.sum("prob").over(w.orderBy(F.desc("prob"), token).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return probs.withColumn("before", before).where(F.round("before", 9) <= p).drop("_e", "before")


def pick(logits: DataFrame, group: list[str], token: str, logit: str, temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """One token of each group: the greatest at temperature 0, else a draw from the softmax of logit / temperature."""
    key = [F.col(g) for g in group] + [F.col(token)]
    score = F.col(logit) if temperature == 0 else F.col(logit) / temperature + gumbel(seed, *key)
    return logits.where(F.col(logit).isNotNull()).groupBy(*group).agg(F.max_by(token, F.struct(score, -F.col(token))).alias("token"))
