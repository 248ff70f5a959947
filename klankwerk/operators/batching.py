"""Shards, batches, shuffles, samples and choices for training input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from klankwerk.functions.training import uniform
from klankwerk.operators.positions import positions
from klankwerk.schemas import CHUNKS_PER_SHARD, TEXT_CLEAN_P, TEXT_DROPOUT_P


BLOCK = 1 << 16


def sharded(df: DataFrame, order: Sequence[str], per_shard: int = CHUNKS_PER_SHARD) -> DataFrame:
    """Rows with ``position``, ``shard`` (contiguous runs of ``per_shard``) and ``place`` in it, and the number of shards."""
    rows = positions(df, order)
    shards = rows.select(F.coalesce(F.ceil(F.count("*") / per_shard), F.lit(0))).scalar()
    return rows.withColumn("shard", F.floor(F.col("position") / per_shard)).withColumn("place", F.col("position") % per_shard).withColumn("shards", shards)


def batched(df: DataFrame, batch: int, place: str = "place", shard: str = "shard") -> DataFrame:
    """Rows with ``batch_no`` in their shard; the last rows of a shard that fill no batch are left out.

    ``place`` numbers the rows of a shard from 0.
    """
    sizes = df.groupBy(shard).agg(F.count("*").alias("_n"))
    full = df.join(sizes, shard).where(F.col(place) < F.floor(F.col("_n") / batch) * batch)
    return full.withColumn("batch_no", F.floor(F.col(place) / batch)).drop("_n")


def shuffled(df: DataFrame, keys: Sequence[str], seed: int = 42, epoch: int = 0, shard: str | None = None, name: str = "shuffled_place") -> DataFrame:
    """A permutation, of all rows or within each shard, that depends on the keys and the seed alone.

    Epochs share one order, as in the reference behaviour, unless ``epoch`` differs.
    """
    draw = df.withColumn("_u", F.xxhash64(F.lit(seed), F.lit(epoch), *keys))
    if shard is None:
        return positions(draw, ["_u", *keys], name).drop("_u")
    return draw.withColumn(name, F.row_number().over(W.partitionBy(shard).orderBy("_u", *keys)) - 1).drop("_u")


def drawn_with_replacement(df: DataFrame, weight: str, keys: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """Rows with ``draws`` > 0: how often each comes in ``size`` draws in proportion to ``weight``.

    Systematic sampling: the cumulative weights, in the order of a hash of the keys, are met by equally spaced points
    from a random start, so each row is drawn its expected number of times rounded up or down and the draws sum to
    ``size``. Null, NaN and negative weights count as 0.
    """
    w = F.when(F.col(weight).isNotNull() & ~F.isnan(F.col(weight).cast("double")) & (F.col(weight) > 0), F.col(weight).cast("double")).otherwise(0.0)
    rows = positions(df.withColumn("_w", w).withColumn("_u", F.xxhash64(F.lit(seed), *keys)), ["_u", *keys], "_p")
    # sums of blocks of rows, and of blocks of blocks, so that no window holds more than a block of either
    rows = rows.withColumn("_b", F.floor(F.col("_p") / BLOCK))
    sums = rows.groupBy("_b").agg(F.sum("_w").alias("_s")).withColumn("_c", F.floor(F.col("_b") / BLOCK))
    upper = sums.groupBy("_c").agg(F.sum("_s").alias("_t"))
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    upper = upper.select("_c", ahead("_t", W.orderBy("_c")).alias("_u"))  # a row for each 2**32 rows
    before = sums.join(F.broadcast(upper), "_c").select("_b", (F.col("_u") + ahead("_s", W.partitionBy("_c").orderBy("_b"))).alias("_before"))
    total = sums.select(F.sum("_s")).scalar()
    upto = F.col("_before") + F.sum("_w").over(W.partitionBy("_b").orderBy("_p").rowsBetween(W.unboundedPreceding, 0))
    start = float(size) and (hash((seed, size)) % 9973) / 9973.0
    point = lambda x: F.floor(F.round(x / total * F.lit(float(size)), 9) - F.lit(start) + 1)
    done = rows.drop("_u").join(before, "_b").withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_w"))
    done = done.withColumn("draws", (F.least(point(F.col("_to")), F.lit(size)) - F.least(point(F.col("_from")), F.lit(size))).cast("int"))
    return done.where("draws > 0").drop("_w", "_p", "_b", "_before", "_to", "_from")


def drawn_without_replacement(df: DataFrame, weight: str, keys: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """``size`` rows, a row's chance growing with its weight (the least exponential arrival times are taken)."""
    arrival = -F.ln(uniform(seed, *[F.col(k) for k in keys])) / F.col(weight)
    return df.where(F.col(weight) > 0).withColumn("_a", arrival).orderBy("_a", *keys).limit(size).drop("_a")


def chosen_text(transcription: Column, clean: Column, keys: Sequence[str], seed: int = 42, clean_p: float = TEXT_CLEAN_P, dropout_p: float = TEXT_DROPOUT_P) -> Column:
    """The clean transcript with probability ``clean_p``, else the other; '' with probability ``dropout_p``. Null is ''."""
    key = [F.col(k) for k in keys]
    text = F.when(uniform(seed, *key) < clean_p, clean).otherwise(transcription)
    return F.when(uniform(seed + 1, *key) < dropout_p, F.lit("")).otherwise(F.coalesce(text, F.lit("")))


def left_over(shards: DataFrame, present: DataFrame, key: str = "shard") -> DataFrame:
    """Rows of the shards that are not there yet."""
    return shards.join(present.select(key).distinct(), key, "left_anti")
