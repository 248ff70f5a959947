"""A global running number in a given order, without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from klankwerk.runtime import staged


def positions(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """``df`` with its rows numbered from 0 in ``order``, which should be total; equal rows are numbered arbitrarily.

    Rows are range-partitioned and written down with their partition; the numbers before each partition come from one
    count per partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    fixed = staged(ordered, "ranges")
    counts = fixed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return fixed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + inner - 1).drop("_part", "_before")
