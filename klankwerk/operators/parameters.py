"""Parameter inventories: tables ``name, shape`` matched by name and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """``name, status``: 'both', or 'missing' for one of ``ours`` that ``theirs`` lacks and 'surplus' the other way round.

    Names are compared exactly; null names are left out and repeated ones count once.
    """
    side = lambda df, c: df.select("name").where("name IS NOT NULL").distinct().withColumn(c, F.lit(True))
    both = side(ours, "_a").join(side(theirs, "_b"), "name", "full_outer")
    return both.select("name", F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "missing").otherwise("surplus").alias("status"))


def summary(shapes: DataFrame, bytes_each: int = 4) -> DataFrame:
    """One row: ``tensors``, ``parameters`` (products of shapes, an empty shape is one) and ``megabytes``; null shapes count nowhere."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x.cast("long"))
    total = shapes.where("shape IS NOT NULL").agg(F.count("*").alias("tensors"), F.coalesce(F.sum(size), F.lit(0)).alias("parameters"))
    return total.withColumn("megabytes", F.round(F.col("parameters") * bytes_each / float(1 << 20), 6))
