"""Gaps and islands: overlapping intervals of an entity as continuous periods and the gaps between them.

The running maximum of earlier ends is taken in two levels. Intervals are first reduced to one row per entity and
start, each split for itself before anything is sent by entity, and cut into time slices; a slice of W milliseconds
holds at most W distinct starts, so no window ever sorts more than that, even where one entity has a third of all rows
and however many of them start together. A slice becomes its islands, one row each. Across slices only the last end of
each slice and the islands it reaches are compared; an island no other slice reaches is done where it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from klankwerk.runtime import staged

SLICE = 3_600_000


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, slice_len: int = SLICE, once: str | None = None) -> DataFrame:
    """Rows ``*keys, kind, start_ms, end_ms, intervals``; ``start`` and ``end`` are whole numbers.

    ``kind`` is 'period' (a maximal union of intervals that overlap or touch; ``intervals`` counts those in it) or
    'gap' (from the end of a period to the start of the next of the same entity; ``intervals`` is 0). Rows with a null
    in a key, start or end, or with end <= start, are ignored. Repeated rows count each; with ``once``, a column that
    names an interval, the other rows of one name count once (a null is a name as well; of rows that differ, the least
    of each column counts).
    Other columns are ignored. An empty input gives an empty result.
    """
    k = [f"k{i}" for i in range(len(keys))]
    place = [*k, "t"]
    clean = df.select(*[F.col(c).alias(n) for c, n in zip(keys, k)], F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), *([F.col(once).alias("i")] if once else []))
    clean = clean.where(" AND ".join(f"{n} IS NOT NULL" for n in k) + " AND e > s")
    if once:
        # rows of a name meet in a split by its hash, which is even; that split then reduces its rows per start
        parts = F.pmod(F.xxhash64("i"), F.lit(64 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))).cast("int").alias("b")
        clean = clean.select("*", parts).repartition("b").groupBy("b", "i").agg(*[F.min(c).alias(c) for c in (*k, "s", "e")])
    clean = clean.withColumn("t", F.floor(F.col("s") / slice_len))
    # one row per start: partial sums below the exchange, in each split by name or else by the aggregation itself
    starts = clean.groupBy(*(["b"] if once else []), *place, "s").agg(F.max("e").alias("e"), F.count("*").alias("n"))
    within = W.partitionBy(*place).orderBy("s")
    rows = (
        starts.repartition(*place)
        .groupBy(*place, "s")
        .agg(F.max("e").alias("e"), F.sum("n").alias("n"))
        .withColumn("p", F.max("e").over(within.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("own", F.max(F.when(F.col("p").isNull() | (F.col("s") > F.col("p")), F.col("s"))).over(within.rowsBetween(W.unboundedPreceding, 0)))
    )
    # islands of a slice for itself; ``p`` is the end before it in the slice, null for the first
    islands = rows.groupBy(*place, "own").agg(F.max("e").alias("e"), F.sum("n").alias("n"), F.min_by("p", "s").alias("p"))
    islands = islands.withColumn("last", F.lead("own").over(W.partitionBy(*place).orderBy("own")).isNull())
    islands = staged(islands, "islands")

    # what earlier slices of the entity reach: islands are in order and apart, so the last has a slice's greatest end
    earlier = W.partitionBy(*k).orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    reach = islands.where("last").select(*place, F.max("e").over(earlier).alias("before")).where("before IS NOT NULL")
    reach = staged(reach, "reach")
    seen = islands.join(reach, place, "left")
    # an island that starts at or before that end goes on with an earlier one; one that ends in a later slice may be gone on with
    lost = F.coalesce(F.col("own") <= F.col("before"), F.lit(False))
    open_ = F.col("last") & (F.col("e") >= (F.col("t") + 1) * slice_len)
    # of the islands of a slice that are not lost the first follows on what came before, in the slice or earlier
    seen = seen.withColumn("lost", lost).withColumn("p", F.greatest("p", "before"))
    alone = seen.where(~F.col("lost") & ~open_)
    linked = staged(seen.where(F.col("lost") | open_), "linked")
    # the island a lost one goes on with is the last opened before it: none in between is apart from it
    opened = linked.where("NOT lost").select(*place, F.col("own").alias("label"))
    reached = linked.where("lost").select(*place).distinct().withColumn("label", F.lit(None).cast("long"))
    label = opened.unionByName(reached).groupBy(*place).agg(F.max("label").alias("label"))
    label = label.select(*place, F.max("label").over(earlier).alias("label")).where("label IS NOT NULL")
    joined = linked.where("lost").join(label, place).select(*k, "label", "e", "n")
    joined = joined.unionByName(linked.where("NOT lost").select(*k, F.col("own").alias("label"), "e", "n"))
    whole = joined.groupBy(*k, "label").agg(F.max("e").alias("e"), F.sum("n").alias("n"))

    named = [F.col(n).alias(c) for c, n in zip(keys, k)]
    gap = F.struct(F.lit("gap").alias("kind"), F.col("p").alias("s"), F.col("own").alias("e"), F.lit(0).cast("long").alias("n"))
    period = F.struct(F.lit("period").alias("kind"), F.col("own").alias("s"), F.col("e"), F.col("n"))
    out = lambda rows: rows.select(*named, F.col("x.kind").alias("kind"), F.col("x.s").alias("start_ms"), F.col("x.e").alias("end_ms"), F.col("x.n").alias("intervals"))
    at_once = out(alone.select(*k, F.explode(F.array_compact(F.array(period, F.when(F.col("p").isNotNull(), gap)))).alias("x")))
    gaps = out(linked.where("NOT lost AND p IS NOT NULL").select(*k, gap.alias("x")))
    merged = out(whole.withColumn("own", F.col("label")).select(*k, period.alias("x")))
    return at_once.unionByName(gaps).unionByName(merged)
