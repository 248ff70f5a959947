"""Cutting oversized recordings at natural boundaries with an overlap, by dynamic programming over cut positions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE = 600_000


@dataclass(frozen=True)
class CutCost:
    """What a piece from s to e costs; the plan with the least sum is taken, ties going to the later first cut.

    ``passed``: for each boundary later than e that the piece could still have reached. With this cost alone, taking
    the last boundary every time costs nothing and anything else costs more, so the plan is the one of longest pieces.
    ``imbalance``: for the squared difference from equal pieces, in units of the limit.
    ``hard``: for a cut where no boundary is in reach.
    """

    passed: float = 1.0
    imbalance: float = 0.0
    hard: float = 0.0


def plan_cuts(duration: int, boundaries: np.ndarray, limit: int, overlap: int, cost: CutCost) -> list[tuple[int, int, bool]]:
    """(start, end, ends at a boundary or the end of the item) of each piece.

    Dynamic programme over the ends of pieces, states being settled in rising order of their cost, so that what is
    dearer than the best plan is never looked at. A state is the end of a piece, the next piece starts ``overlap``
    before it; from a start s the candidates are the boundaries in (s + overlap, s + limit], or s + limit where there
    is none. The last piece begins where at most ``limit`` remains and ends with the item.
    """
    if duration <= limit:
        return [(0, duration, True)]
    bounds = np.unique(boundaries[(boundaries > overlap) & (boundaries < duration)]).astype(np.int64)
    pieces = -(-(duration - overlap) // (limit - overlap))
    target = (duration + (pieces - 1) * overlap) / pieces
    at_bound = np.full(len(bounds), np.inf)  # least cost known of a piece ending there
    came_bound = np.full(len(bounds), -1, dtype=np.int64)  # end of the piece before; -1 is the beginning
    loose: dict[int, tuple[float, int]] = {}  # the same for cuts off any boundary
    # of equal costs the later end is settled first, the end of the item before all others
    pending: list[tuple[float, int, int]] = [(0.0, 0, -1)]
    last = -1
    while pending:
        base, end, state = heappop(pending)
        if end == -duration:
            last = state
            break
        at = int(np.searchsorted(bounds, state)) if state >= 0 else len(bounds)
        known = min(float(at_bound[at]) if at < len(bounds) and bounds[at] == state else np.inf, loose.get(state, (np.inf, -1))[0])
        if state >= 0 and base > known + 1e-9:
            continue  # settled at less before
        start = 0 if state < 0 else state - overlap
        if duration - start <= limit:
            heappush(pending, (base + cost.imbalance * ((duration - start - target) / limit) ** 2, -duration, state))
            continue
        a, b = np.searchsorted(bounds, [start + overlap, start + limit], side="right")
        if a < b:
            total = base + cost.passed * np.arange(b - a - 1, -1, -1) + cost.imbalance * ((bounds[a:b] - start - target) / limit) ** 2
            better = a + np.flatnonzero(total < at_bound[a:b] - 1e-9)
            at_bound[better], came_bound[better] = total[better - a], state
            for i in better.tolist():
                heappush(pending, (float(at_bound[i]), -int(bounds[i]), int(bounds[i])))
        else:
            cut = start + limit
            total = base + cost.hard + cost.imbalance * ((limit - target) / limit) ** 2
            if cut not in loose or total < loose[cut][0] - 1e-9:
                loose[cut] = (total, state)
                heappush(pending, (total, -cut, cut))
    ends, natural, state = [duration], [True], last
    while state >= 0:
        i = int(np.searchsorted(bounds, state))
        here = i < len(bounds) and bounds[i] == state
        ends.append(state)
        natural.append(here)
        state = int(came_bound[i]) if here and at_bound[i] <= loose.get(state, (np.inf, -1))[0] else loose[state][1]
    ends.reverse()
    natural.reverse()
    starts = [0] + [e - overlap for e in ends[:-1]]
    return list(zip(starts, ends, natural))


def quiet_boundaries(spans: DataFrame, item: str, start: str, end: str, slice_len: int = SLICE) -> DataFrame:
    """``item, boundary``: ends of spans at which no other span of the item is running (start < t < end).

    At t nothing is running if as many spans started before t as ended by t. Both counts are prefix sums taken in two
    levels, over time slices of the item and within a slice, after reducing to one row per item and time; a slice has
    at most ``slice_len`` distinct times, so no window grows with the rows of an item. Spans with a null or with
    end <= start are ignored; repeated spans change nothing in the result. An empty input gives an empty result.
    """
    good = spans.select(F.col(item).alias("i"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("i IS NOT NULL AND s < e")
    points = good.select("i", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("u"), F.lit(0).alias("d")), F.struct(F.col("e").alias("t"), F.lit(0).alias("u"), F.lit(1).alias("d")))).alias("x"))
    points = points.select("i", F.floor(F.col("x.t") / slice_len).alias("b"), "x.t", "x.u", "x.d")
    before = W.partitionBy("i").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    slices = points.groupBy("i", "b").agg(F.sum(F.col("u") - F.col("d")).alias("x"))
    # what runs on into a slice comes in as a row before all its times
    carried = slices.select("i", "b", F.lit(None).cast("long").alias("t"), F.sum("x").over(before).alias("u"), F.lit(0).cast("long").alias("d")).where("u > 0")
    each = points.withColumn("u", F.col("u").cast("long")).withColumn("d", F.col("d").cast("long")).unionByName(carried)
    w = W.partitionBy("i", "b").orderBy(F.col("t").asc_nulls_first())
    running = F.coalesce(F.sum("u").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))
    # reduced to one row per time in each split, then sent by slice
    each = each.groupBy("i", "b", "t").agg(F.sum("u").alias("u"), F.sum("d").alias("d"))
    quiet = each.withColumn("running", running).where("d > 0 AND running = 0 AND t IS NOT NULL")
    return quiet.select(F.col("i").alias(item), F.col("t").alias("boundary"))


def split_items(items: DataFrame, item: str, length: str, spans: DataFrame, span_item: str, start: str, end: str, limit: int = 600_000, overlap: int = 15_000, cost: CutCost = CutCost()) -> DataFrame:
    """``item, piece_no, piece_start_ms, piece_end_ms, natural`` of every item longer than ``limit``.

    Lengths are whole numbers; items with a null length or one of at most ``limit`` do not come out, items without a
    usable span are cut every ``limit``. Repeated items count once (the greatest length). A null item is left out. An
    item's boundaries meet in one row as an array, 8 bytes a boundary.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    long = items.select(F.col(item).alias("i"), F.col(length).cast("long").alias("n")).where(F.col("i").isNotNull() & (F.col("n") > limit)).groupBy("i").agg(F.max("n").alias("n"))
    inside = spans.join(long.select(F.col("i").alias(span_item)), span_item, "left_semi")
    packed = quiet_boundaries(inside, span_item, start, end).withColumn("b", F.floor(F.col("boundary") / SLICE))
    packed = packed.groupBy(F.col(span_item).alias("i"), "b").agg(F.collect_list("boundary").alias("at"))
    whole = long.select("i", "n", F.lit(None).cast("array<bigint>").alias("at")).unionByName(packed.select("i", F.lit(None).cast("bigint").alias("n"), "at"))

    kind = items.schema[item].dataType
    out = T.StructType([T.StructField(item, kind), T.StructField("piece_no", T.IntegerType()), T.StructField("piece_start_ms", T.LongType()), T.StructField("piece_end_ms", T.LongType()), T.StructField("natural", T.BooleanType())])
    fields = to_arrow_schema(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans = [plan_cuts(n, np.asarray(at.values, dtype=np.int64), limit, overlap, cost) for n, at in zip(batch.column(1).to_pylist(), batch.column(2))]
            sizes = np.array([len(p) for p in plans], dtype=np.int64)
            flat = [x for p in plans for x in p]
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(plans)), sizes))), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), *([x[c] for x in flat] for c in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, fields)], schema=fields)

    # as many tasks as the session has shuffle partitions: the packed input is small, the planning is not
    whole = whole.repartition(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")), "i")
    whole = whole.groupBy("i").agg(F.max("n").alias("n"), F.flatten(F.collect_list("at")).alias("at"))
    return whole.mapInArrow(cut, out)
