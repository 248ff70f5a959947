"""Filling containers of fixed capacity with items of varying length, by linear grouping.

Only the histogram of lengths (at most ``capacity`` rows, whatever the number of items) goes to the driver, where the
packing is planned for ranks: the k-th item of length n. Large lengths are rounded up within groups of equal
cardinality, configurations of the few rounded sizes are optimised by column generation, actual lengths are put in
place of rounded ones, and what room that leaves is filled best-fit with the small items. The plan is a table of rank
ranges per length, bounded by the capacity as well. Items get their rank from a count per split and length, and look
their container up in the plan: no item ever meets another in a task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from klankwerk.runtime import staged


# ---- planning on the histogram ----


def _best_config(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value: unbounded knapsack over the rounded sizes, by number of items."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        more, pick = best.copy(), np.full(capacity + 1, -1, dtype=np.int64)
        for j, (s, v) in enumerate(zip(sizes.tolist(), value.tolist())):
            gain = best[: capacity + 1 - s] + v
            up = gain > more[s:] + 1e-12
            more[s:][up], pick[s:][up] = gain[up], j
        if (pick < 0).all():
            break
        best = more
        picks.append(pick)
    config, c = np.zeros(len(sizes), dtype=np.int64), capacity
    for pick in reversed(picks):
        if pick[c] >= 0:
            config[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), config


def optimise_configs(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many containers of each: the linear programme by column generation, rounded down.

    Goes on until no configuration would help; only a run of 16 exchanges per size that change nothing (exchanges
    among equally good ones could go on for ever) ends it before.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    configs = [np.eye(m, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(m)]
    uses = demand / np.diag(basis)
    least, idle = uses.sum(), 0
    while idle <= 16 * m:
        value = np.linalg.solve(basis.T, np.ones(m))
        worth, config = _best_config(np.maximum(value, 0), sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, config.astype(float))
        ratio = np.where(step > 1e-9, uses / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out], configs[out] = config, config
        uses = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
        idle = 0 if uses.sum() < least * (1 - 1e-12) else idle + 1
        least = min(least, uses.sum())
    return [(configs[i], int(np.floor(uses[i] + 1e-9))) for i in range(m) if uses[i] >= 1]


class _Plan:
    """Rank ranges: for each length, items with rank in [lo, hi) go to containers ``first + (rank - lo) // per``."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int]] = []

    def put(self, length: int, lo: int, hi: int, first: int, per: int = 1) -> None:
        if hi > lo:
            self.rows.append((length, lo, hi, first, per))


def plan_containers(histogram: dict[int, int], capacity: int, small: float = 0.2, groups: int = 192) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan's rows and the number of containers; lengths are from 1 to ``capacity``."""
    plan = _Plan()
    edge = small * capacity
    large = sorted(((n, c) for n, c in histogram.items() if n > edge and c > 0), reverse=True)
    rest: dict[int, list[tuple[int, int]]] = {n: [(0, c)] for n, c in histogram.items() if 0 < n <= edge and c > 0}
    total = sum(c for _, c in large)
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of containers
    used = 0
    if total:
        # groups of equal cardinality over the lengths in falling order; a group takes its greatest length as size
        quota = max(1, -(-total // groups))
        members: list[list[list[int]]] = []  # of a group: [length, lo, hi] in falling order
        filled = quota
        for n, c in large:
            lo = 0
            while lo < c:
                if filled == quota:
                    members.append([])
                    filled = 0
                take = min(quota - filled, c - lo)
                members[-1].append([n, lo, lo + take])
                lo += take
                filled += take
        # neighbours with the same greatest length are one size
        merged: list[list[list[int]]] = []
        for g in members:
            if merged and merged[-1][0][0] == g[0][0]:
                merged[-1].extend(g)
            else:
                merged.append(g)
        sizes = np.array([g[0][0] for g in merged])
        demand = np.array([sum(hi - lo for _, lo, hi in g) for g in merged])
        left = [[tuple(x) for x in g] for g in merged]
        for config, copies in optimise_configs(sizes, demand, capacity):
            # slots of a group take its items in order; more copies than items are left out
            copies = min([copies, *[sum(hi - lo for _, lo, hi in left[g]) // int(config[g]) for g in np.flatnonzero(config)]])
            if copies <= 0:
                continue
            cuts = {0: 0, copies: 0}
            spans = []
            for g in np.flatnonzero(config):
                per, need = int(config[g]), copies * int(config[g])
                at, keep = 0, []
                for n, lo, hi in left[g]:
                    take = min(hi - lo, need - at)
                    if take > 0:
                        spans.append((at, at + take, n, lo, per))
                        at += take
                    if lo + max(take, 0) < hi:
                        keep.append((n, lo + max(take, 0), hi))
                left[g] = keep
            load = np.zeros(0)
            for a, b, n, lo, per in spans:
                # a range of slots may begin and end inside a container: those parts are rows of their own
                x, y = a, b
                if x % per:
                    end = min(y, x - x % per + per)
                    plan.put(n, lo, lo + end - x, used + x // per, per)
                    cuts.update({x // per: 0, x // per + 1: 0})
                    x = end
                if x < y:
                    plan.put(n, lo + x - a, lo + y - a, used + x // per, per)
                    cuts.update({x // per: 0, y // per: 0, -(-y // per): 0})
            marks = sorted(k for k in cuts if 0 <= k <= copies)
            load = np.zeros(len(marks) - 1)
            heads = np.array(marks[:-1])
            for a, b, n, _, per in spans:
                first, last = heads * per, heads * per + per
                load += n * np.maximum(0, np.minimum(last, b) - np.maximum(first, a))
            for k, v in enumerate(load):
                rooms.setdefault(capacity - int(v), []).append((used + marks[k], used + marks[k + 1]))
            used += copies
        for g in left:
            for n, lo, hi in g:
                rest.setdefault(n, []).append((lo, hi))
    # best fit of what is left, longest first, a range of containers at a time
    order = sorted(r for r in rooms if r > 0)
    for n in sorted(rest, reverse=True):
        for lo, hi in rest[n]:
            while lo < hi:
                k = bisect_left(order, n)
                if k == len(order):
                    per = capacity // n
                    count = (hi - lo) // per
                    if count:  # whole new containers of this length
                        plan.put(n, lo, lo + count * per, used, per)
                        room = capacity - per * n
                        lo += count * per
                        a, b = used, used + count
                    else:
                        plan.put(n, lo, hi, used, per)
                        room = capacity - (hi - lo) * n
                        lo = hi
                        a, b = used, used + 1
                    used = b
                else:
                    room = order[k]
                    a, b = rooms[room].pop()
                    # a container that is the tightest stays so until the length no longer fits
                    per = min(room // n, hi - lo)
                    take = min((hi - lo) // per, b - a)
                    if a + take < b:
                        rooms[room].append((a + take, b))
                        b = a + take
                    if not rooms[room]:
                        del rooms[room]
                        order.pop(k)
                    plan.put(n, lo, lo + take * per, a, per)
                    lo += take * per
                    room -= n * per
                if room > 0:
                    if room not in rooms:
                        insort(order, room)
                    rooms.setdefault(room, []).append((a, b))
    return plan.rows, used


# ---- ranks and lookup ----


def fill_containers(items: DataFrame, item: str, length: str, capacity: int, small: float = 0.2, groups: int = 192) -> DataFrame:
    """``item, piece, pieces, frames, container`` for each item, or each piece of an item above ``capacity``.

    An oversized item is cut into pieces of ``capacity`` and one of the rest; no other item is cut. Items of a null,
    zero or negative length take no room and come out with container null and ``pieces`` 0. A null item is an item.
    Repeated rows are items of their own. Other columns are ignored. An empty input gives an empty result. No
    container holds more than ``capacity``.
    """
    spark = items.sparkSession
    n = F.col(length).cast("long")
    parts = items.select(F.col(item).alias("i"), F.when(n > 0, n).alias("n"))
    parts = parts.withColumn("pieces", F.coalesce(F.ceil(F.col("n") / capacity), F.lit(0)).cast("int"))
    parts = parts.withColumn("piece", F.explode(F.when(F.col("pieces") > 1, F.sequence(F.lit(1), F.col("pieces"))).otherwise(F.array(F.lit(1)))))
    parts = parts.withColumn("frames", F.when(F.col("piece") < F.col("pieces"), F.lit(capacity)).otherwise(F.col("n") - (F.col("pieces") - 1) * capacity).cast("int"))
    # a split's number and the count of earlier items of that length in it, fixed by writing them down
    names = ["i", "piece", "pieces", "frames"]
    schema = parts.select(*names).schema.add("split", T.IntegerType()).add("k", T.LongType())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            f = batch.column("frames").fill_null(0).to_numpy(zero_copy_only=False)
            by = np.argsort(f, kind="stable")
            head = np.r_[True, f[by][1:] != f[by][:-1]] if len(f) else np.zeros(0, bool)
            since = np.arange(len(f)) - np.maximum.accumulate(np.where(head, np.arange(len(f)), 0))
            k = np.empty(len(f), dtype=np.int64)
            k[by] = since + seen[f[by]]
            seen += np.bincount(f, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(f), split, dtype=np.int32)), pa.array(k)], names=[*names, "split", "k"])

    numbered = staged(parts.select(*names).mapInArrow(number, schema), "lengths")
    counts = staged(numbered.where("frames IS NOT NULL").groupBy("frames", "split").agg(F.count("*").alias("c")), "length_counts")
    # at most `capacity` rows, however many items
    histogram = {int(r.frames): int(r.c) for r in counts.groupBy("frames").agg(F.sum("c").alias("c")).collect()}
    plan, _ = plan_containers(histogram, capacity, small, groups)
    earlier = W.partitionBy("frames").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("frames", "split", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    ranked = numbered.where("frames IS NOT NULL").join(offsets, ["frames", "split"]).select("i", "piece", "pieces", "frames", (F.col("before") + F.col("k")).alias("rank"))
    table = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)  # bounded by the capacity, not by the items

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        # one sorted key of length and first rank; ranks stay below 2**48
        at = (t[:, 0] << 48) + t[:, 1]
        for batch in batches:
            n, rank = batch.column("frames").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            row = np.searchsorted(at, (n << 48) + rank, side="right") - 1
            # a range that begins inside a container counts its slots from that container's first
            box = t[row, 3] + (rank - t[row, 1]) // t[row, 4]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(box)], names=[*names, "container"])

    placed = ranked.mapInArrow(lookup, numbered.select(*names).schema.add("container", T.LongType()))
    none = numbered.where("frames IS NULL").select(*names, F.lit(None).cast("bigint").alias("container"))
    return placed.unionByName(none).withColumnRenamed("i", item)
