"""The most similar vectors of every vector, by scans or small-world graphs of shards whose results are merged.

Equal directions are one class first. The classes are cut into shards of a bounded number of vectors by centroids of two
levels, so that similar vectors mostly share a shard: about sqrt(cells) upper centroids from a bounded sample, and for
each upper cell lower centroids from a sample of its own vectors, as many as it has shards. Every vector is looked up in
the shards of its nearest lower centroids, found among those of its upper cell and the upper cells next to it, and the
results of a vector's shards are merged. A shard is scanned whole, by products of blocks. On request it becomes a
hierarchical navigable small-world graph instead, kept as flat arrays of neighbours. What a task holds is one shard and
one block of queries, or one block of vectors and the lower centroids about it. The shards a vector visits grow with the
root of their number: with a fixed number of visits, ever more neighbours would be missed as the vectors grow.

Vectors travel packed without loss: numbers that are multiples of one power of two take a byte or two each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from klankwerk.runtime import staged

#: Vectors of a shard that is scanned, and of one that becomes a graph.
SHARD, GRAPH_SHARD = 24_576, 3072
QUERIES = 65_536
ROUTED = 65_536
SAMPLE, EACH = 65_536, 1024
#: A vector visits so many shards at least, and that many times the root of their number.
PROBES, SPREAD = 6, 1.25
BESIDE = 15
LINKS = 12
CANDIDATES = 48
BEAM = 16
FAN = 4


# ---- packed vectors ----


def pack_rows(x: np.ndarray) -> list[bytes]:
    """Finite float32 rows as bytes: a byte for the width w, two for an exponent e, then integers of w bytes times 2**e.

    Rows that fit no such integers of one or two bytes are kept as float32 (width 4, exponent 0). Nothing is lost.
    """
    bits = np.ascontiguousarray(x, dtype=np.float32).view(np.int32)
    mantissa, power = (bits & 0x7FFFFF).astype(np.int64), (bits >> 23) & 0xFF
    mantissa = np.where(power > 0, mantissa | 0x800000, mantissa)
    lowest = mantissa & -mantissa
    # the exponent of the lowest bit that is set in any number of the row
    low = np.where(mantissa > 0, np.log2(np.maximum(lowest, 1)).astype(np.int64) + np.maximum(power, 1) - 150, 1000).min(axis=1)
    low = np.where(low == 1000, 0, low).astype(np.int16)
    whole = np.ldexp(x.astype(np.float64), -low.astype(np.int64)[:, None])
    top = np.abs(whole).max(axis=1, initial=0)
    out = []
    for row, w, e, t in zip(x, whole, low, top):
        if t <= 127:
            out.append(b"\1" + e.tobytes() + w.astype(np.int8).tobytes())
        elif t <= 32767:
            out.append(b"\2" + e.tobytes() + w.astype(np.int16).tobytes())
        else:
            out.append(b"\4\0\0" + row.astype(np.float32).tobytes())
    return out


def unpack_rows(blobs: list[bytes], dim: int) -> np.ndarray:
    """The float32 rows of ``pack_rows``."""
    out = np.empty((len(blobs), dim), dtype=np.float32)
    width = np.fromiter((b[0] for b in blobs), dtype=np.int64, count=len(blobs))
    for w, kind in ((1, np.int8), (2, np.int16), (4, np.float32)):
        at = np.flatnonzero(width == w)
        if len(at):
            raw = np.frombuffer(b"".join([blobs[i] for i in at.tolist()]), dtype=np.uint8).reshape(len(at), 3 + w * dim)
            low = np.ascontiguousarray(raw[:, 1:3]).view(np.int16)[:, 0].astype(np.int32)
            out[at] = np.ldexp(np.ascontiguousarray(raw[:, 3:]).view(kind).astype(np.float32), low[:, None])
    return out


# ---- one shard's graph ----


def _select(order: np.ndarray, sims: np.ndarray, unit: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (most similar first, -1 for none) those nearer to the row than to any taken before."""
    n, width = order.shape
    kept = np.full((n, most), -1, dtype=np.int32)
    count = np.zeros(n, dtype=np.int64)
    taken = np.zeros((n, width), dtype=bool)
    for c in range(width):
        here = (order[:, c] >= 0) & (count < most)
        if not here.any():
            continue
        rows = np.flatnonzero(here)
        cand = order[rows, c]
        near = np.full(len(rows), -2.0, dtype=np.float32)
        for k in range(most):
            with_k = count[rows] > k
            if not with_k.any():
                break
            r = rows[with_k]
            near[with_k] = np.maximum(near[with_k], np.einsum("ij,ij->i", unit[cand[with_k]], unit[kept[r, k]]))
        good = near < sims[rows, c]
        r = rows[good]
        kept[r, count[r]] = cand[good]
        taken[r, c] = True
        count[r] += 1
    # places left over go to the most similar of the others
    for c in range(width):
        r = np.flatnonzero((order[:, c] >= 0) & ~taken[:, c] & (count < most))
        kept[r, count[r]] = order[r, c]
        count[r] += 1
    return kept


def _layer(unit: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Neighbours of ``nodes`` (in order of insertion) among themselves, as indices into ``unit``.

    A node's links are chosen from the most similar of those inserted before it; links back are added and the lists
    pruned by the same rule.
    """
    n, x = len(nodes), unit[nodes]
    width = min(CANDIDATES, n)
    sims = x @ x.T
    earlier = np.where(np.tri(n, k=-1, dtype=bool), sims, -3.0)
    top = np.argpartition(-earlier, width - 1, axis=1)[:, :width] if n > width else np.tile(np.arange(n), (n, 1))
    value = np.take_along_axis(earlier, top, axis=1)
    by = np.argsort(-value, axis=1, kind="stable")
    top, value = np.take_along_axis(top, by, axis=1), np.take_along_axis(value, by, axis=1)
    forward = _select(np.where(value > -2.5, top, -1), value, x, most)
    i, k = np.nonzero(forward >= 0)
    j = forward[i, k]
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    s = sims[a, b]
    by = np.lexsort((-s, a))
    a, b, s = a[by], b[by], s[by]
    starts = np.searchsorted(a, np.arange(n))
    slot = np.arange(len(a)) - starts[a]
    room = slot < 2 * CANDIDATES
    order, value = np.full((n, 2 * CANDIDATES), -1, dtype=np.int64), np.full((n, 2 * CANDIDATES), -3.0, dtype=np.float32)
    order[a[room], slot[room]], value[a[room], slot[room]] = b[room], s[room]
    links = _select(order, value, x, 2 * most)
    return np.where(links >= 0, nodes[np.maximum(links, 0)], -1).astype(np.int32)


def build_graph(unit: np.ndarray, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Flat arrays of a graph over unit vectors: ``base`` (n x 2M), ``upper`` (one row per node and level), ``levels``."""
    n = len(unit)
    order = np.argsort(keys, kind="stable")  # keys are hashes: insertion is in random order, the same each time
    u = (np.arange(n) + 0.5) / n
    level = np.minimum(np.floor(-np.log(u[np.random.default_rng(7).permutation(n)]) / np.log(LINKS)).astype(np.int32), 6)
    base = np.full((n, 2 * LINKS), -1, dtype=np.int32)
    base[order] = _layer(unit, order, LINKS)
    upper, heads = [], [0]
    for lv in range(1, int(level.max(initial=0)) + 1):
        nodes = order[level[order] >= lv]
        upper.append(np.column_stack([nodes.astype(np.int32), _layer(unit, nodes, LINKS)]))
        heads.append(heads[-1] + len(nodes))
    flat = np.concatenate(upper) if upper else np.zeros((0, 2 * LINKS + 1), dtype=np.int32)
    return {"base": base, "upper": flat, "heads": np.asarray(heads, dtype=np.int32)}


def search_graph(unit: np.ndarray, graph: dict[str, np.ndarray], queries: np.ndarray, k: int, beam: int = BEAM, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(indices, similarities) of the ``k`` nodes most similar to each query that the graph leads to, -1 for none."""
    n, heads = len(unit), graph["heads"]
    k = min(k, n)
    beam = max(beam, k)
    found, score = np.full((len(queries), k), -1, dtype=np.int64), np.full((len(queries), k), -2.0, dtype=np.float32)
    where = {}
    for lv in range(len(heads) - 1, 0, -1):
        rows = graph["upper"][heads[lv - 1] : heads[lv]]
        at = np.full(n, -1, dtype=np.int64)
        at[rows[:, 0]] = np.arange(len(rows))
        where[lv] = (rows[:, 1:], at)
    entry = int(graph["upper"][heads[-2], 0]) if len(heads) > 1 else 0
    for lo in range(0, len(queries), block):
        q = queries[lo : lo + block]
        m = len(q)
        here = np.full(m, entry, dtype=np.int64)
        best = q @ unit[entry]
        for lv in sorted(where, reverse=True):
            links, at = where[lv]
            moving = np.arange(m)
            while len(moving):
                nb = links[at[here[moving]]]
                dots = [unit.take(row, axis=0, mode="clip") @ q[x] for row, x in zip(nb, moving.tolist())]
                sims = np.where(nb >= 0, np.stack(dots), -2.0)
                j = sims.argmax(axis=1)
                top = sims[np.arange(len(moving)), j]
                up = top > best[moving]
                moving = moving[up]
                here[moving], best[moving] = nb[up, j[up]], top[up]
        seen = np.zeros((m, n), dtype=bool)
        ids, val = np.full((m, beam), -1, dtype=np.int64), np.full((m, beam), -2.0, dtype=np.float32)
        done = np.ones((m, beam), dtype=bool)
        ids[:, 0], val[:, 0], done[:, 0] = here, best, False
        seen[np.arange(m), here] = True
        live = np.arange(m)
        while True:
            # the best of each query's beam that were not followed yet
            open_ = np.where(done[live], -3.0, val[live])
            few = np.argpartition(-open_, FAN - 1, axis=1)[:, :FAN] if beam > FAN else np.argsort(-open_, axis=1)[:, :FAN]
            good = np.take_along_axis(open_, few, axis=1) > -2.5
            going = good.any(axis=1)
            live, few, good = live[going], few[going], good[going]
            if not len(live):
                break
            np.put_along_axis(sub := done[live], few, True, axis=1)
            done[live] = sub
            nb = graph["base"][np.where(good, np.take_along_axis(ids[live], few, axis=1), 0)]
            nb = np.where(good[:, :, None], nb, -1).reshape(len(live), -1)
            fresh = (nb >= 0) & ~seen[live[:, None], np.maximum(nb, 0)]
            r, c = np.nonzero(fresh)
            node = nb[r, c]
            seen[live[r], node] = True
            # a node may be a neighbour of several
            pair = live[r] * n + node
            _, first = np.unique(pair, return_index=True)
            r, c, node = r[first], c[first], node[first]
            sims = np.full(nb.shape, -2.0, dtype=np.float32)
            # a query at a time: its few rows are in the cache when they are multiplied
            cuts, dots = np.searchsorted(r, np.arange(len(live) + 1)).tolist(), np.empty(len(r), dtype=np.float32)
            for i, x in enumerate(live.tolist()):
                a, b = cuts[i], cuts[i + 1]
                if a < b:
                    dots[a:b] = unit.take(node[a:b], axis=0) @ q[x]
            sims[r, c] = dots
            all_val = np.concatenate([val[live], sims], axis=1)
            all_ids = np.concatenate([ids[live], np.where(sims > -2, nb, -1)], axis=1)
            all_done = np.concatenate([done[live], ~(sims > -2)], axis=1)
            keep = np.argpartition(-all_val, beam - 1, axis=1)[:, :beam]
            val[live], ids[live], done[live] = (np.take_along_axis(z, keep, axis=1) for z in (all_val, all_ids, all_done))
        by = np.argsort(-val, axis=1, kind="stable")[:, :k]
        found[lo : lo + m], score[lo : lo + m] = np.take_along_axis(ids, by, axis=1), np.take_along_axis(val, by, axis=1)
    return found, score


# ---- one shard scanned ----

SCANNED = 512


def scan_shard(raw: np.ndarray, unit: np.ndarray, queries: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine rounded to 6 decimals) for the ``k`` rows most similar to each query, and all tied with the last.

    Only similarities of at least ``least``; ``unit`` has the directions of the rows. All rows are compared in single
    precision, and those that may count in double.
    """
    n, floor, out = len(raw), least - 1e-4, []
    square = np.einsum("ij,ij->i", raw, raw, dtype=np.float64)
    for lo in range(0, len(queries), SCANNED):
        q = queries[lo : lo + SCANNED]
        own = np.einsum("ij,ij->i", q, q, dtype=np.float64)
        sims = (q / np.sqrt(own)[:, None]).astype(np.float32) @ unit.T
        passed = sims >= floor
        if n > k and np.count_nonzero(passed) > 8 * k * len(q):
            # nothing much below the k-th of a query can be among its k best
            passed &= sims >= (np.partition(sims, n - k, axis=1)[:, n - k] - 4e-6)[:, None]
        at = np.flatnonzero(passed)
        i, j = at // n, at % n
        s = np.empty(len(at))
        for a in range(0, len(at), 8192):
            x, y = i[a : a + 8192], j[a : a + 8192]
            s[a : a + 8192] = np.round(np.einsum("ij,ij->i", q[x], raw[y], dtype=np.float64) / np.sqrt(own[x] * square[y]), 6)
        good = s >= least
        i, j, s = i[good], j[good], s[good]
        by = np.lexsort((-s, i))
        i, j, s = i[by], j[by], s[by]
        first = np.searchsorted(i, np.arange(len(q) + 1))
        last = np.minimum(first[:-1] + k, first[1:]) - 1
        best = s >= s[last[i]]
        out.append((lo + i[best], j[best], s[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


# ---- centroids ----


def train_centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """``count`` unit centroids of unit vectors (spherical k-means); empty ones are dropped."""
    rng = np.random.default_rng(seed)
    count = min(count, len(sample))
    centre = sample[np.sort(rng.choice(len(sample), count, replace=False))]
    for _ in range(rounds):
        home = np.concatenate([(sample[i : i + 8192] @ centre.T).argmax(axis=1) for i in range(0, len(sample), 8192)])
        sums = np.zeros_like(centre)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1)
        centre = sums[norm > 1e-9] / norm[norm > 1e-9][:, None]
    return centre.astype(np.float32)


def _units(blobs, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors and their directions."""
    blobs = list(blobs)
    raw, unit = np.empty((len(blobs), dim), dtype=np.float32), np.empty((len(blobs), dim), dtype=np.float32)
    for lo in range(0, len(blobs), 4096):
        x = unpack_rows(blobs[lo : lo + 4096], dim)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
        raw[lo : lo + 4096], unit[lo : lo + 4096] = x, x / norm[:, None]
    return raw, unit


# ---- the operator ----


def usable_vectors(df: DataFrame, key: str, vector: str, when: str, dim: int) -> DataFrame:
    """``id, v`` of the latest row of each key whose vector has ``dim`` finite numbers, not all zero; v is packed.

    A key whose latest row is unusable does not come out. Ties on ``when`` go to the greater bytes.
    """
    kind = df.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(-1))
            right = sizes == dim
            out: list[bytes | None] = [None] * batch.num_rows
            at = np.flatnonzero(right)
            if len(at):
                flat = lists.take(pa.array(at)).flatten()
                x = np.asarray(flat.cast(pa.float32()).fill_null(float("nan")), dtype=np.float32).reshape(-1, dim)
                fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                for i, row in zip(at[fine].tolist(), pack_rows(x[fine])):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.binary()), batch.column(2)], names=["id", "v", "w"])

    packed = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(when).alias("w"))
    packed = packed.mapInArrow(pack, f"id {kind}, v binary, w {df.schema[when].dataType.simpleString()}")
    return packed.groupBy("id").agg(F.max(F.struct("w", "v")).alias("r")).select("id", F.col("r.v").alias("v")).where("v IS NOT NULL")


def _routed(heads: DataFrame, dim: int, count: int, shard: int, probes: int) -> DataFrame:
    """``c, v, cells``: the cells of the ``probes`` nearest lower centroids of each vector, its own first.

    Both levels are always there. The driver holds the upper centroids, sqrt(count / shard) of them; the lower ones are
    a table of one row for each upper cell.
    """
    spark = heads.sparkSession
    upper = int(np.ceil(np.sqrt(-(-count // shard))))
    some = min(SAMPLE, EACH * (upper + 1))
    sample = heads.where(_drawn(F.lit(min(1.0, 1.2 * some / count)))).select("v").limit(some)
    tops = train_centroids(_units([bytes(r.v) for r in sample.collect()], dim)[1], upper)
    shared = spark.sparkContext.broadcast(tops)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home = (_units(batch.column(1).to_pylist(), dim)[1] @ shared.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))], names=["c", "v", "top"])

    placed = staged(heads.mapInArrow(climb, "c binary, v binary, top int"), "placed")
    sizes = staged(placed.groupBy("top").agg(F.count("*").alias("n")), "tops")
    # as many lower centroids as the upper cell has shards, from EACH vectors each; from 8 where that is above SAMPLE
    lower = F.ceil(F.col("n") / shard)
    drawn = F.greatest(F.least(EACH * (lower + 1), F.lit(SAMPLE)), 8 * lower)
    part = placed.join(F.broadcast(sizes), "top").where(_drawn(drawn / F.col("n"))).select("top", "v", lower.cast("int").alias("k"))

    def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        centres = train_centroids(_units(rows["v"], dim)[1], int(rows["k"].iloc[0]))
        return pd.DataFrame([{"other": key[0], "centres": centres.tobytes()}])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trained = staged(part.repartition(max(tasks, min(upper, 20_000)), "top").groupBy("top").applyInPandas(train, "other int, centres binary"), "centres")
    # an upper cell looks at its own lower centroids and those of the upper cells nearest to it
    beside = []
    for lo in range(0, len(tops), 1024):
        order = np.argsort(-(tops[lo : lo + 1024] @ tops.T), axis=1, kind="stable")[:, : BESIDE + 1]
        beside += [(lo + i, int(t)) for i, row in enumerate(order) for t in row]
    blocks = F.ceil(F.col("n") / ROUTED).cast("int")
    around = spark.createDataFrame(beside, "top int, other int").join(trained, "other").join(F.broadcast(sizes.select("top", blocks.alias("blocks"))), "top")
    around = around.select("top", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "other", "centres")
    rows = placed.join(F.broadcast(sizes.select("top", blocks.alias("blocks"))), "top").select("top", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("block"), "c", "v")

    def route(key: tuple, vectors: pd.DataFrame, holders: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(holders):
            return pd.DataFrame({"c": pd.Series(dtype=object), "v": pd.Series(dtype=object), "cells": pd.Series(dtype=object)})
        holders = holders.sort_values("other")
        mats = [np.frombuffer(x, dtype=np.float32).reshape(-1, dim) for x in holders["centres"]]
        names = np.concatenate([(int(o) << 32) + np.arange(len(m)) for o, m in zip(holders["other"], mats)])
        centres, cells = np.concatenate(mats), []
        p = min(probes, len(centres))
        for lo in range(0, len(vectors), 4096):
            sims = _units(vectors["v"].iloc[lo : lo + 4096], dim)[1] @ centres.T
            near = np.argpartition(-sims, p - 1, axis=1)[:, :p]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable"), axis=1)
            cells += names[near].tolist()
        return pd.DataFrame({"c": vectors["c"], "v": vectors["v"], "cells": cells})

    groups, place = max(tasks, min(2 * upper, 20_000)), ["top", "block"]
    return rows.repartition(groups, *place).groupBy(*place).cogroup(around.repartition(groups, *place).groupBy(*place)).applyInPandas(route, "c binary, v binary, cells array<bigint>")


def _drawn(rate):
    """Whether the class is of a sample of that rate, by its hash."""
    return F.pmod(F.xxhash64("c"), F.lit(1 << 30)) < rate * F.lit(1 << 30)


def similar_vectors(vectors: DataFrame, dim: int, k: int = 5, least: float = -1.0, shard: int | None = None, probes: int | None = None, beam: int = 0) -> DataFrame:
    """``id, other, similarity``: for each vector its ``k`` most similar others, cosine rounded to 6 decimals.

    ``vectors`` is ``id, v`` as of ``usable_vectors``, ids unique. Ties go to the lower id. Only similarities of at least
    ``least`` come out. Vectors of one direction (to a millionth in every coordinate) are exact: they are one class in
    the graph, and a class of any size costs each member k rows. The other similarities are exact too, but a neighbour
    may be missed where neither visits the shard of the other; see the README for the recall measured. A vector visits
    ``probes`` shards, by default ``PROBES`` or ``SPREAD`` times the root of their number, whichever is more; where there
    are no more than that the result is exact. With a ``beam`` shards are searched by graphs of that beam, which misses
    more. With no or one vector the result is empty.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["id"].dataType.simpleString()
    keep = k + 1  # a member may have to leave itself out

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, unit = _units(batch.column(1).to_pylist(), dim)
                grid = np.rint(unit.astype(np.float64) * (1 << 20)).astype(np.int32)
                names = [hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in grid]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, type=pa.binary())], names=["id", "v", "c"])

    classed = staged(vectors.select("id", "v").mapInArrow(classify, f"id {kind}, v binary, c binary"), "classed")
    # the lowest ids of each class: the limit is applied before the shuffle as well, so a hot class stays small
    lowest = classed.withColumn("r", F.row_number().over(W.partitionBy("c").orderBy("id"))).where(F.col("r") <= keep)
    lowest = staged(lowest.select("c", "id", F.when(F.col("r") == 1, F.col("v")).alias("v")), "lowest")
    heads = lowest.where("v IS NOT NULL").select("c", "v")
    members = lowest.groupBy("c").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    count = heads.count()
    if not count:
        return spark.createDataFrame([], f"id {kind}, other {kind}, similarity double")

    shard = shard or (GRAPH_SHARD if beam else SHARD)
    probes = probes or max(PROBES, int(np.ceil(SPREAD * np.sqrt(count / shard))))
    routed = staged(_routed(heads, dim, count, shard, probes), "routed")
    # a cell with more than a third more than a shard holds is cut by hash, and a query visits all its parts
    cells = routed.select(F.posexplode("cells").alias("pos", "cell")).groupBy("cell").agg(F.count_if(F.col("pos") == 0).alias("home"), F.count("*").alias("n"))
    cells = cells.where("home > 0").select("cell", F.ceil(F.col("home") / (shard * 4 // 3)).cast("int").alias("subs"), F.ceil(F.col("n") / QUERIES).cast("int").alias("blocks"))
    cells = staged(cells, "cells")
    hashed = F.xxhash64("c")

    shards = routed.select("c", "v", F.col("cells")[0].alias("cell")).join(cells, "cell")
    shards = shards.select("cell", F.pmod(hashed, F.col("subs")).cast("int").alias("sub"), "blocks", "c", "v", hashed.alias("h"))

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "c"]).reset_index(drop=True)
        graph = build_graph(_units(part["v"], dim)[1], part["h"].to_numpy()) if beam else {}
        sizes, blocks = np.array([len(v) for v in part["v"]], dtype=np.int32), int(part["blocks"].iloc[0])
        own = ((part["h"].to_numpy().astype(np.uint64) >> np.uint64(20)) % np.uint64(blocks)).astype(np.int32)
        row = {"cell": key[0], "sub": key[1], "blocks": blocks, "names": b"".join(part["c"]), "vectors": b"".join(part["v"]), "sizes": sizes.tobytes(), "own": own.tobytes()}
        return pd.DataFrame([row | {g: graph[g].tobytes() if beam else None for g in ("base", "upper", "heads")}])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(tasks, min(-(-count // shard), 20_000))
    fields = "cell bigint, sub int, blocks int, names binary, vectors binary, sizes binary, own binary, base binary, upper binary, heads binary"
    index = staged(shards.repartition(groups, "cell", "sub").groupBy("cell", "sub").applyInPandas(build, fields), "shards")

    # a vector is sent to the shards it visits but its own, which has it
    asked = routed.select("c", "v", F.posexplode("cells").alias("pos", "cell")).join(cells, "cell")
    asked = asked.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).where((F.col("pos") > 0) | (F.col("sub") != F.pmod(hashed, F.col("subs")))).select("cell", "sub", F.pmod(F.shiftrightunsigned(hashed, 20), F.col("blocks")).cast("int").alias("block"), "c", "v")
    served = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def look(key: tuple, queries: pd.DataFrame, holder: pd.DataFrame) -> pd.DataFrame:
        columns = ["c", "o", "s"]
        if not len(holder):
            return pd.DataFrame({"c": pd.Series(dtype=object), "o": pd.Series(dtype=object), "s": pd.Series(dtype=float)})
        g = holder.iloc[0]
        ends = np.cumsum(np.frombuffer(g["sizes"], np.int32)).tolist()
        raw, unit = _units([g["vectors"][a:b] for a, b in zip([0, *ends], ends)], dim)
        names = np.frombuffer(g["names"], dtype="V16")
        mine = np.flatnonzero(np.frombuffer(g["own"], np.int32) == key[2])
        own = np.concatenate([names[mine], np.frombuffer(b"".join(queries["c"]), dtype="V16")])
        if beam:
            width = 2 * LINKS
            graph = {"base": np.frombuffer(g["base"], np.int32).reshape(-1, width), "upper": np.frombuffer(g["upper"], np.int32).reshape(-1, width + 1), "heads": np.frombuffer(g["heads"], np.int32)}
        parts = (raw[mine[lo : lo + 8192]] for lo in range(0, len(mine), 8192))
        others = (unpack_rows(queries["v"].iloc[lo : lo + 8192].tolist(), dim) for lo in range(0, len(queries), 8192))
        found, done = [], 0
        for q in chain(parts, others):
            if beam:
                norm = np.sqrt(np.einsum("ij,ij->i", q, q, dtype=np.float64))
                got, near = search_graph(unit, graph, (q / norm[:, None]).astype(np.float32), k + 3, beam)
                # those clearly below the least similarity need no exact figure
                i, at = np.nonzero((got >= 0) & (near > least - 1e-4))
                j = got[i, at]
                a, b = q[i].astype(np.float64), raw[j].astype(np.float64)
                s = np.round(np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)), 6)
            else:
                i, j, s = scan_shard(raw, unit, q, keep, least)
            found.append((done + i, j, s))
            done += len(q)
        if not found:
            return pd.DataFrame({"c": pd.Series(dtype=object), "o": pd.Series(dtype=object), "s": pd.Series(dtype=float)})
        i, j, s = (np.concatenate(x) for x in zip(*found))
        other = names[j]
        ok = (own[i] != other) & (s >= least)
        return pd.DataFrame({"c": [x.tobytes() for x in own[i][ok]], "o": [x.tobytes() for x in other[ok]], "s": s[ok]}, columns=columns)

    place = ["cell", "sub", "block"]
    groups = min(4 * groups, 20_000)
    found = asked.repartition(groups, *place).groupBy(*place).cogroup(served.repartition(groups, *place).groupBy(*place)).applyInPandas(look, "c binary, o binary, s double")
    # what one finds of the other holds both ways: a pair missed from one side comes in from the other
    found = staged(found, "found")
    found = found.unionByName(found.select(F.col("o").alias("c"), F.col("c").alias("o"), "s")).distinct()
    # merge the shards: the best classes of a class, then their members
    order = W.partitionBy("c").orderBy(F.desc("s"), "low")
    near = found.join(members.select(F.col("c").alias("o"), F.col("ids").alias("others"), F.element_at("ids", 1).alias("low")), "o")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("c").agg(F.collect_list(F.struct("s", "others")).alias("near"))
    lists = members.join(near, "c", "left")
    # (-similarity, id) in order, the class itself first at similarity 1
    entries = F.flatten(F.concat(F.array(F.transform("ids", lambda x: F.struct(F.lit(-1.0).alias("d"), x.alias("o")))), F.coalesce(F.transform("near", lambda z: F.transform(z["others"], lambda x: F.struct((-z["s"]).alias("d"), x.alias("o")))), F.array().cast(f"array<array<struct<d:double,o:{kind}>>>"))))
    lists = lists.select("c", "ids", F.slice(F.sort_array(entries), 1, keep).alias("best"))
    alone = lists.where(F.size("ids") == 1).select(F.element_at("ids", 1).alias("id"), "best")
    # members of a class of many take its list; the list comes in several copies so that a hot class is spread
    salt = 16
    shared = lists.where(F.size("ids") > 1).select("c", "best", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("salt"))
    many = classed.select("id", "c", F.pmod(F.xxhash64("id"), F.lit(salt)).cast("int").alias("salt")).join(shared, ["c", "salt"]).select("id", "best")
    every = alone.unionByName(many).select("id", F.explode(F.slice(F.filter("best", lambda x: x["o"] != F.col("id")), 1, k)).alias("x"))
    return every.select("id", F.col("x.o").alias("other"), (-F.col("x.d")).alias("similarity")).where(F.col("similarity") >= least)
