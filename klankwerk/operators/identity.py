"""Speaker identity: nearest stored speaker by cosine similarity, and the online assignment of new voices.

Query sets are taken in blocks of a bounded number, each held against all stored vectors by matrix products in the
executors; only the best match of a query in a batch of rows leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from klankwerk.runtime import Grown

BLOCK = 4096
THRESHOLD = 0.5


def _unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in double precision and which rows are usable, given lists of one length."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    size = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(size) & (size > 0)
    return x / np.where(good, size, 1)[:, None], good


def _usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    return df.where(F.col(key).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))


def similar_pairs(queries: DataFrame, store: DataFrame, key: str = "id", vector: str = "embedding", dim: int = 512, threshold: float = THRESHOLD) -> DataFrame:
    """``query, id, similarity`` (6 decimals) of every query and every other stored vector at ``threshold`` or above.

    Unusable vectors (null, another length, null or NaN inside, all zero) match nothing. Queries come in blocks of
    ``BLOCK``, so the driver and a task hold a bounded number of them whatever their number; each block's matches are
    added to one table in the shared folder, so neither the plan nor the driver grows with the blocks.
    """
    spark = queries.sparkSession
    kind = store.schema[key].dataType.simpleString()
    result = Grown(spark, f"query {kind}, id {kind}, similarity double", "pairs")
    for ids, units in _blocks(_usable(queries, key, vector, dim), key, vector):
        shared = spark.sparkContext.broadcast((ids, units))

        def match(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, units = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                x, good = _unit(batch[vector])
                sims = np.round(units @ x[good].T, 6)
                q, s = np.nonzero(sims >= threshold)
                own = batch[key].to_numpy()[good]
                keep = ids[q] != own[s]
                yield pd.DataFrame({"query": ids[q][keep], "id": own[s][keep], "similarity": sims[q, s][keep]})

        found = _usable(store, key, vector, dim).select(key, vector).mapInPandas(match, f"query {kind}, id {kind}, similarity double")
        result.add(found)
    return result.rows()


def nearest(pairs: DataFrame) -> DataFrame:
    """The most similar of each query; ties go to the lowest id."""
    best = F.max_by(F.struct("id", "similarity"), F.struct("similarity", -F.col("id"))).alias("b")
    return pairs.groupBy("query").agg(best).select("query", "b.id", "b.similarity")


def _blocks(df: DataFrame, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of at most ``BLOCK`` usable rows, brought in one partition at a time."""
    ids, rows = [], []

    def done():
        units, good = _unit(rows)
        return np.asarray(ids)[good], units[good]

    for r in df.select(key, vector).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == BLOCK:
            yield done()
            ids, rows = [], []
    if ids:
        yield done()


def resolve_block(spark: SparkSession, store: DataFrame, voices: list[tuple], threshold: float = THRESHOLD, compat: bool = False, next_id: int = 1, dim: int | None = None) -> tuple[list[tuple], list[tuple], int]:
    """One block of ``(key, file, vector)`` in order against ``store`` (``id, embedding``).

    Gives ``(key, speaker id)`` of each voice, the new ``(id, vector)`` and the next free id. All usable vectors have
    the length ``dim``, or else of the longest. A voice takes the most
    similar speaker at ``threshold`` or above, ties to the lowest id; else it becomes a new one. With ``compat`` the
    new speakers of a file are not seen by the other voices of that file.
    """
    if not voices:
        return [], [], next_id
    dim = dim or max([len(v) for _, _, v in voices if v] or [1])
    fine = [v if v and len(v) == dim and None not in v else [0.0] * dim for _, _, v in voices]
    units, good = _unit(fine)
    queries = spark.sparkContext.broadcast(units)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = queries.value
        top, who = np.full(len(q), -2.0), np.zeros(len(q), dtype=np.int64)
        for batch in batches:
            if len(batch):
                x, ok = _unit(batch["embedding"])
                ids = batch["id"].to_numpy()[ok]
                order = np.argsort(ids, kind="stable")
                sims = np.round(q @ x[ok][order].T, 6)
                if sims.size:
                    j = sims.argmax(axis=1)
                    s, i = sims[np.arange(len(q)), j], ids[order][j]
                    better = (s > top) | ((s == top) & (i < who))
                    top[better], who[better] = s[better], i[better]
        k = np.flatnonzero(top >= threshold)
        yield pd.DataFrame({"k": k, "id": who[k], "s": top[k]})

    found = store.mapInPandas(best, "k bigint, id bigint, s double").groupBy("k").agg(F.max_by(F.struct("id", "s"), F.struct("s", -F.col("id"))).alias("b"))
    stored = {r.k: (r.b.s, r.b.id) for r in found.collect()} if good.any() else {}
    given, fresh = [], []
    fresh_units, fresh_files = np.zeros((len(voices), units.shape[1])), []
    for k, (key, file, vector) in enumerate(voices):
        sim, who = stored.get(k, (-2.0, None))
        if good[k] and fresh:
            sims = np.round(fresh_units[: len(fresh)] @ units[k], 6)
            if compat:
                sims[[f == file for f in fresh_files]] = -2.0
            j = int(sims.argmax())
            if sims[j] >= threshold and sims[j] > sim:
                sim, who = sims[j], fresh[j][0]
        if who is None:
            who, next_id = next_id, next_id + 1
            if good[k]:
                fresh_units[len(fresh)] = units[k]
                fresh_files.append(file)
                fresh.append((who, [float(x) for x in vector]))
        given.append((key, int(who)))
    return given, fresh, next_id


_STORE = T.StructType([T.StructField("id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def resolve_speakers(voices: DataFrame, store: DataFrame | None = None, threshold: float = THRESHOLD, compat: bool = False, block: int = BLOCK, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``key, speaker_id``, the grown store) for ``key, file, seq, embedding`` taken in the order of file, seq and key.

    The assignment depends on its order, so blocks follow each other; each is one pass over the store. What a block
    gives is added to tables in the shared folder. Voices without a usable vector (of length ``dim``, or else of the longest in its block) get ids of their own that match nothing.
    """
    spark = voices.sparkSession
    store = (store if store is not None else spark.createDataFrame([], _STORE)).select("id", "embedding")
    next_id = int(store.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1
    kind = voices.schema["key"].dataType
    names = T.StructType([T.StructField("key", kind), T.StructField("speaker_id", T.LongType())])
    given, added, waiting = Grown(spark, names, "given"), Grown(spark, _STORE, "speakers"), []

    def flush() -> None:
        nonlocal next_id, waiting
        some, fresh, next_id = resolve_block(spark, store.unionByName(added.rows()), waiting, threshold, compat, next_id, dim)
        given.add(spark.createDataFrame(some, names))
        if fresh:
            added.add(spark.createDataFrame(fresh, _STORE))
        waiting = []

    for r in voices.orderBy("file", "seq", "key").select("key", "file", "embedding").toLocalIterator():
        waiting.append((r[0], r[1], r[2]))
        if len(waiting) == block:
            flush()
    if waiting:
        flush()
    return given.rows(), store.unionByName(added.rows())
