"""Per-key totals when a few keys hold most of the rows.

Each input split dictionary-encodes its keys and adds its values into dense arrays with ``numpy.bincount``; only the
arrays travel, cut into blocks by key hash, and each block is summed by one reducer. A split sends a key at most once
however many rows it holds, so the work of a task follows the size of its split and never the weight of a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

FLUSH_KEYS = 1 << 20


class _Accumulator:
    """Dense arrays over a growing dictionary of keys; ``home`` is the block of each key."""

    def __init__(self) -> None:
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: pa.Array, home: np.ndarray, sums: np.ndarray, rows: np.ndarray) -> None:
        self.parts.append((keys, home, sums, rows))
        self.held += len(keys)
        if self.held > FLUSH_KEYS + 2 * len(self.parts[0][0]):
            self.merge()

    def merge(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.parts:
            return None
        coded = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode()
        codes, n = np.asarray(coded.indices), len(coded.dictionary)
        home = np.zeros(n, dtype=np.int32)
        home[codes] = np.concatenate([p[1] for p in self.parts])
        sums = np.stack([np.bincount(codes, weights=s, minlength=n) for s in np.concatenate([p[2] for p in self.parts], axis=1)])
        # counts stay below 2**53, where float64 weights are exact
        rows = np.stack([np.bincount(codes, weights=r, minlength=n).astype(np.int64) for r in np.concatenate([p[3] for p in self.parts], axis=1)])
        self.parts, self.held = [(coded.dictionary, home, sums, rows)], n
        return self.parts[0]


def dense_totals(df: DataFrame, key: str, values: Sequence[str], blocks: int | None = None) -> DataFrame:
    """``key``, ``<value>_total`` and ``<value>_rows`` for each value column.

    Rows with a null key are left out. A null, NaN value adds nothing and is not counted; a key that has only such
    values comes out with total 0.0 and 0 rows. Repeated rows all count. An empty input gives an empty result. Other
    columns are ignored, whatever their names. ``blocks`` is the number of array blocks (default: the session's
    shuffle partitions); memory of a reducer is its share of the distinct keys.
    """
    values = list(values)
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[key].dataType
    slim = df.where(F.col(key).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"), F.col(key).alias("k"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)]
    )
    partial = T.StructType(
        [T.StructField("b", T.IntegerType()), T.StructField("k", T.ArrayType(kind))]
        + [T.StructField(f"s{i}", T.ArrayType(T.DoubleType())) for i in range(len(values))]
        + [T.StructField(f"n{i}", T.ArrayType(T.LongType())) for i in range(len(values))]
    )
    out = T.StructType(
        [T.StructField(key, kind)] + [x for v in values for x in (T.StructField(f"{v}_total", T.DoubleType()), T.StructField(f"{v}_rows", T.LongType()))]
    )
    partial_arrow, out_arrow, width = to_arrow_schema(partial), to_arrow_schema(out), len(values)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = _Accumulator()
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(1).dictionary_encode()
            codes, n = np.asarray(coded.indices), len(coded.dictionary)
            home = np.zeros(n, dtype=np.int32)
            home[codes] = np.asarray(batch.column(0))
            sums, rows = [], []
            for i in range(width):
                v = np.asarray(pc.fill_null(batch.column(2 + i), float("nan")))
                good = ~np.isnan(v)
                sums.append(np.bincount(codes, weights=np.where(good, v, 0.0), minlength=n))
                rows.append(np.bincount(codes, weights=good, minlength=n).astype(np.int64))
            acc.add(coded.dictionary, home, np.stack(sums), np.stack(rows))
            if acc.held > FLUSH_KEYS and len(acc.merge()[0]) > FLUSH_KEYS:
                # a split of ever new keys sends what it has and begins anew
                yield blocks_of(acc.merge())
                acc = _Accumulator()
        if (merged := acc.merge()) is not None:
            yield blocks_of(merged)

    def blocks_of(merged: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        keys, home, sums, rows = merged
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
        offsets = pa.array(np.append(cuts, len(order)).astype(np.int32))
        arrays = [keys.take(pa.array(order)), *[pa.array(x[order]) for x in (*sums, *rows)]]
        columns = [pa.array(home[order][cuts]), *[pa.ListArray.from_arrays(offsets, a) for a in arrays]]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, partial_arrow)], schema=partial_arrow)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = _Accumulator()
        for batch in batches:
            flat = [batch.column(1 + i).flatten() for i in range(1 + 2 * width)]
            if len(flat[0]):
                home = np.zeros(len(flat[0]), dtype=np.int32)
                acc.add(flat[0], home, np.stack([np.asarray(f) for f in flat[1 : 1 + width]]), np.stack([np.asarray(f) for f in flat[1 + width :]]))
        if (merged := acc.merge()) is not None:
            keys, _, sums, rows = merged
            columns = [keys] + [x for i in range(width) for x in (pa.array(sums[i]), pa.array(rows[i]))]
            yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, out_arrow)], schema=out_arrow).to_batches(max_chunksize=65536)

    return slim.mapInArrow(scatter, partial).repartition(blocks, "b").mapInArrow(reduce, out)
