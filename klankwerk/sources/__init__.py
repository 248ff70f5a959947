"""Sources and sinks: listings, lists, blobs, Parquet shards, a relational store, metrics and queues."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klankwerk import schemas
from klankwerk.functions.text import AUDIO_SUFFIXES, is_audio, not_blank, object_key, shard_name, strip
from klankwerk.operators.batching import left_over, sharded

# ---- listings and lists ----


def list_objects(spark: SparkSession, root: str, suffixes: tuple[str, ...] = AUDIO_SUFFIXES) -> DataFrame:
    """``path, length`` of all files under ``root`` with one of the suffixes, in any case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.where(is_audio(F.col("path"), suffixes)).orderBy("path")


def write_list(paths: DataFrame, target: str) -> None:
    """One path on each line, sorted."""
    paths.select(F.col("path").alias("value")).orderBy("value").write.mode("overwrite").text(target)


def read_list(spark: SparkSession, source: str) -> DataFrame:
    """``path``: lines without white space at their ends, blank ones dropped. A missing file is an error."""
    return spark.read.text(source).where(not_blank(F.col("value"))).select(strip(F.col("value")).alias("path"))


# ---- blobs ----


def read_blobs(spark: SparkSession, root: str) -> DataFrame:
    """``path`` relative to ``root``, ``content``."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.element_at(F.split("path", base.removeprefix("file://"), 2), -1).alias("path"), "content")


def with_blobs(rows: DataFrame, path: str, local: DataFrame | None, remote: DataFrame | None) -> DataFrame:
    """Rows with ``content`` of the local blob, else of the remote one; rows with neither are dropped."""
    if local is None and remote is None:
        raise ValueError("a local or a remote source is needed")
    out = rows
    for name, blobs in (("_local", local), ("_remote", remote)):
        if blobs is not None:
            out = out.join(blobs.select(F.col("path").alias(path), F.col("content").alias(name)), path, "left")
        else:
            out = out.withColumn(name, F.lit(None).cast("binary"))
    return out.withColumn("content", F.coalesce("_local", "_remote")).drop("_local", "_remote").where("content IS NOT NULL")


def present(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """``path, present``: whether each path is in a listing."""
    there = listing.select("path").distinct().withColumn("_there", F.lit(True))
    return paths.select("path").join(there, "path", "left").select("path", F.coalesce("_there", F.lit(False)).alias("present"))


def move_files(plan: DataFrame, root: str, drop_failed: bool = False) -> DataFrame:
    """Move files ``source`` to ``target`` (under ``root``), giving ``source, target, moved, error`` of each.

    A target that is there already is kept and the source removed. A source that cannot be moved stays and its error
    is told; with ``drop_failed`` it is removed as well, so that a work folder never fills up. Both are paths of a file
    system all executors share. A repeated row finds its target there. Nothing happens before the result is used.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source, target in zip(batch["source"], batch["target"]):
                error, goal = None, Path(root, target)
                try:
                    goal.parent.mkdir(parents=True, exist_ok=True)
                    if not goal.exists():
                        shutil.copyfile(source, f"{goal}.part")
                        os.replace(f"{goal}.part", goal)
                except OSError as e:
                    error = str(e)
                if error is None or drop_failed:
                    Path(source).unlink(missing_ok=True)
                out.append((source, target, error is None, error))
            yield pd.DataFrame(out, columns=["source", "target", "moved", "error"])

    return plan.select("source", "target").mapInPandas(run, "source string, target string, moved boolean, error string")


def upload_blobs(blobs: DataFrame, root: str, sign: Callable[[str], str] | None = None) -> DataFrame:
    """Write ``path, content`` under ``root``, a URI of a file system executors reach; ``path, uri, length, url, error`` of each.

    The key of a file is ``functions.text.object_key`` of its path. An object that is there is replaced, whole or not at
    all. ``url`` is what ``sign`` makes of the URI, null without it. A null content is an error, as is one that cannot
    be written; the others go on. Nothing happens before the result is used.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            out = []
            for path, key, blob in zip(batch["path"], batch["key"], batch["content"]):
                uri, error = f"{root.rstrip('/')}/{key}", None
                try:
                    goal = f"{base.rstrip('/')}/{key}"
                    system.create_dir(goal.rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(f"{goal}.part") as stream:
                        stream.write(blob)
                    system.move(f"{goal}.part", goal)
                except Exception as e:  # told in the result
                    error = str(e)[:500]
                out.append((path, uri, len(blob) if blob is not None else None, sign(uri) if sign and error is None else None, error))
            yield pd.DataFrame(out, columns=["path", "uri", "length", "url", "error"]).astype({"length": "Int64"})

    return blobs.select("path", object_key(F.col("path")).alias("key"), "content").mapInPandas(run, "path string, uri string, length bigint, url string, error string")


# ---- Parquet shards ----


def write_shards(df: DataFrame, order: list[str], target: str, stem: str = "dataset", per_shard: int = schemas.CHUNKS_PER_SHARD, resume: bool = True) -> None:
    """zstd Parquet, one folder ``shard=<name>`` for each run of ``per_shard`` rows in ``order``; present shards are kept.

    Rows of a shard are in order within its files. With ``resume`` false everything is written anew.
    """
    spark = df.sparkSession
    rows = sharded(df, order, per_shard).withColumn("shard", shard_name(stem, F.col("shard"), F.col("shards"), ""))
    if resume:
        try:
            rows = left_over(rows, spark.read.parquet(target).select("shard"))
        except Exception as error:  # nothing there yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
    rows = rows.repartition("shard").sortWithinPartitions("shard", "position").drop("shards", "position", "place")
    rows.write.mode("append" if resume else "overwrite").option("compression", "zstd").partitionBy("shard").parquet(target)


def read_shards(spark: SparkSession, source: str, schema: str | None = None) -> DataFrame:
    """Parquet of a file, a folder or a glob, with ``file`` of each row; the schema is pinned if given. A missing path is an error."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(source).withColumn("file", F.col("_metadata.file_path"))


def shard_sizes(spark: SparkSession, source: str) -> DataFrame:
    """``file, row_count``; no data column is read."""
    return spark.read.parquet(source).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("row_count"))


def head(shards: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows in the order of files, then of ``order``."""
    return shards.orderBy("file", *order).limit(limit)


def in_turn(shards: DataFrame, order: list[str]) -> Iterator:
    """The rows, shard after shard; the driver holds one partition at a time."""
    return shards.orderBy("file", *order).toLocalIterator(prefetchPartitions=True)


# ---- a relational store ----


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table over JDBC, read in ``parts`` ranges of ``key`` where bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


# ---- messages, metrics, configuration ----


def to_messages(rows: DataFrame) -> DataFrame:
    """``value``: each row as one JSON text; nulls are left out of it."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def parse_jobs(messages: DataFrame) -> DataFrame:
    """Jobs of JSON texts, with defaults for missing parameters; what is no JSON or lacks a path has ``broken`` true."""
    job = messages.select("value", F.from_json("value", schemas.JOB).alias("j"))
    defaults = {"window_size_sec": schemas.WINDOW_SEC, "skip_start_sec": schemas.SKIP_START_SEC, "skip_end_sec": schemas.SKIP_END_SEC}
    return job.select(
        "j.audio_file_path", *[F.coalesce(f"j.{k}", F.lit(v)).alias(k) for k, v in defaults.items()], "j.timestamp", F.col("j.audio_file_path").isNull().alias("broken"), "value"
    )


def jobs_for(paths: DataFrame, window: float = schemas.WINDOW_SEC, skip_start: float = schemas.QUEUED_SKIP_START_SEC, skip_end: float = schemas.QUEUED_SKIP_END_SEC) -> DataFrame:
    """A job for each path."""
    given = {"window_size_sec": window, "skip_start_sec": skip_start, "skip_end_sec": skip_end}
    return paths.select(F.col("path").alias("audio_file_path"), *[F.lit(float(v)).alias(k) for k, v in given.items()], F.unix_micros(F.current_timestamp()).cast("double").alias("timestamp"))


def append_metrics(metrics: DataFrame, target: str) -> None:
    """Rows ``run, tag, step, value`` added to the metrics table, a folder for each run."""
    metrics.write.mode("append").partitionBy("run").parquet(target)


def append_histograms(values: DataFrame, target: str, buckets: int = 30) -> None:
    """Histograms of rows ``run, tag, step, value`` added to a table: ``run, tag, step, low, high, row_count``.

    Buckets are of equal width between the least and the greatest value of a run, tag and step; equal values have one
    bucket. Null and NaN values count nowhere.
    """
    keys = ["run", "tag", "step"]
    fine = values.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    ends = fine.groupBy(*keys).agg(F.min("value").cast("double").alias("_a"), F.max("value").cast("double").alias("_z"))
    width = (F.col("_z") - F.col("_a")) / buckets
    place = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_a")) / width), F.lit(buckets - 1))).otherwise(F.lit(0))
    rows = fine.join(ends, keys).groupBy(*keys, "_a", "_z", place.alias("_i")).agg(F.count("*").alias("row_count"))
    low, high = F.col("_a") + F.col("_i") * width, F.when(width > 0, F.col("_a") + (F.col("_i") + 1) * width).otherwise(F.col("_z"))
    rows.select(*keys, low.alias("low"), high.alias("high"), "row_count").write.mode("append").partitionBy("run").parquet(target)


def load_config(path: str) -> dict | None:
    """A JSON configuration; None where the file is missing."""
    file = Path(path)
    return json.loads(file.read_text()) if file.exists() else None


def save_config(config: dict, path: str) -> None:
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(config, indent=2))
