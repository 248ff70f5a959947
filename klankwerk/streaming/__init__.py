"""Structured Streaming: queues of JSON jobs, micro-batches, idempotent ingest and online speaker identity.

A queue is a folder of JSON text files. Progress is in the checkpoint, so a batch is neither lost nor run twice
against an idempotent sink; a message that cannot be parsed goes to a folder of its own instead of blocking the rest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from klankwerk.operators.identity import resolve_speakers
from klankwerk.operators.store import still_to_do, upsert
from klankwerk.sources import parse_jobs, to_messages


def push(rows: DataFrame, queue: str) -> None:
    """Rows as messages at the end of a queue."""
    to_messages(rows).write.mode("append").text(queue)


def messages(spark: SparkSession, queue: str, per_trigger: int = 8) -> DataFrame:
    """``value`` of each message, oldest files first, at most ``per_trigger`` files in a micro-batch."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(queue)


def queue_length(spark: SparkSession, queue: str) -> int:
    return spark.read.text(queue).count()


class Progress(StreamingQueryListener):
    """Counts of what the queries of a session did, by query name or id; add it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.failed: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        key = event.progress.name or str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows
        self.batches[key] = self.batches.get(key, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed[str(event.id)] = event.exception


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """``each`` micro-batch; an error in it ends the query, and the batch is run again on the next start."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def job_consumer(done: Callable[[], DataFrame], work: Callable[[DataFrame], None], dead_letters: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch function: parse jobs with defaults, set broken ones aside, skip paths done or repeated, ``work`` on the rest."""

    def each(batch: DataFrame, number: int) -> None:
        jobs = parse_jobs(batch).persist()
        try:
            jobs.where("broken").select("value").write.mode("overwrite").text(f"{dead_letters}/batch={number}")
            good = jobs.where("NOT broken").dropDuplicates(["audio_file_path"])
            todo = still_to_do(good.select(F.col("audio_file_path").alias("path")), done()).withColumnRenamed("path", "audio_file_path")
            work(good.join(todo, "audio_file_path", "left_semi").drop("broken", "value"))
        finally:
            jobs.unpersist()

    return each


def table_upserter(path: str, schema: str, key: str, kept: list[str], newest: str, buckets: int = 16) -> Callable[[DataFrame], None]:
    """A sink that merges rows into a Parquet table by key, in versions that are never changed.

    Rows are in ``buckets`` by the hash of their key. A version writes the buckets its rows fall into under a folder of
    its own, and then, in one step, a manifest ``<path>/_manifests/<version>`` that names the folder of every bucket. The
    greatest manifest is the table. A reader sees the table before or after a version, never a mixture, and a writer
    that dies before its manifest is there leaves the table as it was. One writer at a time: a version that another has
    written meanwhile is an error. A null key is left out.
    """

    def write(rows: DataFrame) -> None:
        spark = rows.sparkSession
        version, folders = _manifest(spark, path)
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        rows = rows.where(F.col(key).isNotNull()).withColumn("_bucket", bucket).persist()
        try:
            touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # at most as many as there are buckets
            present = _read(spark, path, {b: f for b, f in folders.items() if b in touched}, schema)
            attempt = f"v{version + 1}-{uuid.uuid4().hex[:8]}"  # what a dead writer left is never read
            merged = upsert(present, rows.drop("_bucket"), key, kept, newest).withColumn("_bucket", bucket)
            merged.repartition("_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{path}/{attempt}")
        finally:
            rows.unpersist()
        _put(spark, f"{path}/_manifests/{version + 1:012d}", json.dumps({**folders, **{b: f"{attempt}/_bucket={b}" for b in touched}}))

    return write


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """(version, folder of each bucket) of the greatest manifest; (0, {}) where there is none."""
    fs, where = _file_system(spark, f"{path}/_manifests")
    if not fs.exists(where):
        return 0, {}
    names = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(where)) if n.isdigit())
    if not names:
        return 0, {}
    text = "".join(r[0] for r in spark.read.option("wholetext", True).text(f"{path}/_manifests/{names[-1]}").collect())
    return int(names[-1]), {int(b): f for b, f in json.loads(text).items()}


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside and renamed."""
    fs, where = _file_system(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(where) or not fs.rename(beside, where):
        fs.delete(beside, False)
        raise RuntimeError(f"{path} has been written by another")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _read(spark: SparkSession, path: str, folders: dict[int, str], schema: str) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for _, f in sorted(folders.items())])


def current(spark: SparkSession, path: str, schema: str) -> tuple[int, DataFrame]:
    """(version, rows) of a table kept by ``table_upserter``; version 0 is empty."""
    version, folders = _manifest(spark, path)
    return version, _read(spark, path, folders, schema)


def identity_consumer(store: str, given: str, threshold: float = 0.5, compat: bool = False) -> Callable[[DataFrame, int], None]:
    """A micro-batch function over ``key, file, seq, embedding``: speakers known to earlier batches are found again.

    Output and store of batch n are folders of their own, rewritten if the batch is run again.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(store).where(F.col("batch") < number).select("id", "embedding")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            known = None
        names, grown = resolve_speakers(batch, known, threshold, compat)
        new = grown if known is None else grown.join(known.select("id"), "id", "left_anti")
        names.write.mode("overwrite").parquet(f"{given}/batch={number}")
        new.select("id", "embedding").write.mode("overwrite").parquet(f"{store}/batch={number}")

    return each
