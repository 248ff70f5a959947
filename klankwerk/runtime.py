"""Session set-up, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: list[str] = []
_STAGED: list[str] = []


def session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("klankwerk")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("KLANKWERK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table, pruned to ``columns`` when any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the session has a single process is it a temporary one.
    """
    here = spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN_DIRS:
            _OWN_DIRS.append(tempfile.mkdtemp(prefix="klankwerk-"))
            atexit.register(shutil.rmtree, _OWN_DIRS[0], True)
        here = f"file://{_OWN_DIRS[0]}"
    return here.rstrip("/")


def staged(df: DataFrame, name: str, max_partition_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage at a copy that outlives any executor. The folder is new each time, so a repeated call never
    reads an older result; the files stay until ``drop_staged``, as the caller's result may still read them.
    """
    spark = df.sparkSession
    path = _new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/klankwerk/{name}-{uuid.uuid4().hex[:12]}"
    _STAGED.append(path)
    return path


def drop_staged(spark: SparkSession) -> int:
    """Delete what this driver has staged so far, once its results have been written; how many tables that were."""
    gone = 0
    while _STAGED:
        where = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        gone += bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
    return gone


class Grown:
    """A table in the shared folder to which frames are added one after the other."""

    def __init__(self, spark: SparkSession, schema, name: str) -> None:
        self.spark, self.parts = spark, 0
        self.path = _new_path(spark, name)
        self.empty = spark.createDataFrame([], schema)

    def add(self, df: DataFrame) -> None:
        df.select(*self.empty.columns).write.mode("append").option("compression", "zstd").parquet(self.path)
        self.parts += 1

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.empty.schema).parquet(self.path) if self.parts else self.empty


def latest(df: DataFrame, key: str, when: str, *columns: str) -> DataFrame:
    """The row of each ``key`` with the greatest ``when``; rows equal in all columns count once.

    Ties on ``when`` go to the greatest values of ``columns`` in order, so the result does not depend on the layout.
    Keyed aggregation with a partial step: a hot key is reduced before the shuffle.
    """
    picked = F.max(F.struct(when, *columns)).alias("_row")
    return df.groupBy(key).agg(picked).select(key, *[F.col(f"_row.{c}").alias(c) for c in (when, *columns)])


def millis(seconds: Column) -> Column:
    """Seconds as whole milliseconds (half up); NaN and infinite values are null."""
    good = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(9.0e12))
    return F.when(good, F.floor(seconds * F.lit(1000.0) + F.lit(0.5)))


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name."""
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted = "_" + wanted
    return wanted
