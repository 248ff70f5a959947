"""Speaker timelines: processing window, clipping and greedy packing of turns into chunks.

A timeline is ``file, seq, start, end, speaker`` in seconds; the order is (start, seq).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klankwerk.schemas import MIN_CHUNK_SEC, SKIP_END_SEC, SKIP_START_SEC, WINDOW_SEC


def natural_break(after: Column) -> Column:
    """Aggregate: the end of the first turn, in start order, that ends at ``after`` or later; else ``after``."""
    first = F.min_by("end", F.when(F.col("end") >= after, F.struct("start", "seq")))
    return F.coalesce(first, F.min(after))


def processing_windows(turns: DataFrame, files: DataFrame, skip_start: float = SKIP_START_SEC, skip_end: float = SKIP_END_SEC) -> DataFrame:
    """``file, ws, we``: from the natural break after ``skip_start`` to that before the last ``skip_end`` seconds.

    ``files`` is ``file, duration``. The window ends at the end of the last turn to start, at the latest. A file
    without turns or without a duration has no window.
    """
    timed = turns.join(files.where("duration IS NOT NULL"), "file")
    last = F.max_by("end", F.struct("start", "seq"))
    return timed.groupBy("file").agg(
        natural_break(F.lit(float(skip_start))).alias("ws"), F.least(natural_break(F.col("duration") - F.lit(float(skip_end))), last).alias("we")
    )


def clipped(turns: DataFrame, windows: DataFrame) -> DataFrame:
    """Turns that overlap their file's window (touching it is not enough), cut to it."""
    inside = turns.join(windows, "file").where("end > ws AND start < we")
    return inside.select("file", "seq", F.greatest("start", "ws").alias("start"), F.least("end", "we").alias("end"), "speaker")


def pack_greedily(turns: DataFrame, window: float = WINDOW_SEC, least: float = MIN_CHUNK_SEC) -> DataFrame:
    """``file, chunk_no, start, end, turns, first_seq, last_seq``: chunks of successive turns that span ``window`` at most.

    Turns longer than the window are skipped. A turn that would stretch the chunk beyond the window opens the next
    one. The end of a chunk is that of its last turn to start, even where an earlier one goes on. Chunks shorter than
    ``least`` are dropped and not numbered. The fold over a file is sequential by its nature; rows stream through it in
    order, so a task holds one batch and one open chunk, however long the file.
    """
    kind = turns.schema["file"].dataType.simpleString()
    rows = turns.where(F.col("end") - F.col("start") <= window).select("file", "seq", "start", "end")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "file").sortWithinPartitions("file", "start", "seq")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "chunk_no", "start", "end", "turns", "first_seq", "last_seq"]
        file, number, chunk, out = None, 0, None, []

        def close() -> None:
            nonlocal number
            if chunk is not None and chunk[1] - chunk[0] >= least:
                out.append((file, number, *chunk))
                number += 1

        for batch in batches:
            for f, q, s, e in zip(batch["file"].tolist(), batch["seq"].tolist(), batch["start"].tolist(), batch["end"].tolist()):
                if chunk is None or f != file or e - chunk[0] > window:
                    close()
                    if f != file:
                        file, number = f, 0
                    chunk = [s, e, 1, q, q]
                else:
                    chunk[1], chunk[2], chunk[4] = e, chunk[2] + 1, q
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(fold, f"file {kind}, chunk_no int, start double, end double, turns int, first_seq bigint, last_seq bigint")


def longest_turns(turns: DataFrame) -> DataFrame:
    """Each speaker's longest turn in a file; of equal ones the first."""
    size = F.round(F.col("end") - F.col("start"), 6)
    best = F.max_by(F.struct("seq", "start", "end"), F.struct(size, -F.col("start"), -F.col("seq"))).alias("b")
    return turns.where("speaker IS NOT NULL").groupBy("file", "speaker").agg(best).select("file", "speaker", "b.seq", "b.start", "b.end")


def turns_by_speaker(turns: DataFrame) -> DataFrame:
    """The turns of each speaker of a file as a list in order; a list is as long as a speaker has turns in one file."""
    listed = F.sort_array(F.collect_list(F.struct("start", "seq", "end"))).alias("turns")
    return turns.where("speaker IS NOT NULL").groupBy("file", "speaker").agg(listed)
