"""The relational store: lookups, summaries, upserts, key-consistent inserts and cascading deletes.

Null keys never match. Durations are rounded to 6 decimals before anything is ranked by them, so that ties and the
order of summation cannot change a winner; ties go to the lowest id.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from klankwerk.runtime import staged


def live_events(events: DataFrame) -> DataFrame:
    """Events by distinct id, those with a usable duration; ``duration_sec`` is end - start."""
    ok = ~F.isnan("start_time_sec") & ~F.isnan("end_time_sec")
    return events.dropDuplicates(["id"]).where(ok).withColumn("duration_sec", F.col("end_time_sec") - F.col("start_time_sec"))


def speaker_time_in_chunks(events: DataFrame) -> DataFrame:
    """``chunk_id, speaker_id, duration_sec, events``, one row for each speaker in each chunk."""
    spoken = events.where("speaker_id IS NOT NULL AND chunk_id IS NOT NULL").groupBy("chunk_id", "speaker_id")
    return spoken.agg(F.round(F.sum("duration_sec"), 6).alias("duration_sec"), F.count("*").alias("events"))


def speaker_time(events: DataFrame, chunk_id: int, speaker_id: int) -> DataFrame:
    """One row with the seconds of one speaker in one chunk, 0.0 where there is none."""
    here = events.where((F.col("chunk_id") == chunk_id) & (F.col("speaker_id") == speaker_id))
    return here.agg(F.coalesce(F.round(F.sum("duration_sec"), 6), F.lit(0.0)).alias("duration_sec"))


def chunk_summary(events: DataFrame) -> DataFrame:
    """Speakers of each chunk, ``place`` 1 for the one who speaks most."""
    order = W.partitionBy("chunk_id").orderBy(F.desc("duration_sec"), "speaker_id")
    return speaker_time_in_chunks(events).withColumn("place", F.row_number().over(order))


def chunk_owners(events: DataFrame) -> DataFrame:
    """``chunk_id, speaker_id``: who speaks most in each chunk."""
    best = F.max_by("speaker_id", F.struct("duration_sec", -F.col("speaker_id"))).alias("speaker_id")
    return speaker_time_in_chunks(events).groupBy("chunk_id").agg(best)


def speaker_totals(events: DataFrame) -> DataFrame:
    return events.where("speaker_id IS NOT NULL").groupBy("speaker_id").agg(F.round(F.sum("duration_sec"), 6).alias("duration_sec"))


def chunks_of_done_files(files: DataFrame, chunks: DataFrame, limit: int | None = None, ordered: bool = True) -> DataFrame:
    """Chunks of successful files in the order of file, start and chunk; a limit of None or 0 is no limit.

    Without ``ordered``, for those who put the rows in an order of their own, they are not sorted unless limited.
    """
    good = files.where("success").select(F.col("id").alias("audio_file_id"), "original_file_path", "audio_duration_sec")
    rows = chunks.withColumnRenamed("id", "chunk_id").join(good, "audio_file_id")
    rows = rows.orderBy("audio_file_id", "start_time_ms", "chunk_id") if ordered or limit else rows
    return rows.limit(limit) if limit else rows


def done_status(paths: DataFrame, files: DataFrame) -> DataFrame:
    """``path, success``: false for a path that is unknown or failed."""
    known = files.groupBy(F.col("original_file_path").alias("path")).agg(F.max("success").alias("_s"))
    return paths.select("path").join(known, "path", "left").select("path", F.coalesce("_s", F.lit(False)).alias("success"))


def still_to_do(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Paths without a successful file; failed ones come again, repeated ones once."""
    return paths.select("path").where("path IS NOT NULL").distinct().join(files.where("success").select(F.col("original_file_path").alias("path")), "path", "left_anti")


def numbered_after(new: DataFrame, present: DataFrame, key: str, order: Sequence[str], name: str = "id") -> DataFrame:
    """``new`` with ids that go on after the greatest of ``present``, in ``order``; see ``positions``."""
    from klankwerk.operators.positions import positions

    top = present.select(F.coalesce(F.max(key), F.lit(0)).alias("top")).scalar()
    return positions(new, order, "_position").withColumn(name, (F.col("_position") + 1 + top).cast("int")).drop("_position")


def upsert(present: DataFrame, incoming: DataFrame, key: str, kept: Sequence[str], newest: str) -> DataFrame:
    """``present`` with ``incoming`` merged in by ``key``: all columns of the newest incoming row but ``kept`` ones.

    Columns in ``kept`` (an id, the time of creation) stay as they were where the key was present. A null key is left
    out. Of several incoming rows of a key the one with the greatest ``newest`` counts.
    """
    rest = [c for c in present.columns if c != key]
    new = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(newest, *[c for c in rest if c != newest])).alias("_new"))
    both = present.withColumn("_was", F.lit(True)).join(new, key, "full_outer")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"_new.{c}")) if c in kept else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c))
    return both.select(key, *[pick(c).alias(c) for c in rest])


def with_speakers(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events with the ``speaker_id`` of their file and label; null where the label is unknown."""
    known = labels.select("audio_file_id", "speaker_label", F.col("speaker_id").alias("_id"))
    return events.drop("speaker_id").join(known, ["audio_file_id", "speaker_label"], "left").withColumnRenamed("_id", "speaker_id")


def unnest_chunks(results: DataFrame) -> DataFrame:
    """One row for each chunk of each file result, with its place in the list."""
    rows = results.select("source_file", F.posexplode("chunks").alias("chunk_no", "chunk"))
    return rows.select("source_file", "chunk_no", F.col("chunk.audio_chunk").alias("audio_chunk"), F.col("chunk.transcription").alias("transcription"), F.col("chunk.transcription_clean").alias("transcription_clean"))


def unnest_turns(chunks: DataFrame) -> DataFrame:
    """One row for each speaker turn of each chunk, keyed by file, chunk and place."""
    rows = chunks.select("source_file", "chunk_no", F.posexplode("audio_chunk.speaker_events").alias("turn_no", "turn"))
    return rows.select("source_file", "chunk_no", "turn_no", "turn.start", "turn.end", "turn.speaker")


class Stored(NamedTuple):
    """The four tables after results have been stored."""

    files: DataFrame
    chunks: DataFrame
    events: DataFrame
    speakers: DataFrame


def store_results(results: DataFrame, files: DataFrame, chunks: DataFrame, events: DataFrame, speakers: DataFrame, threshold: float = 0.5, compat: bool = False) -> Stored:
    """The tables with file results added: files merged by path, chunks and turns appended, voices resolved.

    ``results`` has the columns of ``schemas.FILE_RESULT``, ``created_at`` and, if voices are to be resolved,
    ``speaker_embeddings`` (label to vector). A file is known by ``gcs_audio_path``: a present one keeps its id and its
    time of creation and takes the newest result's values, a new one gets the next id in the order of paths; results
    without a path are left out. A missing window is 0 to the duration. Chunks get the next ids in the order of file,
    time and place in their list, turns in the order of chunk and place; several results of one file all add theirs. A
    voice takes the most similar stored speaker at ``threshold`` or above, else a new one (see ``resolve_speakers``;
    of a label that comes more than once in a file the newest counts). A turn whose label has no voice has a null
    speaker. Empty results leave the tables as they are.
    """
    from klankwerk.operators.identity import resolve_speakers

    new = results.where("gcs_audio_path IS NOT NULL").withColumnRenamed("gcs_audio_path", "original_file_path")
    window = lambda k, other: F.coalesce(F.col("processing_window")[k], other)
    incoming = new.select(
        F.lit(None).cast("int").alias("id"), "original_file_path", "audio_duration_sec", window("start", F.lit(0.0)).alias("processing_window_start"),
        window("end", F.col("audio_duration_sec")).alias("processing_window_end"), "success", "created_at",
    )
    merged = staged(upsert(files.select(*incoming.columns), incoming, "original_file_path", ["id", "created_at"], "created_at").select(*incoming.columns), "files")
    fresh = numbered_after(merged.where("id IS NULL").drop("id"), files, "id", ["original_file_path"])
    all_files = staged(merged.where("id IS NOT NULL").unionByName(fresh.select(*incoming.columns)), "files")

    owned = new.join(all_files.select(F.col("id").alias("audio_file_id"), "original_file_path"), "original_file_path")
    rows = owned.select("audio_file_id", "created_at", F.posexplode("chunks").alias("chunk_no", "c"))
    rows = staged(numbered_after(rows, chunks, "id", ["audio_file_id", "created_at", "chunk_no", F.col("c.audio_chunk.start"), F.col("c.audio_chunk.file_path")]), "chunks")
    a = "c.audio_chunk"
    added = rows.select(
        "id", "audio_file_id", F.coalesce(f"{a}.gcs_file_path", f"{a}.file_path").alias("chunk_file_path"), F.col(f"{a}.start").cast("int").alias("start_time_ms"), F.col(f"{a}.end").cast("int").alias("end_time_ms"),
        "c.transcription", F.lit(None).cast("double").alias("transcription_conf"), "c.transcription_clean", F.lit(None).cast("double").alias("transcription_clean_conf"), "created_at",
    )

    known, all_speakers = None, speakers
    if "speaker_embeddings" in results.columns:
        voices = owned.select("audio_file_id", "created_at", F.explode("speaker_embeddings").alias("label", "v"))
        voices = voices.groupBy("audio_file_id", "label").agg(F.max_by("v", F.struct("created_at", "v")).alias("embedding"))
        voices = voices.select(F.struct("audio_file_id", "label").alias("key"), F.col("audio_file_id").alias("file"), F.col("label").alias("seq"), F.col("embedding").cast("array<float>").alias("embedding"))
        given, grown = resolve_speakers(voices, speakers.select(F.col("id").cast("long").alias("id"), "embedding"), threshold, compat)
        known = given.select("key.audio_file_id", F.col("key.label").alias("speaker_label"), F.col("speaker_id").cast("int").alias("speaker_id"))
        born = grown.join(speakers.select(F.col("id").cast("long").alias("id")), "id", "left_anti")
        all_speakers = speakers.unionByName(born.select(F.col("id").cast("int").alias("id"), "embedding", F.current_timestamp().alias("created_at")))
    turns = rows.select("audio_file_id", F.col("id").alias("chunk_id"), "created_at", F.posexplode(f"{a}.speaker_events").alias("turn_no", "e"))
    turns = turns.select("audio_file_id", "chunk_id", "turn_no", F.col("e.start").alias("start_time_sec"), F.col("e.end").alias("end_time_sec"), F.col("e.speaker").alias("speaker_label"), "created_at")
    turns = with_speakers(turns, known) if known is not None else turns.withColumn("speaker_id", F.lit(None).cast("int"))
    turns = numbered_after(turns, events, "id", ["chunk_id", "turn_no"])
    columns = ["id", "audio_file_id", "chunk_id", "speaker_id", "start_time_sec", "end_time_sec", "speaker_label", "created_at"]
    return Stored(all_files, chunks.select(*added.columns).unionByName(added), events.select(*columns).unionByName(turns.select(*columns)), all_speakers)


def delete_files(gone: DataFrame, files: DataFrame, chunks: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the files in ``gone`` (column ``id``) and what hangs on them."""
    ids = gone.select(F.col("id").alias("audio_file_id")).distinct()
    left_chunks = chunks.join(ids, "audio_file_id", "left_anti")
    lost = chunks.join(ids, "audio_file_id", "left_semi").select(F.col("id").alias("chunk_id"))
    left_events = events.join(ids, "audio_file_id", "left_anti").join(lost, "chunk_id", "left_anti")
    return files.join(gone.select("id").distinct(), "id", "left_anti"), left_chunks, left_events
