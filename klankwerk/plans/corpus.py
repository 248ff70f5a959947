"""Queries of the general data-pipeline operators (problems 2 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klankwerk.operators.dense_totals import dense_totals
from klankwerk.operators.periods import periods_and_gaps
from klankwerk.runtime import latest, millis, table


def _owner_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_owner, real_sec, stored_sec, chunks`` for every owner on either side; a missing total is 0."""
    chunks = table(spark, sf_dir, "processed_chunks", "chunk_id", "exported_at", "chunk_owner", "start_ms", "end_ms", "duration_ms")
    chunks = latest(chunks, "chunk_id", "exported_at", "chunk_owner", "start_ms", "end_ms", "duration_ms").where("chunk_owner != -1")
    chunks = chunks.select("chunk_owner", (F.coalesce("duration_ms", F.col("end_ms") - F.col("start_ms")) / 1000).alias("real"))
    runs = table(spark, sf_dir, "speaker_stats", "speaker_id", "run_id", "duration_sec", "computed_at")
    runs = runs.where("speaker_id IS NOT NULL AND speaker_id != -1").groupBy("speaker_id", "run_id").agg(F.max(F.struct("computed_at", "duration_sec")).alias("r"))
    runs = runs.select(F.col("speaker_id").alias("chunk_owner"), F.col("r.duration_sec").alias("stored"))
    real, stored = dense_totals(chunks, "chunk_owner", ["real"]), dense_totals(runs, "chunk_owner", ["stored"])
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind))
    both = real.join(stored, "chunk_owner", "full_outer")
    return both.select(
        "chunk_owner", zero("real_total", "double").alias("real_sec"), zero("stored_total", "double").alias("stored_sec"), zero("real_rows", "long").alias("chunks")
    )


def owner_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of every owner, rounded to the millisecond."""
    return _owner_sums(spark, sf_dir).select("chunk_owner", F.round("real_sec", 3).alias("real_sec"), F.round("stored_sec", 3).alias("stored_sec"), "chunks")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owner_sums(spark, sf_dir).where(F.abs(F.round(F.col("real_sec") - F.col("stored_sec"), 6)) > 0.5).select("chunk_owner")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "audio_events", "id", "chunk_id", "speaker_id", "start_time_sec", "end_time_sec")
    return events.select("id", "chunk_id", "speaker_id", millis(F.col("start_time_sec")).alias("s"), millis(F.col("end_time_sec")).alias("e"))


def p4_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every period of speech, single turns included, and every silence between two of them."""
    # an id stands for one event; its repeats are equal in all columns
    return periods_and_gaps(_turns(spark, sf_dir), ["chunk_id", "speaker_id"], "s", "e", once="id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = p4_periods(spark, sf_dir).where("kind = 'gap' OR intervals >= 2")
    return cases.select("chunk_id", "speaker_id", "kind", "start_ms", "end_ms")


QUERIES = {"p2_found": p2_found, "p2_owner_totals": owner_totals, "p4_found": p4_found, "p4_periods": p4_periods}

_TOTALS = """
with cur as (
  select chunk_id, arg_max(struct_pack(o := chunk_owner, s := start_ms, e := end_ms, d := duration_ms), exported_at) r
  from (select distinct chunk_id, exported_at, chunk_owner, start_ms, end_ms, duration_ms from processed_chunks) group by chunk_id),
a as (select r.o as id, sum(coalesce(r.d, r.e - r.s)) / 1000 as real_sec, count(coalesce(r.d, r.e - r.s)) as chunks
      from cur where r.o is not null and r.o <> -1 group by 1),
b as (select speaker_id as id, sum(d) as stored_sec from (
        select speaker_id, run_id, arg_max(duration_sec, computed_at) d from speaker_stats group by 1, 2)
      where speaker_id is not null and speaker_id <> -1 group by 1)
select coalesce(a.id, b.id) as chunk_owner, coalesce(real_sec, 0) as real_sec, coalesce(stored_sec, 0) as stored_sec,
       coalesce(chunks, 0) as chunks
from a full join b on a.id = b.id
"""
_PERIODS = """
with ev as (
  select distinct id, chunk_id, speaker_id, cast(floor(start_time_sec * 1000 + 0.5) as bigint) s, cast(floor(end_time_sec * 1000 + 0.5) as bigint) e
  from audio_events where chunk_id is not null and speaker_id is not null),
m as (select *, max(e) over (partition by chunk_id, speaker_id order by s, e, id rows between unbounded preceding and 1 preceding) p from ev where e > s),
l as (select *, sum(case when p is null or s > p then 1 else 0 end) over (partition by chunk_id, speaker_id order by s, e, id rows unbounded preceding) g from m),
i as (select chunk_id, speaker_id, g, min(s) start_ms, max(e) end_ms, count(*) intervals from l group by 1, 2, 3),
r as (select chunk_id, speaker_id, 'period' as kind, start_ms, end_ms, intervals from i
      union all
      select chunk_id, speaker_id, 'gap', p, s, 0 from l where p is not null and s > p)
"""
SQL = {
    "p2_found": f"select chunk_owner from ({_TOTALS}) where abs(round(real_sec - stored_sec, 6)) > 0.5",
    "p2_owner_totals": f"select chunk_owner, round(real_sec, 3) as real_sec, round(stored_sec, 3) as stored_sec, chunks from ({_TOTALS})",
    "p4_found": _PERIODS + "select chunk_id, speaker_id, kind, start_ms, end_ms from r where kind = 'gap' or intervals >= 2",
    "p4_periods": _PERIODS + "select * from r",
}
