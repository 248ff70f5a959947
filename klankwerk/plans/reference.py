"""Queries of the corpus-preparation operators over the speech tables, each beside the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klankwerk import schemas as K
from klankwerk import sources, streaming
from klankwerk.functions import media
from klankwerk.functions import text as X
from klankwerk.functions import tokens as Tk
from klankwerk.functions import training as M
from klankwerk.operators import balance, batching, identity, metrics, parameters, store, timeline
from klankwerk.runtime import latest, shared_dir, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.live_events(table(spark, sf_dir, "audio_events"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["original_file_path", "audio_duration_sec", "processing_window_start", "processing_window_end", "success"]
    return latest(table(spark, sf_dir, "audio_files"), "id", "created_at", *cols)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "audio_chunks"), "id", "created_at", "audio_file_id", "chunk_file_path", "start_time_ms", "end_time_ms", "transcription", "transcription_clean")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["source_file", "start_ms", "end_ms", "duration_ms", "transcription", "transcription_clean", "file_path", "chunk_owner", "sample_prob", "cb_weight"]
    return latest(table(spark, sf_dir, "processed_chunks"), "chunk_id", "exported_at", *cols)


_EV = """ev as (select distinct id, audio_file_id, chunk_id, speaker_id, start_time_sec, end_time_sec, speaker_label, end_time_sec - start_time_sec as d
  from audio_events where not isnan(start_time_sec) and not isnan(end_time_sec))"""
_SPOKEN = _EV + """, spoken as (select chunk_id, speaker_id, round(sum(d), 6) as duration_sec, count(*) as events from ev
  where speaker_id is not null and chunk_id is not null group by 1, 2)"""
_FILES = """files as (select id, r.* from (select id, arg_max(struct_pack(original_file_path, audio_duration_sec, success, processing_window_start, processing_window_end, created_at), created_at) r from (select distinct * from audio_files) group by id))"""
_CHUNKS = """chunks as (select id, r.* from (select id, arg_max(struct_pack(audio_file_id, chunk_file_path, start_time_ms, end_time_ms, transcription, transcription_clean), created_at) r
  from (select distinct id, audio_file_id, chunk_file_path, start_time_ms, end_time_ms, transcription, transcription_clean, created_at from audio_chunks) group by id))"""
_EXPORTED = """exported as (select chunk_id, r.* from (select chunk_id, arg_max(struct_pack(source_file, start_ms, end_ms, duration_ms, transcription, transcription_clean, file_path, chunk_owner, sample_prob, cb_weight), exported_at) r
  from (select distinct chunk_id, source_file, start_ms, end_ms, duration_ms, transcription, transcription_clean, file_path, chunk_owner, sample_prob, cb_weight, exported_at from processed_chunks) group by chunk_id))"""


# ---- the store's statements ----


@query(f"with {_SPOKEN} select * from spoken")
def speaker_duration_in_chunk(spark, sf_dir):
    return store.speaker_time_in_chunks(_events(spark, sf_dir))


@query(f"with {_SPOKEN} select *, cast(row_number() over (partition by chunk_id order by duration_sec desc, speaker_id) as int) as place from spoken")
def chunk_speaker_summary(spark, sf_dir):
    return store.chunk_summary(_events(spark, sf_dir))


@query(f"with {_SPOKEN} select chunk_id, arg_max(speaker_id, (duration_sec, -speaker_id)) as speaker_id from spoken group by 1")
def chunk_owner(spark, sf_dir):
    return store.chunk_owners(_events(spark, sf_dir))


@query(f"with {_EV} select id, chunk_id, speaker_id, start_time_sec, end_time_sec, speaker_label from ev where speaker_id is not null")
def chunk_events(spark, sf_dir):
    rows = _events(spark, sf_dir).where("speaker_id IS NOT NULL")
    return rows.select("id", "chunk_id", "speaker_id", "start_time_sec", "end_time_sec", "speaker_label").orderBy("chunk_id", "start_time_sec", "id")


@query(f"with {_EV} select speaker_id, round(sum(d), 6) as duration_sec from ev where speaker_id is not null group by 1")
def speaker_durations(spark, sf_dir):
    return store.speaker_totals(_events(spark, sf_dir))


@query(f"""with {_FILES}, {_CHUNKS} select c.id as chunk_id, audio_file_id, original_file_path, chunk_file_path, start_time_ms, end_time_ms, transcription, transcription_clean
from chunks c join files f on f.id = c.audio_file_id where success""")
def successful_chunks(spark, sf_dir):
    rows = store.chunks_of_done_files(_files(spark, sf_dir), _chunks(spark, sf_dir))
    return rows.select("chunk_id", "audio_file_id", "original_file_path", "chunk_file_path", "start_time_ms", "end_time_ms", "transcription", "transcription_clean")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "processed_chunks", "source_file").select(X.strip(F.col("source_file")).alias("path")).distinct()


@query(f"""with {_FILES} select distinct p as path from (select regexp_replace(source_file, '^\\s+|\\s+$', '', 'g') p from processed_chunks) where p is not null
and p not in (select original_file_path from files where success and original_file_path is not null)""")
def unprocessed_files(spark, sf_dir):
    return store.still_to_do(_paths(spark, sf_dir), _files(spark, sf_dir))


@query(f"""with {_FILES}, p as (select distinct regexp_replace(source_file, '^\\s+|\\s+$', '', 'g') path from processed_chunks)
select path, coalesce((select bool_or(success) from files where original_file_path = path), false) as success from p""")
def processed_lookup(spark, sf_dir):
    return store.done_status(_paths(spark, sf_dir), _files(spark, sf_dir))


_STATS = f"""with {_EV}, t as (select speaker_id, round(sum(d), 6) as duration_sec from ev where speaker_id is not null group by 1),
w as (select *, pow(duration_sec + 1800.0, 0.35::double) as w from t), c as (select *, greatest(least(w / sum(w) over (), 0.05::double), 0.00005::double) as c from w),
stats as (select speaker_id, duration_sec, round(c / sum(c) over (), 9) as sample_prob,
  round(greatest(least((1 - 0.9999::double) / (1 - pow(0.9999::double, greatest(duration_sec / 60, 1))), 3.0::double), 0.5::double), 9) as cb_weight from c)"""


@query(_STATS + " select * from stats")
def speaker_stats(spark, sf_dir):
    return balance.speaker_stats(store.speaker_totals(_events(spark, sf_dir)))


@query(_STATS + """, own as (select chunk_id, arg_max(speaker_id, (s, -speaker_id)) as owner from (
    select chunk_id, speaker_id, round(sum(d), 6) s from ev where speaker_id is not null and chunk_id is not null group by 1, 2) group by 1), """
       + f"{_FILES}, {_CHUNKS}" + """
select original_file_path as source_file, cast(c.id as varchar) as chunk_id, start_time_ms::double as start_ms, end_time_ms::double as end_ms,
  (end_time_ms - start_time_ms)::double as duration_ms, coalesce(transcription, '') as transcription, coalesce(transcription_clean, '') as transcription_clean,
  chunk_file_path as file_path, coalesce(owner, -1)::bigint as chunk_owner, coalesce(sample_prob, 0) as sample_prob, coalesce(cb_weight, 1) as cb_weight,
  ((row_number() over (order by audio_file_id, start_time_ms, c.id)) - 1) // 40000 as shard
from chunks c join files f on f.id = c.audio_file_id left join own on own.chunk_id = c.id left join stats on stats.speaker_id = own.owner where success""")
def training_export(spark, sf_dir):
    """Chunks of successful files with owner, statistics and defaults, in shards."""
    events = _events(spark, sf_dir)
    owners = store.chunk_owners(events).withColumnRenamed("speaker_id", "owner")
    stats = speaker_stats(spark, sf_dir).select(F.col("speaker_id").alias("owner"), "sample_prob", "cb_weight")
    rows = store.chunks_of_done_files(_files(spark, sf_dir), _chunks(spark, sf_dir), ordered=False).join(owners, "chunk_id", "left").join(stats, "owner", "left")
    rows = batching.sharded(rows, ["audio_file_id", "start_time_ms", "chunk_id"])
    ms = lambda c: F.col(c).cast("double")
    return rows.select(
        F.col("original_file_path").alias("source_file"), F.col("chunk_id").cast("string").alias("chunk_id"), ms("start_time_ms").alias("start_ms"), ms("end_time_ms").alias("end_ms"),
        (ms("end_time_ms") - ms("start_time_ms")).alias("duration_ms"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("transcription", "transcription_clean")],
        F.col("chunk_file_path").alias("file_path"), F.coalesce("owner", F.lit(-1)).cast("long").alias("chunk_owner"),
        F.coalesce("sample_prob", F.lit(0.0)).alias("sample_prob"), F.coalesce("cb_weight", F.lit(1.0)).alias("cb_weight"), "shard",
    )


@query("""with f as (select distinct id, original_file_path, audio_duration_sec, success, created_at from audio_files where original_file_path is not null),
old as (select original_file_path, r.* from (select original_file_path, arg_min(struct_pack(id := id, d := audio_duration_sec, s := success, t := created_at), created_at) r from f where success group by 1)),
new as (select original_file_path, r.* from (select original_file_path, arg_max(struct_pack(d := audio_duration_sec, s := success), created_at) r from f group by 1))
select n.original_file_path, coalesce(o.id, -1) as id, n.d as audio_duration_sec, n.s as success from new n left join old o using (original_file_path)""")
def upsert_files(spark, sf_dir):
    """Into the earliest successful row of each path come all rows; a path without one is new, with id -1."""
    rows = table(spark, sf_dir, "audio_files", "id", "original_file_path", "audio_duration_sec", "success", "created_at").where("original_file_path IS NOT NULL")
    rest = [c for c in rows.columns if c != "original_file_path"]
    first = F.min_by(F.struct(*rest), F.struct("created_at", "id", "audio_duration_sec")).alias("r")
    present = rows.where("success").groupBy("original_file_path").agg(first).select("original_file_path", *[f"r.{c}" for c in rest])
    return store.upsert(present, rows.withColumn("id", F.lit(-1)), "original_file_path", ["id"], "created_at").select("original_file_path", "id", "audio_duration_sec", "success")


@query(f"""with {_EV}, {_FILES}, {_CHUNKS}, top as (select (select max(id) from files where success) as f, (select max(id) from chunks) as c, (select max(id) from ev) as e),
f as (select id as old, created_at, case when success then id else (select f from top) + row_number() over (partition by success order by original_file_path) end as id from files where original_file_path is not null),
c0 as (select f.id as audio_file_id, c.id as old, f.created_at, row_number() over (partition by f.old order by start_time_ms nulls first, c.id) as chunk_no from chunks c join f on f.old = c.audio_file_id),
c as (select *, (select c from top) + row_number() over (order by audio_file_id, created_at, chunk_no) as id from c0),
e as (select c.audio_file_id, c.id as chunk_id, start_time_sec, end_time_sec, speaker_label, row_number() over (partition by c.id order by start_time_sec, ev.id) as turn_no from ev join c on c.old = ev.chunk_id)
select cast((select e from top) + row_number() over (order by chunk_id, turn_no) as int) as id, audio_file_id::int as audio_file_id, chunk_id::int as chunk_id, start_time_sec, end_time_sec, speaker_label from e""")
def store_results(spark, sf_dir):
    """Every file with its chunks and turns as a nested result, stored beside the tables as they are; the turns that come in."""
    files, chunks, events = _files(spark, sf_dir), _chunks(spark, sf_dir), _events(spark, sf_dir)
    turns = events.where("chunk_id IS NOT NULL").groupBy(F.col("chunk_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("start_time_sec", "id", "end_time_sec", "speaker_label"))).alias("xs"))
    turns = turns.select("id", F.transform("xs", lambda x: F.struct(x["start_time_sec"].alias("start"), x["end_time_sec"].alias("end"), x["speaker_label"].alias("speaker"))).alias("speaker_events"))
    ms = lambda c: F.col(c).cast("double")
    body = F.struct(ms("start_time_ms").alias("start"), ms("end_time_ms").alias("end"), "speaker_events", F.col("chunk_file_path").alias("file_path"), F.lit(None).cast("string").alias("gcs_file_path"))
    nested = chunks.join(turns, "id", "left").select("audio_file_id", F.struct("start_time_ms", "id", F.struct(body.alias("audio_chunk"), "transcription", "transcription_clean").alias("chunk")).alias("c"))
    nested = nested.groupBy(F.col("audio_file_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["chunk"]).alias("chunks"))
    windows = F.create_map(F.lit("start"), F.col("processing_window_start"), F.lit("end"), F.col("processing_window_end"))
    results = files.join(nested, "id", "left").select(F.col("original_file_path").alias("source_file"), F.col("original_file_path").alias("gcs_audio_path"), "audio_duration_sec", "chunks", "success", windows.alias("processing_window"), "created_at")
    wide = chunks.select("*", *[F.lit(None).cast("double").alias(c) for c in ("transcription_conf", "transcription_clean_conf")])
    stored = store.store_results(results, files.where("success"), wide, events, table(spark, sf_dir, "speakers"))
    return stored.events.join(events.select("id"), "id", "left_anti").select("id", "audio_file_id", "chunk_id", "start_time_sec", "end_time_sec", "speaker_label")


@query(f"""with {_EV}, {_FILES}, {_CHUNKS}, gone as (select id from files where not success)
select (select count(*) from files where id not in (select id from gone)) as files, (select count(*) from chunks where audio_file_id not in (select id from gone)) as chunks,
(select count(*) from ev where audio_file_id not in (select id from gone) and chunk_id not in (select id from chunks where audio_file_id in (select id from gone))) as events""")
def cascade_delete(spark, sf_dir):
    """What is left of each table without the failed files."""
    files = _files(spark, sf_dir)
    left = store.delete_files(files.where("NOT success"), files, _chunks(spark, sf_dir), _events(spark, sf_dir))
    counts = [t.select(F.count("*")).scalar() for t in left]
    return spark.range(1).select(*[c.alias(n) for c, n in zip(counts, ("files", "chunks", "events"))])


@query(f"""with {_EV}, known as (select audio_file_id, speaker_label, min(speaker_id) as speaker_id from ev where speaker_id is not null group by 1, 2)
select ev.id, ev.audio_file_id, ev.speaker_label, known.speaker_id from ev left join known using (audio_file_id, speaker_label)""")
def events_with_speakers(spark, sf_dir):
    """Events with the lowest speaker id of their file and label, null where there is none."""
    events = _events(spark, sf_dir)
    labels = events.where("speaker_id IS NOT NULL").groupBy("audio_file_id", "speaker_label").agg(F.min("speaker_id").alias("speaker_id"))
    return store.with_speakers(events, labels).select("id", "audio_file_id", "speaker_label", "speaker_id")


# ---- similarity and identity ----

_VOICES = """v as (select id, e::double[512] e from (select id, arg_max(struct_pack(e := embedding), created_at).e e from speakers group by id)
  where e is not null and len(e) = 512 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
s as (select a.id as query, b.id as id, round(array_cosine_similarity(a.e, b.e), 6) as similarity from v a join v b on a.id <> b.id where a.id % 50 = 0)"""


def _voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "speakers"), "id", "created_at", "embedding")


@query(f"with {_VOICES} select * from s where similarity >= 0.5")
def speaker_similarities(spark, sf_dir):
    """Every pair at 0.5 or above of a speaker whose id is divisible by 50 and any other."""
    voices = _voices(spark, sf_dir)
    return identity.similar_pairs(voices.where("id % 50 = 0"), voices, threshold=0.5)


@query(f"with {_VOICES} select query, arg_max(id, (similarity, -id)) as id, max(similarity) as similarity from s where similarity >= 0.3 group by 1")
def nearest_speaker(spark, sf_dir):
    voices = _voices(spark, sf_dir)
    return identity.nearest(identity.similar_pairs(voices.where("id % 50 = 0"), voices, threshold=0.3))


@query("""with recursive cur as (select id, arg_max(struct_pack(e := embedding), created_at).e e from speakers where id is not null group by id),
v as (select id, row_number() over (order by id) as k, case when e is not null and len(e) = 512 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0 then e::double[512] end as e from cur),
s as materialized (select a.k as a, b.k as b, round(array_cosine_similarity(a.e, b.e), 6) as s from v a join v b on b.k < a.k where a.e is not null and b.e is not null and round(array_cosine_similarity(a.e, b.e), 6) >= 0.5),
near as materialized (select v.k, v.e is not null as usable, coalesce(list(s.b) filter (where s.b is not null), []) as bs from v left join s on s.a = v.k group by 1, 2),
r as (select 0::bigint as k, []::bigint[] as founders union all
  select r.k + 1, case when near.usable and len(list_intersect(r.founders, near.bs)) = 0 then list_append(r.founders, near.k) else r.founders end from r join near on near.k = r.k + 1),
f as (select unnest(founders) as k from (select founders from r order by k desc limit 1)),
born as (select v.id, v.k, row_number() over (order by v.k) as speaker_id from v where v.e is null or v.k in (select k from f)),
joined as (select s.a as k, arg_max(born.speaker_id, (s.s, -born.speaker_id)) as speaker_id from s join born on born.k = s.b where s.b in (select k from f) and s.a not in (select k from f) group by 1)
select v.id as key, coalesce(born.speaker_id, joined.speaker_id)::bigint as speaker_id from v left join born on born.k = v.k left join joined on joined.k = v.k""")
def resolve_speakers(spark, sf_dir):
    """Speaker of each voice, taken in the order of their ids, against those before it; voices without a usable vector included."""
    voices = _voices(spark, sf_dir).select(F.col("id").alias("key"), F.lit(0).alias("file"), F.col("id").alias("seq"), "embedding")
    return identity.resolve_speakers(voices, dim=512)[0]


# ---- timelines ----


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where("duration_sec > 0 AND audio_file_id IS NOT NULL")
    return rows.select(F.col("audio_file_id").alias("file"), F.col("id").cast("long").alias("seq"), F.col("start_time_sec").alias("start"), F.col("end_time_sec").alias("end"), F.col("speaker_id").alias("speaker"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select(F.col("id").alias("file"), F.col("audio_duration_sec").alias("duration")).where("NOT isnan(duration)")
    return timeline.processing_windows(_turns(spark, sf_dir), files, K.QUEUED_SKIP_START_SEC, K.QUEUED_SKIP_END_SEC)


_TURNS = f"""{_EV}, {_FILES}, tn as (select audio_file_id as file, id as seq, start_time_sec as s, end_time_sec as e, speaker_id from ev where d > 0 and audio_file_id is not null),
win as (select file, coalesce(arg_min(e, (s, seq)) filter (where e >= 120), 120) as ws,
    least(coalesce(arg_min(e, (s, seq)) filter (where e >= n - 180), min(n) - 180), arg_max(e, (s, seq))) as we
  from (select tn.*, f.audio_duration_sec n from tn join files f on f.id = tn.file where f.audio_duration_sec is not null and not isnan(f.audio_duration_sec)) group by file),
cl as (select tn.file, seq, greatest(s, ws) as s, least(e, we) as e, speaker_id from tn join win using (file) where e > ws and s < we)"""


@query(f"with {_TURNS} select file, round(ws, 6) as ws, round(we, 6) as we from win")
def processing_window(spark, sf_dir):
    return _windows(spark, sf_dir).select("file", F.round("ws", 6).alias("ws"), F.round("we", 6).alias("we"))


@query(f"with {_TURNS} select file, seq, round(s, 6) as start_sec, round(e, 6) as end_sec, speaker_id as speaker from cl")
def clipped_turns(spark, sf_dir):
    rows = timeline.clipped(_turns(spark, sf_dir), _windows(spark, sf_dir))
    return rows.select("file", "seq", F.round("start", 6).alias("start_sec"), F.round("end", 6).alias("end_sec"), "speaker")


@query(f"""with recursive {_TURNS}, o as (select *, row_number() over (partition by file order by s, seq) r from cl where e - s <= 30),
p as (select file, r, s as head, s, e, seq, 0 as n from o where r = 1
  union all select o.file, o.r, case when o.e - p.head > 30 then o.s else p.head end, o.s, o.e, o.seq, case when o.e - p.head > 30 then p.n + 1 else p.n end
  from p join o on o.file = p.file and o.r = p.r + 1),
g as (select file, n, min(head) as head, arg_max(e, r) as e, count(*) as turns, arg_min(seq, r) as first_seq, arg_max(seq, r) as last_seq from p group by 1, 2)
select file, cast(row_number() over (partition by file order by n) - 1 as int) as chunk_no, round(head, 6) as start_sec, round(e, 6) as end_sec, turns, first_seq, last_seq from g where e - head >= 1.0""")
def greedy_chunks(spark, sf_dir):
    rows = timeline.pack_greedily(timeline.clipped(_turns(spark, sf_dir), _windows(spark, sf_dir)))
    return rows.select("file", "chunk_no", F.round("start", 6).alias("start_sec"), F.round("end", 6).alias("end_sec"), "turns", "first_seq", "last_seq")


@query(f"with {_TURNS} select file, speaker_id as speaker, arg_max(seq, (round(e - s, 6), -s, -seq)) as seq from tn where speaker_id is not null group by 1, 2")
def longest_turn(spark, sf_dir):
    return timeline.longest_turns(_turns(spark, sf_dir)).select("file", "speaker", "seq")


@query(f"with {_TURNS} select file, speaker_id as speaker, count(*) as turns, list(seq order by s, seq) as seqs from tn where speaker_id is not null group by 1, 2")
def turns_by_speaker(spark, sf_dir):
    rows = timeline.turns_by_speaker(_turns(spark, sf_dir))
    return rows.select("file", "speaker", F.size("turns").cast("long").alias("turns"), F.col("turns.seq").alias("seqs"))


# ---- text and paths ----


@query("""with t as (select doc_id, encode(replace(replace(replace(replace(coalesce(text, ''), '[S1]', chr(1)), '[S2]', chr(2)), '[S3]', chr(3)), '[S4]', chr(4))) as b from documents),
x as (select doc_id, left(hex(b), 2048) h from t)
select doc_id, list_resize(list_transform(range(1, len(h), 2), lambda i: cast(('0x' || substr(h, i, 2)) as int)), 1024, 0) as tokens from x""")
def byte_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.byte_tokens(F.col("text")).alias("tokens"))


_CLEAN = "regexp_replace(regexp_replace({0}, '<\\|.*?\\|>', '', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"with {_CHUNKS} select id, {_CLEAN.format('transcription')} as transcription, {_CLEAN.format('transcription_clean')} as transcription_clean from chunks")
def strip_special_tokens(spark, sf_dir):
    return _chunks(spark, sf_dir).select("id", *[X.strip_special_tokens(F.col(c)).alias(c) for c in ("transcription", "transcription_clean")])


@query(f"""with {_CHUNKS}, {_FILES} select c.id as chunk_id, string_split(original_file_path, '/')[-2] as parent, regexp_replace(string_split(original_file_path, '/')[-1], '\\.[^.]*$', '') as stem,
lower(regexp_extract(original_file_path, '\\.([^./]*)$', 1)) as suffix,
string_split(original_file_path, '/')[-2] || '/' || regexp_replace(string_split(original_file_path, '/')[-1], '\\.[^.]*$', '') || '/' || string_split(chunk_file_path, '/')[-1] as target
from chunks c join files f on f.id = c.audio_file_id""")
def path_parts(spark, sf_dir):
    rows = _chunks(spark, sf_dir).join(_files(spark, sf_dir).select(F.col("id").alias("audio_file_id"), "original_file_path"), "audio_file_id")
    p = F.col("original_file_path")
    return rows.select(F.col("id").alias("chunk_id"), X.parent_name(p).alias("parent"), X.stem(p).alias("stem"), X.suffix(p).alias("suffix"), X.chunk_path(p, F.col("chunk_file_path")).alias("target"))


@query(f"""with {_FILES} select distinct original_file_path as path from files where lower(regexp_extract(original_file_path, '\\.([^./]*)$', 1)) in ('mp3', 'wav', 'flac', 'm4a', 'aac', 'ogg', 'wma')""")
def audio_paths(spark, sf_dir):
    return _files(spark, sf_dir).select(F.col("original_file_path").alias("path")).where(X.is_audio(F.col("path"))).distinct().orderBy("path")


@query(f"with {_CHUNKS} select id from chunks where transcription <> '' and transcription_clean <> '' and (end_time_ms - start_time_ms) / 1000 <= 30")
def usable_transcripts(spark, sf_dir):
    """Chunks of at most 30 s with both transcripts."""
    return _chunks(spark, sf_dir).where("transcription != '' AND transcription_clean != '' AND (end_time_ms - start_time_ms) / 1000 <= 30").select("id")


# ---- summaries of the export ----


@query(f"""with {_EXPORTED} select count(*) as row_count, min(duration_ms) as min_duration_ms, max(duration_ms) as max_duration_ms, min(sample_prob) as min_sample_prob, max(sample_prob) as max_sample_prob,
min(cb_weight) as min_cb_weight, max(cb_weight) as max_cb_weight, count(*) filter (where regexp_replace(transcription, '\\s', '', 'g') <> '') as with_transcription,
count(*) filter (where regexp_replace(transcription_clean, '\\s', '', 'g') <> '') as with_transcription_clean, count(distinct source_file) as source_files from exported""")
def dataset_summary(spark, sf_dir):
    return balance.dataset_summary(_exported(spark, sf_dir))


@query(f"""with {_EXPORTED}, h as (select round(cb_weight, 3) as value, count(*) as row_count from exported where cb_weight is not null group by 1)
select value, row_count, round(100 * row_count / sum(row_count) over (), 6) as percent from h""")
def weight_histogram(spark, sf_dir):
    return balance.value_histogram(_exported(spark, sf_dir), "cb_weight").orderBy("value")


@query(f"with {_EXPORTED} select source_file, chunk_id, duration_ms from exported order by source_file nulls last, chunk_id limit 10")
def first_rows(spark, sf_dir):
    return _exported(spark, sf_dir).select("source_file", "chunk_id", "duration_ms").orderBy(F.asc_nulls_last("source_file"), "chunk_id").limit(10)


# ---- token sequences ----


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes made up for each current chunk: id % 24 + 1 frames of 9."""
    t = lambda n: F.transform(F.sequence(F.lit(0), F.col("id") % 24), n)
    frame = t(lambda i: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda c: ((F.col("id") * 31 + i * 9 + c * 7) % 1024).cast("int")))
    return _chunks(spark, sf_dir).select("id", frame.alias("frames"))


_CODES = f"""{_CHUNKS}, ids as (select id, id % 24 + 1 as n from chunks), ch as (select unnest(range(9)) as c, unnest([0, 8, 9, 10, 11, 12, 13, 14, 15]) as d),
src as (select id, n, t, c, d, (id::bigint * 31 + t * 9 + c * 7) % 1024 as v from (select id, n, unnest(range(n)) as t from ids) cross join ch)"""


def _long(rows: DataFrame, name: str = "frames") -> DataFrame:
    steps = rows.select("id", F.posexplode(name).alias("t", "f"))
    return steps.select("id", F.col("t").cast("long").alias("t"), F.posexplode("f").alias("c", "token")).select("id", "t", F.col("c").cast("long").alias("c"), F.col("token").cast("long").alias("token"))


@query(f"""with {_CODES}, full_ as (select id, n, unnest(range(32)) as t from ids)
select f.id, f.t, ch.c, case when f.t = 0 then 1026 when f.t <= least(n, 30) then (f.id::bigint * 31 + (f.t - 1) * 9 + ch.c * 7) % 1024 when f.t = least(n, 30) + 1 then 1024 else 1025 end as token
from full_ f cross join ch""")
def audio_frames(spark, sf_dir):
    return _long(_codes(spark, sf_dir).select("id", Tk.framed(F.col("frames"), 32).alias("frames")))


@query(f"with {_CODES} select id, t, c, case when t < d then 1026 else (id::bigint * 31 + (t - d) * 9 + c * 7) % 1024 end as token from src")
def delay_pattern(spark, sf_dir):
    return _long(_codes(spark, sf_dir).select("id", Tk.delayed(F.col("frames")).alias("frames")))


@query(f"with {_CODES} select id, t, c, case when t + d >= n then 1025 else (id::bigint * 31 + (t + d) * 9 + c * 7) % 1024 end as token from src")
def revert_pattern(spark, sf_dir):
    return _long(_codes(spark, sf_dir).select("id", Tk.reverted(F.col("frames")).alias("frames")))


@query(f"with {_CODES} select id, t, c, v as token from src where t < n - 15")
def delay_round_trip(spark, sf_dir):
    """Reverting the delayed codes gives them back, but for the last 15 steps."""
    return _long(_codes(spark, sf_dir).select("id", Tk.codes_only(Tk.reverted(Tk.delayed(F.col("frames")))).alias("frames")))


@query(f"with {_CODES} select id, t, c, case when t + 1 >= n then 1025 else (id::bigint * 31 + (t + 1) * 9 + c * 7) % 1024 end as token from src")
def shifted_targets(spark, sf_dir):
    return _long(_codes(spark, sf_dir).select("id", Tk.shifted(F.col("frames")).alias("frames")))


@query(f"""with {_CODES}, steps as (select id, n, unnest(range(n)) as t from ids), buffer as (select id, n, unnest(range(least(n + 16, 32))) as t from ids)
select id, t, c, case when t - d <= 0 then 1026 when t - d <= n then (id::bigint * 31 + (t - d - 1) * 9 + c * 7) % 1024 else -1 end as token from buffer cross join ch""")
def prompt_prefill(spark, sf_dir):
    """The codes as a prompt in a generation buffer of 32 steps."""
    return _long(_codes(spark, sf_dir).select("id", Tk.prefilled(F.col("frames"), 32).alias("frames")))


@query(f"with {_CODES} select id, r.copy_no, 8 as steps_limit, least(n, 8) as steps, sum(v)::bigint as total from (select *, unnest([0, 1]) as copy_no from src) r where t < 8 group by 1, 2, 3, 4")
def prompt_pair(spark, sf_dir):
    """The first eight steps of the codes twice side by side, as for guidance."""
    rows = _codes(spark, sf_dir).select("id", F.posexplode(Tk.repeated(Tk.first_steps(F.col("frames"), 8))).alias("copy_no", "frames"))
    total = F.aggregate(F.flatten("frames"), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("id", "copy_no", F.lit(8).alias("steps_limit"), F.size("frames").alias("steps"), total.alias("total"))


@query(f"with {_CODES} select id, list(v order by t, c) as codes, [max(n)::bigint, 9] as shape from src group by id")
def flat_codes(spark, sf_dir):
    rows = _codes(spark, sf_dir)
    again = Tk.unflat(Tk.flat(F.col("frames")))
    return rows.select("id", F.transform(Tk.flat(again), lambda v: v.cast("long")).alias("codes"), Tk.shape(again).alias("shape"))


# ---- batches, samples and choices ----


@query(f"""with {_EXPORTED}, p as (select chunk_id, row_number() over (order by chunk_id) - 1 as position from exported), s as (select *, position // 40000 as shard, position % 40000 as place from p),
n as (select *, count(*) over (partition by shard) as size from s) select chunk_id, shard, place // 16 as batch_no from n where place < size // 16 * 16""")
def batches(spark, sf_dir):
    """Batches of 16 in shards of the export's size."""
    rows = batching.sharded(_exported(spark, sf_dir).select("chunk_id"), ["chunk_id"])
    return batching.batched(rows, 16).select("chunk_id", "shard", "batch_no")


@query()
def shuffled_order(spark, sf_dir):
    return batching.shuffled(_exported(spark, sf_dir).select("chunk_id"), ["chunk_id"])


@query(f"with {_EXPORTED} select count(*) as row_count, 0 as first_place, count(*) - 1 as last_place, count(*) as places, false as in_order from exported")
def shuffled_order_invariants(spark, sf_dir):
    """Of the shuffled order: whether it is a permutation, and whether one that changes nothing."""
    rows = shuffled_order(spark, sf_dir)
    sorted_ = batching.positions(rows, ["chunk_id"], "place")
    return sorted_.agg(
        F.count("*").alias("row_count"), F.min("shuffled_place").cast("int").alias("first_place"), F.max("shuffled_place").alias("last_place"), F.count_distinct("shuffled_place").alias("places"),
        (F.count_if(F.col("place") == F.col("shuffled_place")) == F.count("*")).alias("in_order"),
    )


@query(f"with {_EXPORTED} select count(*) as row_count, count(*) as draws, 0 as far_off from exported")
def weighted_draw_invariants(spark, sf_dir):
    """Of the weighted draws: their sum, and the rows drawn a whole time more or less often than their weight asks for."""
    rows = _exported(spark, sf_dir).select("chunk_id", F.coalesce("sample_prob", F.lit(0.0)).alias("w")).join(weighted_draws(spark, sf_dir).select("chunk_id", "draws"), "chunk_id", "left")
    total = rows.agg(F.sum("w").alias("weight"), F.count("*").alias("n"))
    asked = F.col("w") / total.select("weight").scalar() * total.select("n").scalar()
    off = F.abs(F.coalesce("draws", F.lit(0)) - asked) >= 1 + 1e-6
    return rows.agg(F.count("*").alias("row_count"), F.sum(F.coalesce("draws", F.lit(0))).alias("draws"), F.count_if(off).alias("far_off"))


@query(f"with {_EXPORTED} select count(*) as row_count, 0 as foreign_texts from exported")
def chosen_text_invariants(spark, sf_dir):
    """Of the chosen texts: rows, and texts that are neither of the row's two and not empty."""
    rows = chosen_texts(spark, sf_dir).join(_exported(spark, sf_dir).select("chunk_id", "transcription", "transcription_clean"), "chunk_id")
    one = (F.col("text") == "") | F.col("text").eqNullSafe(F.col("transcription")) | F.col("text").eqNullSafe(F.col("transcription_clean"))
    return rows.agg(F.count("*").alias("row_count"), F.count_if(~one).alias("foreign_texts"))


@query()
def weighted_draws(spark, sf_dir):
    """As many draws as there are rows, in proportion to sample_prob."""
    rows = _exported(spark, sf_dir).select("chunk_id", "sample_prob")
    return batching.drawn_with_replacement(rows, "sample_prob", ["chunk_id"], rows.count())


@query()
def chosen_texts(spark, sf_dir):
    rows = _exported(spark, sf_dir)
    return rows.select("chunk_id", batching.chosen_text(F.col("transcription"), F.col("transcription_clean"), ["chunk_id"]).alias("text"))


@query("select source, count(*) as samples, count(*) // 128 * 3 as steps from documents where source is not null group by 1")
def step_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", "source").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("samples"))
    return rows.withColumn("steps", M.total_steps(F.col("samples"), 16, 8, 3))


@query("""select o_orderkey as step, round(case when o_orderkey < 500 then 0.0001 * o_orderkey / 500.0 else 0.0001 * greatest(0, 0.5 * (1 + cos(2 * pi() * 0.25 * (o_orderkey - 500) / 599500.0))) end, 12) as rate
from (select distinct o_orderkey from orders)""")
def lr_schedule(spark, sf_dir):
    steps = table(spark, sf_dir, "orders", "o_orderkey").distinct().select(F.col("o_orderkey").alias("step"))
    return steps.select("step", F.round(M.cosine_with_warmup(F.col("step"), 0.0001, 500, 600_000, 0.25), 12).alias("rate"))


# ---- training metrics and sampling ----


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    return rows.select(
        F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("t"), (F.col("l_partkey") % 9).alias("channel"),
        F.when(F.col("l_suppkey") % 5 == 0, K.PAD).otherwise((F.col("l_partkey") % 1024).cast("int")).alias("target"),
        (F.col("l_partkey") % 1024 + F.when(F.col("l_linenumber") == 1, 1).otherwise(0)).alias("predicted"), (F.col("l_discount") * 10).alias("loss"),
    )


_PRED = """pred as (select l_orderkey as sample, l_linenumber as t, l_partkey % 9 as channel, case when l_suppkey % 5 = 0 then 1025 else l_partkey % 1024 end as target,
  l_partkey % 1024 + case when l_linenumber = 1 then 1 else 0 end as predicted, l_discount * 10 as loss from lineitem),
m as (select *, (target <> 1025)::int as m, (target <> 1025)::int * case when channel = 0 then 4 else 1 end as w, (target <> 1025 and target = predicted)::int as hit from pred)"""


@query(f"""with {_PRED} select round(sum(loss * w) / greatest(sum(w), 1e-8), 6) as loss, round(sum(loss * m) / greatest(sum(m), 1e-8), 6) as mean_masked_loss,
round(sum(hit) / greatest(sum(m), 1e-8), 6) as accuracy, sum(m)::bigint as tokens, round(sum(m) / greatest(count(*), 1e-8), 6) as non_pad_ratio from m""")
def masked_loss(spark, sf_dir):
    return metrics.loss_summary(_predictions(spark, sf_dir))


@query(f"""with {_PRED} select channel, round(coalesce(sum(loss * m) / nullif(sum(m), 0), 0), 6) as loss, round(coalesce(sum(hit) / nullif(sum(m), 0), 0), 6) as accuracy, sum(m)::bigint as tokens
from m group by 1""")
def channel_metrics(spark, sf_dir):
    return metrics.channel_summary(_predictions(spark, sf_dir))


@query("""with r as (select o_orderkey as step, 'price' as metric, o_totalprice as value from orders)
select step // 8 as run, metric, round(avg(value), 6) as mean from r group by 1, 2 having count(distinct step) = 8""")
def accumulated_means(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), F.lit("price").alias("metric"), F.col("o_totalprice").alias("value"))
    return metrics.mean_over_steps(rows, "step", "metric", "value", 8)


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return rows.select("vec_id", F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))


_LOGITS = "lg as (select vec_id, unnest(range(len(embedding))) as token, unnest(embedding)::double as logit from embeddings)"


@query(f"with {_LOGITS} select vec_id, token, cast(row_number() over (partition by vec_id order by logit desc, token) as int) as rank from lg qualify rank <= 45")
def top_k(spark, sf_dir):
    return metrics.top_k(_logits(spark, sf_dir), ["vec_id"], "token", "logit", 45).select("vec_id", F.col("token").cast("long").alias("token"), "rank")


@query(f"""with {_LOGITS}, e as (select *, exp(logit - max(logit) over (partition by vec_id)) e from lg), p as (select vec_id, token, e / sum(e) over (partition by vec_id) as prob from e),
c as (select *, coalesce(sum(prob) over (partition by vec_id order by prob desc, token rows between unbounded preceding and 1 preceding), 0) as before from p)
select vec_id, token, round(prob, 9) as prob from c where round(before, 9) <= 0.95""")
def top_p(spark, sf_dir):
    return metrics.top_p(_logits(spark, sf_dir), ["vec_id"], "token", "logit", 0.95).select("vec_id", F.col("token").cast("long").alias("token"), F.round("prob", 9).alias("prob"))


@query(f"with {_LOGITS} select vec_id, arg_max(token, (logit, -token)) as token from lg group by 1")
def greedy_token(spark, sf_dir):
    return metrics.pick(_logits(spark, sf_dir), ["vec_id"], "token", "logit", 0).select("vec_id", F.col("token").cast("long").alias("token"))


@query()
def sampled_token(spark, sf_dir):
    return metrics.pick(_logits(spark, sf_dir), ["vec_id"], "token", "logit", 1.2, seed=7)


@query(f"""with {_LOGITS}, u as (select l.vec_id, l.token, l.logit as c, coalesce(r.logit, 0) as u from lg l left join lg r on r.vec_id = l.vec_id and r.token = 63 - l.token),
g as (select vec_id, token, c + 3.0::double * (c - u) as v from u where token <= 40 and (vec_id % 9 = 0 or token <> 40)) select vec_id, token, round(v, 6) as logit from g""")
def guided_logits(spark, sf_dir):
    """Guidance of each vector against its reverse, EOS at 40, the vector's id mod 9 as channel."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("c"))
    mixed = M.eos_masked(M.guided(F.col("c"), F.reverse("c"), 3.0), F.col("vec_id") % 9, 40)
    rows = rows.select("vec_id", F.posexplode(mixed).alias("token", "logit")).where("logit IS NOT NULL")
    return rows.select("vec_id", F.col("token").cast("long").alias("token"), F.round("logit", 6).alias("logit"))


@query(f"""with {_LOGITS} select vec_id, round(ln(sum(exp(logit))) - max(logit) filter (where token = vec_id % 64), 6) as loss from lg group by 1""")
def token_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return rows.select("vec_id", F.round(M.cross_entropy(F.col("e"), (F.col("vec_id") % 64).cast("int")), 6).alias("loss"))


@query(f"""with {_LOGITS}, q as (select vec_id, sqrt(avg(logit * logit) + 1e-5) as r from lg group by 1),
h as (select a.vec_id, a.token, a.logit as x, b.logit as y, vec_id % 100 / pow(10000.0::double, 2.0 * a.token / 64) as t from lg a join lg b using (vec_id) where a.token < 32 and b.token = a.token + 32),
o as (select vec_id, token, x * cos(t) - y * sin(t) as rotated from h union all select vec_id, token + 32, y * cos(t) + x * sin(t) from h)
select vec_id, token, round(logit / r, 6) as rms_norm, round(logit / (1 + exp(-logit)), 6) as silu, round(rotated, 6) as rotated from lg join q using (vec_id) join o using (vec_id, token)""")
def layer_steps(spark, sf_dir):
    """Vectors normed by their root mean square, through the sigmoid gate, and turned by a position (id mod 100)."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    three = F.arrays_zip(M.rms_norm(F.col("e")).alias("rms_norm"), M.silu(F.col("e")).alias("silu"), M.rotated(F.col("e"), F.col("vec_id") % 100).alias("rotated"))
    return rows.select("vec_id", F.posexplode(three).alias("token", "x")).select("vec_id", F.col("token").cast("long").alias("token"), *[F.round(f"x.{c}", 6).alias(c) for c in ("rms_norm", "silu", "rotated")])


# ---- messages ----


@query(f"""with {_FILES} select original_file_path as audio_file_path, 30.0::double as window_size_sec, case when id % 2 = 0 then 120.0 else 80.0 end::double as skip_start_sec, 80.0::double as skip_end_sec from files where original_file_path is not null""")
def parsed_jobs(spark, sf_dir):
    """Jobs as JSON and back; parameters that a message lacks take their defaults."""
    rows = _files(spark, sf_dir).select(F.col("original_file_path").alias("audio_file_path"), F.when(F.col("id") % 2 == 0, 120.0).alias("skip_start_sec"))
    return sources.parse_jobs(sources.to_messages(rows)).where("NOT broken").select("audio_file_path", "window_size_sec", "skip_start_sec", "skip_end_sec")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def message_fields(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""select count(*) as tensors, coalesce(sum(case when len(encoded_audio_shape) = 0 then 1 else list_product(encoded_audio_shape) end), 0)::bigint as parameters, round(coalesce(sum(case when len(encoded_audio_shape) = 0 then 1 else list_product(encoded_audio_shape) end), 0) * 4 / 1048576.0, 6) as megabytes
from processed_chunks where encoded_audio_shape is not null""")
def parameter_summary(spark, sf_dir):
    """The shapes of the export taken for those of tensors."""
    return parameters.summary(table(spark, sf_dir, "processed_chunks", "encoded_audio_shape").withColumnRenamed("encoded_audio_shape", "shape"))


@query(f"""with {_FILES}, a as (select distinct original_file_path as name from files where original_file_path is not null),
b as (select distinct regexp_replace(source_file, '^\\s+|\\s+$', '', 'g') as name from processed_chunks where source_file is not null)
select coalesce(a.name, b.name) as name, case when b.name is null then 'missing' when a.name is null then 'surplus' else 'both' end as status from a full join b on a.name = b.name""")
def matched_names(spark, sf_dir):
    """Paths of files and of the export, matched as parameter names are."""
    ours = _files(spark, sf_dir).select(F.col("original_file_path").alias("name"))
    return parameters.matched(ours, _paths(spark, sf_dir).select(F.col("path").alias("name")))


@query("""select id, strftime(created_at, 'run_%Y%m%d-%H%M%S') as name from (select distinct id, created_at from speakers where created_at is not null)""")
def run_names(spark, sf_dir):
    rows = table(spark, sf_dir, "speakers", "id", "created_at").where("created_at IS NOT NULL").distinct()
    return rows.select("id", X.run_name("run", F.col("created_at")).alias("name"))


@query("select count(distinct vec_id) as row_count, 0 as foreign_tokens from embeddings")
def sampled_token_invariants(spark, sf_dir):
    """Of the sampled tokens: rows, and tokens that the vector lacks."""
    rows = sampled_token(spark, sf_dir)
    return rows.agg(F.count("*").alias("row_count"), F.count_if(~F.col("token").between(0, 63)).alias("foreign_tokens"))


# ---- sinks, queues and media boundaries ----


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/klankwerk/{name}-{uuid.uuid4().hex[:12]}"


@query(f"""with {_EXPORTED}, s as (select chunk_id, (row_number() over (order by chunk_id) - 1) // 500 as k, count(*) over () as n from exported)
select case when n <= 500 then 'dataset' else 'dataset_shard_' || lpad(cast(k + 1 as varchar), 3, '0') end as shard, count(*) as row_count, min(chunk_id) as first_id, max(chunk_id) as last_id from s group by 1""")
def shard_export(spark, sf_dir):
    """The export written in shards of 500 rows, resumed once, and read back."""
    target, rows = _scratch(spark, "export"), _exported(spark, sf_dir)
    for _ in range(2):  # the second run finds every shard there
        sources.write_shards(rows, ["chunk_id"], target, per_shard=500)
    return sources.read_shards(spark, target).groupBy("shard").agg(F.count("*").alias("row_count"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"))


@query(f"with {_FILES} select distinct regexp_replace(original_file_path, '^\\s+|\\s+$', '', 'g') as path from files where original_file_path is not null")
def path_list(spark, sf_dir):
    """Paths written as a text list and read back."""
    target = _scratch(spark, "list")
    sources.write_list(_files(spark, sf_dir).select(F.col("original_file_path").alias("path")).where("path IS NOT NULL").distinct(), target)
    return sources.read_list(spark, target).distinct()


@query(f"""with {_FILES} select original_file_path as path, max(success::int) = 1 as present from files where original_file_path is not null group by 1""")
def present_paths(spark, sf_dir):
    """Which paths are in a listing, here that of the successful files."""
    files = _files(spark, sf_dir).select(F.col("original_file_path").alias("path"), "success").where("path IS NOT NULL")
    return sources.present(files.select("path").distinct(), files.where("success"))


@query(f"""with {_FILES} select distinct original_file_path as audio_file_path, 30.0::double as window_size_sec, 120.0::double as skip_start_sec, 180.0::double as skip_end_sec
from files where original_file_path is not null and original_file_path not in (select original_file_path from files where success and original_file_path is not null)""")
def job_stream(spark, sf_dir):
    """Jobs of all files pushed to a queue twice, consumed as a stream; those done already are skipped."""
    base, files = _scratch(spark, "queue"), _files(spark, sf_dir)
    jobs = sources.jobs_for(files.select(F.col("original_file_path").alias("path")).where("path IS NOT NULL"))
    for _ in range(2):
        streaming.push(jobs, f"{base}/jobs")
    schema = "audio_file_path string, window_size_sec double, skip_start_sec double, skip_end_sec double, timestamp double"
    write = streaming.table_upserter(f"{base}/table", schema, "audio_file_path", [], "timestamp")
    consumer = streaming.job_consumer(lambda: files, lambda rows: write(rows.select("audio_file_path", "window_size_sec", "skip_start_sec", "skip_end_sec", "timestamp")), f"{base}/dead")
    streaming.start(streaming.messages(spark, f"{base}/jobs", 1000), consumer, f"{base}/checkpoint").awaitTermination()
    return streaming.current(spark, f"{base}/table", schema)[1].drop("timestamp")


@query()
def media_pipeline(spark, sf_dir):
    """Path to turns, chunks and transcripts through the media stand-ins, with the path as content."""
    files = _files(spark, sf_dir).select(F.col("id").alias("file"), F.encode("original_file_path", "UTF-8").alias("content")).where("content IS NOT NULL")
    chunks = timeline.pack_greedily(media.diarise(files.where(media.is_readable(F.col("content")))))
    cut = media.cut_segments(chunks.join(files, "file"))
    return cut.select("file", "chunk_no", "start", "end", media.transcribe(F.col("segment")).alias("transcription"), F.size(media.encode_audio(F.col("segment"))).alias("frames"))


_BYTES = "left(hex(encode(replace(replace(replace(replace(coalesce(transcription, ''), '[S1]', chr(1)), '[S2]', chr(2)), '[S3]', chr(3)), '[S4]', chr(4)))), 2048)"


@query(f"""with {_CODES}, audio as (select id, n, unnest(range(64)) as t from ids), wide as (select id, n, t, c, d from audio cross join ch),
f as (select id, t, c, case when t < d then 1026 when t - d = 0 then 1026 when t - d <= n then (id::bigint * 31 + (t - d - 1) * 9 + c * 7) % 1024 when t - d = n + 1 then 1024 else 1025 end as x,
  case when t = 63 then 1025 when t + 1 < d or t + 1 - d = 0 then 1026 when t + 1 - d <= n then (id::bigint * 31 + (t - d) * 9 + c * 7) % 1024 when t + 1 - d = n + 1 then 1024 else 1025 end as y from wide),
s as (select id, sum(x * (t * 9 + c + 1))::bigint as audio_input, sum(y * (t * 9 + c + 1))::bigint as audio_target from f group by 1),
b as (select id, {_BYTES} as h from chunks), tx as (select id, coalesce(list_sum(list_transform(range(1, len(h), 2), lambda i: cast(('0x' || substr(h, i, 2)) as int) * ((i + 1) // 2))), 0)::bigint as text from b)
select id, 1024 as text_length, text, 64 as audio_input_length, audio_input, 64 as audio_target_length, audio_target from s join tx using (id)""")
def window_batches(spark, sf_dir):
    """Model input: the text as bytes, framed codes as delayed inputs and shifted targets; lengths, and sums of each entry times its place."""
    rows = _codes(spark, sf_dir).join(_chunks(spark, sf_dir).select("id", "transcription"), "id").select("id", X.byte_tokens(F.col("transcription")).alias("text"), Tk.framed(F.col("frames"), 64).alias("audio"))
    rows = rows.withColumn("audio_input", Tk.delayed(F.col("audio"))).withColumn("audio_target", Tk.shifted(F.col("audio_input")))
    placed = lambda x: F.aggregate(F.transform(x, lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    sums = {"text": placed(F.col("text")), "audio_input": placed(F.flatten("audio_input")), "audio_target": placed(F.flatten("audio_target"))}
    return rows.select("id", *[x for c, v in sums.items() for x in (F.size(c).alias(f"{c}_length"), v.alias(c))])


@query(f"""with {_FILES} select original_file_path as path, case when bool_or(success) then 'local' else 'remote' end as content from files where original_file_path is not null group by 1""")
def blob_fallback(spark, sf_dir):
    """Content from the local blobs, here those of the successful files, else from the remote ones."""
    files = _files(spark, sf_dir).select(F.col("original_file_path").alias("path"), "success").where("path IS NOT NULL")
    blobs = lambda rows, text: rows.select("path").distinct().withColumn("content", F.lit(text).cast("binary"))
    return sources.with_blobs(files.select("path").distinct(), "path", blobs(files.where("success"), "local"), blobs(files, "remote")).select("path", F.col("content").cast("string").alias("content"))


@query("""with r as (select event_type as tag, value, min(value) over (partition by event_type) as a, max(value) over (partition by event_type) as z from events where value is not null and not isnan(value))
select tag, case when z > a then least(floor((value - a) / ((z - a) / 30)), 29) else 0 end::bigint as bucket, count(*) as row_count from r group by 1, 2""")
def metric_histograms(spark, sf_dir):
    """Histograms of the events' values by type, written to the metrics table and read back."""
    target = _scratch(spark, "histograms")
    rows = table(spark, sf_dir, "events", "event_type", "value").select(F.lit("run").alias("run"), F.col("event_type").alias("tag"), F.lit(1).alias("step"), "value")
    sources.append_histograms(rows, target)
    read = spark.read.parquet(target)
    bucket = F.when(F.col("z") > F.col("a"), F.round((F.col("low") - F.col("a")) / ((F.col("z") - F.col("a")) / 30))).otherwise(0)
    # the last bucket may be empty, so the ends are those of the values
    ends = rows.where("value IS NOT NULL AND NOT isnan(value)").groupBy("tag").agg(F.min("value").alias("a"), F.max("value").alias("z"))
    return read.join(ends, "tag").select("tag", bucket.cast("long").alias("bucket"), "row_count")


@query(f"""with {_FILES} select count(distinct original_file_path) as queued, count(distinct original_file_path) * 2 as pushed from files where original_file_path is not null""")
def queue_length(spark, sf_dir):
    """Jobs of all files pushed to a queue twice: different paths and messages in it."""
    target = _scratch(spark, "queue")
    jobs = sources.jobs_for(_files(spark, sf_dir).select(F.col("original_file_path").alias("path")).where("path IS NOT NULL").distinct())
    for _ in range(2):
        streaming.push(jobs, target)
    waiting = sources.parse_jobs(spark.read.text(target))
    return waiting.agg(F.count_distinct("audio_file_path").alias("queued"), F.lit(streaming.queue_length(spark, target)).cast("long").alias("pushed"))
