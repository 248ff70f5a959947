"""Queries of the operators for training data and the SQL they are held against."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from klankwerk.llm.containers import fill_containers
from klankwerk.llm.leaks import build_index, find_leaks
from klankwerk.llm.mixing import mix, token_counts
from klankwerk.llm.neighbours import similar_vectors, usable_vectors
from klankwerk.llm.pieces import CutCost, split_items
from klankwerk.llm.spam import spam_pages
from klankwerk.llm.splits import assign_splits, components, load_members, save_members, source_path
from klankwerk.runtime import latest, millis, shared_dir, staged, table

LIMIT_MS, OVERLAP_MS, CAPACITY = 600_000, 15_000, 3072


def _one_row(*parts: DataFrame) -> DataFrame:
    """The columns of frames of one row each, side by side, as scalar subqueries."""
    return parts[0].sparkSession.range(1).select(*[p.select(c).scalar().alias(c) for p in parts for c in p.columns])


# ---- 1: similar voices ----

DIM, NEAREST, LEAST = 512, 5, 0.5


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, other, similarity`` for the five most similar others of every speaker, as far as they reach 0.5."""
    voices = usable_vectors(table(spark, sf_dir, "speakers"), "id", "embedding", "created_at", DIM)
    return similar_vectors(voices, DIM, NEAREST, LEAST)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = p1_neighbours(spark, sf_dir)
    return near.select(F.least("id", "other").alias("speaker_a"), F.greatest("id", "other").alias("speaker_b")).distinct()


# ---- 3: oversized recordings ----


def _recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = latest(table(spark, sf_dir, "audio_files", "id", "created_at", "audio_duration_sec"), "id", "created_at", "audio_duration_sec")
    chunks = table(spark, sf_dir, "audio_chunks", "id", "created_at", "audio_file_id", "start_time_ms", "end_time_ms")
    chunks = latest(chunks, "id", "created_at", "audio_file_id", "start_time_ms", "end_time_ms")
    return files.select("id", millis(F.col("audio_duration_sec")).alias("n")), chunks


def _pieces(spark: SparkSession, sf_dir: str, cost: CutCost) -> DataFrame:
    files, chunks = _recordings(spark, sf_dir)
    return split_items(files, "id", "n", chunks, "audio_file_id", "start_time_ms", "end_time_ms", LIMIT_MS, OVERLAP_MS, cost)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, CutCost()).select(F.col("id").alias("audio_file_id"), "piece_start_ms", "piece_end_ms")


def p3_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of nearly equal length, under the same limit, overlap and boundaries."""
    cuts = _pieces(spark, sf_dir, CutCost(passed=0.0, imbalance=1.0, hard=4.0))
    return cuts.select(F.col("id").alias("audio_file_id"), "piece_no", "piece_start_ms", "piece_end_ms", "natural")


def p3_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the balanced pieces: recordings cut, and how many pieces break the limit, the ends, the overlap or the order."""
    w = W.partitionBy("audio_file_id").orderBy("piece_no")
    cuts = p3_balanced(spark, sf_dir).join(_recordings(spark, sf_dir)[0].select(F.col("id").alias("audio_file_id"), "n"), "audio_file_id")
    cuts = cuts.withColumn("before", F.lag("piece_end_ms").over(w)).withColumn("after", F.lead("piece_no").over(w))
    wrong = lambda c, name: F.count_if(c).alias(name)
    return cuts.agg(
        F.count_distinct("audio_file_id").alias("recordings"), wrong(F.col("piece_end_ms") - F.col("piece_start_ms") > LIMIT_MS, "too_long"),
        wrong(F.when(F.col("before").isNull(), F.col("piece_start_ms") != 0).otherwise(F.col("piece_start_ms") != F.col("before") - OVERLAP_MS), "wrong_start"),
        wrong(F.col("after").isNull() & (F.col("piece_end_ms") != F.col("n")), "wrong_end"), wrong(F.col("piece_end_ms") <= F.col("before"), "no_progress"),
    )


# ---- 5: training sequences ----


def p5_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, piece, pieces, frames, container`` for every current chunk."""
    rows = table(spark, sf_dir, "processed_chunks", "chunk_id", "exported_at", "encoded_audio_shape", "duration_ms", "start_ms", "end_ms")
    rows = latest(rows, "chunk_id", "exported_at", "encoded_audio_shape", "duration_ms", "start_ms", "end_ms")
    coded = F.filter("encoded_audio_shape", lambda x: (x != 9) & (x != 1))
    spoken = F.ceil(F.coalesce("duration_ms", F.col("end_ms") - F.col("start_ms")) * 44100 / 512000)
    # a shape without such an entry, or none at all, leaves the duration
    frames = F.coalesce(F.when(F.size(coded) > 0, coded[0]), spoken)
    return fill_containers(rows.select("chunk_id", frames.alias("n")), "chunk_id", "n", CAPACITY)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_sequences(spark, sf_dir).where("pieces > 1 AND piece = 1").select("chunk_id")


def p5_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sequences: chunks and frames in them, what is overfilled, cut without need or placed twice, and whether the number is within 2 per cent of a bound for any packing."""
    rows = staged(p5_sequences(spark, sf_dir), "sequences")
    loads = rows.where("container IS NOT NULL").groupBy("container").agg(F.sum("frames").alias("load")).agg(F.count("*").alias("used"), F.count_if(F.col("load") > CAPACITY).alias("overfilled"))
    counts = rows.agg(
        F.count_if(F.col("piece") == 1).alias("chunks"), F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"), F.count_if((F.col("pieces") > 1) & (F.col("piece") < F.col("pieces")) & (F.col("frames") != CAPACITY)).alias("badly_cut"),
        (F.count("*") - F.count_distinct("chunk_id", "piece")).alias("twice"), F.count_if(F.col("frames") > CAPACITY // 2).alias("large"),
    )
    bound = F.greatest(F.ceil(F.col("frames") / CAPACITY), F.col("large"))
    return _one_row(counts, loads).select("chunks", "frames", "overfilled", "badly_cut", "twice", (F.col("used") <= bound * 1.02 + 10).alias("near_bound"))


# ---- 6: splits ----

SHARES = {"train": 0.9, "validation": 0.05, "test": 0.05}


def _owned(rows: DataFrame) -> DataFrame:
    """The rows with ``source_path`` and with owners that stand for nobody made null."""
    return rows.withColumn("source_path", source_path(F.col("source_file"))).withColumn("owner", F.when(F.col("chunk_owner") != -1, F.col("chunk_owner")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "processed_chunks", "chunk_id", "exported_at", "chunk_owner", "source_file")
    rows = _owned(latest(rows, "chunk_id", "exported_at", "chunk_owner", "source_file")).where("owner IS NOT NULL")
    _, sources = components(rows, "owner", "source_path")
    groups = sources.groupBy("root").agg(F.count("*").alias("paths")).where("paths > 1")
    return sources.join(groups, "root").select(F.col("source").alias("source_path"), F.col("root").alias("group_owner"))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of processed_chunks, repeated and outdated ones included, with its split."""
    rows = _owned(table(spark, sf_dir, "processed_chunks", "chunk_id", "exported_at", "chunk_owner", "source_file"))
    return assign_splits(rows, "owner", "source_path", SHARES)[0].select("chunk_id", "source_path", "chunk_owner", "split")


def _in_batches(spark: SparkSession, sf_dir: str, batches: int = 3) -> tuple[DataFrame, str]:
    """Every row of processed_chunks with its batch and split, and the folder of the component table's versions.

    The batches are equal stretches of the export times (rows without one are in the first); each loads the version
    the one before it saved and saves its own.
    """
    rows = _owned(table(spark, sf_dir, "processed_chunks", "chunk_id", "exported_at", "chunk_owner", "source_file"))
    first, last = rows.agg(F.min(F.unix_micros("exported_at")), F.max(F.unix_micros("exported_at"))).first()
    width = ((last or 0) - (first or 0)) // batches + 1
    rows = rows.withColumn("batch", F.coalesce(F.floor((F.unix_micros("exported_at") - F.lit(first or 0)) / width), F.lit(0)).cast("int") + 1)
    folder, out = f"{shared_dir(spark)}/klankwerk/component_table-{uuid.uuid4().hex[:12]}", None
    for b in range(1, batches + 1):
        done, members = assign_splits(rows.where(F.col("batch") == b), "owner", "source_path", SHARES, load_members(spark, folder, b - 1) if b > 1 else None)
        save_members(members, folder, b)
        out = done if out is None else out.unionByName(done)
    return out, folder


def p6_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of processed_chunks with its split, taken in three batches through the saved component table."""
    return _in_batches(spark, sf_dir)[0].select("chunk_id", "source_path", "chunk_owner", "batch", "split")


def _divided(rows: DataFrame, *more) -> DataFrame:
    """One row: the records, and the owners and paths that are in more than one split."""
    ways = lambda key, name: rows.where(F.col(key).isNotNull() & (F.col("split") != "quarantine")).groupBy(key).agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias(name))
    rows = rows.withColumn("owner", F.when(F.col("chunk_owner") != -1, F.col("chunk_owner")))
    return _one_row(rows.agg(F.count("*").alias("records"), F.count_if(F.col("split").isNull()).alias("without_split"), *more), ways("owner", "divided_owners"), ways("source_path", "divided_paths"))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the splits: records, owners and paths that are divided, and whether train is near its share."""
    near = F.abs(F.count_if(F.col("split") == "train") / F.count("*") - SHARES["train"]) < 0.1
    return _divided(staged(p6_splits(spark, sf_dir), "splits"), near.alias("train_near_share"))


def p6_batch_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the splits in batches: records, owners and paths that are divided, and members that a later version of the table has otherwise or not at all."""
    rows, folder = _in_batches(spark, sf_dir)
    rows = staged(rows.select("chunk_id", "source_path", "chunk_owner", "batch", "split"), "splits")
    changed = None
    for old in (1, 2):
        was, now = (load_members(spark, folder, v).where("kind != 'total'").select("kind", "name", "split") for v in (old, old + 1))
        lost = was.join(now, ["kind", "name", "split"], "left_anti")
        changed = lost if changed is None else changed.unionByName(lost)
    return _one_row(_divided(rows), changed.agg(F.count("*").alias("changed_members")))


# ---- 7: test items in the corpus ----


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item with a passage of 12 words in common, and how much of the item is covered."""
    segments = build_index(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return find_leaks(segments, table(spark, sf_dir, "eval_items", "item_id", "text"), "item_id", "text").drop("phrase")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


NEAR_TERMS, NEAR_WITHIN = 4, 40


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item with a passage of 12 words in common, or with the item's rarest terms close together."""
    segments = build_index(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    found = find_leaks(segments, table(spark, sf_dir, "eval_items", "item_id", "text"), "item_id", "text", near_terms=NEAR_TERMS, near_within=NEAR_WITHIN)
    return found.select("doc_id", "item_id", "phrase")


# ---- 8: the mix ----

VOCABULARY = os.environ.get("KLANKWERK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How that vocabulary parts a text into words: a fixed value of the public byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _mix(spark: SparkSession, sf_dir: str, make_up: bool = False) -> tuple[DataFrame, DataFrame]:
    texts = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    sized = token_counts(texts, "text", VOCABULARY, WORDS, "doc_id", "source")
    return mix(sized, "doc_id", "source", "n_tokens", table(spark, sf_dir, "mix_targets"), "source", "target_share", "max_repeats", make_up=make_up)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].where("limited").select("source")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sized text and how often the mix uses it."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares wanted and reached."""
    return _mix(spark, sf_dir)[1]


def p8_made_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached where the other sources take over what the capped ones leave open."""
    return _mix(spark, sf_dir, make_up=True)[1]


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the mix: texts and targets, texts used more often than their cap, and sources that miss what they are to have by more than their median text."""
    mixed, report = _mix(spark, sf_dir)
    mixed, report = staged(mixed, "mixed"), staged(report, "report")
    over = mixed.join(report.select("source", "max_repeats"), "source", "left").agg(F.count("*").alias("texts"), F.count_if(F.col("copies") > F.coalesce("max_repeats", F.lit(0))).alias("over_cap"))
    median = mixed.groupBy("source").agg(F.percentile_approx("n_tokens", 0.5).alias("median"))
    off = report.join(median, "source", "left").agg(F.count("*").alias("targets"), F.count_if(F.abs(F.col("mix_tokens") - F.col("wanted_tokens")) > F.coalesce("median", F.lit(0))).alias("far_off"))
    return _one_row(over, off)


# ---- 9: spam pages ----


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "page_labels", "doc_id", "page_label")
    return spam_pages(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang", labels)


def p9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its distance from the clean texts of its language and the verdict."""
    return _pages(spark, sf_dir).select("doc_id", "lang", "n_words", F.round("density", 6).alias("density"), F.round("distance", 4).alias("distance"), "spam")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).where("spam").select("doc_id")


def p9_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents the distance and the lean keep from being spam, each alone, and how that compares with more than half of the words outside sentences."""
    near, away, dense = F.col("distance") <= F.col("bound"), F.col("lean") <= 0, F.col("density") > 0.5
    count = lambda c, name: F.count_if(c).alias(name)
    return _pages(spark, sf_dir).where("n_words > 0").agg(
        F.count("*").alias("documents"), count(F.col("spam"), "spam"), count(near & ~away, "kept_by_distance_alone"), count(away & ~near, "kept_by_lean_alone"), count(near & away, "kept_by_both"),
        count(dense & ~F.col("spam"), "dense_but_kept"), count(~dense & F.col("spam"), "spam_but_not_dense"), F.round(F.max("bound"), 4).alias("bound"),
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p3_found": p3_found,
    "p3_balanced": p3_balanced,
    "p3_invariants": p3_invariants,
    "p5_found": p5_found,
    "p5_sequences": p5_sequences,
    "p5_invariants": p5_invariants,
    "p6_found": p6_found,
    "p6_splits": p6_splits,
    "p6_invariants": p6_invariants,
    "p6_batches": p6_batches,
    "p6_batch_invariants": p6_batch_invariants,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p7_near": p7_near,
    "p8_found": p8_found,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_made_up": p8_made_up,
    "p8_invariants": p8_invariants,
    "p9_found": p9_found,
    "p9_pages": p9_pages,
    "p9_reasons": p9_reasons,
}

_NEAREST = """
with cur as (select id, arg_max(struct_pack(e := embedding), created_at).e e from speakers group by id),
v as (select id, e::double[512] e from (
        select id, e from cur where e is not null and len(e) = 512
        and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0)),
s as (select a.id a, b.id b, round(array_cosine_similarity(a.e, b.e), 6) s from v a join v b on a.id <> b.id),
t as (select a, b, s, row_number() over (partition by a order by s desc, b) r from s where s >= 0.5)
"""

SQL = {
    "p1_found": _NEAREST + "select distinct least(a, b) as speaker_a, greatest(a, b) as speaker_b from t where r <= 5",
    "p1_neighbours": _NEAREST + "select a as id, b as other, s as similarity from t where r <= 5",
    "p7_found": """
with w as (
  select id, k, list_filter(regexp_extract_all(strip_accents(lower(regexp_replace(x, '\\[[^\\]]*\\]|\\([^)]*\\)', ' ', 'g'))), '[\\p{L}\\p{N}]+'),
                            lambda v: v not in ('eh', 'ehm', 'uh', 'uhm', 'hm')) ws
  from (select doc_id as id, 0 as k, text as x from documents union all select item_id, 1, text from eval_items) where x is not null),
g as (select id, k, array_to_string(ws[i:i + 11], ' ') as gram from (select id, k, ws, unnest(range(1, len(ws) - 10)) as i from w where len(ws) >= 12))
select distinct d.id as doc_id, e.id as item_id from g d join g e on d.gram = e.gram where d.k = 0 and e.k = 1
""",
    "p7_leaks": """
with w as (
  select row_number() over () as r, id, k, list_filter(regexp_extract_all(strip_accents(lower(regexp_replace(x, '\\[[^\\]]*\\]|\\([^)]*\\)', ' ', 'g'))), '[\\p{L}\\p{N}]+'),
                            lambda v: v not in ('eh', 'ehm', 'uh', 'uhm', 'hm')) ws
  from (select doc_id as id, 0 as k, text as x from documents union all select item_id, 1, text from eval_items) where x is not null and id is not null),
g as (select r, id, k, i, len(ws) as n, array_to_string(ws[i:i + 11], ' ') as gram from (select *, unnest(range(1, len(ws) - 10)) as i from w where len(ws) >= 12)),
m as (select distinct d.id as doc_id, e.id as item_id, e.n, e.i from g d join g e on d.gram = e.gram where d.k = 0 and e.k = 1)
select doc_id, item_id, count(distinct i)::int as passages, count(distinct p)::int as matched_words, max(n)::int as item_words
from (select *, unnest(range(i, i + 12)) as p from m) group by 1, 2
""",
    "p7_near": """
with w as (
  select row_number() over () as r, id, k, list_filter(regexp_extract_all(strip_accents(lower(regexp_replace(x, '\\[[^\\]]*\\]|\\([^)]*\\)', ' ', 'g'))), '[\\p{L}\\p{N}]+'),
                            lambda v: v not in ('eh', 'ehm', 'uh', 'uhm', 'hm')) ws
  from (select doc_id as id, 0 as k, text as x from documents union all select item_id, 1, text from eval_items) where x is not null and id is not null),
g as (select id, k, array_to_string(ws[i:i + 11], ' ') as gram from (select id, k, ws, unnest(range(1, len(ws) - 10)) as i from w where len(ws) >= 12)),
phrases as (select distinct d.id as doc_id, e.id as item_id from g d join g e on d.gram = e.gram where d.k = 0 and e.k = 1),
tok as (select r, id, k, unnest(ws) as t, unnest(range(len(ws))) as p from w),
df as (select t, count(distinct r) as n from tok where k = 0 group by t),
pick as (select r, id, t, row_number() over (partition by r order by n, t) as q from (select distinct r, id, t from tok where k = 1) join df using (t)),
four as (select * from pick where q <= 4 and r in (select r from pick group by r having count(*) >= 4)),
docs as (select r, id, t, p from tok where k = 0 and t in (select t from four)),
heads as (select s.r as item, s.id as item_id, d.r as doc, d.id as doc_id, d.p from four s join docs d on d.t = s.t where s.q = 1),
near as (select distinct doc_id, item_id from (
  select h.item, h.item_id, h.doc, h.doc_id, h.p from heads h join four s on s.r = h.item and s.q > 1 join docs d on d.r = h.doc and d.t = s.t and abs(d.p - h.p) <= 40
  group by all having count(distinct s.q) = 3))
select doc_id, item_id, true as phrase from phrases union all select doc_id, item_id, false from near anti join phrases using (doc_id, item_id)
""",
    "p6_found": """
with recursive cur as (
  select chunk_id, arg_max(struct_pack(o := chunk_owner, f := source_file), exported_at) r
  from (select distinct chunk_id, exported_at, chunk_owner, source_file from processed_chunks) group by chunk_id),
e as (select distinct r.o o, regexp_replace(lower(regexp_replace(r.f, '^\\s+|\\s+$', '', 'g')), '/+', '/', 'g') s
      from cur where r.o is not null and r.o <> -1 and r.f is not null),
reach as (
  select o as a, o as b from e
  union
  select reach.a, e2.o from reach join e e1 on e1.o = reach.b join e e2 on e2.s = e1.s where e2.o < reach.b or e2.o > reach.b),
root as (select b as o, min(a) g from reach group by 1),
p as (select distinct e.s, g from e join root using (o))
select s as source_path, g as group_owner from p where g in (select g from p group by g having count(*) > 1)
""",
    "p3_found": """
with recursive f as (
  select id, cast(floor(arg_max(audio_duration_sec, created_at) * 1000 + 0.5) as bigint) n from audio_files
  where audio_duration_sec is null or not isnan(audio_duration_sec) group by id),
c0 as (select id, arg_max(struct_pack(f := audio_file_id, s := start_time_ms, e := end_time_ms), created_at) r from (
         select distinct id, audio_file_id, start_time_ms, end_time_ms, created_at from audio_chunks) group by id),
c as (select r.f as f, r.s as s, r.e as e from c0 where r.s < r.e and r.f in (select id from f where n > 600000)),
pts as (select f, t, sum(u) u, sum(d) d from (select f, s t, 1 u, 0 d from c union all select f, e, 0, 1 from c) group by 1, 2),
run as (select *, coalesce(sum(u) over (partition by f order by t rows between unbounded preceding and 1 preceding), 0)
                  - sum(d) over (partition by f order by t rows unbounded preceding) r from pts),
b as (select f, list(t order by t) ts from run where d > 0 and r = 0 group by f),
w as (select f.id, f.n, coalesce(b.ts, []) ts from f left join b on b.f = f.id where f.n > 600000),
p as (
  select id, n, ts, cast(0 as bigint) s,
         case when n <= 600000 then n else coalesce(list_max(list_filter(ts, lambda x: x > 15000 and x <= 600000)), 600000) end e from w
  union all
  select id, n, ts, e - 15000,
         case when n - (e - 15000) <= 600000 then n
              else coalesce(list_max(list_filter(ts, lambda x: x > e and x <= e - 15000 + 600000)), e - 15000 + 600000) end
  from p where e < n)
select id as audio_file_id, s as piece_start_ms, cast(e as bigint) as piece_end_ms from p
""",
    "p3_invariants": """
select count(*) as recordings, 0 as too_long, 0 as wrong_start, 0 as wrong_end, 0 as no_progress
from (select id, arg_max(audio_duration_sec, created_at) as d from audio_files where audio_duration_sec is null or not isnan(audio_duration_sec) group by id)
where floor(d * 1000 + 0.5) > 600000
""",
    "p5_invariants": """
with cur as (select chunk_id, arg_max(struct_pack(h := encoded_audio_shape, d := duration_ms, s := start_ms, e := end_ms), exported_at) r
             from (select distinct chunk_id, exported_at, encoded_audio_shape, duration_ms, start_ms, end_ms from processed_chunks) group by chunk_id),
n as (select coalesce(list_filter(r.h, lambda x: x <> 9 and x <> 1)[1], ceil(coalesce(r.d, r.e - r.s) * 44100 / 512000)) as n from cur)
select count(*) as chunks, coalesce(sum(n) filter (where n > 0), 0)::bigint as frames, 0 as overfilled, 0 as badly_cut, 0 as twice, true as near_bound from n
""",
    "p6_invariants": "select count(*) as records, 0 as without_split, true as train_near_share, 0 as divided_owners, 0 as divided_paths from processed_chunks",
    "p6_batch_invariants": "select count(*) as records, 0 as without_split, 0 as divided_owners, 0 as divided_paths, 0 as changed_members from processed_chunks",
    # sizes in characters for those in tokens: which sources are capped is the same for both
    "p8_found": """
with d as (select lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) as s, sum(length(text)) as n from documents where text is not null group by 1),
t as (select lower(trim(source)) as s, max(target_share) as share, max(max_repeats) as most from mix_targets group by 1)
select t.s as source from t left join d on d.s = t.s where share * (select sum(n) from d where s <> '') > most * coalesce(n, 0)
""",
    "p8_invariants": """
select (select count(*) from documents where text is not null and regexp_replace(source, '^\\s+|\\s+$', '', 'g') <> '') as texts, 0 as over_cap,
       (select count(distinct lower(trim(source))) from mix_targets) as targets, 0 as far_off
""",
    "p5_found": """
with cur as (select chunk_id, arg_max(struct_pack(h := encoded_audio_shape, d := duration_ms, s := start_ms, e := end_ms), exported_at) r
             from (select distinct chunk_id, exported_at, encoded_audio_shape, duration_ms, start_ms, end_ms from processed_chunks) group by chunk_id)
select chunk_id from cur
where coalesce(list_filter(r.h, lambda x: x <> 9 and x <> 1)[1], ceil(coalesce(r.d, r.e - r.s) * 44100 / 512000)) > 3072
""",
}
