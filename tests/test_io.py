"""Sources, sinks, media boundaries and streaming."""

import json
import math

import pytest
from pyspark.sql import functions as F

from klankwerk import schemas as K
from klankwerk import sources, streaming
from klankwerk.functions import media


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_listing_and_lists(spark, tmp_path):
    for name in ("a/x.MP3", "a/y.txt", "z.wav"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"abc")
    listed = sources.list_objects(spark, str(tmp_path / "in"))
    assert [r.path.rsplit("/", 1)[1] for r in listed.collect()] == ["x.MP3", "z.wav"]
    assert sources.list_objects(spark, str(tmp_path / "in"), ("mp3",)).count() == 1
    sources.write_list(listed, str(tmp_path / "list"))
    assert sources.read_list(spark, str(tmp_path / "list")).count() == 2
    (tmp_path / "raw.txt").write_text("  b \n\n\t\na\n")
    assert rows(sources.read_list(spark, str(tmp_path / "raw.txt"))) == [("a",), ("b",)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sources.read_list(spark, str(tmp_path / "none.txt"))
    blobs = sources.read_blobs(spark, str(tmp_path / "in"))
    want = spark.createDataFrame([("z.wav",), ("gone.wav",)], "path string")
    assert rows(sources.with_blobs(want, "path", None, blobs).select("path")) == [("z.wav",)]
    with pytest.raises(ValueError):
        sources.with_blobs(want, "path", None, None)


def test_shards_resume_and_sizes(spark, tmp_path):
    df = spark.range(95).withColumn("v", F.col("id") * 2)
    target = str(tmp_path / "shards")
    sources.write_shards(df, ["id"], target, per_shard=40)
    assert rows(spark.read.parquet(target).groupBy("shard").count()) == [("dataset_shard_001", 40), ("dataset_shard_002", 40), ("dataset_shard_003", 15)]
    sources.write_shards(df, ["id"], target, per_shard=40)
    assert spark.read.parquet(target).count() == 95
    assert sources.shard_sizes(spark, target).agg(F.sum("row_count")).first()[0] == 95
    assert [r.id for r in sources.head(sources.read_shards(spark, target), ["id"], 3).collect()] == [0, 1, 2]


def test_jobs_get_defaults_and_broken_ones_are_marked(spark):
    texts = [(json.dumps({"audio_file_path": "a", "window_size_sec": 20, "skip_start_sec": 1, "skip_end_sec": 2}),), ('{"audio_file_path": "b"}',), ("no json",)]
    got = sources.parse_jobs(spark.createDataFrame(texts, "value string"))
    assert rows(got.select("audio_file_path", "window_size_sec", "skip_start_sec", "skip_end_sec", "broken"))[:2] == [("a", 20.0, 1.0, 2.0, False), ("b", 30.0, 80.0, 80.0, False)]
    assert got.where("broken").count() == 1
    made = sources.parse_jobs(sources.to_messages(sources.jobs_for(spark.createDataFrame([("p",)], "path string"))))
    assert made.first().skip_start_sec == 120.0


def test_metrics_and_config(spark, tmp_path):
    m = spark.createDataFrame([("r", "loss", 1, 0.5)], "run string, tag string, step int, value double")
    for _ in range(2):
        sources.append_metrics(m, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    assert sources.load_config(str(tmp_path / "none.json")) is None
    sources.save_config({"a": 1}, str(tmp_path / "c/x.json"))
    assert sources.load_config(str(tmp_path / "c/x.json")) == {"a": 1}


def test_media_stand_ins_and_failures(spark):
    df = spark.createDataFrame([("a", b"one"), ("b", b"two"), ("c", b"")], "file string, content binary")
    turns = media.diarise(df)
    assert turns.count() == 24 and rows(turns) == rows(media.diarise(df))

    def bad():
        def run(blobs):
            if b"two" in blobs:
                raise OSError
            return ["ok"] * len(blobs)

        return run

    got = dict(rows(df.select("file", media.transcribe(F.col("content"), bad, 1))))
    assert got == {"a": "ok", "b": "", "c": "ok"}
    r = df.where("file = 'a'").select(media.embed(F.col("content")).alias("e"), media.encode_audio(F.col("content")).alias("c"), media.is_readable(F.col("content")).alias("ok")).first()
    assert len(r.e) == 512 and len(r.c[0]) == K.CHANNELS and r.ok
    cut = media.cut_segments(df.withColumn("start", F.lit(0.0)).withColumn("end", F.lit(1.0)))
    assert cut.where("segment IS NULL").count() == 0


def test_stream_of_jobs_is_parsed_deduplicated_and_upserted(spark, tmp_path):
    queue, table, dead, ckpt = (str(tmp_path / x) for x in ("q", "t", "dead", "ck"))
    streaming.push(sources.jobs_for(spark.createDataFrame([("a.mp3",), ("b.mp3",)], "path string")), queue)
    spark.createDataFrame([("not json",)], "value string").write.mode("append").text(queue)
    schema = "original_file_path string, id int, success boolean, at double"
    write = streaming.table_upserter(table, schema, "original_file_path", ["id"], "at")

    def work(jobs):
        write(jobs.select(F.col("audio_file_path").alias("original_file_path"), F.lit(1).alias("id"), F.lit(True).alias("success"), F.col("timestamp").alias("at")))

    consumer = streaming.job_consumer(lambda: streaming.current(spark, table, schema)[1], work, dead)
    for _ in range(2):
        streaming.start(streaming.messages(spark, queue), consumer, ckpt).awaitTermination()
        streaming.push(sources.jobs_for(spark.createDataFrame([("a.mp3",), ("c.mp3",)], "path string")), queue)
    streaming.start(streaming.messages(spark, queue), consumer, ckpt).awaitTermination()
    done = streaming.current(spark, table, schema)[1]
    assert rows(done.select("original_file_path", "success")) == [("a.mp3", True), ("b.mp3", True), ("c.mp3", True)]
    assert spark.read.text(dead).count() == 1 and streaming.queue_length(spark, queue) == 7


def test_stream_of_voices_finds_speakers_of_earlier_batches(spark, tmp_path):
    source, store, given, ckpt = (str(tmp_path / x) for x in ("v", "s", "g", "ck"))
    schema = "key string, file int, seq int, embedding array<float>"
    for n, data in enumerate([[("a", 1, 0, [1.0, 0.0])], [("b", 2, 0, [1.0, 0.1]), ("c", 2, 1, [0.0, 1.0])]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        streaming.start(stream, streaming.identity_consumer(store, given), f"{ckpt}").awaitTermination()
    assert rows(spark.read.parquet(given).select("key", "speaker_id")) == [("a", 1), ("b", 1), ("c", 2)]
    assert spark.read.parquet(store).count() == 2
    assert math.isclose(spark.read.parquet(store).where("id = 1").first().embedding[0], 1.0)


def test_moved_files_and_listings(spark, tmp_path):
    (tmp_path / "w").mkdir()
    for n in "ab":
        (tmp_path / "w" / n).write_text(n)
    (tmp_path / "o/x").mkdir(parents=True)
    (tmp_path / "o/x/b").write_text("kept")
    plan = spark.createDataFrame([(str(tmp_path / "w/a"), "x/a"), (str(tmp_path / "w/b"), "x/b"), (str(tmp_path / "w/none"), "x/none")], "source string, target string")
    got = {r.target: r.moved for r in sources.move_files(plan, str(tmp_path / "o")).collect()}
    assert got == {"x/a": True, "x/b": True, "x/none": False}
    assert (tmp_path / "o/x/a").read_text() == "a" and (tmp_path / "o/x/b").read_text() == "kept" and not any((tmp_path / "w").iterdir())
    there = sources.present(spark.createDataFrame([("p",), ("q",)], "path string"), spark.createDataFrame([("p",), ("p",)], "path string"))
    assert rows(there) == [("p", True), ("q", False)]


def test_progress_counts_rows(spark, tmp_path):
    listener = streaming.Progress()
    spark.streams.addListener(listener)
    spark.createDataFrame([("a",), ("b",)], "value string").write.text(str(tmp_path / "q"))
    streaming.start(streaming.messages(spark, str(tmp_path / "q")), lambda df, n: df.count(), str(tmp_path / "ck")).awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(listener)
    assert sum(listener.rows.values()) >= 2 and not listener.failed


def test_shards_in_turn(spark, tmp_path):
    sources.write_shards(spark.range(9), ["id"], str(tmp_path / "s"), per_shard=4)
    assert [r.id for r in sources.in_turn(sources.read_shards(spark, str(tmp_path / "s")), ["id"])] == list(range(9))


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "k string, v int, at int"
    frame = lambda data: spark.createDataFrame(data, schema)
    write = streaming.table_upserter(path, schema, "k", [], "at", buckets=4)
    assert streaming.current(spark, path, schema)[0] == 0
    write(frame([("a", 1, 1), ("b", 1, 1), (None, 9, 9)]))
    before = rows(streaming.current(spark, path, schema)[1])
    assert before == [("a", 1, 1), ("b", 1, 1)]

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(streaming, "_put", dies)  # the rows are written, the manifest is not
        with pytest.raises(RuntimeError, match="killed"):
            write(frame([("a", 5, 5), ("c", 5, 5)]))
    version, table = streaming.current(spark, path, schema)
    assert version == 1 and rows(table) == before
    write(frame([("a", 2, 2), ("c", 2, 2), ("b", 0, 0)]))
    version, table = streaming.current(spark, path, schema)
    assert version == 2 and rows(table) == [("a", 2, 2), ("b", 0, 0), ("c", 2, 2)]
    # a version another writer has written meanwhile is never replaced
    with monkeypatch.context() as m:
        m.setattr(streaming, "_manifest", lambda *_: (1, {}))
        with pytest.raises(RuntimeError, match="another"):
            write(frame([("z", 1, 1)]))
    assert rows(streaming.current(spark, path, schema)[1]) == [("a", 2, 2), ("b", 0, 0), ("c", 2, 2)]
    write(frame([]))
    assert streaming.current(spark, path, schema)[1].count() == 3


def test_tables_go_through_jdbc_and_back(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path / 'store'};create=true"
    df = spark.createDataFrame([(i, f"t{i}" if i % 3 else None, i / 4) for i in range(50)], "id int, name string, size double")
    for half in ("id < 25", "id >= 25"):
        sources.write_jdbc(df.where(half), url, "items", driver="org.apache.derby.jdbc.EmbeddedDriver")
    whole = sources.read_jdbc(spark, url, "items", driver="org.apache.derby.jdbc.EmbeddedDriver")
    parts = sources.read_jdbc(spark, url, "items", "ID", (0, 50), 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert rows(whole) == rows(parts) == rows(df) and parts.rdd.getNumPartitions() == 4


def test_uploads_and_their_errors(spark, tmp_path):
    root = f"file://{tmp_path / 'bucket'}"
    blobs = spark.createDataFrame([("gs://x/a/b.mp3", b"abc"), ("c.mp3", b""), ("d.mp3", None)], "path string, content binary")
    for _ in range(2):
        got = {r.path: r for r in sources.upload_blobs(blobs, root, lambda uri: uri + "?signed").collect()}
    assert (tmp_path / "bucket" / "a" / "b.mp3").read_bytes() == b"abc" and got["gs://x/a/b.mp3"].url == f"{root}/a/b.mp3?signed"
    assert got["c.mp3"].length == 0 and got["c.mp3"].error is None and got["d.mp3"].error and got["d.mp3"].url is None
    assert not list((tmp_path / "bucket").rglob("*.part")) or (tmp_path / "bucket" / "d.mp3.part").exists()


def test_a_file_that_cannot_be_moved_stays(spark, tmp_path):
    (tmp_path / "one").write_text("1")
    (tmp_path / "out").write_text("no folder")
    plan = spark.createDataFrame([(str(tmp_path / "one"), "x/one")], "source string, target string")
    assert not sources.move_files(plan, str(tmp_path / "out")).first().moved and (tmp_path / "one").exists()
    assert not sources.move_files(plan, str(tmp_path / "out"), drop_failed=True).first().moved and not (tmp_path / "one").exists()


def test_histograms_of_metrics(spark, tmp_path):
    data = [("r", "a", 1, float(v)) for v in range(10)] + [("r", "b", 1, 2.0), ("r", "b", 1, 2.0), ("r", "b", 1, None), ("r", "b", 1, math.nan)]
    sources.append_histograms(spark.createDataFrame(data, "run string, tag string, step int, value double"), str(tmp_path / "h"), 3)
    got = spark.read.parquet(str(tmp_path / "h"))
    assert rows(got.select("tag", "low", "high", "row_count")) == [("a", 0.0, 3.0, 3), ("a", 3.0, 6.0, 3), ("a", 6.0, 9.0, 4), ("b", 2.0, 2.0, 2)]


def test_waves_are_read_resampled_and_written(spark):
    tone = [0.5 * math.sin(2 * math.pi * 50 * k / 8000) for k in range(800)]
    df = spark.createDataFrame([(1, tone), (2, []), (3, None)], "id int, x array<float>").select("id", media.save_wave(F.col("x"), 8000).alias("content"))
    back = {r.id: r.w for r in df.select("id", media.load_wave(F.col("content"), 8000).alias("w")).collect()}
    assert max(abs(a - b) for a, b in zip(back[1].samples, tone)) < 1e-4 and back[1].channels == 1
    assert back[2].samples == [] and back[3] is None or back[3].samples is None
    twice = df.where("id = 1").select(media.load_wave(F.col("content"), 16000).alias("w")).first().w
    assert len(twice.samples) == 1600 and twice.rate == 16000 and max(abs(a - b) for a, b in zip(twice.samples[::2], tone)) < 1e-3
    bad = spark.createDataFrame([(b"no wave",)], "content binary").select(media.load_wave(F.col("content")).alias("w")).first().w
    assert bad is None or bad.samples is None


def test_codes_are_decoded_and_said(spark):
    df = spark.createDataFrame([([[1] * 9, [1023] * 9], [5, 6, 0]), (None, [7])], "codes array<array<int>>, text array<int>")
    heard = df.select(media.decode_audio(F.col("codes"), hop=4).alias("x")).collect()
    assert len(heard[0].x) == 8 and heard[0].x[0] < heard[0].x[7] and heard[1].x is None
    said = df.select(media.generate(F.col("text"), F.col("codes")).alias("x"), media.generate(F.col("text")).alias("y")).collect()
    assert len(said[0].x) == 5 and said[0].x[:2] == [[1] * 9, [1023] * 9] and len(said[1].x) == len(said[1].y) == 2


def test_waves_are_converted_cut_and_measured(spark):
    samples = [k / 1000 for k in range(1000)]
    df = spark.createDataFrame([(samples,)], "x array<float>").select(media.save_wave(F.col("x"), 1000).alias("c")).unionByName(spark.createDataFrame([(b"x",)], "c binary"))
    got = df.select(media.wave_seconds(F.col("c")).alias("s"), media.wave_seconds(media.convert_wave(F.col("c"), 500)).alias("t"), media.load_wave(media.cut_wave(F.col("c"), F.lit(0.25), F.lit(0.5), 1000), 1000)["samples"].alias("x")).collect()
    assert got[0].s == got[0].t == 1.0 and len(got[0].x) == 250 and abs(got[0].x[0] - 0.25) < 1e-3
    assert got[1].s is None and got[1].t is None and got[1].x is None
