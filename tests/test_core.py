"""Operators outside the llm subpackage, on small frames."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from klankwerk import schemas as K
from klankwerk.functions import text as X
from klankwerk.functions import tokens as Tk
from klankwerk.functions import training as M
from klankwerk.functions.vectors import cosine
from klankwerk.operators import balance, batching, identity, metrics, parameters, store, timeline
from klankwerk.operators.dense_totals import dense_totals
from klankwerk.operators.periods import periods_and_gaps
from klankwerk.operators.positions import positions
from klankwerk.runtime import latest, millis

T0 = dt.datetime(2024, 3, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


# ---- dense totals ----


def test_totals_match_a_plain_sum_with_a_hot_key(spark):
    rng = random.Random(1)
    data = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([1.5, 2.0, None, float("nan")])) for _ in range(3000)]
    want = {}
    for k, v in data:
        if k is not None:
            s, n = want.setdefault(k, (0.0, 0))
            want[k] = (s + v, n + 1) if v is not None and not math.isnan(v) else (s, n)
    df = spark.createDataFrame(data, "k bigint, v double").withColumn("b", F.lit("clash")).repartition(7)
    got = {r.k: (r.v_total, r.v_rows) for r in dense_totals(df, "k", ["v"], blocks=3).collect()}
    assert got == want


def test_totals_of_text_keys_and_of_two_values(spark):
    df = spark.createDataFrame([("é", 1.0, 2.0), ("é", 3.0, None), ("", 1.0, 1.0)], "name string, a double, c double")
    assert rows(dense_totals(df, "name", ["a", "c"])) == [("", 1.0, 1, 1.0, 1), ("é", 4.0, 2, 2.0, 1)]


def test_totals_of_ever_new_keys_are_sent_in_parts(spark, monkeypatch):
    from klankwerk.operators import dense_totals as module

    monkeypatch.setattr(module, "FLUSH_KEYS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        df = spark.range(3000).select((F.col("id") % 1500).alias("k"), F.lit(1.0).alias("v")).repartition(2)
        assert rows(dense_totals(df, "k", ["v"])) == sorted(((k, 2.0, 2) for k in range(1500)), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_staged_tables_can_be_dropped(spark):
    from klankwerk.runtime import drop_staged, staged

    drop_staged(spark)
    assert staged(spark.range(3), "x").count() == 3 and drop_staged(spark) == 1 and drop_staged(spark) == 0


def test_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "k bigint, v double")
    assert dense_totals(empty, "k", ["v"]).count() == 0
    assert dense_totals(spark.createDataFrame([(None, 1.0)], "k bigint, v double"), "k", ["v"]).count() == 0
    assert rows(dense_totals(spark.createDataFrame([(4, None)], "k bigint, v double"), "k", ["v"])) == [(4, 0.0, 0)]


# ---- periods ----


def brute_periods(data):
    out = []
    for k in {r[0] for r in data}:
        spans = sorted((s, e) for x, s, e in data if x == k)
        at = []
        for s, e in spans:
            if at and s <= at[-1][1]:
                at[-1][1], at[-1][2] = max(at[-1][1], e), at[-1][2] + 1
            else:
                if at:
                    out.append((k, "gap", at[-1][1], s, 0))
                at.append([s, e, 1])
        out += [(k, "period", *a) for a in at]
    return sorted(out, key=repr)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-50, 200), st.integers(1, 90)), max_size=40))
def test_periods_match_brute_force_across_slices(spark, spans):
    data = [(k, s, s + n) for k, s, n in spans]
    df = spark.createDataFrame(data, "k int, s bigint, e bigint")
    assert rows(periods_and_gaps(df, ["k"], "s", "e", slice_len=20)) == brute_periods(data)


def test_periods_over_many_slices(spark):
    rng = random.Random(11)
    data = [(rng.randint(1, 3), s, s + rng.choice([1, 3, 8, 40, 200])) for s in (rng.randint(0, 3000) for _ in range(400))]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(data)] * 2, "i int, k int, s bigint, e bigint").withColumn("b", F.lit("clash"))
    for width in (7, 60, 10**6):
        assert rows(periods_and_gaps(df, ["k"], "s", "e", slice_len=width, once="i")) == brute_periods(data)


def test_equal_starts_of_one_key_are_reduced_before_they_are_sent(spark):
    same = spark.range(2_000_000).select(F.lit(1).alias("k"), F.lit(5).alias("s"), (F.col("id") % 1000 + 6).alias("e"), "id")
    for once in (None, "id"):
        found = periods_and_gaps(same, ["k"], "s", "e", once=once)
        assert rows(found) == [(1, "period", 5, 1005, 2_000_000)]


def test_periods_ignore_unusable_rows(spark):
    df = spark.createDataFrame([(1, 5, 5), (1, 9, 3), (None, 1, 2), (1, None, 2), (1, 1, None), (2, 0, 4), (2, 4, 6), (2, 0, 4)], "kind int, s bigint, e bigint")
    df = df.withColumnRenamed("kind", "who").withColumn("t", F.lit("clash"))
    assert rows(periods_and_gaps(df, ["who"], "s", "e")) == [(2, "period", 0, 6, 3)]
    assert periods_and_gaps(df.limit(0), ["who"], "s", "e").count() == 0


# ---- basics ----


def test_latest_takes_the_last_row_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, T0, 5), (1, T0 + dt.timedelta(1), 3), (1, T0 + dt.timedelta(1), 4), (2, T0, None)], "id int, at timestamp, v int")
    assert rows(latest(df, "id", "at", "v").select("id", "v")) == [(1, 4), (2, None)]


def test_millis(spark):
    df = spark.createDataFrame([(1.0005,), (81.85423623806088,), (float("nan"),), (float("inf"),), (None,), (-0.0015,)], "x double")
    assert [r[0] for r in df.select(millis(F.col("x"))).collect()][1:5] == [81854, None, None, None]


def test_positions_follow_the_order(spark):
    data = [(i * 7919 % 1000,) for i in range(1000)]
    got = positions(spark.createDataFrame(data, "v int").repartition(5), ["v"]).collect()
    assert sorted((r.position, r.v) for r in got) == [(i, i) for i in range(1000)]


# ---- store ----


def events(spark, data):
    return store.live_events(spark.createDataFrame(data, "id int, audio_file_id int, chunk_id int, speaker_id int, start_time_sec double, end_time_sec double, speaker_label string"))


def test_chunk_owner_ties_and_nulls(spark):
    ev = events(spark, [(1, 1, 1, 2, 0.0, 5.0, "A"), (2, 1, 1, 1, 5.0, 10.0, "B"), (2, 1, 1, 1, 5.0, 10.0, "B"), (3, 1, 2, None, 0.0, 9.0, "C")])
    assert rows(store.chunk_owners(ev)) == [(1, 1)]
    assert store.speaker_time(ev, 1, 2).first().duration_sec == 5.0
    assert store.speaker_time(ev, 2, 7).first().duration_sec == 0.0
    assert [r.place for r in store.chunk_summary(ev).orderBy("speaker_id").collect()] == [1, 2]


def test_upsert_keeps_id_and_takes_the_newest(spark):
    schema = "id int, path string, n int, at int"
    present = spark.createDataFrame([(1, "a", 1, 0), (2, "b", 1, 0)], schema)
    new = spark.createDataFrame([(9, "b", 5, 1), (9, "b", None, 2), (8, "c", 7, 1), (7, None, 1, 1)], schema)
    assert rows(store.upsert(present, new, "path", ["id"], "at").select("path", "id", "n", "at")) == [("a", 1, 1, 0), ("b", 2, None, 2), ("c", 8, 7, 1)]


def test_status_anti_join_and_limit(spark):
    files = spark.createDataFrame([(1, "a", True, 9.0), (2, "b", False, 9.0)], "id int, original_file_path string, success boolean, audio_duration_sec double")
    paths = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "path string")
    assert rows(store.still_to_do(paths, files)) == [("b",), ("c",)]
    assert ("a", True) in rows(store.done_status(paths, files)) and ("c", False) in rows(store.done_status(paths, files))
    chunks = spark.createDataFrame([(i, 1, i) for i in range(5)], "id int, audio_file_id int, start_time_ms int")
    assert store.chunks_of_done_files(files, chunks, 0).count() == 5
    assert store.chunks_of_done_files(files, chunks, 2).count() == 2
    left = store.delete_files(files.where("id = 1"), files, chunks, spark.createDataFrame([(1, 1, 0), (2, 2, 9)], "id int, audio_file_id int, chunk_id int"))
    assert [d.count() for d in left] == [1, 0, 1]
    new = store.numbered_after(spark.createDataFrame([("x",), ("y",)], "v string"), files, "id", ["v"])
    assert rows(new.select("v", "id")) == [("x", 3), ("y", 4)]


def test_nested_results(spark):
    data = [("f", [(((0.0, 1.0, [(0.0, 0.5, "A"), (0.5, 1.0, "B")], "p", "q"), "t", "c"))])]
    df = spark.createDataFrame(data, f"source_file string, chunks array<struct<{K.CHUNK_TEXT}>>")
    chunks = store.unnest_chunks(df)
    assert chunks.select("transcription").first()[0] == "t"
    assert rows(store.unnest_turns(chunks).select("turn_no", "speaker")) == [(0, "A"), (1, "B")]


# ---- timelines ----


def turns(spark, spans):
    return spark.createDataFrame([(1, i, float(s), float(e), "A") for i, (s, e) in enumerate(spans)], "file int, seq bigint, start double, end double, speaker string")


@pytest.mark.parametrize(
    "spans, want",
    [
        ([(0, 10), (11, 25), (26, 40), (40, 80), (81, 81.5)], [(0.0, 25.0), (26.0, 40.0)]),
        ([(0, 20), (5, 8)], [(0.0, 8.0)]),
        ([(0, 30), (30, 60)], [(0.0, 30.0), (30.0, 60.0)]),
        ([(0, 0.5), (31, 40)], [(31.0, 40.0)]),
        ([], []),
    ],
)
def test_greedy_packing(spark, spans, want):
    got = timeline.pack_greedily(turns(spark, spans), 30.0)
    assert [(r.start, r.end) for r in got.orderBy("chunk_no").collect()] == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(0, 300), st.floats(0.1, 45)), max_size=30))
def test_packing_keeps_order_and_window(spark, spans):
    spans = [(round(s, 3), round(s + n, 3)) for s, n in spans]
    got = timeline.pack_greedily(turns(spark, spans), 30.0).orderBy("chunk_no").collect()
    assert all(1.0 <= r.end - r.start <= 30 + 1e-9 for r in got)
    assert [r.start for r in got] == sorted(r.start for r in got)
    assert sum(r.turns for r in got) <= sum(1 for s, e in spans if e - s <= 30)


def test_windows_and_clipping(spark):
    files = spark.createDataFrame([(1, 80.0), (2, None)], "file int, duration double")
    t = turns(spark, [(0, 50), (10, 20), (60, 70)])
    w = timeline.processing_windows(t, files, 15, 15).first()
    assert (w.ws, w.we) == (50.0, 70.0)
    clip = timeline.clipped(turns(spark, [(5, 10), (8, 14)]), spark.createDataFrame([(1, 10.0, 20.0)], "file int, ws double, we double"))
    assert rows(clip.select("start", "end")) == [(10.0, 14.0)]
    longest = timeline.longest_turns(turns(spark, [(0, 5), (10, 15), (20, 21)])).first()
    assert longest.seq == 0
    assert timeline.turns_by_speaker(t).first().turns[0].start == 0.0


# ---- balance ----


def test_weights_and_probabilities(spark):
    df = spark.createDataFrame([(1, 30.0), (2, 90.0), (3, 7200.0)], "speaker_id int, duration_sec double")
    got = {r.speaker_id: r for r in balance.speaker_stats(df).collect()}
    assert [round(got[k].cb_weight, 3) for k in (1, 2, 3)] == [1.0, 0.667, 0.5]
    assert abs(sum(r.sample_prob for r in got.values()) - 1) < 1e-6
    assert balance.speaker_stats(df.limit(0)).count() == 0


def test_histogram_and_summary(spark):
    df = spark.createDataFrame([(0.5,), (0.50001,), (1.0,), (None,)], "w double")
    assert rows(balance.value_histogram(df, "w")) == [(0.5, 2, 66.666667), (1.0, 1, 33.333333)]


# ---- text and tokens ----


def test_text_functions(spark):
    df = spark.createDataFrame([(" <|nl|> hoi <|end|>\n", "[S1] hé [S2]", "gs://b/x/Ep.one.MP3")], "a string, b string, p string")
    r = df.select(X.strip_special_tokens(F.col("a")), X.byte_tokens(F.col("b"), 10), X.stem(F.col("p")), X.suffix(F.col("p")), X.parent_name(F.col("p")), X.object_key(F.col("p")), X.is_audio(F.col("p"))).first()
    assert tuple(r) == ("hoi", [1, 32, 104, 195, 169, 32, 2, 0, 0, 0], "Ep.one", "mp3", "x", "x/Ep.one.MP3", True)
    assert one(spark, X.byte_tokens(F.lit(None).cast("string"), 4)) == [0, 0, 0, 0]
    assert one(spark, X.byte_tokens(F.lit("x" * 2000))) == [120] * 1024
    assert one(spark, X.byte_tokens(F.lit("[S3]"), 4, speakers=2)) == [91, 83, 51, 93]
    assert one(spark, X.not_blank(F.lit(" \t\n"))) is False
    assert one(spark, X.shard_name("d", F.lit(0), F.lit(1))) == "d.parquet"
    assert one(spark, X.shard_name("d", F.lit(11), F.lit(12))) == "d_shard_012.parquet"


def frames(spark, t, c=9):
    data = [[(100 * i + j) % 1024 for j in range(c)] for i in range(t)]
    return data, spark.createDataFrame([(data,)], "x array<array<int>>")


@pytest.mark.parametrize("t", [0, 1, 15, 16, 40])
def test_delay_and_revert(spark, t):
    data, df = frames(spark, t)
    got = df.select(Tk.delayed(F.col("x")).alias("d"), Tk.codes_only(Tk.reverted(Tk.delayed(F.col("x")))).alias("r"), Tk.unflat(Tk.flat(F.col("x"))).alias("u"), Tk.shifted(F.col("x")).alias("s")).first()
    assert got.d == [[data[i - d][c] if i >= d else K.BOS for c, d in enumerate(K.DELAY)] for i in range(t)]
    assert got.r == data[: max(0, t - 15)]
    assert got.u == data
    assert got.s == (data[1:] + [[K.PAD] * 9] if t else [])


def test_framing(spark):
    data, df = frames(spark, 3)
    got = df.select(Tk.framed(F.col("x"), 8).alias("f"), Tk.framed(F.col("x"), 4).alias("g")).first()
    assert got.f == [[K.BOS] * 9, *data, [K.EOS] * 9] + [[K.PAD] * 9] * 3
    assert got.g == [[K.BOS] * 9, *data[:2], [K.EOS] * 9]
    assert len(df.select(Tk.prefilled(F.col("x"), 12).alias("p")).first().p) == 12


# ---- training ----


def test_schedule_and_steps(spark):
    steps = spark.createDataFrame([(0,), (5,), (10,), (60,), (110,)], "s int")
    got = [round(r[0], 6) for r in steps.select(M.cosine_with_warmup(F.col("s"), 1.0, 10, 110, 0.5)).collect()]
    assert got == [0.0, 0.5, 1.0, 0.5, 0.0]
    assert one(spark, M.total_steps(F.lit(1000), 16, 8, 3)) == 21


def test_softmax_entropy_and_eos(spark):
    x = [0.0, 1.0, 3.0]
    df = spark.createDataFrame([(x,)], "x array<double>")
    got = df.select(M.softmax(F.col("x")).alias("p"), M.cross_entropy(F.col("x"), F.lit(1)).alias("l"), M.eos_only_if_best(F.col("x"), 2).alias("e"), M.eos_only_if_best(F.col("x"), 1).alias("n")).first()
    p = np.exp(x) / np.exp(x).sum()
    assert np.allclose(got.p, p) and abs(got.l + math.log(p[1])) < 1e-9
    assert got.e == [None, None, 3.0] and got.n == [0.0, None, 3.0]


def test_top_p_and_pick(spark):
    df = spark.createDataFrame([(1, t, math.log(p)) for t, p in enumerate([0.5, 0.3, 0.15, 0.05])], "g int, token int, logit double")
    assert {r.token for r in metrics.top_p(df, ["g"], "token", "logit", 0.75).collect()} == {0, 1}
    assert {r.token for r in metrics.top_p(df, ["g"], "token", "logit", 0.85).collect()} == {0, 1, 2}
    assert metrics.pick(df, ["g"], "token", "logit", 0).first().token == 0
    many = spark.range(4000).withColumnRenamed("id", "g").crossJoin(F.broadcast(df.drop("g")))
    share = metrics.pick(many, ["g"], "token", "logit", 1.0, 3).where("token = 0").count() / 4000
    assert abs(share - 0.5) < 0.04


def test_losses(spark):
    data = [(0, 0, 0, 5, 5, 1.0), (0, 1, 1, 5, 4, 2.0), (0, 2, 1, K.PAD, 1, 9.0), (0, 3, 2, K.PAD, 1, 9.0)]
    df = spark.createDataFrame(data, "sample int, t int, channel int, target int, predicted int, loss double")
    got = metrics.loss_summary(df).first()
    assert (got.loss, got.mean_masked_loss, got.accuracy, got.tokens, got.non_pad_ratio) == (1.2, 1.5, 0.5, 2, 0.5)
    assert rows(metrics.channel_summary(df))[2] == (2, 0.0, 0.0, 0)
    assert metrics.loss_summary(df.limit(0)).first().loss == 0.0


def test_batches_and_draws(spark):
    df = spark.range(103)
    got = batching.batched(batching.sharded(df, ["id"], 50), 8)
    assert got.groupBy("shard", "batch_no").count().where("count != 8").count() == 0 and got.count() == 96
    order = batching.shuffled(df, ["id"])
    assert sorted(r.shuffled_place for r in order.collect()) == list(range(103))
    assert rows(order) == rows(batching.shuffled(df.repartition(3), ["id"]))
    weighted = df.withColumn("w", F.when(F.col("id") < 3, 10.0).when(F.col("id") < 6, None).otherwise(1.0))
    drawn = {r.id: r.draws for r in batching.drawn_with_replacement(weighted, "w", ["id"], 260).collect()}
    assert sum(drawn.values()) == 260 and all(abs(drawn[i] - 20) <= 1 for i in range(3)) and not {3, 4, 5} & set(drawn)
    assert batching.drawn_without_replacement(weighted, "w", ["id"], 10).count() == 10
    texts = df.select("id", batching.chosen_text(F.lit("t"), F.lit("c"), ["id"], clean_p=0.5, dropout_p=0.0).alias("x"))
    assert 30 < texts.where("x = 'c'").count() < 75


# ---- similarity ----


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [None if r[0] is None else round(r[0], 6) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, None, None, None]


def test_equal_vectors_resolve_to_one_speaker(spark):
    voices = [("a", 1, 0, [1.0, 0.0]), ("b", 1, 1, [1.0, 0.01]), ("c", 2, 0, [1.0, 0.0]), ("d", 2, 1, [0.0, 1.0]), ("e", 3, 0, None)]
    df = spark.createDataFrame(voices, "key string, file int, seq int, embedding array<float>")
    for block in (2, 100):
        got = dict(rows(identity.resolve_speakers(df, block=block)[0]))
        assert got["a"] == got["b"] == got["c"] == 1 and got["d"] == 2 and got["e"] == 3
    compat = dict(rows(identity.resolve_speakers(df, compat=True)[0]))
    assert compat["a"] != compat["b"] and compat["c"] in (compat["a"], compat["b"])


def test_voices_without_a_usable_vector_come_out(spark, tmp_path):
    from klankwerk.plans import reference

    one, at = [1.0] + [0.0] * 511, dt.datetime(2024, 3, 1)
    data = [(1, [1.0], at), (2, one, at), (3, None, at), (4, one, at), (5, [1.0], at), (6, [0.0] * 512, at)]
    spark.createDataFrame(data, K.SPEAKERS).write.parquet(f"{tmp_path}/speakers.parquet")
    assert rows(reference.resolve_speakers(spark, str(tmp_path))) == [(1, 1), (2, 2), (3, 3), (4, 2), (5, 4), (6, 5)]
    voices = spark.createDataFrame([(k, 0, k, v) for k, v, _ in data], "key int, file int, seq int, embedding array<float>")
    assert rows(identity.resolve_speakers(voices, block=1, dim=512)[0]) == [(1, 1), (2, 2), (3, 3), (4, 2), (5, 4), (6, 5)]


def test_similar_pairs_and_unusable_vectors(spark):
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [float("nan"), 1.0])]
    df = spark.createDataFrame(data, "id int, embedding array<float>")
    pairs = identity.similar_pairs(df, df, dim=2, threshold=0.5)
    assert rows(pairs) == [(1, 2, 1.0), (2, 1, 1.0)]
    assert rows(identity.nearest(pairs)) == [(1, 2, 1.0), (2, 1, 1.0)]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from klankwerk.runtime import shared_dir

    conf = lambda **x: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: x.get(k.rsplit(".", 1)[1], d)))
    with pytest.raises(ValueError):
        shared_dir(conf(master="yarn"))
    with pytest.raises(ValueError):
        shared_dir(conf(master="local-cluster[3,2,3000]"))
    assert shared_dir(conf(master="yarn", dir="hdfs://x/")) == "hdfs://x"
    assert shared_dir(conf(master="local[8]")).startswith("file:///")


def test_file_results_are_stored_with_ids_and_speakers(spark):
    turn = lambda a, b, s: (float(a), float(b), s)
    chunk = lambda a, b, turns, path, far=None: ((float(a), float(b), turns, path, far), "tekst", None)
    one, two = [1.0, 0.0], [0.0, 1.0]
    results = [
        ("x", "new.mp3", 60.0, [chunk(0, 900, [turn(0, 1, "A"), turn(1, 2, "B")], "c0"), chunk(900, 1800, [turn(1, 2, "C")], "c1", "far/c1")], True, {"start": 5.0}, {"A": one, "B": two}, T0),
        ("y", "old.mp3", 30.0, [], False, {}, None, T0),
        ("y", "old.mp3", 31.0, [chunk(0, 500, None, "c2")], True, {"start": 1.0, "end": 30.0}, {"A": [0.9, 0.1]}, T0 + dt.timedelta(1)),
        ("z", None, 9.0, None, True, {}, None, T0),
    ]
    results = spark.createDataFrame(results, f"{K.FILE_RESULT}, speaker_embeddings map<string, array<double>>, created_at timestamp")
    files = spark.createDataFrame([(7, "old.mp3", 1.0, 0.0, 1.0, False, T0)], K.AUDIO_FILES)
    speakers = spark.createDataFrame([(3, one, T0)], K.SPEAKERS)
    empty = lambda schema: spark.createDataFrame([], schema)
    got = store.store_results(results, files, empty(K.AUDIO_CHUNKS), empty(K.AUDIO_EVENTS), speakers)
    assert rows(got.files.select("id", "original_file_path", "audio_duration_sec", "processing_window_start", "processing_window_end", "success")) == [(7, "old.mp3", 31.0, 1.0, 30.0, True), (8, "new.mp3", 60.0, 5.0, 60.0, True)]
    assert rows(got.chunks.select("id", "audio_file_id", "chunk_file_path", "end_time_ms")) == [(1, 7, "c2", 500), (2, 8, "c0", 900), (3, 8, "far/c1", 1800)]
    assert rows(got.events.select("id", "audio_file_id", "chunk_id", "speaker_id", "speaker_label")) == [(1, 8, 2, 3, "A"), (2, 8, 2, 4, "B"), (3, 8, 3, None, "C")]
    assert rows(got.speakers.select("id", "embedding")) == [(3, one), (4, two)]
    again = store.store_results(results.limit(0), got.files, got.chunks, got.events, got.speakers)
    assert [x.count() for x in again] == [2, 3, 3, 2]


def test_steps_of_a_layer_and_guidance_inputs(spark):
    x = F.array(*[F.lit(v) for v in (3.0, 4.0, 0.0, 0.0)])
    assert np.allclose(one(spark, M.rms_norm(x)), [1.2, 1.6, 0, 0], atol=1e-5)
    assert np.allclose(one(spark, M.silu(x))[:2], [3 / (1 + math.exp(-3)), 4 / (1 + math.exp(-4))])
    assert np.allclose(one(spark, M.rotated(x, F.lit(2))), [3 * math.cos(2), 4 * math.cos(0.02), 3 * math.sin(2), 4 * math.sin(0.02)])
    assert one(spark, Tk.guidance_pair(F.array(F.lit(5), F.lit(6)))) == [[0, 0], [5, 6]]
    assert one(spark, Tk.first_steps(Tk.repeated(F.array(F.lit(5)), 3), 2)) == [[5], [5]]


def test_draws_over_many_blocks(spark, monkeypatch):
    df = spark.range(2000).withColumn("w", (F.col("id") % 7).cast("double"))
    whole = rows(batching.drawn_with_replacement(df, "w", ["id"], 700))
    monkeypatch.setattr(batching, "BLOCK", 4)
    assert rows(batching.drawn_with_replacement(df, "w", ["id"], 700)) == whole and sum(r[-1] for r in whole) == 700


def test_parameters_are_matched_and_summed(spark):
    shapes = spark.createDataFrame([("a", [2, 3]), ("b", []), ("c", None), (None, [1 << 20])], "name string, shape array<int>")
    assert rows(parameters.summary(shapes)) == [(3, 7 + (1 << 20), round((7 + (1 << 20)) * 4 / (1 << 20), 6))]
    assert rows(parameters.matched(shapes, spark.createDataFrame([("b",), ("d",), ("d",), (None,)], "name string"))) == [("a", "missing"), ("b", "both"), ("c", "missing"), ("d", "surplus")]
