"""The operators for training data against brute force, and on awkward input."""

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from klankwerk.llm import containers, leaks, mixing, neighbours, pieces, queries, spam, splits

T0 = dt.datetime(2024, 3, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- 1 ----


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 20), dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.5 * rng.normal(size=(n, dim))).astype(np.float32)


def nearest_by_force(x, ids, k, least):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    out = set()
    for i in range(len(x)):
        s = np.round(u @ u[i], 6)
        best = sorted((-s[j], ids[j]) for j in range(len(x)) if j != i)[:k]
        out |= {(ids[i], j) for v, j in best if -v >= least}
    return out


def voices(spark, x, ids):
    df = spark.createDataFrame([(int(i), v.tolist(), T0) for i, v in zip(ids, x)], "id int, embedding array<float>, created_at timestamp")
    return neighbours.usable_vectors(df.withColumn("v", F.lit("clash")), "id", "embedding", "created_at", x.shape[1])


def test_neighbours_have_the_recall_of_brute_force(spark):
    x = clustered(1500, 32)
    ids = np.random.default_rng(1).permutation(1500) + 1
    want = nearest_by_force(x, ids, 5, 0.5)
    got = neighbours.similar_vectors(voices(spark, x, ids), 32, 5, 0.5, shard=128)
    got = {(r.id, r.other) for r in got.collect()}
    assert len(want & got) / len(want) >= 0.95 and len(got - want) < 0.05 * len(want)


def test_copies_ties_and_a_hot_group_are_exact(spark):
    base = clustered(30, 16, 3)
    x = np.concatenate([base, np.repeat(base[:1], 40, axis=0), base[1:3] * 2])
    ids = np.arange(1, len(x) + 1)
    got = {(r.id, r.other) for r in neighbours.similar_vectors(voices(spark, x, ids), 16, 5, -1.0).collect()}
    assert got == nearest_by_force(x, ids, 5, -1.0)


def test_unusable_outdated_and_no_vectors(spark):
    nan, later = float("nan"), T0 + dt.timedelta(1)
    data = [(1, [1.0, 0.0], T0), (2, [1.0, 0.0], T0), (2, None, later), (3, [0.0, 0.0], T0), (4, [nan, 1.0], T0), (5, [1.0], T0), (6, [1.0, None], T0), (None, [1.0, 0.0], T0), (7, [0.0, 2.0], T0), (7, [3.0, 0.0], later)]
    df = spark.createDataFrame(data, "id int, embedding array<float>, created_at timestamp")
    usable = neighbours.usable_vectors(df, "id", "embedding", "created_at", 2)
    assert [r.id for r in usable.orderBy("id").collect()] == [1, 7]
    assert rows(neighbours.similar_vectors(usable, 2)) == [(1, 7, 1.0), (7, 1, 1.0)]
    assert neighbours.similar_vectors(usable.limit(0), 2).count() == 0
    assert neighbours.similar_vectors(usable.where("id = 1"), 2).count() == 0


def test_pairs_are_found_among_many_shards(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(750, 64))
    x = np.concatenate([base, base + 0.9 * rng.normal(size=base.shape)]).astype(np.float32)
    ids = rng.permutation(len(x)) + 1
    want = nearest_by_force(x, ids, 5, 0.5)
    got = {(r.id, r.other) for r in neighbours.similar_vectors(voices(spark, x, ids), 64, 5, 0.5, shard=16).collect()}
    assert len(want & got) / len(want) >= 0.97 and not got - want


@pytest.mark.parametrize("least", [-1.0, 0.5])
def test_scanned_shards_are_exact(least):
    x = np.concatenate([clustered(700, 16), 3 * clustered(30, 16)])
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    i, j, _ = neighbours.scan_shard(x, unit, x, 6, least)
    got = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a != b}
    assert nearest_by_force(x, range(len(x)), 5, least) <= got and len(got) < 5.2 * len(x)


@pytest.mark.parametrize("n", [1, 2, 5, 40, 300])
def test_graphs_of_any_size_can_be_searched(n):
    x = clustered(n, 8, n)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found, _ = neighbours.search_graph(unit, neighbours.build_graph(unit, np.arange(n)), unit, 3)
    assert (found == np.arange(n)[:, None]).any(axis=1).mean() > 0.95


# ---- 3 ----


def greedy(duration, bounds, limit, overlap):
    out, s = [], 0
    while duration - s > limit:
        inside = [b for b in bounds if s + overlap < b <= s + limit]
        e = max(inside) if inside else s + limit
        out.append((s, e))
        s = e - overlap
    return [*out, (s, duration)]


def test_planned_cuts_are_the_longest_pieces():
    rng = random.Random(2)
    for _ in range(400):
        limit, duration = rng.randint(20, 60), rng.randint(1, 500)
        overlap, bounds = rng.randint(0, 15), sorted({rng.randint(0, 520) for _ in range(rng.randint(0, 40))})
        got = pieces.plan_cuts(duration, np.array(bounds, dtype=np.int64), limit, overlap, pieces.CutCost())
        assert [g[:2] for g in got] == greedy(duration, bounds, limit, overlap)
        even = pieces.plan_cuts(duration, np.array(bounds, dtype=np.int64), limit, overlap, pieces.CutCost(0, 1, 4))
        assert all(e - s <= limit for s, e, _ in even) and even[0][0] == 0 and even[-1][1] == duration
        assert all(a[1] - b[0] == overlap for a, b in zip(even, even[1:]))


def test_balanced_cuts_are_of_least_cost():
    cost = pieces.CutCost(0, 1, 4)
    bounds, limit, overlap, duration = [12, 20, 27, 33, 41, 48, 55], 25, 5, 70

    def every(s, target):
        if duration - s <= limit:
            yield ((duration - s - target) / limit) ** 2
            return
        inside = [b for b in bounds if s + overlap < b <= s + limit and b < duration]
        for e in inside or [s + limit]:
            for rest in every(e - overlap, target):
                yield rest + ((e - s - target) / limit) ** 2 + (0 if inside else cost.hard)

    n = -(-(duration - overlap) // (limit - overlap))
    target = (duration + (n - 1) * overlap) / n
    plan = pieces.plan_cuts(duration, np.array(bounds), limit, overlap, cost)
    assert abs(sum(((e - s - target) / limit) ** 2 + (0 if ok else cost.hard) for s, e, ok in plan) - min(every(0, target))) < 1e-9


def test_pieces_end_where_nothing_is_running(spark):
    rng = random.Random(5)
    items = [(1, 900), (2, 60), (3, 250), (4, None), (None, 900), (5, 100), (1, 900)]
    spans = [(rng.choice([1, 1, 1, 3, None]), s, s + rng.randint(-3, 30)) for s in (rng.randint(0, 920) for _ in range(120))]
    spans += [(1, 100, None), (1, 5, 30), (1, 5, 30)]
    a = spark.createDataFrame(items, "i int, n bigint").withColumn("at", F.lit("clash"))
    b = spark.createDataFrame(spans, "i int, s int, e int").withColumn("n", F.lit(1))
    got = pieces.split_items(a, "i", "n", b, "i", "s", "e", 100, 10).select("i", "piece_start_ms", "piece_end_ms")
    want = []
    for i, n in {x for x in items if x[0] and x[1] and x[1] > 100}:
        own = [(s, e) for k, s, e in spans if k == i and e is not None and s < e]
        bounds = sorted({t for _, t in own if not any(s < t < e for s, e in own)})
        want += [(i, *p) for p in greedy(n, bounds, 100, 10)]
    assert rows(got) == sorted(want, key=repr)
    assert pieces.split_items(a.limit(0), "i", "n", b, "i", "s", "e", 100, 10).count() == 0
    assert pieces.split_items(a, "i", "n", b.limit(0), "i", "s", "e", 100, 10).where("i = 3").count() == 3
    quiet = rows(pieces.quiet_boundaries(b, "i", "s", "e", slice_len=7))
    assert quiet == rows(pieces.quiet_boundaries(b, "i", "s", "e", slice_len=10_000))


# ---- 5 ----


def test_plans_place_every_rank_once_and_never_overfill():
    rng = np.random.default_rng(4)
    for _ in range(150):
        capacity = int(rng.integers(3, 120))
        histogram = Counter({int(n): int(rng.integers(1, 40)) for n in rng.integers(1, capacity + 1, int(rng.integers(1, 40)))})
        plan, used = containers.plan_containers(histogram, capacity)
        load, ranks = np.zeros(used, dtype=int), defaultdict(list)
        for n, lo, hi, first, per in plan:
            np.add.at(load, first + np.arange(hi - lo) // per, n)
            ranks[n] += range(lo, hi)
        assert all(sorted(ranks[n]) == list(range(c)) for n, c in histogram.items())
        assert load.max() <= capacity and load.min() > 0
        least = -(-sum(n * c for n, c in histogram.items()) // capacity)
        assert used <= 1.7 * least + 2


def test_containers(spark):
    rng = random.Random(6)
    data = [(str(k), rng.choice([rng.randint(1, 100), rng.randint(1, 20), 250, None, 0])) for k in range(2000)] + [("7", 50), ("7", 50), (None, 30)]
    df = spark.createDataFrame(data, "name string, n bigint").withColumn("frames", F.lit(9)).repartition(5)
    got = containers.fill_containers(df, "name", "n", 100).collect()
    sized = [r for r in got if r.container is not None]
    load = Counter()
    for r in sized:
        load[r.container] += r.frames
    assert max(load.values()) <= 100
    assert sum(load.values()) == sum(n for _, n in data if n)
    assert Counter(r.name for r in got if r.piece == 1) == Counter(n for n, _ in data)
    assert all(r.pieces == 3 for r in got if r.frames == 50 and r.piece == 3)
    assert {r.pieces for r in got if r.container is None} == {0}
    assert sum(load.values()) / (100 * len(load)) > 0.9
    assert containers.fill_containers(df.limit(0), "name", "n", 100).count() == 0


# ---- 6 ----


def roots_by_force(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_contraction_finds_the_least_node(spark, shape):
    rng = random.Random(3)
    links = {
        "random": [(rng.randint(1, 300), rng.randint(1, 300)) for _ in range(220)] + [(5, 5), (5, 5)],
        "chain": [(i, i + 1) for i in range(1, 90)],
        "star": [(50, i) for i in range(1, 120)],
        "none": [],
    }[shape]
    got = splits.contract(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint"))
    assert dict(rows(got)) == roots_by_force(links)


def test_related_records_share_a_split_and_shares_are_near(spark):
    rng = random.Random(8)
    data = [(rng.choice([1, None, rng.randint(2, 800)]), rng.choice([None, f"s{rng.randint(1, 900)}"])) for _ in range(1500)]
    data += [(10_000 + i, f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(data, "owner bigint, src string").withColumn("split", F.lit("clash")).withColumn("_o", F.lit(1)).withColumn("n", F.lit(2))
    done, members = splits.assign_splits(df, "owner", "src", {"train": 0.8, "test": 0.2})
    got = done.collect()
    assert len(got) == len(data)
    for key in ("owner", "src"):
        seen = defaultdict(set)
        for r in got:
            if r[key] is not None:
                seen[r[key]].add(r._split)
        assert all(len(x) == 1 for x in seen.values())
    share = Counter(r._split for r in got)
    assert abs(share["train"] / len(got) - 0.8) < 0.03
    assert members.where("kind = 'total'").agg(F.sum("records")).first()[0] == sum(1 for o, s in data if o is not None or s is not None)
    assert splits.assign_splits(df.limit(0), "owner", "src", {"train": 1.0})[0].count() == 0


def test_later_batches_keep_splits_and_quarantine_conflicts(spark):
    frame = lambda data: spark.createDataFrame(data, "owner bigint, src string")
    first = frame([(k, f"p{k}") for k in range(1, 41) for _ in range(k % 3 + 1)])
    done, members = splits.assign_splits(first, "owner", "src", {"a": 0.5, "b": 0.5})
    of = {r.owner: r.split for r in done.collect()}
    one = next(k for k in of if of[k] == "a")
    two, three = next(k for k in of if of[k] == "b"), next(k for k in of if of[k] == "a" and k != one)
    second = frame([(one, "new1"), (900, "new1"), (one, f"p{three}"), (two, "mix"), (three, "mix"), (901, "mix"), (902, "alone"), (903, f"p{two}")])
    again, grown = splits.assign_splits(second, "owner", "src", {"a": 0.5, "b": 0.5}, members)
    got = {(r.owner, r.src): r.split for r in again.collect()}
    assert got[901, "mix"] == splits.QUARANTINE and got[two, "mix"] == splits.QUARANTINE
    assert got[902, "alone"] in ("a", "b")
    names = {r.name: (r.split, r.component) for r in grown.where("kind = 'owner'").collect()}
    assert all(names[str(k)][0] == of[k] for k in of)
    third, last = splits.assign_splits(frame([(904, "alone"), (1000, f"p{next(k for k in of if k not in (one, two, three))}")]), "owner", "src", {"a": 0.5, "b": 0.5}, grown)
    assert {r.owner: r.split for r in third.collect()}[904] == got[902, "alone"]
    merged = splits.assign_splits(frame([(902, "alone"), (905, "alone")]), "owner", "src", {"a": 0.5, "b": 0.5}, last)[1]
    assert merged.where("name IN ('902', '905')").select("component").distinct().count() == 1


def test_merging_components_of_one_split_go_on_under_one_name(spark):
    frame = lambda data: spark.createDataFrame(data, "owner bigint, src string")
    _, members = splits.assign_splits(frame([(1, "x"), (2, "y")]), "owner", "src", {"a": 1.0})
    assert members.where("kind = 'owner'").select("component").distinct().count() == 2
    _, members = splits.assign_splits(frame([(1, "y")]), "owner", "src", {"a": 1.0}, members)
    assert members.where("kind != 'total'").select("component").distinct().count() == 1


def test_an_old_conflict_leaves_the_components_their_splits(spark):
    frame = lambda data: spark.createDataFrame(data, "owner bigint, src string")
    shares = {"a": 0.5, "b": 0.5}
    done, members = splits.assign_splits(frame([(k, f"p{k}") for k in range(1, 41)] + [(k, "big") for k in range(1, 4)]), "owner", "src", shares)
    of = {r.owner: r.split for r in done.collect()}
    other = next(k for k in of if of[k] != of[1])
    second, members = splits.assign_splits(frame([(1, "mix"), (other, "mix"), (900, "mix"), (901, "p2")]), "owner", "src", shares, members)
    got = {r.owner: r.split for r in second.collect()}
    assert got[900] == splits.QUARANTINE and got[901] == of[1]  # 901 joins nothing
    third, members = splits.assign_splits(frame([(902, "mix"), (903, "p3"), (2, "mix"), (904, "p1")]), "owner", "src", shares, members)
    got = {(r.owner, r.src): r.split for r in third.collect()}
    assert got[902, "mix"] == got[2, "mix"] == splits.QUARANTINE
    assert got[903, "p3"] == got[904, "p1"] == of[1]
    fourth, members = splits.assign_splits(frame([(905, "mix"), (906, "big")]), "owner", "src", shares, members)
    assert {r.owner: r.split for r in fourth.collect()} == {905: splits.QUARANTINE, 906: of[1]}
    kept = members.where("kind != 'total'").groupBy("component").agg(F.collect_set("split").alias("s"))
    assert all(len(r.s) == 1 for r in kept.collect())


def test_three_batches_through_a_saved_table_follow_the_rules(spark, tmp_path):
    rng, shares, table = random.Random(12), {"a": 0.6, "b": 0.4}, str(tmp_path / "table")
    known = {}
    for batch in range(3):
        wide = 60 * (batch + 1)
        data = [(rng.choice([None, 1, rng.randint(1, wide)]), rng.choice([None, f"s{rng.randint(1, wide)}"])) for _ in range(70)] + [(5000 + batch * 100 + i, f"t{batch}-{i}") for i in range(60)]
        ends = [next(int(n) for (kind, n), v in known.items() if kind == "owner" and v == x) for x in shares] if known else []
        data += [(o, f"mix{batch}") for o in ends] + [(8000 + batch, f"mix{batch}")]
        df = spark.createDataFrame(data, "owner bigint, src string").withColumn("_salt", F.lit("clash")).repartition(3)
        done, members = splits.assign_splits(df, "owner", "src", shares, splits.load_members(spark, table, batch))
        splits.save_members(members, table, batch + 1)
        got = defaultdict(set)
        for r in done.collect():
            got[r.owner, r.src].add(r.split)
        assert sum(1 for _ in data) == done.count()
        after = {(r.kind, r.name): r.split for r in splits.load_members(spark, table, batch + 1).where("kind != 'total'").collect()}
        assert all(after[k] == v for k, v in known.items())
        of = lambda o, s: [("owner", str(o))] * (o is not None) + [("source", s)] * (s is not None)
        # groups of new ones, what each is joined to, and what that makes of it
        up = roots_by_force([(x, y) for o, s in data for x in of(o, s) for y in of(o, s) if x not in known and y not in known])
        reach = defaultdict(set)
        for o, s in data:
            for x in of(o, s):
                reach[up.get(x)] |= {known[y] for y in of(o, s) if y in known}
        for x, r in up.items():
            if reach[r]:
                assert after[x] == (next(iter(reach[r])) if len(reach[r]) == 1 else splits.QUARANTINE)
            else:
                assert after[x] == after[r] and after[x] in shares
        for o, s in set(data):
            ways = {after[x] for x in of(o, s)}
            if ways:
                assert got[o, s] == (ways if len(ways) == 1 else {splits.QUARANTINE})
        names = defaultdict(set)
        for r in members.where("kind != 'total'").collect():
            names[r.component].add(r.split)
        assert all(len(x) == 1 for x in names.values())
        known = after
    assert splits.QUARANTINE in known.values()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        splits.save_members(members, table, 3)


def test_source_paths(spark):
    df = spark.createDataFrame([("\t /A//b/ ",), ("  ",), (None,)], "p string")
    assert [r[0] for r in df.select(splits.source_path(F.col("p"))).collect()] == ["/a/b/", None, None]


# ---- 7 ----


def grams(text, n):
    w = leaks.words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_words():
    assert leaks.words("[S1] Eh, Café (lacht) über d'r 12-x\n[open uhm") == ["cafe", "uber", "d", "r", "12", "x", "open"]
    assert leaks.words(None) == leaks.words("") == []


def test_leaks_match_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(25)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, make(rng.randint(2, 30))) for k in range(20)] + [(3, None), (None, "x y z"), (90, ""), (91, "zzz " * 8)]
    docs = [(k, make(rng.randint(0, 200))) for k in range(120)] + [(500, None), (501, ""), (None, "w1 w2"), (7, make(50))]
    docs += [(600 + k, make(20) + " " + " ".join(leaks.words(items[k][1])[:12]) + " " + make(20)) for k in range(20)]
    docs += [(700, " ".join([items[5][1]] * 300)), (701, "zzz " * 500)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("terms", F.lit("clash")).repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("x", F.lit(1))
    want = {(a, b) for a, x in docs for b, y in items if a is not None and b is not None and x and y and grams(x, 4) & grams(y, 4)}
    for size in (10**6, 150):
        index = leaks.build_index(d, "doc_id", "text", segment_tokens=size)
        got = leaks.find_leaks(index, i, "item_id", "text", 4)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    whole = got.where("doc_id = 700 AND item_id = 5").first()
    assert whole.matched_words == whole.item_words == len(leaks.words(items[5][1]))
    monkeypatch.setattr(leaks, "QUERY_BYTES", 300)
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(index, i, "item_id", "text", 4).collect()} == want
    assert leaks.find_leaks(index, i.limit(0), "item_id", "text", 4).count() == 0
    assert leaks.find_leaks(leaks.build_index(d.limit(0), "doc_id", "text"), i, "item_id", "text", 4).count() == 0


def test_proximity_finds_scattered_terms(spark):
    docs = spark.createDataFrame([(1, "de rode kat zat met een blauwe hoed bij de deur"), (2, "rode " + "x " * 100 + "kat hoed")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "kat rode hoed")], "item_id bigint, text string")
    got = leaks.find_leaks(leaks.build_index(docs, "doc_id", "text"), items, "item_id", "text", 12, near_terms=3, near_within=10)
    assert rows(got.select("doc_id", "phrase", "passages")) == [(1, False, 0)]


def near_by_force(docs, items, terms, within):
    """Brute force for documents and items with the corpus's rarest terms of the item within reach of the rarest."""
    texts = [(d, leaks.words(x)) for d, x in docs]
    df = Counter(w for _, ws in texts for w in set(ws))
    out = set()
    for i, x in items:
        picked = sorted({w for w in leaks.words(x) if w in df}, key=lambda w: (df[w], w))[:terms]
        for d, ws in texts if len(picked) == terms else []:
            at = {w: [p for p, v in enumerate(ws) if v == w] for w in picked}
            if any(all(any(abs(q - p) <= within for q in at[w]) for w in picked) for p in at[picked[0]]):
                out.add((d, i))
    return out


def test_proximity_does_not_depend_on_the_segments(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)]
    make = lambda n: " ".join(vocabulary[min(39, int(rng.expovariate(0.12)))] for _ in range(n))
    docs = [(k, make(rng.randint(1, 40))) for k in range(150)] + [(900, "de het een"), (901, "de rode kat zat het een")]
    items = [(k, make(rng.randint(2, 12)) + rng.choice(["", " unheard"])) for k in range(40)] + [(90, "rode kat de het een"), (91, "w1 unheard")]
    want = near_by_force(docs, items, 3, 8)
    assert (901, 90) in want and (900, 90) not in want and len(want) > 40
    i = spark.createDataFrame(items, "item_id bigint, text string")
    for parts, size in ((1, 10**6), (1, 60), (4, 200)):
        index = leaks.build_index(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts), "doc_id", "text", segment_tokens=size)
        got = leaks.find_leaks(index, i, "item_id", "text", 12, near_terms=3, near_within=8).where("NOT phrase")
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    with pytest.raises(ValueError):
        leaks.find_leaks(index, i, "item_id", "text", 12, near_terms=3, near_within=leaks.GAP)


# ---- 8 ----


def test_flight_keeps_both_sums():
    rng = random.Random(1)
    size = [float(rng.randint(1, 500)) for _ in range(2000)]
    p = mixing.flight(size, [0.3] * 2000, rng)
    assert sum(0 < x < 1 for x in p) <= 2
    assert abs(sum(p) - 600) < 1e-6 * 2000 and abs(sum(a * b for a, b in zip(p, size)) - 0.3 * sum(size)) < 1e-3
    done = mixing.landing(size, p)
    assert set(done) <= {0.0, 1.0}
    assert mixing.flight([5.0] * 10, [0.5] * 10, rng).count(1.0) in (4, 5)


def test_settling_turns_few_draws_round():
    assert mixing.settle([5.0, 3.0, 100.0], [1.0, 0.0, 1.0], 5.0) == [0.0, 0.0, 1.0]
    assert mixing.settle([5.0, 3.0], [1.0, 0.0], 1.0) == [1.0, 0.0] and mixing.settle([], [], 3.0) == []


def test_flight_is_unbiased():
    hits = np.zeros(6)
    for k in range(4000):
        size = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
        hits += mixing.flight(size, [0.5] * 6, random.Random(k))
    assert np.all(np.abs(hits / 4000 - 0.5) < 0.03)


def test_mix_reaches_its_shares(spark, monkeypatch):
    rng = random.Random(2)
    data = [(k, rng.choice(["A ", "a", "b", "c", None, "  "]), rng.choice([rng.randint(1, 400), 0])) for k in range(4000)] + [(9999, "a", None), (5, "b", 40), (5, "b", 40)]
    df = spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint").withColumn("whole", F.lit("clash"))
    targets = spark.createDataFrame([("A", 0.2, 3), ("b", 0.5, 3), (" C", 0.3, 1), ("none", 0.0, 2), ("gone", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    for block in (20_000, 50):
        monkeypatch.setattr(mixing, "BLOCK", block)
        mixed, report = mixing.mix(df, "doc_id", "source", "n_tokens", targets, "source", "target_share", "max_repeats")
        own = Counter()
        for _, s, n in data:
            if s and s.strip() and n is not None:
                own[s.strip().lower()] += n
        total = sum(own.values())
        for r in report.collect():
            share = {"a": 0.2, "b": 0.5, "c": 0.3, "none": 0.0, "gone": 0.1}[r.source]
            cap = {"a": 3, "b": 3, "c": 1, "none": 2, "gone": 2}[r.source]
            assert r.own_tokens == own[r.source] and r.limited == (share * total > cap * own[r.source])
            assert abs(r.mix_tokens - min(share * total, cap * own[r.source])) <= 401
        assert mixed.count() == sum(1 for _, s, n in data if s and s.strip() and n is not None)
        assert mixed.agg(F.max("copies")).first()[0] <= 3
    empty = mixing.mix(df.limit(0), "doc_id", "source", "n_tokens", targets, "source", "target_share", "max_repeats")
    assert empty[0].count() == 0 and empty[1].where("mix_tokens != 0").count() == 0


def test_what_capped_sources_leave_open_can_be_made_up():
    assert mixing._rise([(50.0, 20.0), (50.0, 500.0)], 100) == 1.6
    assert mixing._rise([(50.0, 20.0), (30.0, 36.0), (20.0, 500.0)], 100) == (100 - 56) / 20
    assert mixing._rise([(50.0, 500.0), (50.0, 500.0)], 100) == 1.0
    assert mixing._rise([(0.0, 5.0)], 100) == 1.0 and mixing._rise([], 0) == 1.0


def test_a_made_up_mix_has_its_size(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, "abc"[k % 3], rng.randint(1, 300)) for k in range(1500)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.2, 2), ("c", 0.1, 2)], "source string, target_share double, max_repeats int")
    total = df.agg(F.sum("n_tokens")).first()[0]
    for made_up in (False, True):
        _, report = mixing.mix(df, "doc_id", "source", "n_tokens", targets, "source", "target_share", "max_repeats", make_up=made_up)
        got = {r.source: r for r in report.collect()}
        assert got["a"].limited and got["a"].mix_tokens == got["a"].own_tokens == got["a"].share_tokens - got["a"].open_tokens
        assert all(abs(r.mix_tokens - r.wanted_tokens) <= 3 for r in got.values())
        assert (abs(sum(r.mix_tokens for r in got.values()) - total) <= 6) == made_up
        assert abs(got["b"].mix_tokens - 2 * got["c"].mix_tokens) <= 6


def test_tokens_are_counted_in_whole_texts(spark):
    texts = ["hello world", "", "x" * 50_000, "<|endoftext|>", None, "é́ \n\n\t 日本"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = dict(rows(mixing.token_counts(df, "text", queries.VOCABULARY, queries.WORDS, "doc_id")))
    encoder = mixing._encoder(queries.VOCABULARY, queries.WORDS)
    assert got == {k: len(encoder.encode_ordinary(t)) for k, t in enumerate(texts) if t is not None}


# ---- 9 ----

PROSE = "De vraag van Jan was of de lamp op tafel moest staan en ik vond dat het niet zo was. "
LISTS = {
    "tags": " ".join(f"#stoel{k}lamp" for k in range(60)),
    "links": "\n".join(f"https://x{k}.example/pagina?id={k}" for k in range(60)),
    "products": "\n".join(f"lamp{k} A{100 + k} {k},99 EUR kopen" for k in range(40)),
    "bare": " ".join(f"stoel{k} lamp{k}" for k in range(60)),
    "keyword": " ".join(f"de gratis lampenkap voor uw huis is een lampenkap van Dorp{k}" for k in range(20)),
}


def test_spam_is_told_from_prose(spark):
    rng = random.Random(3)
    nouns = [f"{a}{b}" for a in ("winter", "zomer", "tuin", "school", "brood", "markt", "kabel") for b in ("lamp", "stoel", "kast", "deur", "brief", "route")]
    sentence = lambda: f"De {rng.choice(nouns)} van {rng.choice(nouns)} was niet zo {rng.choice(nouns)} als ik dacht, maar het ging wel om de {rng.choice(nouns)}."
    clean = [(k, " ".join(sentence() for _ in range(rng.randint(6, 20))), rng.choice(["nl", None, "en"])) for k in range(300)]
    bad = [(1000 + k, x, "nl") for k, x in enumerate(LISTS.values())]
    part = [(2000 + k, " ".join(sentence() for _ in range(20)) + "\n" + x[: len(x) // 4], "nl") for k, x in enumerate(LISTS.values())]
    odd = [(3000, None, None), (3001, "", "nl"), (3002, " \n", "xx"), (3003, "lamp", "nl"), (3004, PROSE * 3000, "nl"), (3004, PROSE, "nl")]
    df = spark.createDataFrame(clean + bad + part + odd, "doc_id bigint, text string, lang string").withColumn("density", F.lit("clash"))
    votes = [(k, "spam") for k in range(1000, 1003)] + [(k, "ok") for k in (*range(40), 2000, 2001, 2004)] + [(7, "spam"), (9999, "spam"), (None, "ok"), (3, None)]
    labels = spark.createDataFrame(votes, "doc_id bigint, page_label string").withColumn("density", F.lit("clash"))
    got = spam.spam_pages(df, "doc_id", "text", "lang", labels).select("doc_id", "spam").collect()
    assert len(got) == len(clean + bad + part + odd)
    assert {r.doc_id for r in got if r.spam and r.doc_id not in (3003,)} == {b[0] for b in bad}
    assert spam.spam_pages(df.limit(0), "doc_id", "text", "lang", labels).count() == 0
    assert spam.spam_pages(df, "doc_id", "text", "lang", labels.limit(0)).where("spam AND doc_id >= 1000 AND doc_id < 1005").count() == 5


def test_function_words_are_those_most_documents_use(spark):
    docs = [("de kat en de hond", "nl"), ("de hond en een kat", "NL"), ("de vis en", " nl-BE"), ("the cat", "en"), ("the dog", "en"), (None, "en"), ("", "de"), ("x", None), ("y", "und")]
    assert spam.learn_function_words(spark.createDataFrame(docs, "t string, g string"), "t", "g") == {"nl": ["de", "en"], "en": ["the"]}


def test_numbers_of_a_text_do_not_depend_on_the_others():
    lists = {"nl": ["de", "het", "van", "was"], "en": ["the", "was"]}
    texts = ["de kat van het huis was hier", "", None, "lamp " * 40, "#a #b http://x.y/z", "\u00a0de\u2003kat  \n", PROSE * 50, "the cat was the the"]
    told = ["nl", "nl", None, "en", None, "nl", None, None]
    whole = spam.measure_texts(pa.array(texts), told, lists)
    for k, (t, g) in enumerate(zip(texts, told)):
        one = spam.measure_texts(pa.array([t], type=pa.string()), [g], lists)
        assert all(one[c][0] == whole[c][k] for c in one)
        assert one["n_words"][0] == len((t or "").split())
    assert whole["lang"] == ["nl", "und", "und", "en", "und", "nl", "nl", "en"]
    assert whole["repetition"][3] == 1.0 and whole["density"][3] == 1.0 and whole["links"][4] == 1.0
    assert abs(whole["entropy"][0] - 1.0) < 1e-9 and whole["density"][0] == 0.0
    assert spam.measure_texts(pa.array(["a b"]), [None], {})["density"][0] == 1.0


def test_bounds_part_labels_best():
    d, s = np.array([1.0, 2, 3, 9, 30, 40, 50]), np.array([0, 0, 0, 0, 1, 0, 1], dtype=bool)
    assert spam.calibrated_bound(d, s) == 19.5
    assert spam.calibrated_bound(d, s & False) is None and spam.calibrated_bound(d[:0], s[:0]) is None


def test_the_bound_is_set_on_all_labels(spark):
    rng = np.random.default_rng(2)
    for n in (1, 50, 5000):
        # distances with ties, and labels of which some are wrong
        d = np.round(rng.gamma(4.0, 3.0, n), 2)
        bad = (d > 15) ^ (rng.random(n) < 0.1)
        votes = spark.createDataFrame([(float(x), int(y), int(not y)) for x, y in zip(d, bad)], "distance double, bad bigint, fine bigint")
        assert spam.labelled_bound(votes) == spam.calibrated_bound(d, bad)
    assert spam.calibrated_bound(np.full(20, 4.0), np.arange(20) > 9) == 2.0

    # 400 labels for each of 60 pages, and spam the last of them by hash
    ids = [r.id for r in spark.range(60).orderBy(F.xxhash64("id")).collect()]
    words = lambda k: " ".join(PROSE.replace("lamp", f"lamp{k}{j}").replace("tafel", f"tafel{j}") for j in range(3 + k % 7))
    pages = spark.createDataFrame([(k, words(k), "nl") for k in ids[:-5]] + list(zip(ids[-5:], LISTS.values(), ["nl"] * 5)), "doc_id bigint, text string, lang string")
    labels = pages.select("doc_id", F.when(F.col("doc_id").isin(ids[-5:]), "spam").otherwise("ok").alias("page_label")).crossJoin(spark.range(400).select("id"))
    got = spam.spam_pages(pages, "doc_id", "text", "lang", labels).where("n_words > 0 AND lean > 0").collect()
    want = spam.calibrated_bound(np.repeat([r.distance for r in got], 400), np.repeat([r.doc_id in ids[-5:] for r in got], 400))
    assert want is not None and {r.bound for r in got} == {want}
