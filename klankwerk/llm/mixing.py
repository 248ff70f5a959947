"""Mixing sources to target weights by cube-method balanced sampling.

A source's share of the mix fixes how often each of its texts is to be used, r = target tokens / own tokens, at most
its cap. Every text is used floor(r) times, and once more with probability r - floor(r): that draw is balanced by the
cube method on the number of texts and of tokens. The flight phase moves the probabilities of three texts at a time
along the null-space of the two constraints until one is 0 or 1. It runs in blocks of a source; the two undecided
texts a block may leave go to the next level, and the last block of a source lands by the rounding of least error, for
which a few texts of its smaller half are held back.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from klankwerk.runtime import staged

BLOCK = 20_000
#: Texts of a source whose draw is left to the landing, besides those the flight leaves undecided.
HELD = 10


def source_name(raw: Column) -> Column:
    """Lower case without white space at both ends; an empty name is none."""
    clean = F.lower(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    return F.when(F.length(clean) > 0, clean)


# ---- sizes ----


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, text: str, vocabulary: str, pattern: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of each row whose text is not null; whole texts, special strings as text.

    ``vocabulary`` is the path of a byte-level vocabulary of ranks, ``pattern`` the expression that parts a text into words.
    """
    schema = texts.select(*keep).schema.add("n_tokens", T.LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        for batch in batches:
            n = [len(encoder.encode_to_numpy(x, disallowed_special=())) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, type=pa.int64())], names=[*keep, "n_tokens"])

    return texts.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text")).mapInArrow(count, schema)


# ---- the cube method ----


def flight(size: list[float], chance: list[float], rng: random.Random) -> list[float]:
    """Chances moved to 0 or 1 but for two at most, the expected and actual sums of 1 and of ``size`` kept."""
    p = list(chance)
    live: list[int] = []
    for i in range(len(p)):
        if 0.0 < p[i] < 1.0:
            live.append(i)
        while len(live) == 3:
            a, b, c = live
            u, v, w = size[b] - size[c], size[c] - size[a], size[a] - size[b]
            if u == 0.0 and v == 0.0:
                u, v, w = 1.0, -1.0, 0.0
            up = down = float("inf")
            for j, x in ((a, u), (b, v), (c, w)):
                if x > 0.0:
                    up, down = min(up, (1.0 - p[j]) / x), min(down, p[j] / x)
                elif x < 0.0:
                    up, down = min(up, p[j] / -x), min(down, (1.0 - p[j]) / -x)
            step = up if rng.random() * (up + down) < down else -down
            live = []
            for j, x in ((a, u), (b, v), (c, w)):
                q = p[j] + step * x
                p[j] = q = 0.0 if q < 1e-9 else 1.0 if q > 1.0 - 1e-9 else q
                if 0.0 < q < 1.0:
                    live.append(j)
    return p


def landing(size: list[float], p: list[float]) -> list[float]:
    """The few undecided chances rounded so that the sum of sizes errs least, then the number of texts."""
    open_ = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    done, chance, n = list(p), np.array([p[i] for i in open_]), np.array([size[i] for i in open_])
    bits = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off, many = np.round(np.abs(bits @ n - chance @ n), 6), np.round(np.abs(bits.sum(axis=1) - chance.sum()), 6)
    for i, b in zip(open_, bits[np.lexsort((many, off))[0]].tolist()):
        done[i] = float(b)
    return done


def settle(size: list[float], done: list[float], over: float, most: int = 32) -> list[float]:
    """``done`` with a few draws turned round, as long as that brings the sum of sizes nearer; it is too great by ``over``.

    A very great text may be among the last undecided ones, which the landing alone cannot make up for.
    """
    n, done = np.array(size), np.array(done)
    for _ in range(most):
        gain = np.where(done == 1.0, -n, n)  # what turning each round adds
        i = int(np.argmin(np.abs(over + gain))) if len(n) else -1
        if i < 0 or abs(over + gain[i]) >= abs(over) - 1e-9:
            break
        over, done[i] = over + gain[i], 1.0 - done[i]
    return done.tolist()


def _flyer(seed: int, depth: int):
    """The flight, and for the last block of a source the landing, of one block."""

    def fly(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        # one order whatever the layout: great texts first, so that the undecided ones at the end are small
        order = np.lexsort((pd.util.hash_array(part["doc"].to_numpy()), -part["n_tokens"].to_numpy()))
        part = part.iloc[order].reset_index(drop=True)
        size, rng = part["n_tokens"].astype(float).tolist(), random.Random(f"{seed}/{depth}/{key[0]}/{key[1]}")
        p = part["chance"].tolist()
        if int(part["blocks"].iloc[0]) == 1:
            # with texts of all sizes below the median the landing comes closer than with what the flight leaves alone
            held = set(np.unique(np.linspace(len(p) // 2, len(p) - 1, HELD).astype(int)).tolist())
            fly = [i for i in range(len(p)) if i not in held]
            for i, q in zip(fly, flight([size[i] for i in fly], [p[i] for i in fly], rng)):
                p[i] = q
            p = landing(size, p)
            p = settle(size, p, float(np.dot(size, p) - np.dot(size, part["chance"])))
        else:
            p = flight(size, p, rng)
        part["chance"] = p
        part["blocks"] = -(-part["blocks"] * 2 // BLOCK)
        part["block"] = part["block"] % part["blocks"]
        return part

    return fly


def _rise(sources: list[tuple[float, float]], total: int) -> float:
    """By how much all shares are to rise, each up to its cap, for the sum to be ``total``; sources are (share, cap) in tokens."""
    left, rise, room = float(total), 1.0, sorted((x for x in sources if x[0] > 0), key=lambda x: x[1] / x[0])
    shares = sum(s for s, _ in room)
    for share, cap in room:  # those whose caps bind first
        rise = left / shares
        if cap >= share * rise:
            return rise
        left, shares = left - cap, shares - share
    return rise


def mix(sized: DataFrame, doc: str, source: str, tokens: str, targets: DataFrame, target_source: str, share: str, repeats: str, seed: int = 23, make_up: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``doc, source, n_tokens, copies``, the report of sources).

    ``sized`` has a row for each text; rows without source or size stay out, sources without a target get 0 copies.
    Sources are compared by ``source_name``; of several targets of one name the greatest counts. The mix is to hold as
    many tokens as the texts of all sources. The report has, for each target, ``source, target_share, max_repeats,
    own_tokens, share_tokens, wanted_tokens, open_tokens, mix_tokens, mix_share, limited``; ``limited`` is whether its
    cap keeps it from its share, by exact comparison of target_share * all tokens with max_repeats * own tokens, and
    ``open_tokens`` what it then lacks of ``share_tokens``. With ``make_up`` the other sources take over what is open, in
    proportion to their shares and within their caps, so that the mix has its size where the caps allow it; without,
    the mix is smaller by what is open and the shares of the others are greater for it. Null shares count as 0, null
    caps as 1. With no texts every number is 0. Repeated rows are texts of their own, drawn each for itself. The
    targets are a list the driver holds.
    """
    spark = sized.sparkSession
    names = targets.select(source_name(F.col(target_source)).alias("source"), F.coalesce(F.col(share), F.lit(0.0)).alias("target_share"), F.coalesce(F.col(repeats), F.lit(1)).cast("int").alias("max_repeats"))
    names = names.where("source IS NOT NULL").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    rows = sized.select(F.col(doc).alias("doc"), source_name(F.col(source)).alias("source"), F.col(tokens).cast("long").alias("n_tokens")).where("source IS NOT NULL AND n_tokens IS NOT NULL")
    rows = staged(rows, "sized")
    own = staged(rows.groupBy("source").agg(F.sum("n_tokens").alias("own_tokens"), F.count("*").alias("docs")), "own")
    everything = int(own.agg(F.sum("own_tokens")).first()[0] or 0)
    plan = staged(names.join(own, "source", "left").na.fill(0, ["own_tokens", "docs"]), "targets")
    rise = _rise([(r.target_share * everything, float(r.max_repeats * r.own_tokens)) for r in plan.collect()], everything) if make_up else 1.0
    asked, most_ = F.col("target_share") * F.lit(everything), F.col("max_repeats") * F.col("own_tokens")
    plan = plan.withColumn("limited", asked > most_).withColumn("share_tokens", F.floor(asked)).withColumn("wanted_tokens", F.least(asked * F.lit(rise), most_.cast("double")))
    plan = plan.withColumn("open_tokens", F.floor(F.greatest(asked - most_, F.lit(0.0))))
    plan = plan.withColumn("rate", F.when(F.col("own_tokens") > 0, F.col("wanted_tokens") / F.col("own_tokens")).otherwise(0.0))
    plan = staged(plan.withColumn("whole", F.floor(F.col("rate") + 1e-12)).withColumn("chance", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))), "plan")

    # targets are a short list, but the join is left to its size all the same
    drawn = rows.join(plan.select("source", "whole", "chance", "docs"), "source", "left").na.fill(0, ["whole", "chance"])
    sure = drawn.where("chance = 0").select("doc", "source", "n_tokens", F.col("whole").cast("int").alias("copies"))
    level = drawn.where("chance > 0").withColumn("blocks", F.ceil(F.col("docs") / BLOCK)).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc", "n_tokens"), F.col("blocks")))
    level = level.select("doc", "source", "n_tokens", "whole", "chance", "block", "blocks")
    schema, depth, decided = level.schema, 0, [sure]
    most = int(plan.agg(F.max("docs")).first()[0] or 0)
    blocks = -(-most // BLOCK)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        last = blocks <= 1
        flown = staged(level.repartition(tasks, "source", "block").groupBy("source", "block").applyInPandas(_flyer(seed, depth), schema), f"flight{depth}")
        decided.append(flown.where("chance = 0 OR chance = 1").select("doc", "source", "n_tokens", (F.col("whole") + F.col("chance")).cast("int").alias("copies")))
        if last:
            break
        level, blocks, depth = flown.where("chance > 0 AND chance < 1"), -(-blocks * 2 // BLOCK), depth + 1
    mixed = decided[0]
    for part in decided[1:]:
        mixed = mixed.unionByName(part)
    reached = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"))
    reached = plan.join(reached, "source", "left").na.fill(0, ["mix_tokens"])
    total = int(reached.agg(F.sum("mix_tokens")).first()[0] or 0)
    report = reached.select("source", "target_share", "max_repeats", "own_tokens", "share_tokens", F.floor("wanted_tokens").alias("wanted_tokens"), "open_tokens", "mix_tokens", (F.col("mix_tokens") / F.lit(max(1, total))).alias("mix_share"), "limited")
    return mixed.withColumnRenamed("doc", doc), report
