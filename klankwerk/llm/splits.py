"""Train, validation and test splits that keep related records together.

Records are related by a shared owner or a shared source, directly or through others. The components are kept as a
table of members (one row per owner and per source) that later batches of records extend, and that is saved in
versions. Within a batch, components are found on the owners alone: an owner is linked to the least owner of each of
its sources, links are contracted to their roots by pointer jumping, and the contracted links go into the next round,
far fewer each time. All states are tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from klankwerk.runtime import free_name, staged

QUARANTINE = "quarantine"


def source_path(raw: Column) -> Column:
    """White space at both ends taken off, lower case, each run of slashes one; an empty path is null."""
    clean = F.regexp_replace(F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")), "/+", "/")
    return F.when(F.length(clean) > 0, clean)


def contract(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected ``links`` (columns ``a``, ``b``): the least node it is joined to.

    Each round every node points to its least neighbour, the pointers are jumped, and the links are carried over to
    what their ends point to. Roots of a round are never above their neighbours, so the number of rounds is the
    logarithm of the number of nodes at most, and a star of any size takes one. Links to itself and repeated links
    change nothing; a node without another is its own root; nulls are ignored.
    """
    live = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    both = staged(live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    live = both.where("a != b")
    while not live.isEmpty():
        jumped = live.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("up"))
        while True:  # until every pointer is at a root of this round; the way left is a quarter each time
            jumped = staged(jumped.select("node", "up"), "pointers")
            onward = jumped.select(F.col("node").alias("up"), F.col("up").alias("next"))
            twice = onward.select(F.col("up").alias("next"), F.col("next").alias("last"))
            jumped = jumped.join(onward, "up").join(twice, "next").select("node", F.col("last").alias("up"), (F.col("last") != F.col("up")).alias("moved"))
            if jumped.where("moved").isEmpty():
                break
        over = lambda df, c, jumped=jumped: df.join(jumped.select(F.col("node").alias(c), F.col("up").alias("_up")), c, "left").withColumn(c, F.coalesce("_up", c)).drop("_up")
        live = staged(over(over(live, "a"), "b").where("a != b").select("a", "b").distinct(), "links")
        roots = over(roots, "root").select("node", "root")  # one look-up for each round, all taken at the end
    return staged(roots, "roots")


def components(records: DataFrame, owner: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(``owner, root``, ``source, root``) of the graph of ``records``: the root is the least owner of the component.

    Records with a null owner or source give no link; a source all of whose records lack an owner is in neither table.
    """
    edges = staged(records.select(F.col(owner).cast("long").alias("o"), F.col(source).alias("s")).where("o IS NOT NULL").distinct(), "edges")
    least = staged(edges.where("s IS NOT NULL").groupBy("s").agg(F.min("o").alias("m")), "least")
    # owners of a hot source are spread over the tasks of a salt; no pairs of owners are made
    links = _joined(edges, least, "s", spread=True).select(F.col("o").alias("a"), F.coalesce("m", "o").alias("b"))
    roots = contract(links)
    sources = _joined(least, roots.select(F.col("node").alias("m"), "root"), "m", spread=True).select(F.col("s").alias("source"), "root")
    return roots.select(F.col("node").alias("owner"), "root"), sources


# ---- the component table ----

_MEMBERS = "kind string, name string, component string, split string, records bigint"


def no_members(spark: SparkSession) -> DataFrame:
    """The component table before any batch: ``kind`` is 'owner' or 'source', ``name`` the owner as text or the path.

    Rows of kind 'total' have the number of records of a batch in each split.
    """
    return spark.createDataFrame([], _MEMBERS)


def save_members(members: DataFrame, folder: str, version: int) -> None:
    """Write the table as a new version of ``folder``; a version that is there is an error, none is ever changed."""
    members.write.mode("errorifexists").option("compression", "zstd").parquet(f"{folder}/version={version}")


def load_members(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """A version as it was saved; version 0 is the empty table, a missing one is an error."""
    return no_members(spark) if version == 0 else spark.read.schema(_MEMBERS).parquet(f"{folder}/version={version}")


# ---- the splits ----


def assign_splits(records: DataFrame, owner: str, source: str, shares: Mapping[str, float], members: DataFrame | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The records with a column ``split`` (with underscores in front if that is taken), and the extended component table.

    Owner and source of a record share its split, and so does whatever they are joined to. Owners and sources that an
    earlier batch knows keep their split. New ones that are joined to each other, directly or through others that are
    new, are a group: joined to known ones of one split it takes that split, and all components it joins go on under
    one name; joined to known ones of several splits it is 'quarantine'. So is a record whose owner and source are
    known with different splits. A group joined to nothing known fills what the splits lack of their ``shares`` of all
    records so far: groups above a thousandth of the records go one by one, greatest first, to the split that lacks
    most, the others by a hash of their root in proportion to what is then lacking. A record without owner and source
    is a component of its own (by its hash; equal rows go together). Repeated rows each count. Every record comes out
    once. All decisions are made on the distinct pairs of owner and source, so that hot owners and sources are small.
    """
    spark = records.sparkSession
    first, members = members is None, no_members(spark) if members is None else members
    total_share = sum(shares.values())
    mark = free_name(records.columns, "split")
    own, src = F.col(owner).cast("long"), F.col(source)
    counted = staged(records.groupBy(own.alias("o"), src.alias("s")).agg(F.count("*").alias("n")), "counted")
    all_records = int(counted.agg(F.sum("n")).first()[0] or 0)

    # the known split and component of either side of a pair; nulls are parted off before the joins
    known = lambda kind, key, to: members.where(F.col("kind") == kind).select(F.col("name").cast("long" if kind == "owner" else "string").alias(key), F.col("split").alias(f"{to}_split"), F.col("component").alias(f"{to}_component"))
    pairs = counted.where("o IS NOT NULL OR s IS NOT NULL")
    if first:
        pairs = pairs.select("*", *[F.lit(None).cast("string").alias(c) for c in ("o_split", "o_component", "s_split", "s_component")])
    else:
        pairs = staged(_joined(_joined(pairs, known("owner", "o", "o"), "o"), known("source", "s", "s"), "s"), "pairs")

    # groups of new owners and sources: links are between new ones alone, the rest hangs on known ones
    new_o, new_s = F.col("o").isNotNull() & F.col("o_split").isNull(), F.col("s").isNotNull() & F.col("s_split").isNull()
    owners, sources = components(pairs.select(F.when(new_o, F.col("o")).alias("o"), F.when(new_s, F.col("s")).alias("s")), "o", "s")
    root = lambda c: F.concat(F.lit("o:"), F.col(c).cast("string"))
    bare = pairs.where(new_s).select("s").distinct().join(sources.select(F.col("source").alias("s")), "s", "left_anti")
    sources = sources.select("source", root("root").alias("s_root")).unionByName(bare.select(F.col("s").alias("source"), F.concat(F.lit("s:"), "s").alias("s_root")))
    owners = owners.select(F.col("owner").alias("o"), root("root").alias("o_root"))
    pairs = staged(_joined(_joined(pairs, owners, "o"), sources.withColumnRenamed("source", "s"), "s"), "pairs")

    # what a group is joined to, and what known components are joined to each other
    touch = pairs.select(F.coalesce("o_root", "s_root").alias("root"), F.coalesce("o_split", "s_split").alias("split"), F.coalesce("o_component", "s_component").alias("component"))
    touch = touch.where("root IS NOT NULL AND split IS NOT NULL").distinct()
    staged_ = (lambda df, name: spark.createDataFrame([], df.schema)) if first else staged  # nothing is known before the first batch
    old = staged_(touch.groupBy("root").agg(F.when(F.min("split") == F.max("split"), F.min("split")).otherwise(QUARANTINE).alias("old")), "old")
    touch = staged_(touch.join(old, "root").where(F.col("split") == F.col("old")), "touch")
    direct = pairs.where("o_split = s_split AND o_component != s_component").select(F.col("o_split").alias("split"), F.col("o_component").alias("p"), F.col("s_component").alias("q"))
    merged = touch.groupBy("root", "split").agg(F.min("component").alias("p")).join(touch.select("root", "split", F.col("component").alias("q")), ["root", "split"]).where("p != q").select("split", "p", "q")
    key = lambda c: F.concat("split", F.lit("\u0001"), c)
    links = direct.unionByName(merged).select(key("p").alias("a"), key("q").alias("b"))
    renamed = (links.select(F.col("a").alias("node"), F.col("b").alias("root")) if first or links.isEmpty() else contract(links)).where("node != root")
    part = lambda c, i: F.element_at(F.split(c, "\u0001"), i)
    renamed = staged_(renamed.select(part("node", 1).alias("split"), part("node", 2).alias("component"), part("root", 2).alias("_to")), "renamed")
    name = lambda rows: rows.join(renamed, ["split", "component"], "left").withColumn("component", F.coalesce("_to", "component")).drop("_to")
    members = name(members).select("kind", "name", "component", "split", "records")
    joined = name(touch.groupBy("root", F.col("old").alias("split")).agg(F.min("component").alias("component")))
    verdict = old.join(joined.select("root", "component"), "root", "left").select("root", F.col("old").alias("split"), F.coalesce("component", F.concat(F.lit("q:"), "root")).alias("component"))

    # new groups fill what is lacking; sums over the splits and at most a thousand heavy groups reach the driver
    sizes = staged(pairs.where("o_root IS NOT NULL OR s_root IS NOT NULL").groupBy(F.coalesce("o_root", "s_root").alias("root")).agg(F.sum("n").alias("n")).join(old, "root", "left"), "sizes")
    fresh = sizes.where("old IS NULL")
    kept = F.when(F.col("o_split").isNotNull() & F.col("s_split").isNotNull() & (F.col("o_split") != F.col("s_split")), F.lit(QUARANTINE)).otherwise(F.coalesce("o_split", "s_split"))
    have = {r.split: int(r.n or 0) for r in members.where("kind = 'total'").groupBy("split").agg(F.sum("records").alias("n")).collect()}
    everything = all_records + sum(have.values())
    for rows in (sizes.where("old IS NOT NULL").groupBy(F.col("old").alias("k")), pairs.where("o_root IS NULL AND s_root IS NULL").groupBy(kept.alias("k"))):
        for r in rows.agg(F.sum("n").alias("n")).collect():
            have[r.k] = have.get(r.k, 0) + int(r.n)
    lack = {k: everything * v / total_share - have.get(k, 0) for k, v in shares.items()}
    heavy = {}
    for r in fresh.where(F.col("n") > max(1, all_records // 1000)).orderBy(F.desc("n"), "root").collect():
        choice = max(lack, key=lambda k: (lack[k], k))
        heavy[r.root] = choice
        lack[choice] -= int(r.n)
    room = {k: max(v, 0.0) for k, v in lack.items()}
    room = room if sum(room.values()) else dict(shares)
    picked = spark.createDataFrame(list(heavy.items()), "root string, pick string")
    decided = fresh.join(F.broadcast(picked), "root", "left").select("root", F.coalesce("pick", _by_share(F.xxhash64(F.lit(seed), F.col("root")), room)).alias("split"), F.col("root").alias("component"))
    decided = staged(decided.unionByName(verdict), "decided")

    # every pair's split: that of its group, or of the known side, or of both known sides
    of = decided.select(F.col("root").alias("_r"), F.col("split").alias("_g"))
    split = F.when(F.col("_g").isNull(), kept).otherwise(F.col("_g"))
    settled = pairs.withColumn("_r", F.coalesce("o_root", "s_root"))
    settled = staged(_joined(settled, of, "_r").select("o", "s", "n", split.alias("_split")), "settled")
    done = _marked(records, own, src, settled, mark, _by_share(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`").cast("string") for c in records.columns]), shares))

    nodes = owners.select(F.lit("owner").alias("kind"), F.col("o").cast("string").alias("name"), F.col("o_root").alias("root")).unionByName(sources.select(F.lit("source").alias("kind"), F.col("source").alias("name"), F.col("s_root").alias("root")))
    new = nodes.join(decided, "root").select("kind", "name", "component", "split", F.lit(0).cast("long").alias("records"))
    none = F.lit(None).cast("string")
    sums = settled.groupBy("_split").agg(F.sum("n").alias("records")).select(F.lit("total").alias("kind"), none.alias("name"), none.alias("component"), F.col("_split").alias("split"), "records")
    return done, staged(members.unionByName(new).unionByName(sums), "members")


SALT = 16


def _joined(pairs: DataFrame, known: DataFrame, key: str, spread: bool = False) -> DataFrame:
    """``pairs`` with the columns of ``known`` by ``key``; rows with a null key take no part in the join.

    With ``spread`` the pairs of a hot key go to ``SALT`` tasks, to each of which the key's one row of ``known`` is
    sent; without, the planner broadcasts a small ``known`` and splits a hot partition.
    """
    more = [c for c in known.columns if c != key]
    some = pairs.where(F.col(key).isNotNull())
    if spread:
        # never broadcast: the planner's estimate of its size does not know of the copies
        wide = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).hint("merge")
        some = some.withColumn("_salt", F.pmod(F.xxhash64(*pairs.columns), F.lit(SALT)).cast("int")).join(wide, [key, "_salt"], "left")
    else:
        some = some.join(known, key, "left")
    types = dict(known.dtypes)
    return some.select(*pairs.columns, *more).unionByName(pairs.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(types[c]).alias(c) for c in more]))


def _marked(records: DataFrame, own: Column, src: Column, settled: DataFrame, mark: str, lone: Column) -> DataFrame:
    """The records with the split of their pair of owner and source, in a column ``mark``; ``lone`` is for those with neither.

    A hot pair's records are spread over ``SALT`` tasks by the split of the input they are in.
    """
    names = [f"`{c}`" for c in records.columns]
    o, s, h, to = (free_name([*records.columns, mark], x) for x in ("_o", "_s", "_h", "_to"))
    tagged = records.withColumn(o, own).withColumn(s, src)
    text = lambda a, b: F.concat(F.coalesce(F.col(a).cast("string"), F.lit("")), F.lit("\u0001"), F.when(F.col(b).isNotNull(), F.concat(F.lit("\u0002"), b)).otherwise(F.lit("")))
    paired = tagged.where(F.col(o).isNotNull() | F.col(s).isNotNull()).withColumn(o, text(o, s)).withColumn(h, F.pmod(F.spark_partition_id(), F.lit(SALT)))
    wide = settled.select(text("o", "s").alias(o), F.col("_split").alias(to)).withColumn(h, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).hint("merge")
    done = paired.join(wide, [o, h]).select(*names, F.col(to).alias(mark))
    return done.unionByName(tagged.where(F.col(o).isNull() & F.col(s).isNull()).select(*names, lone.alias(mark)))


def _by_share(hashed: Column, shares: Mapping[str, float]) -> Column:
    """A name of ``shares`` by a hash, in proportion."""
    u, pick, edge, whole = F.pmod(hashed, F.lit(1 << 40)) / float(1 << 40), F.lit(None).cast("string"), 0.0, sum(shares.values())
    for k, v in shares.items():
        edge += v / whole
        pick = F.coalesce(pick, F.when((u < edge) if k != list(shares)[-1] else F.lit(True), F.lit(k)))
    return pick
