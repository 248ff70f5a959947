"""Keyword-stuffed pages and lists of links or tags, as outliers of a robust Mahalanobis distance.

Each text becomes five numbers: how much of it stands outside sentences (density), how much its three commonest words
of content take up (repetition), the entropy of its words, its share of function words and its share of links, tags and
codes. The function words of a language are learnt: the words most of its documents use. Location and scatter of the
numbers are estimated per language over all texts by concentration steps, as aggregates. A text is spam if its distance
is beyond a bound and its deviation leans to the side of spam; the bound is set on labelled pages where there are any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from klankwerk.runtime import staged

FEATURES = ("density", "repetition", "entropy", "function_words", "links")
#: Spam raises density, repetition and links, and lowers entropy and function words.
DIRECTION = (1.0, 1.0, -1.0, -1.0, 1.0)

#: A function word is one that so many documents of a language use; a language has that share of the documents.
USED_BY, LEAST_LANGUAGE = 0.7, 0.01
#: A keyword is a word of content that makes up so much of its text, and comes so often.
KEYWORD_SHARE, KEYWORD_TIMES = 0.055, 5
REACH, KEYWORD_REACH = 6, 3
SLICE_CHARS = 4 << 20

_EDGES = r"^[^\p{L}\p{N}_#]+|[^\p{L}\p{N}_]+$"
_LINK = r"https?:|www\.|://|href=|\]\(|[\p{L}\p{N}_]\.[\p{L}\p{N}_]+/|^<a$|^#[\p{L}\p{N}_]"
_CODE = r"^[A-Z]{1,3}-?\d{2,}$|^\d+[.,]\d{2}$|^(?:EUR|USD|GBP|€|\$|£)$"

_FIELDS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType())] + [T.StructField(f, T.DoubleType()) for f in FEATURES])


# ---- function words ----


def language(declared: Column) -> Column:
    """The declared language by its first two letters, null for none and for undetermined ones."""
    head = F.substring(F.lower(F.trim(declared)), 1, 2)
    return F.when(head.rlike("^[a-z]{2}$") & ~F.lower(F.trim(declared)).isin("und", "mul", "zxx", "none", "null"), head)


def learn_function_words(pages: DataFrame, text: str, lang: str) -> dict[str, list[str]]:
    """The words that at least ``USED_BY`` of a language's documents use, from counts over all documents.

    Only such words reach the driver: at most the mean number of different words of a document, divided by ``USED_BY``,
    for each of the languages that have ``LEAST_LANGUAGE`` of the documents.
    """
    told = pages.select(language(F.col(lang)).alias("g"), F.col(text).alias("x")).where("g IS NOT NULL AND length(x) > 0")
    sizes = {r.g: int(r["n"]) for r in told.groupBy("g").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    kept = [(g, float(n)) for g, n in sorted(sizes.items()) if n >= LEAST_LANGUAGE * total]
    if not kept:
        return {}
    spark = pages.sparkSession
    used = told.select("g", F.explode(F.array_distinct(F.split(F.lower("x"), r"[^\p{L}]+"))).alias("w")).where("w != ''").groupBy("g", "w").agg(F.count("*").alias("n"))
    found: dict[str, list[str]] = {g: [] for g, _ in kept}
    for r in used.join(F.broadcast(spark.createDataFrame(kept, "g string, docs double")), "g").where(F.col("n") >= USED_BY * F.col("docs")).select("g", "w").orderBy("g", "w").collect():
        found[r.g].append(r.w)
    return found


# ---- the numbers of a text ----


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces between white space of all texts, and which text each is of."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    flat, parent = lists.flatten(), np.asarray(pc.list_parent_indices(lists))
    full = np.asarray(pc.greater(pc.utf8_length(flat), 0))
    return flat.filter(pa.array(full)), parent[full]


def measure_texts(texts: pa.Array, declared: list[str | None], lists: dict[str, list[str]]) -> dict[str, np.ndarray | list]:
    """The columns ``lang``, ``n_words`` and ``FEATURES`` of some texts; all of them are worked out side by side."""
    m, names = len(texts), list(lists)
    raw, doc = _pieces(texts)
    n = np.bincount(doc, minlength=m)
    empty = {"lang": ["und"] * m, "n_words": n, **{f: np.zeros(m) for f in FEATURES}}
    if not len(doc):
        return empty
    coded = raw.dictionary_encode()
    word = coded.dictionary
    bare = pc.replace_substring_regex(word, _EDGES, "")
    special = np.asarray(pc.or_(pc.match_substring_regex(word, _LINK), pc.match_substring_regex(bare, _CODE)))
    plain = pc.utf8_lower(bare).dictionary_encode()
    meant = plain.dictionary
    used = np.array([np.asarray(pc.is_in(meant, value_set=pa.array(ws, type=meant.type))) for ws in lists.values()], dtype=bool).reshape(len(names), len(meant))
    long = np.asarray(pc.greater(pc.utf8_length(meant), 2))
    at = np.asarray(coded.indices)
    link, code = special[at], np.asarray(plain.indices)[at]

    # the language most of whose function words are there, the declared one where there are fewer than three
    counts = np.array([np.bincount(doc, weights=u[code] & ~link, minlength=m) for u in used]).reshape(len(names), m)
    named = np.array([names.index(d) if d in lists else -1 for d in declared], dtype=np.int64)
    chosen = np.where(counts.max(axis=0) >= 3, counts.argmax(axis=0), named) if len(names) else named
    any_ = used.any(axis=0) if len(names) else np.zeros(len(meant), dtype=bool)
    rows = np.vstack([used, any_[None]])  # texts of no known language take the words of all
    function = rows[chosen[doc], code] & ~link
    content = ~function & ~link & long[code]

    # how often a word comes in its text
    pair = doc.astype(np.int64) * len(meant) + code
    pairs, first, inverse, freq = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
    of, size = doc[first], n[doc]
    share = freq / n[of]
    entropy = -np.bincount(of, weights=share * np.log(share), minlength=m) / np.log(np.maximum(n, 2))
    top = np.where(content[first], freq, 0)
    order = np.lexsort((-top, of))
    place = np.arange(len(order)) - np.searchsorted(of[order], of[order])
    repetition = np.bincount(of[order], weights=np.where(place < 3, top[order], 0), minlength=m) / np.maximum(n, 1)
    keyword = content & (freq[inverse] >= np.maximum(KEYWORD_TIMES, KEYWORD_SHARE * size))

    # in a sentence: a function word within reach, no keyword within reach, and no link itself
    ends = np.cumsum(n)
    i, start, end = np.arange(len(doc)), (ends - n)[doc], ends[doc]

    def near(flag: np.ndarray, reach: int) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag)])
        return c[np.minimum(i + reach + 1, end)] - c[np.maximum(i - reach, start)] > 0

    outside = link | near(keyword, KEYWORD_REACH) | ~near(function, REACH)
    mean = lambda flag: np.bincount(doc, weights=flag, minlength=m) / np.maximum(n, 1)
    return {
        "lang": [names[c] if c >= 0 and k else "und" for c, k in zip(chosen.tolist(), n.tolist())], "n_words": n,
        "density": mean(outside), "repetition": repetition, "entropy": entropy, "function_words": mean(function), "links": mean(link),
    }


def text_features(pages: DataFrame, doc: str, text: str, lang: str, lists: dict[str, list[str]]) -> DataFrame:
    """``doc, lang, n_words`` and the five numbers of every row; whole texts, null and empty ones with zeros.

    ``lists`` has the function words of each language. ``lang`` is the language most of the text's function words are
    of, the declared one where there are fewer than three, 'und' where that is none of the known.
    """
    schema = T.StructType([pages.schema[doc], *_FIELDS.fields])
    names, kinds = [f.name for f in schema.fields], [f.type for f in to_arrow_schema(_FIELDS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # so many texts at a time as have a bounded number of characters together, one at least
            lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), dtype=np.int64)
            group = (np.cumsum(lengths) - lengths) // SLICE_CHARS
            cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                got = measure_texts(part.column(1), part.column(2).to_pylist(), lists)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(got[f.name], type=k) for f, k in zip(_FIELDS.fields, kinds)]], names=names)

    return pages.select(doc, F.col(text).alias("_text"), language(F.col(lang)).alias("_lang")).mapInArrow(measure, schema)


# ---- robust location and scatter ----

#: 97.5 and 99.9 per cent points of the chi-squared distribution with five degrees of freedom.
INNER, OUTER = 12.833, 20.515
STEPS = 3
POOLED, FEW = "und", 50


def _distance(model: dict[str, tuple[np.ndarray, np.ndarray]]):
    """The squared Mahalanobis distance of a row as an expression; languages without a model take the pooled one."""

    def one(centre: np.ndarray, precision: np.ndarray):
        x = [F.col(f) - F.lit(float(m)) for f, m in zip(FEATURES, centre)]
        terms = [F.lit(float(precision[i, j] * (1 if i == j else 2))) * x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]
        return sum(terms[1:], terms[0])

    column = one(*model[POOLED])
    for lang, fit in model.items():
        if lang != POOLED:
            column = F.when(F.col("lang") == lang, one(*fit)).otherwise(column)
    return column


def fit_scatter(features: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centre and inverse scatter of each language of at least ``FEW`` texts, and of all together under 'und'.

    From medians and median deviations, ``STEPS`` concentration steps: mean and covariance of the texts within the
    97.5 per cent point of the last fit. Every step is one aggregation over all texts; a few sums per language reach
    the driver. A feature that does not vary gets a small floor of variance.
    """
    worded = features.where("n_words > 0")
    spread = worded.withColumn("lang", F.explode(F.array_distinct(F.array("lang", F.lit(POOLED)))))
    found = spread.groupBy("lang").agg(F.count("*").alias("n"), *[F.percentile_approx(f, 0.5, 2000).alias(f) for f in FEATURES]).collect()
    medians = {r["lang"]: np.array([r[f] for f in FEATURES], dtype=float) for r in found if r["n"] >= FEW or r["lang"] == POOLED}
    if not medians:
        return {POOLED: (np.zeros(len(FEATURES)), np.eye(len(FEATURES)))}
    spread = spread.where(F.col("lang").isin(*medians))
    middle = lambda i: F.create_map(*[x for k, m in medians.items() for x in (F.lit(k), F.lit(float(m[i])))])[F.col("lang")]
    gaps = spread.groupBy("lang").agg(*[F.percentile_approx(F.abs(F.col(f) - middle(i)), 0.5, 2000).alias(f) for i, f in enumerate(FEATURES)]).collect()
    model = {r["lang"]: (medians[r["lang"]], np.diag(1 / np.maximum(1.4826 * np.array([r[f] for f in FEATURES], dtype=float), 0.02) ** 2)) for r in gaps}
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    for _ in range(STEPS):
        sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}_{j}") for i, j in pairs]
        fitted = {}
        for r in spread.where(_distance(model) <= INNER).groupBy("lang").agg(F.count("*").alias("n"), *sums).collect():
            mean = np.array([r[f"s{i}"] for i in range(len(FEATURES))]) / r["n"]
            cov = np.zeros((len(FEATURES), len(FEATURES)))
            for i, j in pairs:
                cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / r["n"] - mean[i] * mean[j]
            fitted[r["lang"]] = (mean, np.linalg.inv(cov + np.eye(len(FEATURES)) * 4e-4))
        model = {**model, **fitted}
    return model


# ---- the verdict ----


def calibrated_bound(distance: np.ndarray, spam: np.ndarray) -> float | None:
    """The distance that parts labelled spam from the rest: greatest sum of the shares of both told right.

    As labels may be wrong, distances that are worse by one label of each kind count as equally good, and of them the
    middle of the widest run without a label is taken, the lowest of equally wide ones. None where the labels are all of
    one kind. Labels of one distance stay together.
    """
    if not spam.any() or spam.all():
        return None
    order = np.argsort(distance, kind="stable")
    d, s = distance[order], spam[order]
    # a cut after the k lowest: the share of the rest below it plus that of spam above it
    right = np.concatenate([[0], np.cumsum(~s)]) / (~s).sum() + 1 - np.concatenate([[0], np.cumsum(s)]) / s.sum()
    edges = np.concatenate([[0.0], d, [d[-1] * 1.5]])
    slack = 1 / s.sum() + 1 / (~s).sum() + 1e-12
    apart = np.diff(edges) > 0
    good = np.flatnonzero(apart & (right >= right[apart].max() - slack)).tolist()
    k = max(good, key=lambda k: edges[k + 1] - edges[k])
    return float((edges[k] + edges[k + 1]) / 2)


def labelled_bound(votes: DataFrame) -> float | None:
    """``calibrated_bound`` of any number of labels: ``distance`` and how many call it spam (``bad``) and not (``fine``).

    Sorted by range and summed up in two levels; one row per partition and the cut that is taken reach the driver.
    """
    spark = votes.sparkSession
    places = votes.groupBy("distance").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    places = places.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "distance")
    places = staged(places.withColumn("part", F.spark_partition_id()), "votes")
    parts = places.groupBy("part").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"), F.min("distance").alias("lo"), F.max("distance").alias("hi")).orderBy("part").collect()
    bad, fine = sum(r["bad"] for r in parts), sum(r["fine"] for r in parts)
    if not bad or not fine:
        return None
    before, b, f = [], 0, 0
    for r, after in zip(parts, [*[r["lo"] for r in parts[1:]], parts[-1]["hi"] * 1.5]):
        before.append((r["part"], b, f, after))
        b, f = b + r["bad"], f + r["fine"]
    w = W.partitionBy("part").orderBy("distance")
    so_far = lambda c: F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col(f"{c}_before")
    cuts = places.join(F.broadcast(spark.createDataFrame(before, "part int, bad_before bigint, fine_before bigint, after double")), "part")
    cuts = cuts.select(F.col("distance").alias("a"), F.coalesce(F.lead("distance").over(w), "after").alias("b"), (so_far("fine") / fine + 1 - so_far("bad") / bad).alias("right"))
    # the cut below all
    cuts = staged(cuts.unionByName(spark.createDataFrame([(0.0, parts[0]["lo"], 1.0)], "a double, b double, right double")).where("b > a"), "cuts")
    slack = 1 / bad + 1 / fine + 1e-12
    best = cuts.agg(F.max("right")).first()[0]
    cut = cuts.where(F.col("right") >= best - slack).select("a", "b").orderBy(F.desc(F.col("b") - F.col("a")), "a").first()
    return (cut["a"] + cut["b"]) / 2


def spam_pages(pages: DataFrame, doc: str, text: str, lang: str, labels: DataFrame | None = None, label: str = "page_label", bad: str = "spam") -> DataFrame:
    """``doc, lang, n_words``, the five numbers, ``distance``, ``lean``, ``bound`` and ``spam`` of every row of ``pages``.

    ``spam`` is true where the distance is beyond the bound and the deviations, in units of the scatter, lean to the
    side of spam (``lean`` > 0). The bound is set on all of ``labels`` (columns ``doc`` and ``label``); wrong and
    repeated labels are votes like others. Without labels of both kinds it is the 99.9 per cent point of clean texts. Texts without words are never spam. Repeated
    rows come out each.
    """
    features = staged(text_features(pages, doc, text, lang, learn_function_words(pages, text, lang)), "features")
    model = fit_scatter(features)
    scale = {k: 1 / np.sqrt(np.maximum(np.diag(np.linalg.inv(p)), 1e-12)) for k, (_, p) in model.items()}

    def lean(k: str):
        terms = [F.lit(float(d * scale[k][i])) * (F.col(f) - F.lit(float(model[k][0][i]))) for i, (f, d) in enumerate(zip(FEATURES, DIRECTION))]
        return sum(terms[1:], terms[0])

    leaning = lean(POOLED)
    for k in model:
        if k != POOLED:
            leaning = F.when(F.col("lang") == k, lean(k)).otherwise(leaning)
    scored = features.withColumn("distance", F.sqrt(F.greatest(_distance(model), F.lit(0.0)))).withColumn("lean", leaning)
    bound = None
    if labels is not None:
        told = F.col(label) == bad
        votes = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc).alias("_doc")).agg(F.count_if(told).alias("bad"), F.count_if(~told).alias("fine"))
        known = scored.where("n_words > 0 AND lean > 0").select(F.col(doc).alias("_doc"), "distance")
        bound = labelled_bound(known.join(votes, "_doc").select("distance", "bad", "fine"))
    bound = float(np.sqrt(OUTER)) if bound is None else bound
    flag = (F.col("n_words") > 0) & (F.col("distance") > bound) & (F.col("lean") > 0)
    return scored.withColumn("bound", F.lit(bound)).withColumn("spam", flag)
