"""Passages of test items inside a corpus, by a distributed positional inverted index.

The corpus is indexed in segments: each split of the corpus becomes segments of a bounded number of tokens, and a
segment is one row with its terms, their posting lists (token positions, as differences) and the starts of its
documents. No posting is shuffled. Test items are turned around as well: each passage stands under its rarest term, by
the document frequencies of the whole corpus. A segment takes up the passages under the terms it has, with the rarest
term's posting list as candidate places, and intersects them with the other terms' lists, shifted by their offsets in
the passage, from the rarest on; what has nothing left, or a term the segment lacks, is done with at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from klankwerk.runtime import staged

FILLERS = ("eh", "ehm", "uh", "uhm", "hm")
SEGMENT_TOKENS = 400_000
SLICE_CHARS = 4 << 20
GAP = 64
QUERY_BYTES = 16 << 20
CANDIDATES = 1 << 22
_ASIDE = r"\[[^\]]*\]|\([^)]*\)"
_BETWEEN = r"[^\p{L}\p{N}]+"

_SEGMENT = T.StructType(
    [
        T.StructField("segment", T.StringType()),
        T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("dfs", T.ArrayType(T.IntegerType())),
        T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("widths", T.ArrayType(T.IntegerType())),
        T.StructField("postings", T.BinaryType()),
        T.StructField("docs", T.ArrayType(T.LongType())),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("gap", T.IntegerType()),
    ]
)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and which text each is of.

    Words are lower-case runs of letters and digits without combining marks; asides in brackets and hesitations are
    left out. A null text has none.
    """
    plain = pc.utf8_lower(pc.replace_substring_regex(pc.fill_null(texts, ""), _ASIDE, " "))
    if not pc.all(pc.string_is_ascii(plain)).as_py():
        plain = pc.replace_substring_regex(pc.utf8_normalize(plain, form="NFKD"), r"\p{M}+", "")
        plain = pc.utf8_lower(plain)  # a compatibility form may have an upper-case letter
    lists = pc.split_pattern_regex(plain, _BETWEEN)
    flat, parent = lists.flatten(), np.asarray(pc.list_parent_indices(lists))
    keep = np.asarray(pc.greater(pc.binary_length(flat), 0)) & ~np.asarray(pc.is_in(flat, value_set=pa.array(FILLERS)))
    return flat.filter(pa.array(keep)), parent[keep]


def words(text: str | None) -> list[str]:
    return words_of(pa.array([text], type=pa.string()))[0].to_pylist()


# ---- the index ----


def _segment(name: str, parts: list[pa.Array], docs: np.ndarray, lengths: np.ndarray, gap: int) -> pa.RecordBatch:
    coded = pa.concat_arrays(parts).dictionary_encode()
    codes, terms = np.asarray(coded.indices), coded.dictionary
    starts = np.cumsum(lengths + gap) - lengths - gap
    order = np.argsort(codes, kind="stable")
    sorted_codes = codes[order]
    owner = np.repeat(np.arange(len(docs)), lengths)
    place = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(len(codes))
    positions, holder = place[order], owner[order]
    size = np.bincount(codes, minlength=len(terms))
    first = np.r_[True, sorted_codes[1:] != sorted_codes[:-1]]
    df = np.bincount(sorted_codes[first | np.r_[True, holder[1:] != holder[:-1]]], minlength=len(terms))
    step = np.where(first, positions, np.diff(positions, prepend=0))
    # a list's differences take 1, 2 or 4 bytes each, as its greatest needs
    heads = np.concatenate([[0], np.cumsum(size)])
    widest = np.maximum.reduceat(step, heads[:-1])
    width = np.where(widest < 256, 1, np.where(widest < 65536, 2, 4)).astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(size * width)])
    blob, wide = np.zeros(begin[-1], dtype=np.uint8), width[sorted_codes]
    at = begin[sorted_codes] + (np.arange(len(codes)) - heads[sorted_codes]) * wide
    for w, kind in ((1, np.uint8), (2, np.uint16), (4, np.uint32)):
        of = np.flatnonzero(wide == w)
        blob[at[of][:, None] + np.arange(w)] = step[of].astype(kind).view(np.uint8).reshape(-1, w)
    row = [name, terms, df.astype(np.int32), size.astype(np.int32), width, blob.tobytes(), docs.astype(np.int64), starts.astype(np.int32), gap]
    fields = to_arrow_schema(_SEGMENT)
    one = lambda x, f: pa.ListArray.from_arrays(pa.array([0, len(x)], type=pa.int32()), pa.array(x, type=f.type.value_type)) if pa.types.is_list(f.type) else pa.array([x], type=f.type)
    return pa.RecordBatch.from_arrays([one(x, f).cast(f.type) for x, f in zip(row, fields)], schema=fields)


def build_index(corpus: DataFrame, doc: str, text: str, gap: int = GAP, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """The positional index of ``corpus`` as a table of segments in the shared folder.

    Every text is indexed whole; null and empty texts have no postings. ``gap`` free positions part two documents, so
    no list intersection reaches across them if ``gap`` is at least the passage length. A text longer than a segment
    has a segment of its own. Document ids are whole numbers; repeated ones are separate documents of the same id.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        parts, docs, lengths, held = [], [], [], 0
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            # so many texts at a time as have a bounded number of characters together, one at least
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), dtype=np.int64)
            group = (np.cumsum(sizes) - sizes) // SLICE_CHARS
            cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                found, parent = words_of(batch.column(1).slice(a, b - a))
                count = np.bincount(parent, minlength=b - a)
                ids, upto, lo = np.asarray(batch.column(0).slice(a, b - a)), np.cumsum(count), 0
                while lo < b - a:
                    # texts up to the one that fills the segment
                    before = upto[lo - 1] if lo else 0
                    hi = min(b - a, int(np.searchsorted(upto, before + segment_tokens - held)) + 1)
                    own = np.flatnonzero(count[lo:hi]) + lo
                    parts.append(found.slice(before, upto[hi - 1] - before))
                    docs.append(ids[own])
                    lengths.append(count[own])
                    held, lo = held + int(upto[hi - 1] - before), hi
                    if held >= segment_tokens:
                        yield _segment(f"{part}-{serial}", parts, np.concatenate(docs), np.concatenate(lengths), gap)
                        parts, docs, lengths, held, serial = [], [], [], 0, serial + 1
        if held:
            yield _segment(f"{part}-{serial}", parts, np.concatenate(docs), np.concatenate(lengths), gap)

    slim = corpus.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("x"))
    return staged(slim.mapInArrow(index, _SEGMENT), "segments")


class _Passages:
    """The test items of a batch turned around: distinct passages, each with its terms from the rarest on.

    Passages are in the order of their rarest term; those under term t are ``under[t]`` to ``under[t + 1]``. Terms the
    corpus lacks have none: their passages match nothing.
    """

    def __init__(self, asked: list[tuple[int, list[str]]], dfs: dict[str, int], length: int, near_terms: int) -> None:
        self.asked, self.terms = asked, sorted(dfs)
        code = {w: i for i, w in enumerate(self.terms)}
        df = np.array([dfs[w] for w in self.terms], dtype=np.int64)
        grams, item, offset = [], [], []
        for k, (_, ws) in enumerate(asked):
            codes = np.array([code.get(w, -1) for w in ws], dtype=np.int32)
            if len(codes) >= length:
                windows = np.lib.stride_tricks.sliding_window_view(codes, length)
                there = np.flatnonzero((windows >= 0).all(axis=1))
                grams.append(windows[there])
                item.append(np.full(len(there), k))
                offset.append(there)
        grams = np.concatenate(grams) if grams else np.zeros((0, length), dtype=np.int32)
        self.item, self.offset = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (item, offset))
        unique, which = np.unique(grams, axis=0, return_inverse=True) if len(grams) else (grams, np.zeros(0, dtype=np.int64))
        shift = np.argsort(df[unique] if len(df) else unique, axis=1, kind="stable").astype(np.int32)
        order = np.argsort(np.take_along_axis(unique, shift, axis=1)[:, 0], kind="stable") if len(unique) else np.zeros(0, dtype=np.int64)
        self.shift = shift[order]
        self.code = np.take_along_axis(unique[order], self.shift, axis=1)
        self.under = np.searchsorted(self.code[:, 0], np.arange(len(self.terms) + 1))
        # the places of each distinct passage in the items
        back = np.empty(len(unique), dtype=np.int64)
        back[order] = np.arange(len(unique))
        place = back[which.ravel()]
        by = np.argsort(place, kind="stable")
        self.item, self.offset = self.item[by], self.offset[by]
        self.places = np.searchsorted(place[by], np.arange(len(unique) + 1))
        self.near: dict[tuple[int, ...], list[int]] = {}
        for k, (_, ws) in enumerate(asked if near_terms else []):
            # the rarest distinct terms of the item over the whole corpus, ties in the order of the terms; none if it has fewer
            picked = sorted({w for w in ws if w in code}, key=lambda w: (dfs[w], w))[:near_terms]
            if len(picked) == near_terms:
                self.near.setdefault(tuple(code[w] for w in picked), []).append(k)


class _Lists:
    """The posting lists of one segment for the terms asked for."""

    def __init__(self, row: pa.RecordBatch, terms: pa.Array) -> None:
        column = lambda c: row.column(c)[0].values
        at = np.asarray(pc.fill_null(pc.index_in(column("terms"), value_set=terms), -1))
        here = np.flatnonzero(at >= 0)
        sizes, widths = np.asarray(column("sizes"), dtype=np.int64), np.asarray(column("widths"), dtype=np.int64)
        heads, blob = np.cumsum(sizes * widths) - sizes * widths, row.column("postings")[0].as_buffer()
        kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32}
        lists: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(terms)
        for i in here.tolist():
            lists[at[i]] = np.cumsum(np.frombuffer(blob, dtype=kinds[int(widths[i])], count=int(sizes[i]), offset=int(heads[i])), dtype=np.int64)
        self.lists = lists
        self.size = np.array([len(x) for x in lists], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
        self.docs, self.starts = np.asarray(column("docs"), dtype=np.int64), np.asarray(column("starts"), dtype=np.int64)
        # the lists turned into one array: which of the terms stands at a place
        self.term_at = np.full(int(self.flat.max(initial=0)) + 1, -1, dtype=np.int32)
        self.term_at[self.flat] = np.repeat(np.arange(len(terms), dtype=np.int32), self.size)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def _phrases(lists: _Lists, p: _Passages) -> tuple[np.ndarray, np.ndarray]:
    """(passage, start in the segment) of each place of each passage, candidates taken up in blocks of bounded size."""
    terms = np.flatnonzero(lists.size)
    many = p.under[terms + 1] - p.under[terms]
    own = np.repeat(p.under[terms], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)  # passages whose rarest term is there
    for c in range(1, p.code.shape[1]):
        own = own[lists.size[p.code[own, c]] > 0]
    weight = lists.size[p.code[own, 0]]
    cuts = [*np.flatnonzero(np.diff((np.cumsum(weight) - weight) // CANDIDATES, prepend=-1)).tolist(), len(own)]
    found = []
    for a, b in zip(cuts, cuts[1:]):
        ids, n = own[a:b], weight[a:b]
        passage = np.repeat(ids, n)
        slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = lists.flat[np.repeat(lists.begin[p.code[ids, 0]], n) + slot] - p.shift[passage, 0]
        for c in range(1, p.code.shape[1]):
            at = start + p.shift[passage, c]
            good = (at >= 0) & (at < len(lists.term_at))
            good[good] = lists.term_at[at[good]] == p.code[passage[good], c]
            passage, start = passage[good], start[good]
            if not len(passage):
                break
        found.append((passage, start))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (own, own)


def _near(lists: _Lists, codes: tuple[int, ...], within: int) -> np.ndarray:
    """Places of the first of ``codes`` about which all others occur, none farther than ``within`` words."""
    at = lists.lists[codes[0]]
    for c in codes[1:]:
        if not len(at):
            break
        other = lists.lists[c]
        at = at[np.searchsorted(other, at + within, side="right") > np.searchsorted(other, at - within)]
    return at


def _matches(lists: _Lists, p: _Passages, length: int, within: int) -> dict[str, np.ndarray]:
    """Document and item of all matches in a segment, with the item's passages and words found."""
    passage, start = _phrases(lists, p)
    doc = lists.doc_of(start)
    # once for each document and passage, then for each place of the passage in the items
    pair = np.unique(doc * np.int64(len(p.code) + 1) + passage)
    doc, passage = pair // (len(p.code) + 1), pair % (len(p.code) + 1)
    many = p.places[passage + 1] - p.places[passage]
    at = np.repeat(p.places[passage], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    doc, item, offset = np.repeat(doc, many), p.item[at], p.offset[at]
    by = np.lexsort((offset, item, doc))
    doc, item, offset = doc[by], item[by], offset[by]
    head = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])] if len(doc) else np.zeros(0, dtype=bool)
    # a passage covers as many further words as it lies beyond the one before it
    new = np.where(head, length, np.minimum(np.diff(offset, prepend=0), length))
    group = np.cumsum(head) - 1
    out = {"doc": doc[head], "item": item[head], "passages": np.bincount(group), "words": np.bincount(group, weights=new)}
    if p.near:
        seen, more = set(zip(out["doc"].tolist(), out["item"].tolist())), []
        for codes, items in p.near.items():
            for d in np.unique(lists.doc_of(_near(lists, codes, within))).tolist():
                more += [(d, k) for k in items if (d, k) not in seen]
        extra = np.array(more, dtype=np.int64).reshape(-1, 2)
        none = np.zeros(len(extra), dtype=np.int64)
        out = {k: np.concatenate([out[k], x]) for k, x in zip(out, (extra[:, 0], extra[:, 1], none, none))}
    return out


def find_leaks(segments: DataFrame, items: DataFrame, item: str, text: str, length: int = 12, near_terms: int = 0, near_within: int = 40) -> DataFrame:
    """``doc_id, item_id, passages, matched_words, item_words, phrase`` for each document and item it holds a passage of.

    A passage is ``length`` consecutive words. ``passages`` counts the item's passages found in the document,
    ``matched_words`` the item's words they cover. With ``near_terms`` > 0, documents also come out in which that many
    of the item's rarest terms all lie within ``near_within`` words of the rarest, with ``phrase`` false and no
    passages. These terms are picked once for the whole corpus, of those that it has; an item with fewer has no such
    match. ``near_within`` and ``length`` must be less than the gap of the index. Items shorter than ``length`` have
    no passage; null texts and null ids are left out; of items with the same id each counts. An item's terms that the
    corpus lacks match nothing. Items are taken in batches of a bounded size, each held against all segments.
    """
    spark = segments.sparkSession
    gap = segments.agg(F.min("gap")).first()[0]
    if gap is not None and max(length, near_within if near_terms else 0) >= gap:
        raise ValueError(f"length and near_within must be less than the gap of the index, {gap}")
    ready = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(text).alias("x"))
    size = ready.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    batches = max(1, -(-int(size) // QUERY_BYTES))
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())] + [T.StructField(c, T.IntegerType()) for c in ("passages", "matched_words", "item_words")] + [T.StructField("phrase", T.BooleanType())])
    result = None
    for b in range(batches):
        share = ready if batches == 1 else ready.where(F.pmod(F.xxhash64("i", "x"), F.lit(batches)) == b)
        rows = [(r.i, r.x) for r in share.toLocalIterator()]
        found, parent = words_of(pa.array([x for _, x in rows], type=pa.string()))
        ends = np.searchsorted(parent, np.arange(len(rows) + 1)).tolist()
        found = found.to_pylist()
        asked = [(i, found[a:b]) for (i, _), a, b in zip(rows, ends, ends[1:])]
        vocabulary = sorted(set(found))
        wanted = spark.createDataFrame([(w,) for w in vocabulary], "t string")
        # document frequency over the whole corpus of the terms asked for; reads two columns of the index
        counted = segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("z")).select(F.col("z.terms").alias("t"), F.col("z.dfs").alias("n"))
        dfs = {r.t: int(r.n) for r in counted.join(F.broadcast(wanted), "t").groupBy("t").agg(F.sum("n").alias("n")).toLocalIterator()}
        shared = spark.sparkContext.broadcast((asked, dfs))

        def match(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            turned = None
            for batch in rows:
                turned = turned or _Passages(*shared.value, length, near_terms)
                terms = pa.array(turned.terms, type=pa.string())
                ids, sizes = np.array([i for i, _ in turned.asked], dtype=np.int64), np.array([len(ws) for _, ws in turned.asked], dtype=np.int64)
                for k in range(batch.num_rows):  # one segment at a time
                    lists = _Lists(batch.slice(k, 1), terms)
                    m = _matches(lists, turned, length, near_within)
                    if len(m["doc"]):
                        columns = [lists.docs[m["doc"]], ids[m["item"]], m["passages"], m["words"], sizes[m["item"]], m["passages"] > 0]
                        yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, to_arrow_schema(out))], schema=to_arrow_schema(out))

        part = segments.mapInArrow(match, out)
        result = part if result is None else result.unionByName(part)
    # repeated ids may lie in several segments
    return result.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("passages", "matched_words", "item_words", "phrase")])
