"""How far each source of a language departs from the others, term by term: word-start pointers, sorted, read off in runs.

Every task takes its texts in slices of about `SLICE_BYTES` bytes, straight from the Arrow buffer: a pointer is kept to each place
where a term starts, and the pointers are ordered by multikey quicksort, eight bytes as one key: three-way partition around a
median, equal parts go eight bytes deeper, slices of `SMALL` pointers are ordered as a whole.  Pointers start out by source and
document and stay so within a term, so equal runs give document frequency and occurrences per source in one
look.  Sums per (language, source, term) meet in a shuffle; the vocabulary of a language are the terms that enough of its
documents hold.  Distances between sources are added up in units of at most `SIDE` by `SIDE` sources and about `TERMS` terms.

Defined cases: null text, lang and source count as empty; a repeated row is a document of its own; groups without terms are
there with the shares that smoothing gives; languages without vocabulary have pairs of value 0; an empty table gives no rows;
other columns are not read.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from harvestline.sources.stored import stored

SLICE_BYTES = 8_000_000
SMALL = 1 << 16
LEAST_DOCUMENTS = 30
PRIOR = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
SIDE = 64
TERMS = 4096

_TERM = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_LOWER = np.array([(b + 32 if 0x41 <= b <= 0x5A else b) if _TERM[b] else 0 for b in range(256)], np.uint8)
#: The first k of eight bytes, the first byte being the highest.
_FIRST = np.array([0, *(((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(1, 9))], np.uint64)


class Pointers:
    """Starts and lengths of the terms of a slice of texts, in the order of `documents`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, documents: np.ndarray):
        base, end = int(offsets[0]), int(offsets[-1])
        raw = data[base:end]
        term = _TERM[raw]
        self.bytes = np.concatenate([_LOWER[raw], np.zeros(8, np.uint8)])
        bounds = offsets - base
        # A text is an edge even where it touches the next without a gap.
        edge = np.zeros(end - base + 1, bool)
        edge[bounds] = True
        before = np.r_[False, term[:-1]] if len(term) else term
        starts = np.flatnonzero(term & (~before | edge[:-1]))
        after = np.r_[term[1:], False] if len(term) else term
        ends = np.flatnonzero(term & (~after | edge[1:])) + 1
        owner = np.searchsorted(bounds, starts, side="right") - 1
        first = np.searchsorted(starts, bounds)
        sizes = np.diff(first)[documents]
        order = np.arange(int(sizes.sum())) + np.repeat(first[:-1][documents] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) if len(documents) else np.zeros(0, np.int64)
        self.start, self.length, self.document = starts[order], (ends - starts)[order], owner[order]
        self.windows = np.lib.stride_tricks.sliding_window_view(self.bytes, 8)

    def keys(self, which: np.ndarray, depth: int) -> np.ndarray:
        """Bytes 8·depth to 8·depth + 7 of the terms as whole numbers; past the end of a term there are zeros."""
        left = np.clip(self.length[which] - 8 * depth, 0, 8)
        at = np.minimum(self.start[which] + 8 * depth, len(self.bytes) - 8)
        return np.ascontiguousarray(self.windows[at]).view(">u8").reshape(-1).astype(np.uint64) & _FIRST[left]


def _ordered(p: Pointers, which: np.ndarray, depth: int) -> np.ndarray:
    """A small slice, ordered as a whole: equal keys that go on are ordered together, eight bytes deeper each time."""
    key = p.keys(which, depth)
    order = np.argsort(key, kind="stable")
    which, key = which[order], key[order]
    run = np.cumsum(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    places, run = np.arange(len(which)), run.astype(np.int64)
    while len(places):
        size = np.bincount(run)[run]
        open_ = (size > 1) & (key & np.uint64(0xFF) > 0)
        places, run, depth = places[open_], run[open_], depth + 1
        if not len(places):
            break
        key = p.keys(which[places], depth)
        order = np.lexsort((key, run))
        which[places] = which[places][order]
        key, run = key[order], run[order]
        run = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (run[1:] != run[:-1])])
    return which


def quicksorted(p: Pointers, small: int = SMALL) -> np.ndarray:
    """Places of the pointers in the order of their terms; equal terms keep the order they had."""
    out, stack = np.arange(len(p.start)), [(0, len(p.start), 0)]
    while stack:
        low, high, depth = stack.pop()
        which = out[low:high]
        if high - low <= small:
            out[low:high] = _ordered(p, which, depth)
            continue
        key = p.keys(which, depth)
        pivot = np.sort(key[:: max(1, len(key) // 1001)])[min(len(key), 1001) // 2 - 1]
        less, equal = key < pivot, key == pivot
        parts = [which[less], which[equal], which[~less & ~equal]]
        out[low:high] = np.concatenate(parts)
        a, b = low + len(parts[0]), high - len(parts[2])
        stack += [(low, a, depth), (b, high, depth)]
        if pivot & np.uint64(0xFF):
            stack.append((a, b, depth + 1))
    return out


def _same_as_before(p: Pointers, order: np.ndarray) -> np.ndarray:
    length = p.length[order]
    same, depth = np.r_[False, length[1:] == length[:-1]] if len(order) else np.zeros(0, bool), 0
    while True:
        at = np.flatnonzero(same & (length > 8 * depth))
        if not len(at):
            return same
        same[at] = p.keys(order[at], depth) == p.keys(order[at - 1], depth)
        depth += 1


def counted(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, groups, document frequencies and occurrences of a slice of texts; `group` numbers the texts' groups."""
    p = Pointers(data, offsets, np.argsort(group, kind="stable"))
    order = quicksorted(p)
    new_term = ~_same_as_before(p, order)
    document = p.document[order]
    owner = group[document]
    fresh = new_term | np.r_[True, document[1:] != document[:-1]] if len(order) else new_term
    head = np.flatnonzero(new_term | np.r_[True, owner[1:] != owner[:-1]] if len(order) else new_term)
    frequency = np.add.reduceat(fresh.astype(np.int64), head) if len(head) else head
    occurrences = np.diff(np.r_[head, len(order)])
    start, length = p.start[order[head]], p.length[order[head]]
    ends = np.cumsum(length)
    text = p.bytes[np.repeat(start - (ends - length), length) + np.arange(int(length.sum()))]
    terms = pa.LargeStringArray.from_buffers(len(head), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
    return terms, owner[head], frequency, occurrences


def occurrences(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, term, documents, n: sums per slice of texts."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("text")
            wide = pa.types.is_large_string(column.type)
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            low = 0
            while low < len(column):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + slice_bytes, side="right")) - 1)
                part = batch.slice(low, high - low)
                langs, sources = (part.column(c).dictionary_encode() for c in ("lang", "source"))
                wide_of = len(sources.dictionary)
                group = np.asarray(langs.indices).astype(np.int64) * wide_of + np.asarray(sources.indices)
                terms, owner, documents, n = counted(data, offsets[low : high + 1], group)
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(owner // wide_of)), sources.dictionary.take(pa.array(owner % wide_of)), terms, pa.array(documents), pa.array(n)],
                    names=["lang", "source", "term", "documents", "n"],
                )
                low = high

    return read.mapInArrow(work, "lang string, source string, term string, documents long, n long")


def vocabulary(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n: occurrences of the terms that at least `least` documents of the language hold."""
    sums = occurrences(docs).groupBy("lang", "source", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"))
    in_language = F.sum("documents").over(Window.partitionBy("lang", "term"))
    kept = sums.withColumn("in_language", in_language).where(F.col("in_language") >= least)
    return stored(kept.select("lang", "source", "term", "n"), "vocabulary")


def _share(n: str, total: str, size: str):
    return F.expr(f"1 + CAST({UNIT} AS DECIMAL(10, 0)) * ({n} + {PRIOR}) DIV ({total} + {PRIOR} * {size})")


def _distances(kept: DataFrame, terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value: sums over the vocabulary of the distances between the groups numbered a <= b."""
    blocks = groups.where("size > 0").groupBy("lang", "size", F.floor(F.col("number") / SIDE).alias("block"))
    blocks = blocks.agg(F.sort_array(F.collect_list(F.struct("number", "none"))).alias("members"))
    blocks = stored(blocks.withColumn("count", F.max("block").over(Window.partitionBy("lang")) + 1), "blocks")
    own = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "size"))
    own = own.groupBy("lang", "term", F.floor(F.col("number") / SIDE).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("number", "p"))).alias("own"))
    rows = terms.select("lang", "term").join(blocks, "lang").join(own, ["lang", "term", "block"], "left")
    empty = F.create_map().cast("map<bigint,bigint>")
    shares = F.transform("members", lambda m: F.coalesce(F.try_element_at(F.coalesce("own", empty), m["number"]), m["none"]))
    dense = rows.select("lang", "term", "block", shares.alias("shares"), "count", (F.xxhash64("term") % F.ceil(F.col("size") / TERMS)).alias("part"))
    sent = dense.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)))
    sent = sent.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "part", "block", "term", "shares")

    def summed(key, table):
        lang, i, j = (k.as_py() for k in key[:3])
        # The rows of one term come in the same order for both blocks.
        table = table.sort_by([("block", "ascending"), ("term", "ascending")])
        block = np.asarray(table.column("block"))
        sides = []
        for side in (i, j):
            at = np.flatnonzero(block == side)
            column = table.column("shares").take(pa.array(at)).combine_chunks()
            sides.append(np.asarray(column.flatten()).reshape(len(at), -1))
        value = np.stack([np.abs(sides[0][:, [a]] - sides[1]).sum(axis=0) for a in range(sides[0].shape[1])])
        a, b = np.nonzero(np.ones(value.shape, bool))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": i * SIDE + a, "b": j * SIDE + b, "value": value.reshape(-1)})

    units = sent.groupBy("lang", "i", "j", "part").applyInArrow(summed, "lang string, a long, b long, value long")
    return units.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).where("a <> b")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by distance (`pair`), terms above the language's share (`term`)."""
    kept = vocabulary(docs, least)
    terms = stored(kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("size"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = read.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["size", "lang_total", "total"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = groups.withColumn("number", number).withColumn("none", F.when(F.col("size") > 0, _share("0L", "total", "size")))
    groups = stored(groups, "groups")

    group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    others = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"))
    pairs = groups.select("lang", "source", F.col("number").alias("a")).join(others, "lang").where("a <> b")
    found = _distances(kept, terms, groups)
    found = found.unionByName(found.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), "value")).distinct()
    pairs = pairs.join(found, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(group))

    shares = kept.join(groups, ["lang", "source"]).join(terms, ["lang", "term"])
    shares = shares.withColumn("value", _share("n", "total", "size") - _share("lang_n", "lang_total", "size")).where("value > 0")
    shares = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    shares = shares.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= top)
    return pairs.select(*columns).unionByName(shares.select(*columns))
