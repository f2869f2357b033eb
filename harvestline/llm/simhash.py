"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

A document's fingerprint has 64 bits.  Two fingerprints within `MAX_BITS` bits agree on at least two of
`MAX_BITS + 2` bit segments, so each distinct fingerprint goes to one group per pair of segments and every
link is inside some group; groups are the parts into which the search is divided.  Inside a group the
fingerprints are sorted by Gray rank and indexed: neighbours in that order share many bits, an upper node keeps the
bits common to its children, and a search adds up the differences from the top and drops a node with all below it
as soon as the sum passes the limit.  A group yields a spanning forest of its links, not all pairs; connected
components are then found on those edges.  A group of over `GROUP_ROWS` fingerprints is dealt out as pairs of
blocks, so no task holds it whole and no link is lost.

Defined cases: null text is empty; a text without words has fingerprint zero and links like any other; equal
fingerprints are linked; repeated rows and repeated doc_ids are rows of their own; a component whose doc_ids are all null
has a null id; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from harvestline.llm.common import add_columns, keeping_columns
from harvestline.llm.components import components
from harvestline.sources.stored import stored

SHINGLE = 4
MAX_BITS = 4
SEED = 42
GROUP_ROWS = 50_000
_FAN = 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    runs = [words[i : len(words) - shingle + 1 + i] for i in range(shingle)] if len(words) >= shingle else None
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*runs)) if runs else [b" ".join(words)]
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Search of 64-bit codes by Hamming distance over levels of shared bit patterns.

    `patterns[k]` and `masks[k]` hold, for each node of level k (0: the codes), the bits that all codes below
    share; `rest[k]` holds those of them that the parent does not have yet.
    """

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        pattern, mask = codes[self.order], np.full(len(codes), ~np.uint64(0))
        self.patterns, self.rest = [pattern], []
        while True:
            first = np.arange(0, len(pattern), _FAN)
            lead = np.repeat(pattern[first], np.diff(np.append(first, len(pattern))))
            shared = np.bitwise_and.reduceat(mask, first) & ~np.bitwise_or.reduceat(pattern ^ lead, first)
            self.rest.append(mask & ~np.repeat(shared, np.diff(np.append(first, len(pattern)))))
            pattern, mask = pattern[first] & shared, shared
            self.patterns.append(pattern)
            if len(pattern) <= _FAN:
                self.rest.append(mask)
                return

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, position of a code) with at most `limit` differing bits."""
        top = len(self.patterns) - 1
        query = np.repeat(np.arange(len(queries)), len(self.patterns[top]))
        node = np.tile(np.arange(len(self.patterns[top])), len(queries))
        spent = np.zeros(len(query), np.int64)
        for level in range(top, -1, -1):
            spent = spent + np.bitwise_count((queries[query] ^ self.patterns[level][node]) & self.rest[level][node])
            near = spent <= limit
            query, node, spent = query[near], node[near], spent[near]
            if level:
                width = np.minimum(_FAN, len(self.patterns[level - 1]) - node * _FAN)
                inner = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                query, spent = np.repeat(query, width), np.repeat(spent, width)
                node = np.repeat(node * _FAN, width) + inner
        return query, self.order[node]


def forest(codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, root) of the components of distinct codes within `limit` bits: found ones leave the search."""
    roots = np.full(len(codes), -1)
    left = np.arange(len(codes))
    index, members = GrayIndex(codes), left
    for seed in range(len(codes)):
        if roots[seed] >= 0:
            continue
        roots[seed], frontier = seed, np.array([seed])
        while len(frontier):
            fresh = []
            for start in range(0, len(frontier), 256):
                _, found = index.search(codes[frontier[start : start + 256]], limit)
                found = np.unique(members[found])
                found = found[roots[found] < 0]
                roots[found] = seed
                fresh.append(found)
                left = members[roots[members] < 0]
                if 0 < len(left) * 2 < len(members):
                    index, members = GrayIndex(codes[left]), left
            frontier = np.concatenate(fresh)
            if not len(left):
                break
    linked = roots != np.arange(len(codes))
    return codes[linked], codes[roots[linked]]


def _small_links(codes: np.ndarray, run: np.ndarray, limit: int, longest: int):
    """Links inside short runs (a single index leaf each), all runs at once."""
    for shift in range(1, longest):
        near = (run[shift:] == run[:-shift]) & (np.bitwise_count(codes[shift:] ^ codes[:-shift]) <= limit)
        if near.any():
            yield codes[shift:][near], codes[:-shift][near]


def _group_edges(codes: np.ndarray, run: np.ndarray, limit: int):
    """Links of rows sorted by run: short runs side by side, each long one by its index."""
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    sizes = np.diff(np.append(starts, len(run)))
    small = np.repeat(sizes <= _FAN, sizes)
    yield from _small_links(codes[small], run[small], limit, min(_FAN, int(sizes.max())))
    for start, size in zip(starts[sizes > _FAN], sizes[sizes > _FAN]):
        yield forest(codes[start : start + size], limit)


def _linked(groups: DataFrame, limit: int) -> DataFrame:
    """Edges a > b from rows (key, code), partitioned and sorted by key."""

    def work(batches):
        held_key, held_code = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def edges(key, code):
            for a, b in _group_edges(code.view(np.uint64), key, limit):
                a, b = a.view(np.int64), b.view(np.int64)
                yield pa.RecordBatch.from_pydict({"a": np.maximum(a, b), "b": np.minimum(a, b)})

        for batch in batches:
            key = np.concatenate([held_key, np.asarray(batch.column("key"))])
            code = np.concatenate([held_code, np.asarray(batch.column("code"))])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
            if cut:
                yield from edges(key[:cut], code[:cut])
            held_key, held_code = key[cut:], code[cut:]
        if len(held_key):
            yield from edges(held_key, held_code)

    return groups.mapInArrow(work, "a long, b long")


def link_codes(codes: DataFrame, limit: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(code, root) of each distinct 64-bit code that has a link within `limit` bits."""
    segments = limit + 2
    bounds = [64 * i // segments for i in range(segments + 1)]
    bits = [((1 << bounds[i + 1]) - 1) ^ ((1 << bounds[i]) - 1) for i in range(segments)]
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    masks = [signed(bits[i] | bits[j]) for i, j in combinations(range(segments), 2)]
    group = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("code").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)]))
    rows = codes.select("code", group.alias("g")).select("code", F.xxhash64("g.mask", "g.part").alias("key"))
    large = rows.groupBy("key").count().where(F.col("count") > group_rows)
    large = stored(large.select("key", F.ceil(F.col("count") / group_rows).cast("int").alias("blocks")), "large")
    block = F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, block), F.greatest(x, block)))
    dealt = rows.join(large, "key", "left").select("code", F.when(F.col("blocks").isNull(), F.array("key")).otherwise(F.transform(others, lambda x: F.xxhash64("key", x))).alias("keys"))
    dealt = dealt.select("code", F.explode("keys").alias("key"))
    sorted_rows = dealt.repartition("key").sortWithinPartitions("key")
    return components(_linked(sorted_rows, limit).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""

    def compute(texts):
        return {"code": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}

    rows = stored(add_columns(docs, "code long", compute, ["doc_id"]), "fingerprints")
    codes = stored(rows.groupBy("code").agg(F.min("doc_id").alias("least_id")), "codes")
    roots = link_codes(codes.select("code"), max_bits)
    rooted = codes.join(roots, "code", "left").select("code", "least_id", F.coalesce("root", "code").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = stored(rooted.join(least, "root").select("code", "component_id"), "found")
    text = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return rows.join(found, "code").select("doc_id", text.alias("fingerprint"), "component_id")


@keeping_columns("doc_id", "text")
def deduplicated(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of `docs`, with its columns, of each component: the one with the smallest doc_id."""

    def compute(texts):
        return {"_code": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}

    rows = stored(add_columns(docs, "_code long", compute), "rows")
    codes = stored(rows.groupBy(F.col("_code").alias("code")).agg(F.min("doc_id").alias("least_id")), "codes")
    roots = link_codes(codes.select("code"), max_bits)
    rooted = codes.join(roots, "code", "left").select("code", "least_id", F.coalesce("root", "code").alias("root"))
    # Of each component a single code is kept, the one that has its smallest doc_id, and of that code a single row.
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull(), "least_id", "code")).alias("b"))
    best = stored(best.select(F.col("b.code").alias("_code"), F.col("b.least_id").alias("_least")), "best")
    best = best.withColumnRenamed("_code", "_best")
    kept = rows.join(best, (F.col("_code") == F.col("_best")) & F.col("doc_id").eqNullSafe(F.col("_least")))
    # Rows that share the smallest doc_id: the first by content. They have one code and one id, so these are repeated rows.
    order = [F.col("_code"), F.col("doc_id")]
    ranked = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*order).orderBy(F.xxhash64("text"), *[c for c in docs.columns if c != "text"])))
    return ranked.where("_n = 1").select(*docs.columns)
