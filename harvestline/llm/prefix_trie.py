"""Prefix trie of conversations: ternary search trees over dictionary-encoded turns, one per range shard, merged at their borders.

A turn is a role and a text, told apart by 128 bits of their SHA-256 (`key`).  Conversations are cut into segments of `SEGMENT`
turns; a segment knows the node it hangs from (`top`, the hash of the path so far), so that a conversation of any length
is spread over many rows.  Segments are ranged by (segment, top, path, conversation); equal paths fall apart by
conversation, so a group of copies is spread too.  Within a sorted shard, blocks of about `BLOCK_TURNS` turns each get a
dictionary of their turns and a ternary search tree, filled by median insertion; an iterative traversal sums members, leaves and
savings.  Nodes on the first and last path of a block, tops, and the ends of segments may go on elsewhere: their parts are
merged by node, and what lies below them is added up along the path, over segments by pointer jumping.

Defined cases: turns without a conv_id take no part; null role or text counts as empty; turns come by number (null first), those with
the same number by key; repeated rows are turns of their own; conversations without turns are members of the root; an
empty table has no node; other columns are not read.  The hash of the members that end at a node reads their ids
in one pass as SHA-256 must, with constant memory however many they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from harvestline.sources.stored import stored

SEGMENT = 64
BLOCK_TURNS = 100_000
HEADS = 3
FAMILY = 20
WORDS = "[^\\x20\\x09-\\x0D]+"
_KEY = 32  # hex digits of a turn's key and of a node's id


def hashed(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, _KEY)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key, words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = hashed(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(WORDS)).cast("long")
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), key.alias("key"), words.alias("words"))


def positioned(rows: DataFrame) -> DataFrame:
    """conv_id, pos, key, words: places by a range sort, so that a conversation of any length spreads over tasks.

    Each sorted part numbers its own rows; a conversation that goes on from earlier parts adds their counts, known from
    one summary row per part.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            ids = np.asarray(batch.column("conv_id"))
            if not len(ids):
                continue
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
            if ids[0] == last:
                place[: starts[1] if len(starts) > 1 else len(ids)] += count
            last, count = ids[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "conv_id", "key", "words")), pa.array(place)], names=["part", "conv_id", "key", "words", "pos"])

    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    local = stored(parts.mapInArrow(numbered, "part int, conv_id long, key string, words long, pos long"), "turns")
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos")).alias("last")).orderBy("part").collect()
    carries, open_id, count = [], None, 0
    for row in ends:
        if row["first"] == open_id:
            carries.append((row["part"], open_id, count))
        count = row["last"]["pos"] + 1 + (count if row["last"]["conv_id"] == open_id == row["first"] else 0)
        open_id = row["last"]["conv_id"]
    if not carries:
        return local.select("conv_id", "pos", "key", "words")
    carry = rows.sparkSession.createDataFrame(carries, "part int, conv_id long, before long")
    joined = local.join(carry, ["part", "conv_id"], "left")
    return joined.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, pos, key, words) of the rebuilt conversations, and all conv_ids.

    Conversation c starts with the first h = crc32(c) % 4 turns of conversation c - c % 20 (remainder with the sign of c) and goes on with
    its own turns after its first h.
    """
    own = positioned(turns(conversations))
    head = F.when(F.col("pos") < HEADS, F.struct("pos", "key", "words"))
    convs = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(head)).alias("heads"))
    convs = stored(convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")), "conversations")
    base = convs.select(F.col("conv_id").alias("base"), F.col("heads").alias("base_heads"))
    family = convs.select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    taken = F.when(F.col("h") > 0, F.slice("base_heads", 1, F.col("h")))
    starts = family.join(base, "base", "left").select("conv_id", "h", F.coalesce(taken, F.array().cast("array<struct<pos:bigint,key:string,words:bigint>>")).alias("taken"))
    starts = stored(starts, "starts")
    first = starts.select("conv_id", F.inline("taken")).select("conv_id", "pos", "key", "words")
    shift = starts.select("conv_id", "h", F.size("taken").alias("n"))
    rest = own.join(shift, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "key", "words")
    return first.unionByName(rest), convs.select("conv_id")


def segments(rows: DataFrame, ids: DataFrame, length: int = SEGMENT) -> DataFrame:
    """seg, top, path, conv_id, words, last: pieces of `length` turns of each conversation, and the node they hang from."""
    piece = F.sort_array(F.collect_list(F.struct((F.col("pos") % length).alias("at"), "key", "words")))
    cut = rows.groupBy("conv_id", F.floor(F.col("pos") / length).alias("seg")).agg(piece.alias("turns"))
    cut = stored(cut.select("conv_id", "seg", F.array_join("turns.key", "").alias("path"), F.col("turns.words").alias("words")), "segments")
    none = ids.join(cut.where("seg = 0").select("conv_id"), "conv_id", "left_anti")
    none = none.select("conv_id", F.lit(0).cast("long").alias("seg"), F.lit("").alias("path"), F.array().cast("array<bigint>").alias("words"))
    deepest = cut.agg(F.max("seg")).first()[0] or 0
    if not deepest:
        return cut.unionByName(none).select("seg", F.lit("").alias("top"), "path", "conv_id", "words", F.lit(True).alias("last"))

    def chained(batches):
        now, top = None, ""
        for batch in batches:
            tops = []
            for conv, path in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist()):
                now, top = (now, top) if conv == now else (conv, "")
                tops.append(top)
                top = hashlib.sha256((top + path).encode()).hexdigest()[:_KEY]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "seg", "last")), pa.array(tops, pa.string())], names=["conv_id", "seg", "last", "top"])

    long = cut.groupBy("conv_id").agg(F.max("seg").alias("end"))
    # Only conversations of several segments are chained, one row for `length` turns.
    many = cut.join(long.where("end > 0"), "conv_id").select("conv_id", "seg", "path", (F.col("seg") == F.col("end")).alias("last"))
    tops = many.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(chained, "conv_id long, seg long, last boolean, top string")
    whole = cut.join(tops, ["conv_id", "seg"], "left").withColumns({"top": F.coalesce("top", F.lit("")), "last": F.coalesce("last", F.lit(True))})
    none = none.withColumns({"top": F.lit(""), "last": F.lit(True)})
    return whole.unionByName(none).select("seg", "top", "path", "conv_id", "words", "last")


class Tree:
    """A ternary search tree over turn numbers: `low` and `high` are siblings, `equal` is the first child; node 0 is the root."""

    def __init__(self):
        self.turn, self.low, self.high, self.equal, self.parent, self.depth = [-1], [0], [0], [0], [-1], [0]

    def insert(self, path) -> list[int]:
        """The nodes along the path, the new ones made on the way."""
        at, nodes = 0, [0]
        for code in path:
            up, below = at, self.equal[at]
            link, at = self.equal, below
            where = up
            while at and self.turn[at] != code:
                where, link = at, (self.low if code < self.turn[at] else self.high)
                at = link[where]
            if not at:
                at = len(self.turn)
                link[where] = at
                self.turn.append(code)
                self.parent.append(up)
                self.depth.append(self.depth[up] + 1)
                for links in (self.low, self.high, self.equal):
                    links.append(0)
            nodes.append(at)
        return nodes

    def traversal(self) -> list[int]:
        """All nodes, parents before children and siblings in order, without recursion."""
        out, stack = [0], [(self.equal[0], False)]
        while stack:
            at, seen = stack.pop()
            if not at:
                continue
            if seen:
                out.append(at)
                stack.append((self.equal[at], False))
            else:
                # low siblings, the node with what is below it, high siblings
                stack += [(self.high[at], False), (at, True), (self.low[at], False)]
        return out


def medians(n: int) -> Iterator[int]:
    """0 … n-1, the middle of every range before its halves."""
    stack = [(0, n)]
    while stack:
        low, high = stack.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            stack += [(middle + 1, high), (low, middle)]


_PARTS = (
    "kind string, id string, parent string, top string, up array<string>, depth long, parent_conv_id long, conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved long, words long, ends string"
)
_NO_ENDS = hashlib.sha256(b"").hexdigest()


class _Out:
    def __init__(self):
        self.names = [x.split()[0] for x in _PARTS.split(", ")]
        self.types = [pa.list_(pa.string()) if "array" in x else pa.string() if x.endswith("string") else pa.int64() for x in _PARTS.split(", ")]
        self.rows: list[tuple] = []

    def add(self, **row):
        self.rows.append(tuple(row.get(n) for n in self.names))

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [()] * len(self.names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, self.types)], names=self.names)
        self.rows = []
        return batch


def _solve(out: _Out, seg: int, top: str, rows: list[tuple], first: bool, last: bool, length: int) -> None:
    """Nodes of one (segment, top) of a block; rows (path, conv_id, words, last) are sorted; `first`, `last`: it touches the block's border."""
    keys = [tuple(p[i : i + _KEY] for i in range(0, len(p), _KEY)) for p, _, _, _ in rows]
    dictionary = {k: i for i, k in enumerate(sorted({k for path in keys for k in path}))}
    starts = [i for i in range(len(rows)) if not i or keys[i] != keys[i - 1]]
    groups = list(zip(starts, [*starts[1:], len(rows)]))
    tree, words, key = Tree(), [0], [""]
    nodes: list[list[int]] = [[]] * len(groups)
    for g in medians(len(groups)):
        start = groups[g][0]
        nodes[g] = tree.insert([dictionary[k] for k in keys[start]])
        for at, k, w in zip(nodes[g][1:], keys[start], rows[start][2]):
            if at == len(words):
                words.append(w)
                key.append(k)
    n = len(words)
    members, least, children, ended, goes_on = [0] * n, [None] * n, [0] * n, [[] for _ in range(n)], [False] * n
    for (start, end), path in zip(groups, nodes):
        at = path[-1]
        members[at] += end - start
        ids = [r[1] for r in rows[start:end]]
        least[at] = min(ids)
        ended[at] = sorted(r[1] for r in rows[start:end] if r[3])
        goes_on[at] = len(ended[at]) < end - start
    border = {0} | {at for at in range(n) if tree.depth[at] == length and goes_on[at]}
    border |= set(nodes[0]) if first else set()
    border |= set(nodes[-1]) if last else set()
    # A segment's end that goes on is a border node, and so are the nodes above it: what hangs below is not known here.
    for at in [a for a in border if goes_on[a] and tree.depth[a] == length]:
        while at > 0:
            border.add(at)
            at = tree.parent[at]
    leaves, saved = [0] * n, [0] * n
    inner_children, inner_leaves, inner_saved = [0] * n, [0] * n, [0] * n
    order = tree.traversal()
    for at in reversed(order):
        up = tree.parent[at]
        if up >= 0:
            members[up] += members[at]
            least[up] = least[at] if least[up] is None else min(least[up], least[at])
        if at in border:
            continue
        leaves[at] += not children[at]
        saved[at] += (members[at] - 1) * words[at]
        children[up] += 1
        leaves[up] += leaves[at]
        saved[up] += saved[at]
        if up in border:
            inner_children[up] += 1
            inner_leaves[up] += leaves[at]
            inner_saved[up] += saved[at]
    names: dict[int, str] = {0: top}

    def name(at: int) -> str:
        if at not in names:
            path, up = [], at
            while up:
                path.append(key[up])
                up = tree.parent[up]
            names[at] = hashlib.sha256((top + "".join(reversed(path))).encode()).hexdigest()[:_KEY]
        return names[at]

    for at in order:
        up, depth = tree.parent[at], seg * length + tree.depth[at]
        text = ",".join(map(str, ended[at]))
        if at not in border:
            row = dict(depth=depth, conv_id=least[at], n_convs=members[at], n_children=children[at], n_leaves=leaves[at], saved=saved[at])
            ends = hashlib.sha256(text.encode()).hexdigest()
            if up in border:
                out.add(kind="below", parent=name(up), ends=ends, **row)
            else:
                out.add(kind="node", parent_conv_id=least[up], ends=ends, **row)
            continue
        inner = dict(n_children=inner_children[at], n_leaves=inner_leaves[at], saved=inner_saved[at])
        if at == 0 and seg:
            out.add(kind="border", id=top, n_convs=0, **inner)
        else:
            above, line = up, []
            while above >= (1 if seg else 0):  # a top gets what is below it by `_below_tops`
                line.append(name(above))
                above = tree.parent[above]
            out.add(kind="border", id=name(at), parent=name(up) if up >= 0 else None, top=top, up=line, depth=depth, conv_id=least[at], n_convs=members[at], words=words[at], **inner)
        if ended[at]:
            out.add(kind="ends", id=name(at), conv_id=ended[at][0], ends=text)


def blocks(length: int, block_turns: int):
    """A function for `mapInArrow` over sorted segments."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = _Out(), [], 0

        def flush():
            nonlocal held, size
            cuts = [i for i in range(len(held)) if not i or held[i][:2] != held[i - 1][:2]] + [len(held)]
            for start, end in zip(cuts, cuts[1:]):
                seg, top = held[start][:2]
                _solve(out, seg, top, [r[2:] for r in held[start:end]], start == 0, end == len(held), length)
            held, size = [], 0
            return out.batch()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("seg", "top", "path", "conv_id", "words", "last"))):
                held.append(row)
                size += 1 + len(row[4])
                if size >= block_turns:
                    yield flush()
        if held:
            yield flush()

    return work


def _hashed_ends(chunks: DataFrame) -> DataFrame:
    """id, ends: SHA-256 of the joined chunks of ids, read in order; the state of one hash is all that is held."""

    def work(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for node, text in zip(batch.column("id").to_pylist(), batch.column("ends").to_pylist()):
                if node == now:
                    state.update(b"," + text.encode())
                else:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_pydict({"id": pa.array([d[0] for d in done], pa.string()), "ends": pa.array([d[1] for d in done], pa.string())})
        if now is not None:
            yield pa.RecordBatch.from_pydict({"id": [now], "ends": [state.hexdigest()]})

    return chunks.select("id", "conv_id", "ends").repartition("id").sortWithinPartitions("id", "conv_id").mapInArrow(work, "id string, ends string")


def _below_tops(merged: DataFrame) -> DataFrame:
    """id, more_leaves, more_saved of border nodes at which later segments hang: all that is below them there.

    A top's own segment is summed first; then, by pointer jumping, each round adds what lies twice as many segments down.
    """
    own = F.struct(F.col("leaves").alias("l"), F.col("saved").alias("s"))
    inside = merged.where("depth > 0").groupBy(F.col("top").alias("id")).agg(F.sum(own["l"]).alias("l"), F.sum(own["s"]).alias("s"))
    tops = merged.where("tail").join(inside, "id", "left")
    sums = stored(tops.select("id", F.col("top").alias("jump"), F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("s", F.lit(0)).alias("s")), "tops")
    while True:
        lower = sums.groupBy(F.col("jump").alias("id")).agg(F.sum("l").alias("dl"), F.sum("s").alias("ds"))
        further = sums.select(F.col("id").alias("jump"), F.col("jump").alias("next"))
        step = sums.join(lower, "id", "left").join(further, "jump", "left")
        changed = step.select("id", F.coalesce("next", F.lit("")).alias("jump"), (F.col("l") + F.coalesce("dl", F.lit(0))).alias("l"), (F.col("s") + F.coalesce("ds", F.lit(0))).alias("s"))
        open_before = sums.where("jump <> ''").limit(1).count()
        sums = stored(changed, "tops")
        if not open_before:
            return sums.select("id", F.col("l").alias("more_leaves"), F.col("s").alias("more_saved"))


def trie(rows: DataFrame, ids: DataFrame, length: int = SEGMENT, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the trie of sequences `rows` (conv_id, pos, key, words); `ids` names all conversations."""
    order = ["seg", "top", "path", "conv_id"]
    cut = segments(rows, ids, length)
    parts = cut.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks(length, block_turns), _PARTS)
    parts = stored(parts, "trie-parts")

    whole = ["depth", "parent", "top", "up", "words"]
    border = parts.where("kind = 'border'").groupBy("id").agg(
        *[F.max(c).alias(c) for c in whole],
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
        F.max(F.col("depth").isNull()).alias("tail"),
    )
    border = stored(border, "borders")
    children = border.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    merged = border.join(children, "id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("n", F.lit(0))).drop("n")
    merged = merged.withColumn("leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
    merged = merged.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("words"))
    merged = stored(merged, "border-nodes")
    added = merged
    if merged.where("tail").limit(1).count():
        # What hangs from a top in later segments; its own parts there are already in `leaves` and `saved`.
        added = merged.join(_below_tops(merged), "id", "left")
        added = added.withColumns({"leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))})
    own = added.select("id", "leaves", "saved", "up")
    upward = own.select(F.explode(F.concat(F.array("id"), F.coalesce("up", F.array().cast("array<string>")))).alias("id"), "leaves", "saved")
    totals = upward.groupBy("id").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = _hashed_ends(parts.where("kind = 'ends'"))
    found = merged.drop("n_leaves", "saved").join(totals, "id").join(ends, "id", "left")
    above = stored(merged.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "border-ids")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    borders = found.join(above, "parent", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(_NO_ENDS)))
    inner = parts.withColumns({"saved_tokens": F.col("saved"), "ends_sha256": F.col("ends")})
    below = inner.where("kind = 'below'").drop("parent_conv_id").join(above, "parent")
    return borders.select(*columns).unionByName(below.select(*columns)).unionByName(inner.where("kind = 'node'").select(*columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    return trie(*rebuilt(conversations))
