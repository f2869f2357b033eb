"""Removal of bytes covered by long strings that occur more than once, with suffix arrays on shards of candidates.

Every window of `WIDTH` bytes is routed by content: its key is the least hash of the `GRAM`-byte strings in it, so equal windows have
equal keys wherever they stand.  Consecutive windows with one key form a run, and a run's bytes a piece.  Keys of a single run
cannot hide a repeat and go (unless the key's string stands twice in the run).  Pieces that are equal as a whole repeat each
other; what is left, one copy of each, goes to suffix arrays by key: see `suffixes`.  A key with over `KEY_PIECES` different pieces
is dealt out as pairs of blocks, so no task holds it whole.  The windows found come back to the runs and so to the texts.

Equal texts are worked on once, under a 128-bit digest.  Texts travel compressed, and only where their bytes are needed.

Defined cases: null text is empty; a text shorter than the width keeps all; equal texts as long as the width or longer lose
all they have in common, which is everything; repeated rows and repeated or null doc_ids are rows of their own; empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from harvestline.llm.common import add_columns, text_groups
from harvestline.llm.suffixes import repeated_windows
from harvestline.sources.stored import stored

WIDTH = 200
GRAM = 32
LONGEST_RUN = 2048
KEY_PIECES = 20_000
UNIT_BYTES = 1 << 20
_GROUP = 1_000_000
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """Hashes of all strings of `GRAM` bytes in a buffer, and their minima over windows."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def grams(self, buffer: np.ndarray) -> np.ndarray:
        if len(buffer) > len(self.up):
            self.up, self.down = _powers(_PRIME, len(buffer)), _powers(_INVERSE, len(buffer))
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * self.up[: len(buffer)], out=sums[1:])
        n = len(buffer) - GRAM + 1
        values = (sums[GRAM:] - sums[:n]) * self.down[:n]
        values ^= values >> np.uint64(32)
        values *= np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
        return values

    @staticmethod
    def minima(values: np.ndarray, span: int) -> np.ndarray:
        """The least of each `span` consecutive values: from block ends backwards and block starts forwards."""
        n = len(values) - span + 1
        blocks = np.full(-(-len(values) // span) * span, ~np.uint64(0))
        blocks[: len(values)] = values
        blocks = blocks.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        return np.minimum(back[:n], ahead[span - 1 : span - 1 + n])


def _runs(texts: list[bytes], hasher: _Hasher) -> dict[str, np.ndarray | list]:
    """Of texts of `WIDTH` bytes or more: text number, key, piece hash, start, windows, and whether the key's string stands twice."""
    joined = b"".join(texts)
    grams = hasher.grams(np.frombuffer(joined, np.uint8))
    span = WIDTH - GRAM + 1
    least = hasher.minima(grams, span)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    out: dict[str, list] = {k: [] for k in ("which", "key", "piece", "start", "windows", "twice")}
    for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
        first = end - size
        keys = least[first : end - WIDTH + 1]
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        starts, stops = cuts.tolist(), [*cuts[1:].tolist(), len(keys)]
        for a, stop in zip(starts, stops):
            for start in range(a, stop, LONGEST_RUN):
                windows = min(stop - start, LONGEST_RUN)
                key = keys[start]
                low = first + start
                out["which"].append(i)
                out["key"].append(key)
                out["piece"].append(xxhash.xxh64_intdigest(joined[low : low + windows - 1 + WIDTH]))
                out["start"].append(start)
                out["windows"].append(windows)
                out["twice"].append(np.count_nonzero(grams[low : low + windows - 1 + span] == key) > 1)
    return out


def _all_runs(docs: DataFrame) -> DataFrame:
    """text_id, key, piece, start, windows, twice of all runs of all texts."""

    def work(batches):
        hasher = _Hasher()
        for batch in batches:
            texts = [t for t in ((x or "").encode() for x in batch.column(0).to_pylist()) if len(t) >= WIDTH]
            for low, high in text_groups(texts, _GROUP):
                part = texts[low:high]
                found = _runs(part, hasher)
                names = pa.array([digest(t) for t in part], pa.binary())
                numbers = lambda k: pa.array(np.array(found[k], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_pydict({
                    "text_id": names.take(pa.array(found["which"], pa.int32())),
                    "key": numbers("key"),
                    "piece": numbers("piece"),
                    "start": pa.array(found["start"], pa.int64()),
                    "windows": pa.array(found["windows"], pa.int32()),
                    "twice": pa.array(found["twice"], pa.bool_()),
                })

    return docs.select("text").mapInArrow(work, "text_id binary, key long, piece long, start long, windows int, twice boolean")


def _packed(docs: DataFrame) -> DataFrame:
    """text_id and compressed bytes of each different text of `WIDTH` bytes or more."""

    def work(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [t for t in ((x or "").encode() for x in batch.column(0).to_pylist()) if len(t) >= WIDTH]
            yield pa.RecordBatch.from_pydict({"text_id": pa.array([digest(t) for t in texts], pa.binary()), "packed": pa.array([press.compress(t) for t in texts], pa.binary())})

    return docs.select("text").mapInArrow(work, "text_id binary, packed binary").dropDuplicates(["text_id"])


def _cut_pieces(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """key, piece, data of the pieces that are wanted as (text_id, key, piece, start, windows)."""
    listed = wanted.groupBy("text_id").agg(F.collect_list(F.struct("key", "piece", "start", "windows")).alias("_cuts"))

    def work(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for packed, cuts in zip(batch.column("packed").to_pylist(), batch.column("_cuts").to_pylist()):
                text = open_.decompress(packed)
                data = [text[c["start"] : c["start"] + c["windows"] - 1 + WIDTH] for c in cuts]
                yield pa.RecordBatch.from_pydict({"key": pa.array([c["key"] for c in cuts], pa.int64()), "piece": pa.array([c["piece"] for c in cuts], pa.int64()), "data": pa.array(data, pa.binary())})

    return _packed(docs).join(listed, "text_id").select("packed", "_cuts").mapInArrow(work, "key long, piece long, data binary")


def _intervals(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"low": int(a), "high": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _repeats(pieces: DataFrame, key_pieces: int) -> DataFrame:
    """key, piece, parts: the ranges of windows of each piece that start elsewhere in pieces of its key."""
    large = pieces.groupBy("key").count().where(F.col("count") > key_pieces)
    large = stored(large.select("key", F.ceil(F.col("count") / key_pieces).cast("int").alias("blocks")), "large-keys")
    block = F.pmod(F.xxhash64("piece"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.xxhash64("key", F.least(x, block), F.greatest(x, block)))
    units = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(others)
    dealt = pieces.join(large, "key", "left").select("key", "piece", "data", F.explode(units).alias("unit"))
    dealt = dealt.repartition("unit").sortWithinPartitions("unit")

    def work(batches):
        held, size, last = {}, 0, None  # a piece that several units bring is there once

        def solve():
            flags = repeated_windows(list(held.values()), WIDTH)
            rows = [(k, p, _intervals(f)) for (k, p), f in zip(held, flags) if f.any()]
            held.clear()
            keys, names, parts = zip(*rows) if rows else ((), (), ())
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "piece": pa.array(names, pa.int64()), "parts": pa.array(parts, kind)})

        for batch in batches:
            for unit, key, piece, data in zip(*(batch.column(c).to_pylist() for c in ("unit", "key", "piece", "data"))):
                if held and unit != last and size > UNIT_BYTES:  # only between units
                    yield solve()
                    size = 0
                size += 0 if (key, piece) in held else len(data)
                held[key, piece] = data
                last = unit
        if held:
            yield solve()

    found = dealt.mapInArrow(work, "key long, piece long, parts array<struct<low:int,high:int>>")
    return found.select("key", "piece", F.explode("parts").alias("part"))


def removable(docs: DataFrame, key_pieces: int = KEY_PIECES) -> DataFrame:
    """text_id and ranges: for each text that has any, the ranges of its windows that start anywhere else."""
    runs = stored(_all_runs(docs), "runs")
    keys = runs.groupBy("key").agg(F.count("*").alias("n"), F.min("piece").alias("a"), F.max("piece").alias("b"), F.max("twice").alias("twice"))
    keys = keys.where("n > 1 or twice").select("key", (F.expr("a <> b") | F.col("twice")).alias("open"))
    candidates = stored(runs.join(keys, "key"), "candidates")
    one = F.min(F.struct("text_id", "start", "windows")).alias("one")
    pieces = stored(candidates.groupBy("key", "piece").agg(F.count("*").alias("n"), one, F.max("open").alias("open")), "pieces")
    wanted = pieces.where("open").select("key", "piece", "one.*")
    cut = stored(_cut_pieces(wanted, docs), "cut")
    inner = _repeats(cut, key_pieces).select("key", "piece", F.col("part.low").alias("low"), F.col("part.high").alias("high"))
    whole = pieces.where("n > 1").select("key", "piece", F.lit(0).alias("low"), F.col("one.windows").alias("high"))
    repeats = stored(inner.union(whole), "repeats")
    hits = candidates.join(repeats, ["key", "piece"])
    span = F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    # A set, so that copies of a text add nothing; it is bounded by the text itself.
    return hits.groupBy("text_id").agg(F.collect_set(span).alias("ranges"))


def kept_bytes(data: bytes, ranges: list[dict]) -> tuple[bytes, int, int]:
    """What stays of the text, the number of bytes and of maximal runs that go."""
    steps = np.zeros(len(data) + 1, np.int64)
    np.add.at(steps, [r["low"] for r in ranges], 1)
    np.add.at(steps, [r["high"] - 1 + WIDTH for r in ranges], -1)
    gone = np.cumsum(steps[:-1]) > 0
    spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def dedup(docs: DataFrame, key_pieces: int = KEY_PIECES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs = docs.select("doc_id", "text")

    def facts(texts):
        data = [t.encode() for t in texts]
        return {"text_id": [digest(d) for d in data], "n_bytes": [len(d) for d in data], "_sha": [hashlib.sha256(d).hexdigest() for d in data]}

    rows = stored(add_columns(docs, "text_id binary, n_bytes long, _sha string", facts, ["doc_id"]), "texts")
    ranges = removable(docs, key_pieces)

    def work(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            made = [kept_bytes(open_.decompress(p), r) for p, r in zip(batch.column("packed").to_pylist(), batch.column("ranges").to_pylist())]
            kept, removed, spans = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_pydict({
                "text_id": batch.column("text_id"),
                "_removed": pa.array(removed, pa.int64()),
                "_spans": pa.array(spans, pa.int64()),
                "_kept": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            })

    cut = _packed(docs).join(ranges, "text_id").mapInArrow(work, "text_id binary, _removed long, _spans long, _kept string")
    zero = F.lit(0).cast("long")
    return rows.join(stored(cut, "kept"), "text_id", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("_removed", zero).alias("n_removed"),
        F.coalesce("_spans", zero).alias("n_spans"),
        F.coalesce("_kept", "_sha").alias("kept_sha256"),
    )
