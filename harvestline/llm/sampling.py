"""Document fingerprints by consistent weighted sampling.

A document is a set of words weighted by their counts.  For each of `SAMPLES` hash functions, each word draws two
gamma(2, 1) values and a uniform one from its own hash alone; they give the word a level below its weight and a rank, and the
word of the least rank is the sample, together with its level.  Two documents have the same sample with a
probability equal to the sum of the lesser weights over the sum of the greater ones (generalised Jaccard).
A sample is kept as 16 bits, so different samples agree by chance once in 65,536.

`neighbours` puts documents in descending order of doc_id: ranges between bounded quantiles are dealt out, each with a copy of
the row that comes after its last, and read in order.

Defined cases: null text is empty; the fingerprint of a text without words is all zeros, alike (1) to another such and
unlike (0) to any other; null doc_ids come last, rows of one doc_id in order of their text; a single document is its own next;
repeated rows are rows of their own; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from harvestline.llm.common import text_groups

SAMPLES = 64
SEED = 6
RANGE_ROWS = 2000
MOST_RANGES = 4096
_GROUP = 500_000
_BLOCK = 256  # words
FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; products wrap."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _mix_in_place(values: np.ndarray, spare: np.ndarray) -> None:
    """`_mixed`, without new arrays."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(values, np.uint64(shift), out=spare)
        np.bitwise_xor(values, spare, out=values)
        np.multiply(values, np.uint64(factor), out=values)
    np.right_shift(values, np.uint64(31), out=spare)
    np.bitwise_xor(values, spare, out=values)


def _draws(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta of every word and hash function, some words at a time, so that the work arrays stay in the processor's cache."""
    step = np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    low = np.uint64(0xFFFFFFFF)
    out = tuple(np.empty((len(hashes), SAMPLES), np.float32) for _ in range(3))
    seeds, drawn, spare = (np.empty((_BLOCK, SAMPLES), np.uint64) for _ in range(3))
    one, two = (np.empty((_BLOCK, SAMPLES)) for _ in range(2))

    def unit(bits, into):
        np.add(bits, 0.5, out=into, casting="unsafe")
        np.divide(into, 4294967296.0, out=into)

    for start in range(0, len(hashes), _BLOCK):
        n = min(_BLOCK, len(hashes) - start)
        s, d, t, x, y = seeds[:n], drawn[:n], spare[:n], one[:n], two[:n]
        np.add(hashes[start : start + n, None], step, out=s)
        for k, result in enumerate(out):
            np.add(s, np.uint64(k), out=d)
            _mix_in_place(d, t)
            np.bitwise_and(d, low, out=t)
            unit(t, x)
            if k < 2:
                np.right_shift(d, np.uint64(32), out=t)
                unit(t, y)
                np.multiply(x, y, out=x)
                np.log(x, out=x)
                np.negative(x, out=x)
            if k == 1:
                np.log(x, out=x)
            result[start : start + n] = x
    return out


def _placed(weight, r: np.ndarray, c: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level and rank of words with the logarithms of their weights."""
    level = np.floor(weight / r + beta)
    return level, c - r * (level - beta) - r


def signatures(texts: list[str]) -> np.ndarray:
    """One row of `SAMPLES` 16-bit samples per text."""
    counts = [Counter(t.split()) for t in texts]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for c in counts for w in c))}
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    if not number:
        return out
    hashes = np.array([xxhash.xxh64_intdigest(w.encode(), SEED) for w in number], np.uint64)
    r, c, beta = _draws(hashes)
    # Most words occur once in a text: their level and rank hang on the word alone.
    once_level, once_rank = _placed(np.float32(0), r, c, beta)
    columns = np.arange(SAMPLES)
    for i, count in enumerate(counts):
        if not count:
            continue
        word = np.fromiter(map(number.__getitem__, count), np.int64, len(count))
        times = np.fromiter(count.values(), np.float32, len(count))
        rank = once_rank.take(word, axis=0)
        again = np.flatnonzero(times > 1)
        some = word[again]
        level, rank[again] = _placed(np.log(times[again])[:, None], r[some], c[some], beta[some])
        best = rank.argmin(axis=0)
        chosen_level = once_level[word[best], columns]
        repeated = times[best] > 1
        chosen_level[repeated] = level[np.searchsorted(again, best[repeated]), columns[repeated]]
        chosen = hashes[word[best]] + chosen_level.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        samples = _mixed(chosen) & np.uint64(0xFFFF)
        out[i] = np.maximum(samples, np.uint64(1))
    return out


def text_of(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def edited(text: str, other: str) -> str:
    """`text` with its last half replaced by the first as many code points of `other`."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _compare(texts: list[str], following: list[str]) -> dict:
    changed = [edited(a, b) for a, b in zip(texts, following)]
    names = {t: i for i, t in enumerate(dict.fromkeys([*texts, *following, *changed]))}
    found = signatures(list(names))
    own, new, other = (found[[names[t] for t in group]] for group in (texts, changed, following))
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": [text_of(s) for s in own],
        "edited_fingerprint": [text_of(s) for s in new],
        "near_edited": (own == new).mean(axis=1),
        "near_next": (own == other).mean(axis=1),
    }


def _in_ranges(docs: DataFrame) -> DataFrame:
    """Rows (range, own, doc_id, text): every document in its range, and the first of each range once more, not `own`, in the one above."""
    ids = docs.select("doc_id")
    rows = ids.count()
    ranges = max(1, min(MOST_RANGES, -(-rows // RANGE_ROWS)))
    probabilities = [i / ranges for i in range(1, ranges)]
    bounds = np.array(sorted(set(ids.approxQuantile("doc_id", probabilities, 0.2 / ranges) if probabilities else [])), float)

    def place(column) -> np.ndarray:
        """0 for null ids, from 1 upwards for the others."""
        known = np.asarray(column.is_valid())
        values = np.asarray(column.fill_null(0)).astype(float)
        return np.where(known, np.searchsorted(bounds, values, "right") + 1, 0).astype(np.int32)

    def ends(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(batch.column(0))), batch.column(0)], names=["range", "doc_id"])

    tops = ids.mapInArrow(ends, "range int, doc_id long").groupBy("range").agg(F.max("doc_id").alias("top")).orderBy("range").collect()
    # The row after the last of a range is the first of the next one below; below the lowest, the first of all.
    after = {r["range"]: below["top"] for r, below in zip(tops, [*tops[-1:], *tops])}
    wanted: dict[int | None, list[int]] = {}
    for above, top in after.items():
        wanted.setdefault(top, []).append(above)
    known = pa.array([t for t in wanted if t is not None], pa.int64())

    def deal(batches):
        import pyarrow.compute as pc

        names = ["range", "own", "doc_id", "text"]
        for batch in batches:
            column = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.array(place(column)), pa.array(np.ones(len(column), bool)), column, batch.column(1)], names=names)
            copied = np.flatnonzero(np.asarray(pc.is_in(column, value_set=known)) | (np.asarray(column.is_null()) if None in wanted else False))
            picks = [(i, r) for i in copied.tolist() for r in wanted.get(column[i].as_py(), ())]
            if picks:
                at, above = (pa.array(x, pa.int32()) for x in zip(*picks))
                yield pa.RecordBatch.from_arrays([above, pa.array(np.zeros(len(at), bool)), column.take(at), batch.column(1).take(at)], names=names)

    text = F.coalesce("text", F.lit("")).alias("text")
    dealt = docs.select(F.col("doc_id").cast("long"), text).mapInArrow(deal, "range int, own boolean, doc_id long, text string")
    order = ["range", F.col("own").desc(), F.col("doc_id").desc_nulls_last(), "text"]
    return dealt.repartition("range").sortWithinPartitions(*order)


def neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness, `FIELDS`."""

    def work(batches):
        held: list[tuple] = []
        for batch in batches:
            rows = held + list(zip(*(batch.column(c).to_pylist() for c in ("range", "own", "doc_id", "text"))))
            pairs = [(a[2], a[3], b[3]) for a, b in zip(rows, rows[1:]) if a[1] and a[0] == b[0]]
            held = rows[-1:]
            for start, end in text_groups([p[1] for p in pairs], _GROUP):
                ids, texts, following = zip(*pairs[start:end])
                made = {"doc_id": pa.array(ids, pa.int64())} | _compare(list(texts), list(following))
                yield pa.RecordBatch.from_pydict(made)

    return _in_ranges(docs).mapInArrow(work, FIELDS)
