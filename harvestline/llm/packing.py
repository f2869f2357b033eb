"""Best-fit packing with exact complements.

Documents become token ids, long ones are cut, and the lengths of all pieces are counted; the plan works on
these counts (at most `LIMIT` of them, whatever the size of the corpus).  From the longest length down, the gap it leaves is looked up in
indexes of the lengths, of the sums of two and of three lengths that are still there; a combination that fills
the gap exactly is used as often as its lengths last.  What finds no complement is packed best-fit.  The plan names for
each run of ranks within a length its first sequence and its offset; pieces are ranked per length in salted parts, so that a length
that a third of all pieces share is never sorted in one task.

Defined cases: a null or empty text is the single end id; repeated rows and repeated or null doc_ids are packed as rows of
their own; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from harvestline.llm.common import BATCH_BYTES
from harvestline.sources.stored import stored

LIMIT = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
SALT = 1024
_WORDS_KEPT = 300_000
# Unicode white space, at which the tokenizer's pattern always splits and which it drops; str.split also cuts at four separators.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_HEAD_TAIL = re.compile("([A-Za-z\xc0-\u024f]+)([!-/:-@\\[-`{-~]*)")
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def _words(text: str) -> list[str]:
    if any(c in text for c in _SEPARATORS):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


class WordTokenizer:
    """Ids of whole texts, as little-endian bytes. What a task has seen is encoded once, up to a bound.

    The tokenizer drops white space, and none of its tokens or special tokens holds any, so that a text's ids are those of its words.
    A word of Latin letters followed by ASCII signs, or by nothing, is cut by the tokenizer's pattern where the signs begin.
    Its letters, in lower case, are one unit whose last id ends a word, so that many are encoded as one text and
    the ids told apart again. All other words are encoded one by one.
    """

    def __init__(self, path: str):
        # A task has one core; the library would start a thread for each core of the machine, with memory of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(c.ids, "<u4") for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_by_one(self, words: list[str], into: dict[str, bytes]) -> None:
        for start in range(0, len(words), 20_000):
            part = words[start : start + 20_000]
            into.update(zip(part, (ids.tobytes() for ids in self._encoded(part))))

    def _add_heads(self, heads: list[str]) -> None:
        parts = [heads[i : i + 64] for i in range(0, len(heads), 64)]
        for start in range(0, len(parts), 500):
            some = parts[start : start + 500]
            for part, ids in zip(some, self._encoded([" ".join(p) for p in some])):
                cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(cuts) != len(part):  # some head is more than one unit
                    self._one_by_one(part, self.heads)
                    continue
                coded = ids.tobytes()
                for head, low, high in zip(part, [0, *cuts], cuts):
                    self.heads[head] = coded[low:high]

    def _add(self, words: list[str]) -> None:
        cut, heads, tails, whole = [], [], [], []
        for word in words:
            if word.isascii() and word.isalpha():
                cut.append(word)
                heads.append(word.lower())
                tails.append("")
                continue
            found = _HEAD_TAIL.fullmatch(word)
            head = found[1].lower() if found else ""
            if head.isalpha():
                cut.append(word)
                heads.append(head)
                tails.append(found[2])
            else:
                whole.append(word)
        self._one_by_one(whole, self.known)
        self._one_by_one(list(set(tails).difference(self.tails)), self.tails)
        self._add_heads(list(set(heads).difference(self.heads)))
        coded = map(bytes.__add__, map(self.heads.__getitem__, heads), map(self.tails.__getitem__, tails))
        self.known.update(zip(cut, coded))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_words(t) for t in texts]
        for kept in (self.known, self.heads, self.tails):
            if len(kept) > _WORDS_KEPT:
                kept.clear()
        self.tails[""] = b""
        self._add(list(set().union(*split).difference(self.known)))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def forget(self) -> None:
        for kept in (self.known, self.heads, self.tails):
            kept.clear()


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str | None) -> WordTokenizer:
    """One per Python worker; without a path, the public vocabulary that is installed there."""
    if path not in _tokenizers:
        import public_tokenizers

        _tokenizers[path] = WordTokenizer(path or public_tokenizers.path(TOKENIZER))
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece.

    Texts leave Arrow in groups of about `BATCH_BYTES` bytes, and what the tokenizer has seen is dropped when a task ends.
    """
    end = np.array([END], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def rows(ids: list, coded: list[bytes]):
        for doc, code in zip(ids, coded):
            code += end
            for k, start in enumerate(range(0, len(code) // 4, limit)):
                yield doc, k, start, min(limit, len(code) // 4 - start), zlib.crc32(code[4 * start : 4 * (start + limit)])

    def work(batches):
        coder = tokenizer(path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        try:
            for batch in batches:
                ids, column = batch.column("doc_id"), batch.column("text")
                sizes = np.asarray(pc.binary_length(column))
                for low, high in _ranges(sizes, BATCH_BYTES):
                    made = list(rows(range(low, high), coder.encode(column.slice(low, high - low).to_pylist())))
                    at, piece, start, length, crc = (np.array(c) for c in zip(*made))
                    arrays = [ids.take(pa.array(at)), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
        finally:
            coder.forget()

    fields = T.StructType().add("doc_id", kind).add("piece", T.IntegerType())
    for name in ("start", "length", "ids_crc32"):
        fields.add(name, T.LongType())
    return source.mapInArrow(work, fields)


def _ranges(sizes: np.ndarray, limit: int):
    """Ranges of consecutive texts with about `limit` bytes each."""
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


# --- plan over counts ------------------------------------------------------------------------------
Pattern = tuple[tuple[int, ...], int]


def _pair_sums(there: np.ndarray) -> np.ndarray:
    """Whether some two available lengths add up to each sum."""
    size = 2 * len(there)
    wave = np.fft.rfft(there.astype(float), size)
    return np.fft.irfft(wave * wave, size)[: len(there)] > 0.5


def _possible(parts: tuple[int, ...], counts: np.ndarray) -> int:
    """How often the counts allow the combination."""
    return min(int(counts[p]) // parts.count(p) for p in parts)


def _two(rest: int, others: tuple[int, ...], counts: np.ndarray) -> tuple[int, int] | None:
    """The longest two available lengths with sum `rest` that are there together with `others`."""
    b = np.arange(1, rest // 2 + 1)
    for x in b[(counts[b] > 0) & (counts[rest - b] > 0)][::-1].tolist():
        if _possible((*others, x, rest - x), counts):
            return x, rest - x
    return None


def _complements(length: int, gap: int, counts: np.ndarray):
    """Combinations of one, two and three available lengths that with `length` fill the sequence, at most one of each kind."""
    if counts[gap]:
        yield (length, gap)
    if counts[length] and (two := _two(gap, (length,), counts)):
        yield (length, *two)
    if not counts[length]:
        return
    pairs = _pair_sums(counts > 0)
    third = np.arange(gap - 2, 0, -1)
    for a in third[(counts[third] > 0) & pairs[gap - third]].tolist():
        if two := _two(gap - a, (length, a), counts):
            yield (length, a, *two)
            return


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[Pattern]:
    """(lengths, how many sequences) for all pieces."""
    counts = np.zeros(limit + 1, np.int64)
    for length, count in histogram.items():
        counts[length] = count
    done: list[Pattern] = [((limit,), int(counts[limit]))] if counts[limit] else []
    counts[limit] = 0
    for length in range(limit - 1, 0, -1):
        while counts[length]:
            found = False
            for parts in _complements(length, limit - length, counts):
                times = _possible(parts, counts)
                if times:
                    np.subtract.at(counts, list(parts), times)
                    done.append((parts, times))
                    found = True
            if not found:
                break
    return done + best_fit(counts, limit)


def best_fit(counts: np.ndarray, limit: int = LIMIT) -> list[Pattern]:
    """Longest first, each into the smallest gap that takes it; equal sequences are kept as one pattern with a count."""
    open_: dict[int, list[Pattern]] = {}
    gaps = np.zeros(limit + 1, np.int64)  # open sequences by the gap they leave

    def put(parts, gap, times):
        open_.setdefault(gap, []).append((parts, times))
        gaps[gap] += times

    for length in range(limit, 0, -1):
        left = int(counts[length])
        while left:
            fitting = np.flatnonzero(gaps[length:])
            if not len(fitting):
                break
            gap = length + int(fitting[0])
            parts, times = open_[gap].pop()
            used = min(times, left)
            gaps[gap] -= times
            if times > used:
                put(parts, gap, times - used)
            put((*parts, length), gap - length, used)
            left -= used
        each = limit // length
        if left // each:
            put((length,) * each, limit - each * length, left // each)
        if left % each:
            put((length,) * (left % each), limit - (left % each) * length, 1)
    return [p for patterns in open_.values() for p in patterns if p[1]]


def _slots(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per length and run of ranks, in that order: length, first rank, first sequence, offset."""
    rows, sequence = [], 0
    for parts, times in patterns:
        ends = np.cumsum(parts)
        rows += [(length, sequence, int(end - length), times) for length, end in zip(parts, ends)]
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    before = np.cumsum(table[:, 3]) - table[:, 3]
    lengths, first = np.unique(table[:, 0], return_index=True)
    ranks = before - before[first][np.searchsorted(lengths, table[:, 0])] if len(table) else before
    return table[:, 0], ranks, table[:, 1], table[:, 2]


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Every piece of every document with its sequence_id and offset."""
    rows = stored(pieces(docs, path, limit), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lengths, ranks, sequences, offsets = _slots(plan(histogram, limit))

    order = ["doc_id", "piece", "ids_crc32"]
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(SALT)).cast("int"))
    counts = salted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = stored(counts.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before")), "ranks")
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order)) - 1
    ranked = salted.withColumn("_rank", rank).join(counts, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    key = (lengths << 45) + ranks

    def place(batches):
        for batch in batches:
            wanted = (np.asarray(batch.column("length")) << 45) + np.asarray(batch.column("_rank"))
            run = np.searchsorted(key, wanted, "right") - 1
            arrays = [batch.column(c) for c in kept]
            arrays += [pa.array(sequences[run] + wanted - key[run], pa.int64()), pa.array(offsets[run], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "sequence_id", "offset"])

    schema = rows.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.select(*kept, "_rank").mapInArrow(place, schema)
