"""Hashed maximum-entropy language model with a softmax factored by classes.

Outcomes are the training tokens that occur `LEAST` times or more, the commonest `LISTED` at most, and `SHAPES` groups of all other tokens by
their spelling.  They stand in nested classes, a code of base `WIDTH` by their counts: log P(token | text before) is the sum, along
the token's path, of log P(choice | class, history), each a softmax over at most `WIDTH` choices; within a spelling group a token
has the smoothed share of its count.  Every softmax starts from the shares of counts below its choices and has on top a log-linear model over the
actual tokens before: the last one, the last two (n-grams) and the last but one (skip).  (kind, history, class) is
hashed to one of `ROWS` weight rows with one weight per choice.

Training reads every training token `PASSES` times and shuffles none.  Each task takes gradient steps (scaled by the row's sum of
squared gradients) over groups of `STEP` tokens on its own copy of the weights; the movements of a row, weighted by how often tasks
met it, are summed over partitions by row block and give the next weights.  Token counts grow with the corpus and stay
distributed; the weights, the tree and the listed tokens are bounded.  Counts of tokens that are not listed come by a join.

Defined cases: null text is empty, and an empty text is its end token; a null doc_id counts as empty text in the fold; without training
text every token is unknown; repeated rows are rows of their own; empty tables give empty results; other columns are not
read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Collection, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from harvestline.llm.common import fold, text_groups
from harvestline.sources.stored import stored

WIDTH = 16
SHAPES = 64
LISTED = 1 << 16
LEAST = 5
ROW_BITS = 18
ROWS = 1 << ROW_BITS
BLOCK_ROWS = 1 << 10
PASSES = 1
TASK_TOKENS = 3_000_000  # a learning task takes about so many tokens or more, so that what tasks hand on stays a share of the input
STEP = 4096
RATE = 1.0
SMOOTH = 0.1
SEED = 42  # as in Spark's xxhash64
TINY = np.float32(1e-30)  # no choice has less
_FLUSH, _NAMES = 200_000, 400_000  # tokens that a task counts, or keeps numbered, at a time
END = b" "  # cannot be a word
NEVER = np.float32(-1e4)  # start of a choice that stands for nothing
MOST = np.float32(80)  # of the score of a choice, whose exponent must fit

#: What a task hands on of a weight row: how many decisions met it and, times that number, how far it moved.
MOVED = np.dtype([("row", "<i4"), ("n", "<f4"), ("moved", "<f4", WIDTH)])
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def tokens(text: str) -> list[bytes]:
    """Words in lower case, then the end."""
    return [*text.encode().lower().split(), END]


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """`tokens` of many texts, one after the other: ends of the texts, each token's place in the list of distinct tokens, that list."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.string())))
    full = np.asarray(pc.binary_length(lists.values)) > 0  # white space at either side of a text leaves empty words
    sizes = np.diff(np.append(0, np.cumsum(full))[np.asarray(lists.offsets)])
    words = lists.values.dictionary_encode()
    ends = np.cumsum(sizes + 1)
    at = np.full(ends[-1], len(words.dictionary), np.int64)
    inside = np.ones(len(at), bool)
    inside[ends - 1] = False
    at[inside] = np.asarray(words.indices)[full]
    return ends, at, [*words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), END]


def shape(token: bytes) -> int:
    """The spelling group of a token: its first two bytes and its last one."""
    last = token[-1:]
    kind = 0 if last.isalnum() or last >= b"\x80" else 1 if last in b".,;:" else 2 if last in b"!?" else 3
    return (zlib.crc32(token[:2]) % (SHAPES // 4)) * 4 + kind


@cache
def _shape_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of `shape`: by the only byte of a token, by its first two, and by its last one."""
    one = [shape(bytes([a])) & ~3 for a in range(256)]
    two = [shape(bytes([a, b])) & ~3 for a in range(256) for b in range(256)]
    return np.array(one), np.array(two), np.array([shape(bytes([a])) & 3 for a in range(256)])


def shapes(tokens: Sequence[bytes]) -> np.ndarray:
    """`shape` of many tokens."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    text = np.frombuffer(b"".join(tokens) + b"\0\0", np.uint8).astype(np.int64)
    end = np.cumsum(size)
    first = end - size
    one, two, kind = _shape_tables()
    group = np.where(size > 1, two[text[first] << 8 | text[first + 1]], one[text[first]])
    return np.where(size > 0, group + kind[text[end - 1]], shape(b""))


def hashes(tokens: Collection[bytes]) -> np.ndarray:
    """64 bit hashes, as Spark's xxhash64 gives them."""
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in tokens), np.uint64, len(tokens))


class Tree:
    """Nested classes over outcomes with counts: `first[i]` to `first[i + 1]` are the decisions (`node`, `choice`) of outcome i."""

    def __init__(self, counts: np.ndarray):
        heap = [(float(n), i) for i, n in enumerate(counts)]
        heapq.heapify(heap)
        size, made, parent = len(counts), [], {}
        take = (size - 2) % (WIDTH - 1) + 2  # fewer at the bottom, so that all classes above are full
        while len(heap) > 1:
            below = [heapq.heappop(heap) for _ in range(min(take, len(heap)))]
            take, name = WIDTH, size + len(made)
            for choice, (_, child) in enumerate(below):
                parent[child] = (len(made), choice)
            made.append([n for n, _ in below])
            heapq.heappush(heap, (sum(made[-1]), name))
        self.start = np.full((len(made), WIDTH), NEVER, np.float32)
        for node, weights in enumerate(made):
            self.start[node, : len(weights)] = np.log(np.array(weights) / sum(weights))
        first, nodes, choices = [0], [], []
        for i in range(size):
            at = i
            while at in parent:
                node, choice = parent[at]
                nodes.append(node)
                choices.append(choice)
                at = size + node
            first.append(len(nodes))
        self.first, self.node, self.choice = np.array(first), np.array(nodes, np.int32), np.array(choices, np.int32)

    def decisions(self, outcomes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position in `outcomes`, class and choice of every decision on their paths."""
        depth = self.first[outcomes + 1] - self.first[outcomes]
        ends = np.cumsum(depth)
        at = np.repeat(np.arange(len(outcomes)), depth)
        place = np.arange(len(at)) + np.repeat(self.first[outcomes] - ends + depth, depth)
        return at, self.node[place], self.choice[place]


def histories(names: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes, a row per kind of feature, of what stands before each token of texts that stand one after the other."""
    index = np.arange(len(names)) - np.repeat(np.append(0, ends[:-1]), np.diff(ends, prepend=0))
    before = []
    for back in (1, 2):
        value = np.roll(names, back)
        value[index < back] = 0
        before.append(value)
    last, earlier = before
    mixed = lambda kind, value: (value ^ np.uint64(kind)) * _MIX
    return np.stack([mixed(1, last), mixed(2, last * _MIX2 + earlier), mixed(3, earlier)])


def weight_rows(history: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The weight row of each kind of feature for decisions in these classes."""
    value = history + node.astype(np.uint64) * _MIX2
    value ^= value >> np.uint64(31)
    return ((value * _MIX) >> np.uint64(64 - ROW_BITS)).astype(np.int32)


def taken(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """`table[rows]`, several times faster."""
    return np.take(table, rows, axis=0, mode="clip")


def put(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """`table[rows] = values`, several times faster: each row is moved as one piece."""
    whole = np.dtype((np.void, table.dtype.itemsize * table.shape[1]))
    np.put(table.view(whole).ravel(), rows, np.ascontiguousarray(values).view(whole).ravel())


def choices(start: np.ndarray, weights: np.ndarray, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities of all choices of each decision."""
    scores = taken(start, node)
    for kind in rows:
        scores += taken(weights, kind)
    p = np.exp(np.minimum(scores, MOST, out=scores), out=scores)
    p /= (p @ np.ones(WIDTH, np.float32))[:, None]
    return p


def gradient(start: np.ndarray, weights: np.ndarray, node: np.ndarray, choice: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows met, how often, and the gradient of the log-likelihood by their weights: observed less expected choices."""
    slope = np.negative(choices(start, weights, node, rows))
    slope.ravel()[np.arange(len(node)) * WIDTH + choice] += 1
    key = np.sort((rows.astype(np.int64) << 32 | np.arange(len(node))).ravel())
    row, at = key >> 32, key & 0xFFFFFFFF
    cut = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    n = np.diff(np.append(cut, len(row)))
    sums, many = taken(slope, at[cut]), n > 1
    if many.any():
        several = np.flatnonzero(np.repeat(many, n))
        put(sums, np.flatnonzero(many), np.add.reduceat(taken(slope, at[several]), np.cumsum(n[many]) - n[many], axis=0))
    return row[cut], n, sums


class Learner:
    """Gradient steps of one task on its own copy of the weights."""

    def __init__(self, start: np.ndarray, weights: np.ndarray):
        self.start, self.given, self.weights = start, weights, weights.copy()
        self.squares, self.met = np.ones(len(weights), np.float32), np.zeros(len(weights), np.float32)

    def step(self, node: np.ndarray, choice: np.ndarray, rows: np.ndarray) -> None:
        row, n, slope = gradient(self.start, self.weights, node, choice, rows)
        self.squares[row] += np.einsum("ij,ij->i", slope, slope)
        self.met[row] += n
        slope *= (RATE / np.sqrt(self.squares[row]))[:, None]
        slope += taken(self.weights, row)
        put(self.weights, row, slope)

    def moved(self):
        """block, rows of the block as `MOVED`."""
        for block in range(0, len(self.weights), BLOCK_ROWS):
            seen = block + np.flatnonzero(self.met[block : block + BLOCK_ROWS])
            if len(seen):
                out = np.zeros(len(seen), MOVED)
                out["row"], out["n"] = seen, self.met[seen]
                out["moved"] = (self.weights[seen] - self.given[seen]) * self.met[seen, None]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block // BLOCK_ROWS], pa.int32()), "rows": pa.array([out.tobytes()], pa.binary())})


class Names(dict):
    """Tokens numbered as they come, after the listed ones, with the outcome and the name (64 bit hash) of each number."""

    def __init__(self, outcome: dict[bytes, int]):
        self.listed, self.known = outcome, hashes(outcome)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.update(self.listed)
        self.outcomes, self.hashes = np.arange(len(self.listed)), self.known

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Outcome and name of distinct tokens."""
        if len(self) > _NAMES:
            self.forget()
        new = [w for w in words if w not in self]
        if new:
            self.outcomes = np.append(self.outcomes, len(self.listed) + shapes(new))
            self.hashes = np.append(self.hashes, hashes(new))
            self.update(zip(new, range(len(self), len(self) + len(new))))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.outcomes[at], self.hashes[at]


class Model:
    """Everything that tasks need beside the weights; its size does not depend on the corpus."""

    def __init__(self, listed: dict[bytes, int], totals: np.ndarray, types: np.ndarray, n: int, v: int):
        """`totals`, `types`: counts and numbers of the tokens in each spelling group that are not listed."""
        ordered = sorted(listed, key=lambda w: (-listed[w], w))
        self.outcome = {w: i for i, w in enumerate(ordered)}
        self.counts = np.array([listed[w] for w in ordered] + [0] * SHAPES, np.int64)
        self.listed, self.totals, self.types, self.n, self.v = len(ordered), totals, types, n, v
        self.tree = Tree(np.append(self.counts[: self.listed], totals + 0.5))
        self.names = None

    def base(self, count):
        """log10 of the add-0.1 share of a token with this count."""
        return np.log10((np.asarray(count) + SMOOTH) / (self.n + SMOOTH * (self.v + 1)))

    def group_size(self) -> np.ndarray:
        return self.totals + SMOOTH * (self.types + 1)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends of the texts; outcome and name (64 bit hash) of each of their tokens."""
        ends, at, words = coded(texts)
        if self.names is None:  # made in the task
            self.names = Names(self.outcome)
        outcomes, names = self.names.of(words)
        return ends, outcomes[at], names[at]

    def steps(self, texts: list[str]):
        """Decisions of the texts in groups of `STEP` tokens: position of the token, class, choice, weight rows."""
        ends, outcomes, names = self.read(texts)
        history = histories(names, ends)
        for at in range(0, len(outcomes), STEP):
            of, node, choice = self.tree.decisions(outcomes[at : at + STEP])
            yield at + of, node, choice, weight_rows(history[:, at : at + STEP][:, of], node)

    def score(self, texts: list[str], weights: np.ndarray) -> tuple:
        """Per text: tokens, listed tokens, sums of both scores over what is at hand; names and groups of the others, with their ends."""
        ends, outcomes, names = self.read(texts)
        history = histories(names, ends)
        score = np.zeros(len(outcomes))
        for at in range(0, len(outcomes), STEP):
            of, node, choice = self.tree.decisions(outcomes[at : at + STEP])
            p = choices(self.tree.start, weights, node, weight_rows(history[:, at : at + STEP][:, of], node))
            chosen = np.log(p.ravel()[np.arange(len(of)) * WIDTH + choice] + TINY)
            score[at : at + STEP] = np.bincount(of, chosen, min(STEP, len(outcomes) - at)) / np.log(10)
        rare = outcomes >= self.listed
        first = np.append(0, ends[:-1])
        base = np.append(self.base(self.counts[: self.listed]), np.zeros(SHAPES))[outcomes]
        add = lambda values: np.add.reduceat(values, first)
        rest = np.append(0, np.cumsum(add(rare.astype(np.int64))))
        return ends - first, add((~rare).astype(np.int64)), add(base), add(score), rest, names[rare].view(np.int64), (outcomes[rare] - self.listed).astype(np.int8)


def _token_counts(docs: DataFrame) -> DataFrame:
    """token, n over all texts; each task adds up what fits before it hands counts on."""

    def work(batches):
        counts: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_pydict({"token": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()

        for batch in batches:
            for _, texts in _texts(batch):
                _, at, words = coded(texts)
                counts.update({w: n for w, n in zip(words, np.bincount(at, minlength=len(words)).tolist()) if n})
                if len(counts) > _FLUSH:
                    yield from out()
        if counts:
            yield from out()

    return docs.select("text").mapInArrow(work, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _common(vocabulary: DataFrame, most: int) -> dict[bytes, int]:
    """The tokens above a count that at most `most` of them reach: counts are binned, so that no task sends more than it must."""
    level = F.floor(F.log2("n") * 8).cast("int")
    found, least = 0, None
    for r in sorted(vocabulary.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        found += r["count"]
        if found > most:
            break
        least = r["level"]
    if least is None:
        return {}
    return {bytes(r["token"]): r["n"] for r in vocabulary.where(level >= least).collect()}


def _groups(vocabulary: DataFrame, listed: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and numbers of the tokens in each spelling group that are not listed."""
    spread = vocabulary.sparkSession.sparkContext.broadcast(frozenset(listed))

    def work(batches):
        for batch in batches:
            words, n = batch.column("token").to_pylist(), np.asarray(batch.column("n"))
            listed = np.fromiter((w in spread.value for w in words), bool, len(words))
            own = np.where(listed, SHAPES, shapes(words))
            kinds = np.bincount(own, minlength=SHAPES + 1)[:SHAPES]
            sums = np.bincount(own, n, SHAPES + 1)[:SHAPES].astype(np.int64)
            yield pa.RecordBatch.from_pydict({"shape": np.arange(SHAPES), "n": sums, "types": kinds})

    totals, types = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    rows = vocabulary.mapInArrow(work, "shape long, n long, types long").groupBy("shape").agg(F.sum("n").alias("n"), F.sum("types").alias("types"))
    for r in rows.collect():
        totals[r["shape"]], types[r["shape"]] = r["n"], r["types"]
    return totals, types


def _texts(batch: pa.RecordBatch):
    texts = [t or "" for t in batch.column("text").to_pylist()]
    for start, end in text_groups(texts):
        yield start, texts[start:end]


def train(docs: DataFrame, model, passes: int = PASSES) -> np.ndarray:
    """Weights after gradient steps over all texts of `docs`; `model` is a broadcast `Model`."""
    context = docs.sparkSession.sparkContext
    weights = np.zeros((ROWS, WIDTH), np.float32)
    for _ in range(passes):
        spread = context.broadcast(weights)

        def work(batches, spread=spread):
            learner = None
            for batch in batches:
                learner = learner or Learner(model.value.tree.start, spread.value)
                for _, texts in _texts(batch):
                    for _, node, choice, rows in model.value.steps(texts):
                        learner.step(node, choice, rows)
            if learner:
                yield from learner.moved()

        def merged(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, data in zip(batch.column("block").to_pylist(), batch.column("rows")):
                    part = np.frombuffer(data.as_buffer(), MOVED)
                    total = sums.setdefault(block, np.zeros((BLOCK_ROWS, WIDTH + 1)))
                    at = part["row"] - block * BLOCK_ROWS  # a task names a row once
                    total[at, 0] += part["n"]
                    total[at, 1:] += part["moved"]
            for block, total in sums.items():
                mean = (total[:, 1:] / np.maximum(total[:, :1], 1)).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "rows": pa.array([mean.tobytes()], pa.binary())})

        moved = docs.select("text").mapInArrow(work, "block int, rows binary")
        weights = weights.copy()
        for r in moved.repartition(F.col("block")).mapInArrow(merged, "block int, rows binary").collect():
            weights[r["block"] * BLOCK_ROWS :][:BLOCK_ROWS] += np.frombuffer(r["rows"], np.float32).reshape(-1, WIDTH)
        spread.destroy()
    return weights


def _scored(docs: DataFrame, model, weights) -> DataFrame:
    """doc_id, sums per text over what the model knows at hand, and the tokens whose counts it lacks."""
    fields = "n_tokens long, known long, base double, score double, keys array<long>, shapes array<tinyint>"
    schema = docs.select("doc_id").schema.simpleString()[len("struct<") : -1].replace(":", " ", 1)

    def work(batches):
        for batch in batches:
            for start, texts in _texts(batch):
                n, known, base, score, ends, keys, shapes = model.value.score(texts, weights.value)
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v)) for v in (keys, shapes)]
                numbers = [pa.array(v) for v in (n.astype(np.int64), known, base, score)]
                names = ["doc_id", "n_tokens", "known", "base", "score", "keys", "shapes"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), *numbers, *lists], names=names)

    return docs.select("doc_id", "text").mapInArrow(work, f"{schema}, {fields}")


def score(docs: DataFrame, parts: int = 10, held: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; fold `held` of `parts` teaches nothing."""
    held_out = fold("doc_id", parts) == held
    docs = docs.select("doc_id", "text")
    context = docs.sparkSession.sparkContext
    training = docs.where(~held_out)
    vocabulary = stored(_token_counts(training), "vocabulary")
    whole = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    listed = _common(vocabulary.where(F.col("n") >= LEAST), LISTED)
    model = Model(listed, *_groups(vocabulary, listed), whole["n"] or 0, whole["v"])
    spread = context.broadcast(model)
    weights = context.broadcast(train(training.coalesce(1 + model.n // TASK_TOKENS), spread))
    rows = stored(_scored(docs, spread, weights).withColumn("_id", F.monotonically_increasing_id()), "scored")

    # Tokens that are not on the list: their counts by a join, then their shares of all tokens and of their group.
    rare = rows.select("_id", F.explode(F.arrays_zip("keys", "shapes")).alias("r")).select("_id", F.col("r.keys").alias("key"), F.col("r.shapes").alias("shape"))
    found = rare.join(vocabulary.select(F.xxhash64("token").alias("key"), "n"), "key", "left")
    count = F.coalesce("n", F.lit(0)) + SMOOTH
    size = F.element_at(F.array(*[F.lit(float(s)) for s in model.group_size()]), F.col("shape") + 1)
    sums = found.groupBy("_id").agg(
        F.count("n").alias("_known"),
        F.sum(F.log10(count / (model.n + SMOOTH * (model.v + 1)))).alias("_base"),
        F.sum(F.log10(count / size)).alias("_score"),
    )
    added = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    return rows.drop("keys", "shapes").join(sums, "_id", "left").select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        added("known", "_known", 0).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        added("base", "_base", 0.0).alias("base_score"),
        added("score", "_score", 0.0).alias("score"),
    )
