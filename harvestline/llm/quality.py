"""Document quality: random Fourier features over document statistics, ridge regression, isotonic calibration.

A document becomes `STATISTICS`, plain measures of its text.  They are standardised with the moments of all
documents and mapped to `2 * FREQUENCIES` random Fourier features, whose inner products approximate a Gaussian
kernel.  Each partition of labelled documents adds up its part of the normal equations; the sums are added row by
row on the cluster and the small system is solved once.  Raw scores of labelled rows that took no part in the fit
are counted in `BINS` score bins and made monotone by pooling adjacent violators.

Defined cases: a null text counts as empty and gets a score like any other; labels that are null, doc_ids that are
null and labels without a document are no training rows; several labels of one document count as their mean,
1 from 0.5; repeated rows are separate rows; without any training row every score is 0.5; with no rows for
calibration the raw score is clipped to 0..1.  Empty tables give empty results.  Columns other than
doc_id, text and quality are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from harvestline.llm.common import add_columns, fold, keeping_columns
from harvestline.sources.stored import stored

FREQUENCIES = 160
BANDWIDTH = 6.0
RIDGE = 1e-4
BINS = 512
SLICE = 1024  # rows whose features a task holds at a time
SEED = 8

STATISTICS = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digit", "end_mark", "comma", "bang",
    "symbol", "pipe", "wide", "space", "newline", "distinct_words", "top_word", "distinct_pairs", "distinct_lines",
    "line_length", "odd_words", "same_neighbour", "short_words",
]
_CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "end_mark": b".?",
    "comma": b",;:",
    "bang": b"!",
    "symbol": b"#$%&*@^~<>{}[]\\/=+_",
    "pipe": b"|",
    "wide": range(128, 256),
    "space": b" \t",
    "newline": b"\n\r",
}


def statistics(text: str) -> list[float]:
    """The values of `STATISTICS` for one text; an empty text has zeros."""
    data = text.encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    if not words:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n, seen = len(words), Counter(words)
    pairs = list(zip(words, words[1:]))
    values = {k: counts[list(v)].sum() / len(data) for k, v in _CLASSES.items()}
    values |= {
        "log_bytes": np.log1p(len(data)),
        "log_words": np.log1p(n),
        "word_length": np.log1p(lengths.mean()),
        "word_length_spread": np.log1p(lengths.std()),
        "distinct_words": len(seen) / n,
        "top_word": max(seen.values()) / n,
        "distinct_pairs": len(set(pairs)) / max(1, len(pairs)),
        "distinct_lines": len(set(lines)) / len(lines),
        "line_length": np.log1p(len(data) / len(lines)),
        "odd_words": sum(c for w, c in seen.items() if not w.strip(b".,;:?!").isalnum() and w.isascii()) / n,
        "same_neighbour": sum(a == b for a, b in pairs) / max(1, len(pairs)),
        "short_words": float((lengths <= 3).mean()),
    }
    return [float(values[k]) for k in STATISTICS]


def with_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`docs` with an array column `statistics`."""
    return add_columns(docs, "statistics array<double>", lambda texts: {"statistics": [statistics(t) for t in texts]}, keep)


def training_labels(labels: DataFrame, name: str) -> DataFrame:
    """One 0/1 label per document: the mean of its non-null labels, 1 from 0.5."""
    known = labels.select("doc_id", F.col(name).cast("double").alias("label")).dropna()
    return known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def features(self, rows: np.ndarray) -> np.ndarray:
        """A one, the standardised statistics, and cosines and sines of random projections of them."""
        x = np.clip((rows - self.mean) / self.scale, -6, 6)
        directions = np.random.default_rng(SEED).standard_normal((x.shape[1], FREQUENCIES)) / BANDWIDTH
        angle = x @ directions
        waves = np.concatenate([np.cos(angle), np.sin(angle)], axis=1) / np.sqrt(FREQUENCIES)
        return np.concatenate([np.ones((len(x), 1)), x, waves], axis=1)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), 0.5)
        return np.concatenate([self.features(rows[i : i + SLICE]) @ self.weights for i in range(0, max(1, len(rows)), SLICE)])

    def score(self, rows: np.ndarray) -> np.ndarray:
        raw = self.raw(rows)
        return np.clip(np.interp(raw, self.knots, self.levels) if len(self.knots) else raw, 0.0, 1.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("statistics").combine_chunks().flatten() if isinstance(batch.column("statistics"), pa.ChunkedArray) else batch.column("statistics").flatten()).reshape(-1, len(STATISTICS))


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    item = [F.col("statistics")[i] for i in range(len(STATISTICS))]
    row = rows.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(item)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(item)]).first()
    values = np.array([0.0 if v is None else v for v in row]).reshape(2, -1)
    return values[0], np.maximum(values[1], 1e-3)


def _normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y, added up per partition and then row by row of the matrix."""

    def part(batches):
        total = None
        for batch in batches:
            rows, labels = _matrix(batch), np.asarray(batch.column("label"))
            for i in range(0, len(rows), SLICE):
                z = model.features(rows[i : i + SLICE])
                joined = np.concatenate([z, labels[i : i + SLICE, None]], axis=1)
                total = z.T @ joined if total is None else total + z.T @ joined
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    def add(pdf):
        return pdf.iloc[:1].assign(row=[np.sum(np.stack(pdf["row"].to_list()), axis=0)])

    schema = "i int, row array<double>"
    sums = rows.select("statistics", "label").mapInArrow(part, schema).groupBy("i").applyInPandas(add, schema).orderBy("i").collect()
    if not sums:
        return np.zeros((0, 0)), np.zeros(0)
    matrix = np.array([r["row"] for r in sums])
    return matrix[:, :-1], matrix[:, -1]


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to `values` under `weights`."""
    blocks: list[list[float]] = []
    for value, weight in zip(values, weights):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, k = blocks.pop()
            u, x, j = blocks.pop()
            blocks.append([(u * x + v * w) / (x + w), x + w, j + k])
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks]) if blocks else np.zeros(0)


def score_columns(df: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """`keep` and `score` for rows that have `statistics`."""
    schema = df.select(*keep, F.lit(0.0).alias("score")).schema

    def work(batches):
        for batch in batches:
            arrays = [batch.column(c) for c in keep] + [pa.array(model.score(_matrix(batch)), pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "score"])

    return df.select(*keep, "statistics").mapInArrow(work, schema)


def fit(rows: DataFrame, labels: DataFrame, training: Column, name: str = "quality") -> QualityModel:
    """Fit on the stored rows (doc_id, statistics) whose `training` holds; a quarter of them calibrates."""
    mean, scale = _moments(rows)
    model = QualityModel(mean, scale)
    known = stored(rows.where(training).join(training_labels(labels, name), "doc_id"), "labelled")
    calibrates = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    matrix, target = _normal_equations(known.where(~calibrates), model)
    if not len(target):
        return model
    count = matrix[0, 0]
    penalty = RIDGE * count * np.eye(len(target))
    penalty[0, 0] = 0.0
    model.weights = np.linalg.lstsq(matrix + penalty, target, rcond=None)[0]
    raw = score_columns(known.where(calibrates), model, ["label"])
    step = F.round(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "score")) * BINS).cast("int").alias("bin")
    bins = raw.groupBy(step).agg(F.count("*").alias("n"), F.avg("label").alias("rate")).orderBy("bin").collect()
    if bins:
        model.knots = np.array([b["bin"] for b in bins]) / BINS
        model.levels = pool_adjacent(np.array([b["rate"] for b in bins]), np.array([b["n"] for b in bins], float))
    return model


def classify(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows of fold `held` of `parts` teach nothing."""
    rows = stored(with_statistics(docs, ["doc_id"]), "statistics")
    held_out = fold("doc_id", parts) == held
    model = fit(rows, labels, ~held_out)
    scored = score_columns(rows, model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@keeping_columns("doc_id", "text")
def accepted(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """The rows of `docs`, with their columns, that the classifier does not reject."""
    rows = stored(with_statistics(docs, ["doc_id"]), "statistics")
    model = fit(rows, labels, fold("doc_id", parts) != held)
    decide = lambda texts: {"_score": model.score(np.array([statistics(t) for t in texts]))}
    return add_columns(docs, "_score double", decide).where("_score >= 0.5").drop("_score")
