"""Toxicity by multiple-instance learning: labels say that a document is toxic, not which sentence makes it so.

Each sentence has a score, a logistic function of the telling words and word beginnings in it; a document's score is the noisy-or of its
sentences, 1 - prod(1 - score).  The gradient of the document's likelihood falls on the sentences in the
share that each has in it, so sentence weights are learned from document labels alone.

The fit uses at most `FIT_ROWS` labelled documents, those with the smallest hash of doc_id (a bounded sample), each once: of rows with one
doc_id the least text.  `VOCABULARY` telling words are chosen there by a chi-square over counts that all tasks add up; then each document becomes, in
its own task, the numbers of its sentences' telling words, and only these meet in the one fit.  Every document is scored, over its whole text.

Defined cases: null text is empty and scores as a text without sentences, by the base rate of a single empty sentence; null labels and
doc_ids teach nothing; several labels of one document count as their mean, 1 from 0.5; without any training row every score is 0;
repeated rows are rows of their own; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from harvestline.llm.common import add_columns, fold
from harvestline.llm.quality import training_labels
from harvestline.sources.stored import stored

FIT_ROWS = 12_000
VOCABULARY = 2048
LEAST_CHI_SQUARE = 15.0
LEAST_DOCUMENTS = 4
STEMS = (3, 4, 5)
STEPS = 300
RATE = 0.1
RIDGE = 2e-2
_FLUSH = 200_000
_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?\n]+|$)")
_WORD = re.compile(r"[^\W_]+")

Sentence = tuple[int, int, set]


def signs(words: set) -> set:
    """The words and, marked, the first letters of those that are longer."""
    return words | {f"{w[:n]}-" for w in words for n in STEMS if len(w) > n}


def sentences(text: str) -> list[Sentence]:
    """(start, end, distinct lower-case words) of every sentence that has words; code points."""
    spans = ((m.start(), m.end(), set(_WORD.findall(m.group().lower()))) for m in _SENTENCE.finditer(text))
    return [s for s in spans if s[2]]


def telling_words(docs: DataFrame, size: int = VOCABULARY) -> list[str]:
    """The words whose presence in `docs` (text, label) goes most with the label, by chi-square, ties by the word."""
    facts = docs.agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("positives")).first()
    n, positives = facts["n"], facts["positives"] or 0
    if not 0 < positives < n:
        return []

    def work(batches):
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def out():
            for label, counts in enumerate(seen):
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "toxic": np.full(len(counts), label), "n": np.array(list(counts.values()), np.int64)})
                counts.clear()

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                seen[int(label)].update(signs(set(_WORD.findall(text.lower()))))
                if len(seen[0]) + len(seen[1]) > _FLUSH:
                    yield from out()
        yield from out()

    counts = docs.select("text", "label").mapInArrow(work, "word string, toxic long, n long").groupBy("word")
    of = lambda label: F.sum(F.when(F.col("toxic") == label, F.col("n")).otherwise(0)).cast("double")
    counts = counts.agg(of(1).alias("a"), of(0).alias("b"))
    a, b = F.col("a"), F.col("b")
    c, d = positives - a, n - positives - b
    part = a * d - b * c
    chi = n * part * part / F.greatest(F.lit(1e-9), (a + b) * (c + d) * (a + c) * (b + d))
    often = counts.where(a + b >= min(LEAST_DOCUMENTS, max(1, n // 50))).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI_SQUARE)
    return [r["word"] for r in often.orderBy(F.col("chi").desc(), "word").limit(size).collect()]


def sentence_words(text: str, number: dict[str, int]) -> tuple[int, int, Counter]:
    """Number of sentences, of those without a telling word, and how often each set of telling words makes one."""
    parts = sentences(text)
    known = Counter(tuple(sorted(number[w] for w in signs(seen) if w in number)) for _, _, seen in parts)
    quiet = known.pop((), 0) + (not parts)
    return max(1, len(parts)), quiet, known


def fit_sentences(words: list[str], documents: list[tuple[int, int, list]], labels: list[float]) -> dict[str, float]:
    """Weights of words, and the base weight under the empty word, that make the labels likeliest.

    Of each document: number of sentences, of those without a telling word, and (times, numbers of telling words) of the others.
    """
    document, sentence, word, times = [], [], [], []
    for d, (_, _, parts) in enumerate(documents):
        for n, known in parts:
            document.append(d)
            sentence += [len(times)] * len(known)
            word += known
            times.append(n)
    total, quiet = (np.array([x[i] for x in documents], float) for i in (0, 1))
    document, sentence, word = (np.array(x, np.int64) for x in (document, sentence, word))
    count, times = len(times), np.array(times, float)
    y = np.array(labels, float)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weights = np.zeros(len(words) + 1)
    weights[0] = np.log(share / max(1.0, float(total.mean())))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        z = weights[0] + np.bincount(sentence, weights[word], count)
        part, base = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-weights[0]))
        clean = np.bincount(document, times * np.logaddexp(0, z), len(y)) + quiet * np.logaddexp(0, weights[0])
        p = -np.expm1(-clean)
        pull = np.where(y > 0, -(1 - p) / np.maximum(p, 1e-12), 1.0)
        slope = pull[document] * part * times
        gradient = np.bincount(word, slope[sentence], len(weights))
        gradient[0] = slope.sum() + (pull * quiet).sum() * base
        gradient = gradient / len(y) + RIDGE * np.append(0.0, weights[1:]) / len(y)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        weights -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return {"": float(weights[0])} | {w: float(weights[i]) for i, w in enumerate(words, 1)}


def sentence_rows(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, label, total, quiet, parts of `docs` (doc_id, text, label), as `sentence_words` has them."""
    number = {w: i for i, w in enumerate(words, 1)}

    def work(batches):
        for batch in batches:
            found = [sentence_words(t, number) for t in batch.column("text").to_pylist()]
            parts = [[{"times": n, "words": list(known)} for known, n in sorted(f[2].items())] for f in found]
            kind = pa.list_(pa.struct([("times", pa.int64()), ("words", pa.list_(pa.int32()))]))
            columns = [batch.column("doc_id"), batch.column("label"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, kind)], names=["doc_id", "label", "total", "quiet", "parts"])

    source = docs.select("doc_id", "label", "text")
    kinds = [*source.drop("text").schema.fields, *StructType.fromDDL("total long, quiet long, parts array<struct<times:long,words:array<int>>>").fields]
    return source.mapInArrow(work, StructType(kinds))


def fit(docs: DataFrame, labels: DataFrame, training: Column, name: str = "toxic", rows: int = FIT_ROWS) -> dict[str, float]:
    """Weights from a bounded sample of the labelled documents whose `training` holds; empty without any."""
    chosen = training_labels(labels, name).where(training & F.col("doc_id").isNotNull())
    chosen = stored(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "sample")
    # At most `rows` rows of two numbers: small by construction.
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = stored(sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")), "sample-texts")
    words = telling_words(sample)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        documents = [(t, q, [(x["times"], list(x["words"])) for x in p]) for t, q, p in zip(pdf["total"], pdf["quiet"], pdf["parts"])]
        weights = fit_sentences(words, documents, pdf["label"].tolist())
        return pd.DataFrame({"word": list(weights), "weight": list(weights.values())})

    found = sentence_rows(sample, words).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(learn, "word string, weight double").collect()
    return {r["word"]: r["weight"] for r in found}


def _score(texts: list[str], weights: dict[str, float]) -> dict:
    scores, spans = [], []
    base = 1 / (1 + np.exp(-weights[""])) if weights else 0.0
    known = weights.keys() - {""}
    for text in texts:
        parts, quiet = [], 0
        for start, end, words in sentences(text):
            hit = signs(words) & known
            if hit:
                parts.append((start, end, 1 / (1 + np.exp(-(weights[""] + sum(weights[w] for w in sorted(hit)))))))
            else:
                quiet += 1
        rest = np.prod([1 - p for _, _, p in parts]) * (1 - base) ** (quiet + (not parts and not quiet))
        scores.append(float(np.clip(1 - rest, 0, 1)))
        spans.append(",".join(f"{s}:{e}" for s, e, p in parts if p >= 0.5))
    return {"score": scores, "offending": spans}


def score_documents(docs: DataFrame, weights: dict[str, float], keep: list[str] | None = None) -> DataFrame:
    """`docs` with score and offending, the spans (start:end) of sentences with a score of 0.5 or more."""
    spread = docs.sparkSession.sparkContext.broadcast(weights)
    return add_columns(docs, "score double, offending string", lambda texts: _score(texts, spread.value), keep)


def classify(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, offending of every document; rows of fold `held` of `parts` teach nothing."""
    held_out = fold("doc_id", parts) == held
    weights = fit(docs, labels, ~held_out)
    scored = score_documents(docs.select("doc_id", "text"), weights, ["doc_id"])
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted, "offending")
