"""Exact top-k by inner product: a Voronoi join of query groups with the data that can hold their nearest rows.

Largest inner products become nearest neighbours in one more dimension: with M the greatest norm, each row x gets the
extra component sqrt(M² - |x|²) and each query a zero.  Pivots divide queries and rows into cells.  From
summaries alone (greatest distance of a cell's queries from its pivot, least distances of rows from each pivot, ranges of the distances
between query cells and pivots) comes a bound per cell within which every query has its k rows; a row is sent to a
cell only if no pivot shows it to lie beyond that bound.  Cells are solved in blocks of `QUERY_ROWS` queries against `CHUNKS`
parts of the rows, read as a stream, and the parts' best are merged.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows without an id, take no part; shorter
vectors count as filled up with zeros; rows that share an id
but not the vector are rows of their own, as queries and as candidates, and equal rows count once; ties go to the smaller id, then the lesser vector; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from harvestline.sources.stored import stored

TOP = 5
QUERY_EVERY = 50
PIVOTS = 4
QUERY_ROWS = 4000
CHUNKS = 64
SCALE = 256


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the integer components as an array of long; rows that take no part are left out."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound).select(F.col("vec_id").cast("long"), whole.alias("v"))


def _rows(column, width: int) -> np.ndarray:
    """Arrow lists as a matrix, filled up with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class _Space:
    """Pivots, and distances to them in the dimension that has the extra component."""

    def __init__(self, pivots: np.ndarray, greatest: float):
        self.pivots, self.greatest = pivots.astype(float), greatest
        self.extra = np.sqrt(np.maximum(greatest - (self.pivots**2).sum(axis=1), 0))

    def distances(self, rows: np.ndarray, query: bool) -> np.ndarray:
        x = rows.astype(float)
        norm = (x**2).sum(axis=1)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.greatest - norm, 0))
        square = (norm + extra**2)[:, None] + self.greatest - 2 * (x @ self.pivots.T + extra[:, None] * self.extra)
        return np.sqrt(np.maximum(square, 0))


def _summaries(rows: DataFrame, space: _Space, width: int, every: int, keep: int) -> pd.DataFrame:
    """Per part of the table: query cells with their numbers and ranges of distances; the least distances of rows from each pivot."""
    n = len(space.pivots)

    def work(batches):
        least = np.zeros((0, n))
        low, high, count = np.full((n, n), np.inf), np.full((n, n), -np.inf), np.zeros(n, np.int64)
        for batch in batches:
            ids, x = np.asarray(batch.column("own")), _rows(batch.column("v"), width)
            least = np.sort(np.concatenate([least, space.distances(x, False)]), axis=0)[:keep]
            asked = ids % every == 0
            d = space.distances(x[asked], True)
            cell = d.argmin(axis=1)
            for c in np.unique(cell):
                low[c] = np.minimum(low[c], d[cell == c].min(axis=0))
                high[c] = np.maximum(high[c], d[cell == c].max(axis=0))
                count[c] += (cell == c).sum()
        for c in range(n):
            yield pa.RecordBatch.from_pydict({"cell": [c], "queries": [int(count[c])], "low": [low[c].tolist()], "high": [high[c].tolist()], "least": [least[:, c].tolist()]})

    schema = "cell long, queries long, low array<double>, high array<double>, least array<double>"
    parts = rows.mapInArrow(work, schema)

    def merge(pdf):
        near = np.sort(np.concatenate(pdf["least"].to_list()))[:keep]
        return pd.DataFrame({
            "cell": pdf["cell"].iloc[:1],
            "queries": [int(pdf["queries"].sum())],
            "low": [np.min(np.stack(pdf["low"].to_list()), axis=0).tolist()],
            "high": [np.max(np.stack(pdf["high"].to_list()), axis=0).tolist()],
            "least": [near.tolist()],
        })

    return parts.groupBy("cell").applyInPandas(merge, schema).orderBy("cell").toPandas()


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best columns of each row, ties to the smaller id; -1 marks no candidate."""
    if scores.shape[1] > k:
        bar = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    else:
        bar = np.full(len(scores), np.iinfo(np.int64).min)
    query, at = np.nonzero(scores >= bar[:, None])
    value, name = scores[query, at], ids[at]
    order = np.lexsort((name, -value, query))
    query, name, value = query[order], name[order], value[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    near = place < k
    return query[near], name[near], value[near]


_NONE = np.iinfo(np.int64).min


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where every sum stays below 2^53."""
    bound = np.abs(queries).max(initial=0).astype(float) * np.abs(rows).max(initial=0) * queries.shape[1]
    if bound < 2**24:
        return (queries.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    return queries @ rows.T


def _solve(units: DataFrame, width: int, k: int) -> DataFrame:
    """The k best rows of each query in each unit; a unit's queries come before its rows."""

    def work(batches):
        unit, names, queries = None, np.zeros(0, np.int64), np.zeros((0, width), np.int64)
        best: list = []

        def merged():
            if not best:
                return
            q, i, s = (np.concatenate(x) for x in zip(*best))
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            near = np.arange(len(q)) - np.searchsorted(q, q) < k
            best[:] = [(q[near], i[near], s[near])]

        def result():
            merged()
            if best:
                q, i, s = best[0]
                yield pa.RecordBatch.from_pydict({"query_id": names[q], "vec_id": i, "score": s})

        for batch in batches:
            which = np.asarray(batch.column("unit"))
            cuts = np.flatnonzero(np.diff(which)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(which)]):
                if unit != which[start]:
                    yield from result()
                    unit, best = which[start], []
                    names, queries = np.zeros(0, np.int64), np.zeros((0, width), np.int64)
                ids = np.asarray(batch.column("vec_id"))[start:end]
                rows = _rows(batch.column("v").slice(start, end - start), width)
                asked = np.asarray(batch.column("asked").slice(start, end - start))
                names, queries = np.concatenate([names, ids[asked]]), np.concatenate([queries, rows[asked]])
                ids, rows = ids[~asked], rows[~asked]
                for low in range(0, len(ids) if len(names) else 0, 2048):
                    part = ids[low : low + 2048]
                    scores = _products(queries, rows[low : low + 2048])
                    scores[names[:, None] == part[None, :]] = _NONE
                    q, i, s = _best(scores, part, k)
                    best.append((q[s > _NONE], i[s > _NONE], s[s > _NONE]))
                    if len(best) > 8:
                        merged()
        yield from result()

    return units.mapInArrow(work, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = QUERY_EVERY, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    # `vec_id` is the place of the row by id and vector from here on, `own` its id.
    rows = quantized(vectors).distinct().orderBy("vec_id", "v")
    rows = stored(rows.select(F.monotonically_increasing_id().alias("vec_id"), F.col("vec_id").alias("own"), "v"), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.max(norm), F.max(F.size("v")), F.sum((F.col("own") % every == 0).cast("long"))).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if facts[0] is None or not facts[2]:
        return spark.createDataFrame([], empty)
    greatest, width, asked = float(facts[0]), int(facts[1]), int(facts[2])
    n = max(PIVOTS, -(-asked // QUERY_ROWS))
    picks = rows.orderBy(F.xxhash64("own"), "vec_id").limit(n).collect()
    pivots = np.array([list(p["v"]) + [0] * (width - len(p["v"])) for p in picks], np.int64)
    space = _Space(pivots, greatest)
    cells = _summaries(rows, space, width, every, k + 1)

    # Within `bound[c]` every query of cell c has k rows beside its own.
    between = np.sqrt(np.maximum(2 * greatest - 2 * (space.pivots @ space.pivots.T + np.outer(space.extra, space.extra)), 0))
    low, high = np.stack(cells["low"].to_list()), np.stack(cells["high"].to_list())
    radius = np.array([high[c, c] for c in range(len(pivots))])
    counts = cells["queries"].to_numpy()
    slack = 1e-6 * (1 + np.sqrt(greatest))
    bound = np.full(len(pivots), -np.inf)
    for c in np.flatnonzero(counts):
        reach = np.min([np.pad(np.array(near), (0, k + 1 - len(near)), constant_values=np.inf) + min(high[c, j], radius[c] + between[c, j]) for j, near in enumerate(cells["least"])], axis=0)
        bound[c] = reach.max() + slack
    blocks = -(-counts // QUERY_ROWS)
    first = np.cumsum(blocks) - blocks
    live = np.flatnonzero(counts)

    def deal(batches):
        for batch in batches:
            ids, column = batch.column("vec_id"), batch.column("v")
            names, x = np.asarray(ids), _rows(column, width)
            mixed = (names.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
            chunk = (mixed >> 8) % CHUNKS
            d = space.distances(x, False)
            take, unit = [], []
            for c in live:
                least = np.maximum(d - high[c], low[c] - d).max(axis=1)  # no query of the cell is nearer to the row
                near = np.flatnonzero(least <= bound[c])
                for b in range(first[c], first[c] + blocks[c]):
                    take.append(near)
                    unit.append(b * CHUNKS + chunk[near])
            at = np.concatenate(take)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(unit)), pa.array(np.zeros(len(at), bool)), ids.take(pa.array(at)), column.take(pa.array(at))], names=names_)
            at = np.flatnonzero(np.asarray(batch.column("own")) % every == 0)
            if len(at):
                cell = space.distances(x[at], True).argmin(axis=1)
                block = first[cell] + mixed[at] % blocks[cell]
                unit = (block[:, None] * CHUNKS + np.arange(CHUNKS)).reshape(-1)
                at = pa.array(np.repeat(at, CHUNKS))
                yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(np.ones(len(at), bool)), ids.take(at), column.take(at)], names=names_)

    names_ = ["unit", "asked", "vec_id", "v"]
    dealt = rows.mapInArrow(deal, "unit long, asked boolean, vec_id long, v array<long>")
    units = dealt.repartition("unit").sortWithinPartitions("unit", F.col("asked").desc())
    found = _solve(units, width, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    ids = lambda name: rows.select(F.col("vec_id").alias(name), F.col("own").alias(f"_{name}"))
    best = best.join(ids("query_id"), "query_id").join(ids("vec_id"), "vec_id")
    return best.select(F.col("_query_id").alias("query_id"), "rank", F.col("_vec_id").alias("vec_id"), "score")
