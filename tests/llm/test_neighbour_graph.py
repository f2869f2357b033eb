"""The graph of near-duplicate vectors against brute force, with lists so short that groups outgrow them."""

import numpy as np
import pytest

from harvestline.llm import neighbour_graph

SCHEMA = "vec_id long, embedding array<float>, label int, node string, root string, u string"


def _rows():
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x)
    vectors = [unit(rng.normal(size=16)) for _ in range(80)]
    tight, loose = unit(rng.normal(size=16)), unit(rng.normal(size=16))
    vectors += [unit(tight + 0.03 * rng.normal(size=16)) for _ in range(30)]
    vectors += [unit(loose + 0.11 * rng.normal(size=16)) for _ in range(40)]  # a group with pairs on both sides of the threshold
    vectors += [vectors[0] + 0.02 * rng.normal(size=16), vectors[1] * 3, vectors[1] * 3, vectors[85], vectors[85]]
    rows = [(7 * i % 211, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, rows[3][1][:8], [3e38] * 16, [1e-38] * 16]
    return rows + [(300 + i, v) for i, v in enumerate(odd)] + [rows[2], rows[2], (None, rows[2][1])]


def _brute(rows):
    sound = [i is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    x = np.array([np.pad(np.array(v, np.float32).astype(float), (0, 16 - len(v))) if ok else np.zeros(16) for (_, v), ok in zip(rows, sound)])
    norm = np.linalg.norm(x, axis=1)
    near = x @ x.T / np.maximum(np.outer(norm, norm), 1e-300) >= 0.9
    near &= np.outer(sound, sound) & ~np.eye(len(rows), dtype=bool)
    least = [i for i, _ in rows]
    for _ in rows:
        for a, b in zip(*np.nonzero(near)):
            least[a] = least[b] = min(least[a], least[b])
    return sorted(((i, int(near[k].sum()), least[k], i is not None and i == least[k]) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("longest", "block", "part"), [(64, 512, 4096), (8, 7, 9)])
def test_links(spark, monkeypatch, longest, block, part):
    monkeypatch.setattr(neighbour_graph, "LONGEST", longest)
    monkeypatch.setattr(neighbour_graph, "BLOCK", block)
    monkeypatch.setattr(neighbour_graph, "PART", part)
    rows = _rows()
    table = spark.createDataFrame([(i, v, 1, "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)
    got, recall = neighbour_graph.neighbours(table, list_size=4)
    assert recall == 1.0
    assert sorted(map(tuple, got.collect()), key=str) == _brute(rows)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neighbour_graph.near_duplicates(empty).collect() == []
    alone = spark.createDataFrame([(1, None, 1, "x", "x", "x"), (2, [0.0], 1, "x", "x", "x")], SCHEMA)
    assert sorted(map(tuple, neighbour_graph.near_duplicates(alone).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
