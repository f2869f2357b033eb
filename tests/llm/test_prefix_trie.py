"""The conversation trie against a brute-force version, with segments and blocks so small that everything lies on a border."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from harvestline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, parent string, key string, words string, part string"


def _rows():
    rng = random.Random(5)
    rows = []
    for c in [*range(80), -3, 1000]:
        if rng.random() < 0.1:
            continue
        said = [(rng.choice(["user", "bot", None]), rng.choice(["a b", "c\t d  e", "", None, "xx yy zz"])) for _ in range(rng.choice([1, 2, 3, 5, 9, 14]))]
        if rng.random() < 0.3:
            said = [("user", "a b")] * rng.choice([4, 8, 9, 12])
        rows += [(c, rng.choice([i, i, i, None, 3]), role, text) for i, (role, text) in enumerate(said)]
    rows += [(200 + k, i, "u", f"t {i // 3}") for k in (0, 1, 5) for i in range(30 - k)]
    rows += [(207, 0, "u", "long " * 50_000)]
    return rows + rows[:7] + [(None, 1, "user", "no id")]


def _brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0), key, (role, text)))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    base = lambda c: c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
    paths = {c: own.get(base(c), [])[: zlib.crc32(str(c).encode()) % 4] + ts[zlib.crc32(str(c).encode()) % 4 :] for c, ts in own.items()}
    members, kids, leaves, saved = defaultdict(set), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p in members:
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members[p]) - 1) * words
            leaves[p[:d]] += not kids[p]
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(paths[c]) == len(p))))
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()),
        key=str,
    )


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in _rows()], SCHEMA).repartition(5)


@pytest.mark.parametrize(("length", "block"), [(64, 100_000), (4, 7), (3, 1)])
def test_trie(table, length, block):
    got = prefix_trie.trie(*prefix_trie.rebuilt(table), length, block).collect()
    assert sorted(map(tuple, got), key=str) == _brute(_rows())


def test_no_conversations(table):
    assert prefix_trie.conversation_trie(table.limit(0)).collect() == []
    assert prefix_trie.conversation_trie(table.where("conv_id IS NULL")).collect() == []


def test_search_tree_is_balanced_and_in_order():
    tree = prefix_trie.Tree()
    for i in prefix_trie.medians(1000):
        tree.insert([i])
    order = tree.traversal()
    assert [tree.turn[a] for a in order] == [-1, *range(1000)]
    deepest, open_nodes = 0, [tree.equal[0]]
    while open_nodes:
        deepest += 1
        open_nodes = [b for a in open_nodes for b in (tree.low[a], tree.high[a]) if b]
    assert deepest == 10
