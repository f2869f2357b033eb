"""The divergence audit against a brute-force version: whole rows, and the sorted slices on their own."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from harvestline.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.mark.parametrize("small", [4, 50, 1 << 16])
def test_slices(small, monkeypatch):
    rng = random.Random(small)
    texts = ["".join(rng.choice("abcXYZéß漢 .,1 ") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["", "Abc" * 6 + " " + "abc" * 6 + " " + "abc" * 5 + "abd", "abcdefgh abcdefgh abcdefghi", "x"] * 2
    groups = np.array([rng.randint(0, 3) for _ in texts])
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"zz" + b"".join(parts) + b"qq", np.uint8)
    monkeypatch.setattr(divergence.quicksorted, "__defaults__", (small,))
    terms, owner, frequency, n = divergence.counted(data, 2 + np.r_[0, np.cumsum([len(x) for x in parts])], groups)
    count, holders = Counter(), defaultdict(set)
    for i, text in enumerate(texts):
        for w in _terms(text):
            count[w, int(groups[i])] += 1
            holders[w, int(groups[i])].add(i)
    assert sorted(zip(terms.to_pylist(), owner.tolist(), frequency.tolist(), n.tolist())) == sorted((*k, len(holders[k]), c) for k, c in count.items())


def _brute(rows, least, top):
    documents = [((t or ""), (la or ""), (s or "")) for _, t, la, s, *_ in rows]
    holders, count = defaultdict(int), Counter()
    for text, lang, source in documents:
        words = _terms(text)
        for w in set(words):
            holders[lang, w] += 1
        for w in words:
            count[lang, source, w] += 1
    out = []
    for lang in {d[1] for d in documents}:
        sources = sorted({d[2] for d in documents if d[1] == lang})
        terms = sorted(w for (la, w), n in holders.items() if la == lang and n >= least)
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(terms))
        n = {s: [count[lang, s, w] for w in terms] for s in sources}
        p = {s: [share(x, sum(n[s])) for x in n[s]] for s in sources}
        both = [sum(n[s][i] for s in sources) for i in range(len(terms))]
        q = [share(x, sum(both)) for x in both]
        for s in sources:
            pairs = [(-sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in sources if o != s]
            over = [(b - a, w) for w, a, b, c in zip(terms, p[s], q, n[s]) if c and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "side"), [(3, 5, 64), (8, 50, 2), (10**6, 5, 2)])
def test_audit(odd, odd_rows, monkeypatch, least, top, side):
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "TERMS", 16)
    got = divergence.audit(odd, least, top)
    assert sorted(map(tuple, got.collect())) == _brute(odd_rows, least, top)


def test_no_documents(nothing):
    assert divergence.audit(nothing).collect() == []
