"""Secret scan: all rules as one minimised automaton, read over whole texts in a single byte pass.

The pass runs from the end of the text, so that a state that accepts marks a byte where a match begins;
from a marked byte the rule's own forward automaton gives the end of the longest match.  Matches of a
rule are taken from the left and do not overlap; a match that fails its rule's length check is dropped, but the bytes it
took stay taken.  Positions are code points.

Defined cases: null text is empty, an empty text has no spans; repeated rows and repeated or null doc_ids are rows of
their own; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from harvestline.llm.automaton import BackwardScan, compile_automaton
from harvestline.llm.common import add_columns, keeping_columns

# A private key: its header, then headers within, base64 and line ends (also written as \\n) up to the END line; without one, the lines that are wholly base64.
_HEADER = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
_END_OF_LINE = r"(\r|\n|\\r|\\n)"
_INNER = rf"({_END_OF_LINE}+[A-Za-z0-9-]+:[^\r\n\\]*)*"
_CLOSED = rf"([A-Za-z0-9+/=\x20\t]|{_END_OF_LINE})*-----END [A-Z ]*PRIVATE KEY-----"
_OPEN = rf"({_END_OF_LINE}+[\x20\t]*[A-Za-z0-9+/=]{{16,}})*"
_KEY = f"{_HEADER}{_INNER}({_CLOSED}|{_OPEN})"

# The rules as (kind, pattern, either case, group whose length counts, least length of it).
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", False, 0, 16),
    ("hex", r"[0-9a-f]{32,}", False, 0, 32),
    ("private_key", _KEY, False, 0, 0),
    ("github", r"gh[oprsu]_[A-Za-z0-9]{20,}", False, 0, 0),
]
#: Where a rule's matches begin, if a shorter pattern tells: every header begins a key, whatever follows.
BEGINS = {"private_key": _HEADER}
BASE = ("assign", "access", "hex")
FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
MARK = "<secret>"

Span = tuple[str, int, int]


@lru_cache(1)
def _compiled():
    scan = BackwardScan([(BEGINS.get(kind, pattern), fold) for kind, pattern, fold, _, _ in RULES])
    forward = [compile_automaton([(pattern, fold)]) for _, pattern, fold, _, _ in RULES]
    exact = [re.compile(pattern.encode(), re.IGNORECASE if fold else 0) for _, pattern, fold, _, _ in RULES]
    return scan, forward, exact


def _long_enough(rule: int, exact, data: bytes) -> bool:
    _, _, _, group, least = RULES[rule]
    return not least or len(exact[rule].fullmatch(data).group(group)) >= least


def secret_spans(texts: list[str]) -> list[list[Span]]:
    """The spans (kind, start, end) of each text, by start and then in the order of the rules."""
    scan, forward, exact = _compiled()
    coded = [t.encode() for t in texts]
    joined = b"\xff".join(coded)
    positions, masks = scan.starts(np.frombuffer(joined, np.uint8))
    begins = np.cumsum([0, *(len(c) + 1 for c in coded)])
    out: list[list[Span]] = [[] for _ in texts]
    for which in np.unique(np.searchsorted(begins, positions, "right") - 1) if len(positions) else ():
        low, high = np.searchsorted(positions, begins[which : which + 2])
        data, found = coded[which], []
        for rule in range(len(RULES)):
            free = 0
            for at in (positions[low:high][(masks[low:high] >> rule) & 1 == 1] - begins[which]).tolist():
                if at < free:
                    continue
                free = forward[rule].longest(data, at)
                if _long_enough(rule, exact, data[at:free]):
                    found.append((at, rule, free))
        before = points = 0
        for at, rule, end in sorted(found):
            points += len(data[before:at].decode())
            before = at
            out[which].append((RULES[rule][0], points, points + len(data[at:end].decode())))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _digest(texts: list[str]) -> dict:
    spans = secret_spans(texts)
    base = [[s for s in row if s[0] in BASE] for row in spans]
    counts = {f"n_{kind}": [sum(s[0] == kind for s in row) for row in base] for kind in BASE}
    return counts | {
        "base_sha256": [hashlib.sha256(_joined(row).encode()).hexdigest() for row in base],
        "spans": [_joined(row) for row in spans],
    }


def found_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, their digest, and all spans."""
    return add_columns(docs, FIELDS, _digest, ["doc_id"])


def masked(text: str, spans: list[Span]) -> str:
    """The text with `MARK` in place of every span; overlapping spans become one mark."""
    parts, end = [], 0
    for _, start, stop in spans:
        if start >= end:
            parts += [text[end:start], MARK]
        end = max(end, stop)
    return "".join([*parts, text[end:]])


@keeping_columns("text", "n_chars")
def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with its columns, all rows kept, secrets masked and n_chars (where there is one) renewed for changed texts."""

    def compute(texts):
        rows = [masked(t, s) if s else None for t, s in zip(texts, secret_spans(texts))]
        return {"_masked": rows}

    done = add_columns(docs, "_masked string", compute)
    changed = F.col("_masked").isNotNull()
    new = {"text": F.coalesce("_masked", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumns(new).select(*docs.columns)
