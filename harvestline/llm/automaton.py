"""Deterministic automata over bytes for a set of regular expressions.

`compile_automaton` reads each pattern's syntax tree, makes one nondeterministic automaton for all of them,
turns it into a deterministic one by subset construction, and minimises that by refining partitions of states.
The result is a transition array [state, byte class] and an accept mask per state with a bit per pattern.
Patterns may use literals, classes, groups, alternatives and repeats; no anchors, look-around or back references.
"""

from __future__ import annotations

import re._parser as syntax  # the standard library's own reader of pattern syntax
from dataclasses import dataclass

import numpy as np


class _Nfa:
    def __init__(self):
        self.steps: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1


def _either_case(values: set[int]) -> set[int]:
    return values | {v ^ 32 for v in values if 65 <= v <= 90 or 97 <= v <= 122}


def _class(items) -> set[int]:
    out: set[int] = set()
    negate = False
    for kind, value in items:
        if kind is syntax.NEGATE:
            negate = True
        elif kind is syntax.LITERAL:
            out.add(value)
        elif kind is syntax.RANGE:
            out.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"unsupported class item {kind}")
    return set(range(256)) - out if negate else out


def _add(nfa: _Nfa, tree, start: int, fold: bool, backward: bool) -> int:
    """Adds the items of `tree` from state `start`; returns the end state."""
    for kind, value in reversed(list(tree)) if backward else list(tree):
        if kind in (syntax.LITERAL, syntax.IN):
            values = {value} if kind is syntax.LITERAL else _class(value)
            end = nfa.state()
            nfa.steps[start].append((frozenset(_either_case(values) if fold else values), end))
        elif kind is syntax.SUBPATTERN:
            end = _add(nfa, value[-1], start, fold, backward)
        elif kind is syntax.BRANCH:
            end = nfa.state()
            for option in value[1]:
                nfa.free[_add(nfa, option, start, fold, backward)].append(end)
        elif kind in (syntax.MAX_REPEAT,):
            low, high, inner = value
            end = start
            for _ in range(low):
                end = _add(nfa, inner, end, fold, backward)
            if high is syntax.MAXREPEAT:
                loop, out = nfa.state(), nfa.state()
                nfa.free[end].append(loop)
                nfa.free[loop].append(out)
                nfa.free[_add(nfa, inner, loop, fold, backward)].append(loop)
                end = out
            else:
                out = nfa.state()
                nfa.free[end].append(out)
                for _ in range(high - low):
                    end = _add(nfa, inner, end, fold, backward)
                    nfa.free[end].append(out)
                end = out
        else:
            raise ValueError(f"unsupported pattern item {kind}")
        start = end
    return start


@dataclass
class Automaton:
    classes: np.ndarray  # class of each byte
    moves: np.ndarray  # [state, class] -> state; state 0 is the start
    accepts: np.ndarray  # per state, a bit for each pattern that ends there
    dead: int  # a state that nothing leaves, or -1

    def longest(self, data: bytes, start: int) -> int:
        """End of the longest match that begins at `start`, or -1 (for automata that are not `anywhere`)."""
        state, end = 0, -1
        moves, classes, accepts = self._lists()
        for i in range(start, len(data)):
            state = moves[state][classes[data[i]]]
            if state == self.dead:
                break
            if accepts[state]:
                end = i + 1
        return end

    def _lists(self):
        if not hasattr(self, "_cached"):
            self._cached = self.moves.tolist(), self.classes.tolist(), self.accepts.tolist()
        return self._cached


def compile_automaton(patterns: list[tuple[str, bool]], backward: bool = False, anywhere: bool = False) -> Automaton:
    """One automaton for (pattern, either case) pairs; `backward` reads the text from its end; `anywhere` lets matches begin at each byte."""
    nfa = _Nfa()
    root = nfa.state()
    final: dict[int, int] = {}
    for bit, (pattern, fold) in enumerate(patterns):
        start = nfa.state()
        nfa.free[root].append(start)
        final[_add(nfa, syntax.parse(pattern), start, fold, backward)] = 1 << bit
    if anywhere:
        nfa.steps[root].append((frozenset(range(256)), root))

    sets = {values for state in nfa.steps for values, _ in state}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    names = {v: i for i, v in enumerate(dict.fromkeys(signature))}
    classes = np.array([names[v] for v in signature], np.int64)
    byte_of = [signature.index(v) for v in names]

    def closure(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in nfa.free[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(s for s in seen if nfa.steps[s] or s in final)

    start = closure({root})
    number, todo, moves = {start: 0}, [start], []
    while todo:
        states = todo.pop(0)
        row = []
        for byte in byte_of:
            target = closure({end for s in states for values, end in nfa.steps[s] if byte in values})
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        moves.append(row)
    table = np.array(moves, np.int64)
    accepts = np.array([sum({final[s] for s in states if s in final}) for states in number], np.int64)

    # States stay together while they accept alike and move to the same blocks.
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.concatenate([block[:, None], block[table]], axis=1), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = list(dict.fromkeys([int(block[0]), *block.tolist()]))
    first = [int(np.flatnonzero(block == b)[0]) for b in order]
    renumber = np.empty(len(order), np.int64)
    renumber[order] = np.arange(len(order))
    small, accept = renumber[block[table[first]]], accepts[first]
    dead = [i for i in range(len(small)) if not accept[i] and (small[i] == i).all()]
    return Automaton(classes, small, accept, dead[0] if dead and not anywhere else -1)


_SEPARATOR = 255  # not in any UTF-8 text
_LANE = 512
_FEW = 24


class BackwardScan:
    """Marks, in one pass from the end, every byte at which some pattern's match begins.

    Texts stand in one buffer with separators between them.  The buffer is cut at reset bytes, after
    which the automaton is in its start state whatever came before; the pieces are read in step, one gather per byte,
    and once few long pieces are left, these are read one after the other.
    """

    def __init__(self, patterns: list[tuple[str, bool]]):
        automaton = compile_automaton(patterns, backward=True, anywhere=True)
        width = automaton.moves.shape[1]
        order = np.argsort(automaton.accepts != 0, kind="stable")  # accepting states last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.width, self.start = width, int(place[0])
        self.moves = place[automaton.moves[order]].astype(np.int32)
        self.accepts = automaton.accepts[order]
        self.first = int((self.accepts == 0).sum())
        self.classes = automaton.classes.astype(np.int32)
        reset = (self.moves == self.start).all(axis=0)
        self.resets = reset[self.classes]
        if not self.resets[_SEPARATOR]:
            raise ValueError("a pattern takes a byte that UTF-8 does not use")
        self.flat = (self.moves * width).reshape(-1).astype(np.int32)  # the next state's row
        self.rows = self.moves.tolist()

    def starts(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions, ascending, and the masks of the patterns that match from there."""
        codes = self.classes[buffer]
        cuts = np.flatnonzero(self.resets[buffer])
        if len(cuts):
            wanted = np.searchsorted(cuts, np.arange(0, len(buffer), _LANE))
            cuts = np.unique(cuts[wanted[wanted < len(cuts)]])
        lows = np.concatenate([[0], cuts])
        highs = np.append(cuts, len(buffer))
        longest_first = np.argsort(lows - highs, kind="stable")
        lows, highs = lows[longest_first], highs[longest_first]
        sizes = highs - lows
        state = np.full(len(lows), self.start * self.width, np.int32)
        at, masks = [], []
        bar, step, alive = self.first * self.width, 0, len(lows)
        falling = -sizes
        while True:
            alive = int(np.searchsorted(falling, -step, "left"))  # pieces with more than `step` bytes
            if alive <= _FEW:
                break
            position = highs[:alive] - 1 - step
            state[:alive] = self.flat[state[:alive] + codes[position]]
            hit = np.flatnonzero(state[:alive] >= bar)
            if len(hit):
                at.append(position[hit])
                masks.append(self.accepts[state[hit] // self.width])
            step += 1
        for lane in range(alive):
            now = int(state[lane]) // self.width
            low = int(lows[lane])
            piece = codes[low : highs[lane] - step][::-1].tolist()
            last = int(highs[lane]) - step - 1
            for i, code in enumerate(piece):
                now = self.rows[now][code]
                if now >= self.first:
                    at.append(np.array([last - i]))
                    masks.append(self.accepts[now : now + 1])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        positions, masks = np.concatenate(at), np.concatenate(masks)
        order = np.argsort(positions)
        return positions[order], masks[order]
