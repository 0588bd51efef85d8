"""Byte automata: patterns are put together from the constructors below, determinised together and minimised.

``search_tables`` gives one automaton that reports, at every byte, which of the patterns end there; ``reversed_tables`` gives
the automaton that, read backwards from an end, finds where a pattern can begin.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def chars(*parts: str) -> tuple:
    """Any byte of the given strings; ``"a-z"`` (three characters with a hyphen in the middle) is a range."""
    out: set[int] = set()
    for p in parts:
        out |= set(range(ord(p[0]), ord(p[2]) + 1)) if len(p) == 3 and p[1] == "-" else {ord(c) for c in p}
    return ("set", frozenset(out))


def seq(*parts: tuple) -> tuple:
    return ("seq", parts)


def alt(*parts: tuple) -> tuple:
    return ("alt", parts)


def star(part: tuple) -> tuple:
    return ("star", part)


def plus(part: tuple) -> tuple:
    return seq(part, star(part))


def maybe(part: tuple) -> tuple:
    return alt(part, seq())


def at_least(n: int, part: tuple) -> tuple:
    return seq(*[part] * n, star(part))


def word(text: str, either_case: bool = False) -> tuple:
    return seq(*[chars(c.lower() + c.upper()) if either_case else chars(c) for c in text])


def backwards(p: tuple) -> tuple:
    if p[0] == "set":
        return p
    if p[0] == "star":
        return star(backwards(p[1]))
    parts = [backwards(x) for x in p[1]]
    return (p[0], tuple(parts[::-1] if p[0] == "seq" else parts))


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.on: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append([])
        return len(self.free) - 1

    def add(self, p: tuple, start: int) -> int:
        """Adds ``p`` after ``start``; the state where it ends."""
        if p[0] == "set":
            end = self.state()
            self.on[start].append((p[1], end))
            return end
        if p[0] == "seq":
            for x in p[1]:
                start = self.add(x, start)
            return start
        inner, end = self.state(), self.state()
        self.free[start].append(inner)
        if p[0] == "star":
            self.free[self.add(p[1], inner)] += [inner, end]
            self.free[start].append(end)
        else:
            for x in p[1]:
                self.free[self.add(x, inner)].append(end)
        return end

    def closed(self, states: Iterable[int]) -> frozenset:
        seen, todo = set(), list(states)
        while todo:
            if (s := todo.pop()) not in seen:
                seen.add(s)
                todo += self.free[s]
        return frozenset(seen)


def _flag_type(n: int) -> type:
    """The smallest type with a bit for each pattern."""
    if n > 64:
        raise ValueError(f"{n} patterns; an automaton holds at most 64")
    return next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if n <= np.iinfo(t).bits)


def tables(patterns: list[tuple], search: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(moves, ends)``: ``moves[state, byte]`` is the next state, bit ``k`` of ``ends[state]`` tells that pattern ``k`` ends there.

    State 0 is the start. With ``search`` a pattern may begin at any byte; otherwise only at the first.
    """
    flags = _flag_type(len(patterns))
    nfa = _Nfa()
    begin = nfa.state()
    final: dict[int, int] = {}
    for k, p in enumerate(patterns):
        s = nfa.state()
        nfa.free[begin].append(s)
        e = nfa.add(p, s)
        final[e] = final.get(e, 0) | 1 << k
    # Bytes that no pattern tells apart share a column.
    sets = sorted({frozenset(b) for row in nfa.on for b, _ in row}, key=sorted)
    inside = np.array([[b in x for x in sets] for b in range(256)])
    column = np.unique(inside, axis=0, return_inverse=True)[1].reshape(-1)
    members = {x: sorted({int(column[b]) for b in x}) for x in sets}
    # Subset construction.
    first = nfa.closed([begin])
    number, rows, todo = {first: 0}, [], [first]
    closures: dict[int, frozenset] = {}
    for states in todo:
        to: list[set[int]] = [set(first) if search else set() for _ in range(column.max() + 1)]
        for s in states:
            for byte_set, t in nfa.on[s]:
                if t not in closures:
                    closures[t] = nfa.closed([t])
                for c in members[byte_set]:
                    to[c] |= closures[t]
        row = []
        for key in map(frozenset, to):
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            row.append(number[key])
        rows.append(row)
    moves = np.array(rows)[:, column]
    ends = np.array([sum({final[s] for s in states if s in final}) for states in todo], np.uint64)
    # Minimisation by refinement: states stay together while they end the same patterns and move to states that are together.
    block = np.unique(ends, return_inverse=True)[1]
    distinct = np.unique(column, return_index=True)[1]
    while True:
        refined = np.unique(np.column_stack([block, block[moves[:, distinct]]]), axis=0, return_inverse=True)[1].reshape(-1)
        if refined.max() == block.max():
            break
        block = refined
    order = np.full(block.max() + 1, -1)
    n = 0
    for b in block:
        if order[b] < 0:
            order[b], n = n, n + 1
    block = order[block]
    small_moves, small_ends = np.zeros((n, 256), np.int32), np.zeros(n, flags)
    small_moves[block], small_ends[block] = block[moves], ends
    return small_moves, small_ends


class Scanner:
    """Scans many texts in step: one table lookup advances every text by one byte.

    Texts are cut after bytes from which every state returns to the start, so long texts are scanned in parallel too.
    """

    def __init__(self, patterns: list[tuple], search: bool = True):
        moves, self.ends = tables(patterns, search)
        # Bytes that move all states alike share a column.
        columns, self.kind = np.unique(moves, axis=1, return_inverse=True)
        self.kind = self.kind.reshape(-1).astype(np.uint8)
        self.width = columns.shape[1]
        self.moves = (columns * self.width).astype(np.int32).reshape(-1)
        self.resets = (moves == 0).all(axis=0)

    def flags(self, buf: np.ndarray, offsets: np.ndarray, stride: int = 512) -> np.ndarray:
        """For each byte, the patterns that end there."""
        resets = np.flatnonzero(self.resets[buf])
        cuts = resets[np.unique(resets // stride, return_index=True)[1]] + 1
        at = np.unique(np.concatenate([offsets, cuts, [0, len(buf)]]))
        starts, lengths = at[:-1], np.diff(at)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        kinds, out = self.kind[buf], np.zeros(len(buf), self.ends.dtype)
        state = np.zeros(len(starts), np.int32)
        ends = np.repeat(self.ends, self.width)
        longest = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(longest), "left")
        for t in range(longest):
            n = active[t]
            i = starts[:n] + t
            state = self.moves[state[:n] + kinds[i]]
            out[i] = ends[state]
        return out
