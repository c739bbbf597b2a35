"""Byte regexes compiled together into one deterministic automaton.

Patterns (literals, classes, groups, alternation, ?, *, +, {m}, {m,}, {m,n}) become position automata; subset
construction makes them one deterministic automaton that starts anew at each byte, and partition refinement
makes that minimal. Bytes that no pattern tells apart share a column of the transition array.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

REPEAT = re.compile(r"\{(\d+)(,?)(\d*)\}")


class _Positions:
    """Glushkov's construction: positions carry byte sets (as 256-bit ints), follow sets are bit masks of positions."""

    def __init__(self, pattern: str, fold: bool) -> None:
        self.p, self.at, self.fold = pattern, 0, fold
        self.bytes: list[int] = []
        self.follow: list[int] = []
        self.null, self.first, self.last = self.alternatives()
        if self.at != len(pattern):
            raise ValueError(f"{pattern!r}: unexpected {pattern[self.at]!r}")

    def alternatives(self):
        out = self.sequence()
        while self.at < len(self.p) and self.p[self.at] == "|":
            self.at += 1
            b = self.sequence()
            out = (out[0] or b[0], out[1] | b[1], out[2] | b[2])
        return out

    def sequence(self):
        out = (True, 0, 0)
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            out = self.joined(out, self.repeated())
        return out

    def joined(self, a, b):
        for i in _ones(a[2]):
            self.follow[i] |= b[1]
        return (a[0] and b[0], a[1] | (b[1] if a[0] else 0), b[2] | (a[2] if b[0] else 0))

    def repeated(self):
        begin = self.at
        x = self.atom()
        end = self.at
        least, most = 1, 1
        if self.at < len(self.p):
            if (c := self.p[self.at]) in "?*+":
                self.at += 1
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            elif m := REPEAT.match(self.p, self.at):
                self.at = m.end()
                least, most = int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1])
        after = self.at

        def again():
            self.at = begin
            y = self.atom()
            assert self.at == end
            return y

        out, copies = x, 1
        if most is None:
            for _ in range(least - 1):
                x = again()
                out = self.joined(out, x)
            for i in _ones(x[2]):  # the last copy repeats
                self.follow[i] |= x[1]
        else:
            while copies < max(most, 1):
                x = again()
                copies += 1
                out = self.joined(out, (x[0] or copies > least, x[1], x[2]))
        self.at = after
        return (True, out[1], out[2]) if least == 0 else out

    def atom(self):
        c = self.p[self.at]
        if c == "(":
            self.at += 1
            if self.p.startswith("?:", self.at):
                self.at += 2
            x = self.alternatives()
            if self.p[self.at : self.at + 1] != ")":
                raise ValueError(f"{self.p!r}: a group is open")
            self.at += 1
            return x
        return self.position(self.one())

    def position(self, found: int):
        if self.fold:
            for lo in range(97, 123):
                if found >> lo & 1 or found >> (lo - 32) & 1:
                    found |= 1 << lo | 1 << (lo - 32)
        self.bytes.append(found)
        self.follow.append(0)
        bit = 1 << (len(self.bytes) - 1)
        return (False, bit, bit)

    def char(self) -> int:
        c = self.p[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.p[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "r": "\r", "t": "\t"}.get(c, c))

    def one(self) -> int:
        if self.p[self.at] == ".":
            self.at += 1
            return (1 << 256) - 1 - (1 << 10)
        if self.p[self.at] != "[":
            return 1 << self.char()
        self.at += 1
        negated = self.p[self.at] == "^"
        self.at += negated
        found, empty = 0, True
        while self.p[self.at] != "]" or empty:
            empty = False
            lo = hi = self.char()
            if self.p[self.at] == "-" and self.p[self.at + 1] != "]":
                self.at += 1
                hi = self.char()
            found |= (1 << (hi + 1)) - (1 << lo)
        self.at += 1
        return (1 << 256) - 1 - found if negated else found


def _ones(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


@dataclass(frozen=True)
class Automaton:
    """columns: a column for each byte; table: states by columns; accepts: for each state the patterns that end there.

    States that accept come last, from the number `accepting` on; state 0 is the start.
    """

    columns: bytes
    table: np.ndarray
    accepts: tuple[tuple[int, ...], ...]
    accepting: int


def compile_patterns(patterns: list[tuple[str, bool]], anchored: bool = False, backwards: bool = False) -> Automaton:
    """One minimal automaton of all patterns; (pattern, fold): fold takes letters A-Z and a-z alike.

    Unless anchored, matches may start at each byte. backwards: the patterns are read from their ends. Each pattern's
    subsets are built and made minimal first, then the reachable combinations of their states, which are made minimal again.
    """
    parts = [_single(p, fold, anchored, backwards) for p, fold in patterns]
    kinds: dict[tuple, int] = {}
    columns = bytes(kinds.setdefault(tuple(cols[b] for cols, _, _ in parts), len(kinds)) for b in range(256))
    tables = [[[row[c] for c in by] for row in table] for (_, table, _), by in zip(parts, zip(*kinds, strict=True), strict=True)]
    number: dict[tuple, int] = {(0,) * len(parts): 0}
    todo, rows = list(number), []
    for state in todo:
        row = []
        for new in zip(*(t[s] for t, s in zip(tables, state, strict=True)), strict=True):
            if new not in number:
                number[new] = len(number)
                todo.append(new)
            row.append(number[new])
        rows.append(row)
    accepts = [tuple(n for n, s in enumerate(state) if parts[n][2][s]) for state in todo]
    table, accepts = _minimal(rows, accepts)
    order = sorted(range(len(table)), key=lambda s: (bool(accepts[s]), s))
    place = np.empty(len(table), np.int32)
    place[order] = np.arange(len(table), dtype=np.int32)
    acc = tuple(accepts[s] for s in order)
    return Automaton(columns, place[np.array(table, np.int32)[order]], acc, next((i for i, a in enumerate(acc) if a), len(acc)))


def _single(pattern: str, fold: bool, anchored: bool, backwards: bool) -> tuple[bytes, list[list[int]], list]:
    """Columns, minimal table and accepting flags of one pattern, by subset construction; state 0 is the start."""
    g = _Positions(pattern, fold)
    follow, first, last = g.follow, g.first, g.last
    if backwards:
        back = [0] * len(follow)
        for i, mask in enumerate(follow):
            for j in _ones(mask):
                back[j] |= 1 << i
        follow, first, last = back, last, first
    sets = sorted(set(g.bytes))
    kinds: dict[tuple, int] = {}
    columns = bytes(kinds.setdefault(tuple(s >> b & 1 for s in sets), len(kinds)) for b in range(256))
    takes = [0] * len(kinds)
    for b in range(256):
        for i, s in enumerate(g.bytes):
            if s >> b & 1:
                takes[columns[b]] |= 1 << i
    number: dict[tuple[int, bool], int] = {(0, True): 0}
    todo, rows = [(0, True)], []
    for state, begin in todo:
        may = first if begin or not anchored else 0
        for i in _ones(state):
            may |= follow[i]
        row = []
        for t in takes:
            new = (may & t, False)
            if new not in number:
                number[new] = len(number)
                todo.append(new)
            row.append(number[new])
        rows.append(row)
    return columns, *_minimal(rows, [bool(state & last) or begin and g.null for state, begin in todo])


def _minimal(rows: list[list[int]], accepts: list) -> tuple[list[list[int]], list]:
    """The same automaton with equal states merged, by refining blocks until states of a block go to the same blocks."""
    kind = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    block, count = np.array([kind[a] for a in accepts], np.int32), len(kind)
    table = np.array(rows, np.int32)
    while True:
        seen: dict[bytes, int] = {}
        block = np.array([seen.setdefault(x.tobytes(), len(seen)) for x in np.column_stack([block, block[table]])], np.int32)
        if len(seen) == count:
            break
        count = len(seen)
    _, rep = np.unique(block, return_index=True)  # blocks are numbered by first state, so the start stays 0
    return block[table[rep]].tolist(), [accepts[r] for r in rep]
