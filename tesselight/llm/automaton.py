"""Regular expressions over bytes as one deterministic automaton.

:func:`compile_rules` parses each rule, joins them into one nondeterministic automaton with a loop
at its start (so that matches may begin anywhere), makes it deterministic by subset construction
over byte classes, minimises it by partition refinement and numbers states so that those which end
a match come last. :meth:`Automaton.scan` runs it over a buffer of texts in one pass.

Syntax: literals, escapes ``\\xHH`` and ``\\.``, classes, groups, ``|``, ``?``, ``*``, ``+``,
``{m}``, ``{m,}``, ``{m,n}`` and ``(?i:...)`` for ASCII letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A byte that no rule may hold; it stands between texts and resets the automaton.
BREAK = 0


class _Parser:
    """Builds an NFA: ``edges[s]`` has (set of bytes, t), ``empty[s]`` has t."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, rule: str, start: int) -> int:
        self.s, self.i = rule, 0
        tree = self._either(False)
        if self.i != len(rule):
            raise ValueError(f"unexpected {rule[self.i]!r} at {self.i} in {rule!r}")
        return self._build(tree, start)

    # a tree is ("set", bytes), ("seq", trees), ("or", trees) or ("rep", tree, least, most)
    def _either(self, fold: bool) -> tuple:
        options = [self._sequence(fold)]
        while self.i < len(self.s) and self.s[self.i] == "|":
            self.i += 1
            options.append(self._sequence(fold))
        return options[0] if len(options) == 1 else ("or", options)

    def _sequence(self, fold: bool) -> tuple:
        items: list[tuple] = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            item = self._atom(fold)
            while self.i < len(self.s) and self.s[self.i] in "?*+{":
                c = self.s[self.i]
                if c == "{":
                    end = self.s.index("}", self.i)
                    low, _, high = self.s[self.i + 1 : end].partition(",")
                    most = int(high) if high else None if "," in self.s[self.i : end] else int(low)
                    item, self.i = ("rep", item, int(low), most), end + 1
                else:
                    item = ("rep", item, int(c == "+"), 1 if c == "?" else None)
                    self.i += 1
            items.append(item)
        return ("seq", items)

    def _atom(self, fold: bool) -> tuple:
        c = self.s[self.i]
        if c == "(":
            if self.s.startswith("(?i:", self.i):
                self.i, fold = self.i + 4, True
            elif self.s.startswith("(?:", self.i):
                self.i += 3
            else:
                self.i += 1
            tree = self._either(fold)
            self.i += 1
            return tree
        if c == "[":
            return ("set", self._class(fold))
        return ("set", self._fold({self._byte()}, fold))

    def _byte(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "\\":
            c = self.s[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def _class(self, fold: bool) -> frozenset[int]:
        self.i += 1
        out: set[int] = set()
        while self.s[self.i] != "]":
            low = high = self._byte()
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                high = self._byte()
            out.update(range(low, high + 1))
        self.i += 1
        return self._fold(out, fold)

    @staticmethod
    def _fold(out: set[int], fold: bool) -> frozenset[int]:
        if fold:
            out = out | {ord(chr(b).swapcase()) for b in out if 65 <= b <= 90 or 97 <= b <= 122}
        return frozenset(out)

    def _build(self, tree: tuple, s: int) -> int:
        kind = tree[0]
        if kind == "set":
            t = self.state()
            self.edges[s].append((tree[1], t))
            return t
        if kind == "seq":
            for x in tree[1]:
                s = self._build(x, s)
            return s
        end = self.state()
        if kind == "or":
            for x in tree[1]:
                self.empty[self._build(x, s)].append(end)
            return end
        _, x, least, most = tree
        for _ in range(least):
            s = self._build(x, s)
        if most is None:
            loop = self.state()
            self.empty[s].append(loop)
            self.empty[self._build(x, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        for _ in range(most - least):
            self.empty[s].append(end)
            s = self._build(x, s)
        self.empty[s].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """``table[state * n_classes + class]`` is the next state times ``n_classes``."""

    classes: np.ndarray  # byte -> class
    table: np.ndarray
    n_classes: int
    start: int
    first_end: int  # states from here on end a match (times n_classes)
    ends: list[frozenset[int]]  # rules that end in each state

    def scan(self, data: np.ndarray, lane: int = 1024, warm: int = 96) -> np.ndarray:
        """Sorted positions in ``data`` after which some rule has matched."""
        return self.reports(data, lane, warm)[0]

    def reports(self, data: np.ndarray, lane: int = 1024, warm: int = 96) -> tuple[np.ndarray, np.ndarray]:
        """Sorted positions in ``data`` after which some rule has matched, and their states' numbers in ``ends``.

        The buffer is cut into lanes that step together. A lane starts ``warm`` bytes early from
        the start state; where its state at its own first byte differs from the state in which the
        lane before ended, it runs again from there, until all agree: the result is that of one
        pass from the first byte to the last.
        """
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = -(-n // lane)
        cls = np.zeros(warm + lanes * lane, self.table.dtype)
        cls[warm:][:n] = self.classes[data]
        cls[:warm] = self.classes[BREAK]
        cls[warm + n :] = self.classes[BREAK]
        steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(cls, (warm + lane, lanes), (cls.itemsize, cls.itemsize * lane)))
        state = np.full(lanes, self.start, self.table.dtype)
        for i in range(warm):
            state += steps[i]
            state = self.table.take(state)
        begun = state.copy()
        begun[0] = self.start
        state = begun.copy()
        hits: list[np.ndarray] = []
        ended = np.empty_like(state)

        def run(which: np.ndarray, state: np.ndarray) -> None:
            sub = steps if len(which) == lanes else np.ascontiguousarray(steps[:, which])
            for i in range(warm, warm + lane):
                state = self.table.take(state + sub[i])
                if state.max() >= self.first_end:
                    at = state >= self.first_end
                    hits.append(np.stack([which[at] * lane + (i - warm), state[at] // self.n_classes]))
            ended[which] = state

        run(np.arange(lanes), state)
        while True:
            wrong = np.flatnonzero(begun[1:] != ended[:-1]) + 1
            if not len(wrong):
                break
            # what these lanes reported stands on a wrong start: only their new run counts
            bad = np.zeros(lanes, bool)
            bad[wrong] = True
            hits[:] = [kept for h in hits if (kept := h[:, ~bad[h[0] // lane]]).size]
            begun[wrong] = ended[wrong - 1]
            run(wrong, begun[wrong])
        found = np.concatenate(hits, axis=1) if hits else np.zeros((2, 0), np.int64)
        found = found[:, np.argsort(found[0], kind="stable")]
        return found[0], found[1]


def compile_rules(rules: list[str]) -> Automaton:
    nfa = _Parser()
    root = nfa.state()
    final: dict[int, int] = {}
    for r, rule in enumerate(rules):
        s = nfa.state()
        nfa.empty[root].append(s)
        final[nfa.add(rule, s)] = r
    # bytes that no edge tells apart share a class
    sets = {b for edges in nfa.edges for b, _ in edges}
    if any(BREAK in b for b in sets):
        raise ValueError("a rule holds the byte that separates texts")
    ordered = sorted(sets, key=sorted)
    seen: dict[tuple, int] = {}
    classes = np.array([seen.setdefault(tuple(b in x for x in ordered), len(seen)) for b in range(256)], np.int64)
    n = len(seen)
    member = [int(np.flatnonzero(classes == c)[0]) for c in range(n)]

    def closure(states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    # subset construction; the root stays in every set: a match may begin anywhere
    start = closure({root})
    number, todo, delta = {start: 0}, [start], []
    while todo:
        now = todo.pop(0)
        row = []
        for c in range(n):
            nxt = closure({root} | {t for s in now for b, t in nfa.edges[s] if member[c] in b})
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append(number[nxt])
        delta.append(row)
    move = np.array(delta)
    ends = [frozenset(final[s] for s in states if s in final) for states in number]
    # minimisation: refine by what a state ends and where it goes until nothing splits
    kinds: dict[frozenset, int] = {}
    block = np.array([kinds.setdefault(e, len(kinds)) for e in ends])
    while True:
        _, finer = np.unique(np.column_stack([block, block[move]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    count = int(block.max()) + 1
    one = [int(np.flatnonzero(block == b)[0]) for b in range(count)]
    order = sorted(range(count), key=lambda b: (bool(ends[one[b]]), b))
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)
    table = np.empty((count, n), np.int32)
    for b in range(count):
        table[rank[b]] = rank[block[move[one[b]]]] * n
    quiet = sum(not ends[one[b]] for b in range(count))
    return Automaton(classes.astype(np.int32), table.reshape(-1), n, int(rank[block[0]]) * n, quiet * n, [ends[one[b]] for b in order])
