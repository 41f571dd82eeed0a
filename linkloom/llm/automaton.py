"""Byte regexes compiled together into one deterministic automaton.

The syntax is the regular part of the usual one: literals, ``.``, ``[...]``, ``\\xHH``, groups, ``|``,
``? * +`` and ``{m}``, ``{m,}``, ``{m,n}``; ``(?i:...)`` ignores ASCII case. Thompson's construction gives
a nondeterministic automaton over classes of bytes that no rule tells apart, subset construction makes
it deterministic, and Moore's refinement minimises it. All states become one flat transition array.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

ANY = frozenset(range(256))


class _Parser:
    """Regex text to a tree: ("set", bytes), ("cat", items), ("alt", items), ("rep", item, least, most)."""

    def __init__(self, pattern: str):
        self.s, self.i, self.fold = pattern, 0, False

    def parse(self):
        tree = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return tree

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"{self.s!r} ends too early")
        self.i += 1
        return c

    def alternatives(self):
        items = [self.sequence()]
        while self.peek() == "|":
            self.take()
            items.append(self.sequence())
        return items[0] if len(items) == 1 else ("alt", items)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated(self.atom()))
        return ("cat", items)

    def repeated(self, item):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : end].partition(",")
                self.i = end + 1
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            item = ("rep", item, least, most)
        return item

    def atom(self):
        c = self.take()
        if c == "(":
            before = self.fold
            if self.s.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.s.startswith("?:", self.i):
                self.i += 2
            tree = self.alternatives()
            self.fold = before
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.s!r}")
            return tree
        if c == "[":
            return ("set", self.folded(self.members()))
        if c == ".":
            return ("set", ANY - {10})
        return ("set", self.folded(self.escaped() if c == "\\" else frozenset({ord(c)})))

    def escaped(self) -> frozenset:
        c = self.take()
        if c == "x":
            self.i += 2
            return frozenset({int(self.s[self.i - 2 : self.i], 16)})
        if c == "s":
            return frozenset(b" \t\n\v\f\r")
        return frozenset({ord({"n": "\n", "r": "\r", "t": "\t"}.get(c, c))})

    def members(self) -> frozenset:
        negated, got, first = self.peek() == "^", set(), True
        if negated:
            self.take()
        while (c := self.take()) != "]" or first:
            first = False
            low = self.escaped() if c == "\\" else frozenset({ord(c)})
            if self.peek() == "-" and self.s[self.i + 1 : self.i + 2] not in ("", "]"):
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else frozenset({ord(c)})
                got.update(range(min(low), max(high) + 1))
            else:
                got |= low
        return ANY - got if negated else frozenset(got)

    def folded(self, members: frozenset) -> frozenset:
        if not self.fold:
            return members
        return members | {b ^ 32 for b in members if chr(b).isascii() and chr(b).isalpha()}


def _reversed(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [_reversed(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [_reversed(x) for x in tree[1]])
    if kind == "rep":
        return ("rep", _reversed(tree[1]), tree[2], tree[3])
    return tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Append the tree's automaton behind a state; returns its last state."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for item in tree[1]:
                start = self.add(item, start)
            return start
        end = self.state()
        if kind == "alt":
            for item in tree[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(item, first)].append(end)
            return end
        _, item, least, most = tree
        for _ in range(least):
            start = self.add(item, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(item, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            for _ in range(most - least):
                self.empty[start].append(end)
                start = self.add(item, start)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """classes: 256 bytes mapping a byte to its class. table: flat, a state is its row's offset and
    ``table[state + class]`` the next one. Accepting states come last, from ``accepting`` on;
    ``mask`` has for each of them, by row, the bits of the rules that end there. ``dead``: a state
    without a way to accept, or -1."""

    classes: bytes
    width: int
    table: np.ndarray
    start: int
    accepting: int
    mask: np.ndarray
    dead: int

    @cached_property
    def fast(self) -> list[int]:
        """The table as a list in which equal entries are one object, which is what takes the room."""
        states, place = np.unique(self.table, return_inverse=True)
        return np.array(states.tolist(), object)[place.ravel()].tolist()


def build(trees: list, anywhere: bool) -> Automaton:
    """One minimal automaton for all trees; anywhere: a match may begin at any byte."""
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for k, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[root].append(first)
        ends[nfa.add(tree, first)] = k
    if anywhere:
        nfa.moves[root].append((ANY, root))
    sets = list(dict.fromkeys(s for moves in nfa.moves for s, _ in moves))
    kinds: dict[tuple, int] = {}
    classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    sample = [classes.index(c) for c in range(len(kinds))]
    # A set of states is a lane of bits; what a state leads to is one number with a lane for each class of bytes.
    lane = -(-len(nfa.empty) // 8)
    bits = [sum(1 << x for x in nfa.closure([y])) for y in range(len(nfa.empty))]
    leads = [0] * len(nfa.empty)
    for x, moves in enumerate(nfa.moves):
        for s, target in moves:
            for c, b in enumerate(sample):
                if b in s:
                    leads[x] |= bits[target] << (8 * lane * c)

    ids: dict[bytes, int] = {}
    order: list[bytes] = []
    rows: list[list[int]] = []

    def number(states: bytes) -> int:
        k = ids.get(states)
        if k is None:
            k = ids[states] = len(order)
            order.append(states)
        return k

    start = number(bits[root].to_bytes(lane, "little"))
    cuts = [slice(c * lane, (c + 1) * lane) for c in range(len(sample))]
    while len(rows) < len(order):
        states, to = int.from_bytes(order[len(rows)], "little"), 0
        while states:
            low = states & -states
            to |= leads[low.bit_length() - 1]
            states ^= low
        lanes = to.to_bytes(lane * len(sample), "little")
        rows.append([number(lanes[c]) for c in cuts])
    table = np.array(rows)
    mask = np.array([sum(1 << k for e, k in ends.items() if states[e >> 3] >> (e & 7) & 1) for states in order])
    return _minimal(classes, table, mask, start)


def _distinct_rows(rows: np.ndarray) -> np.ndarray:
    """For each row the number of the distinct row it is: grouped by a hash, then compared entry by entry."""
    weights = np.random.default_rng(1).integers(1, 1 << 62, rows.shape[1], np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        mixed = (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        hashes = ((mixed ^ (mixed >> np.uint64(29))) * weights).sum(axis=1, dtype=np.uint64)
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    group = group.ravel()
    if (rows == rows[first[group]]).all():
        return group
    return np.unique(rows, axis=0, return_inverse=True)[1].ravel()


def _minimal(classes: bytes, table: np.ndarray, mask: np.ndarray, start: int) -> Automaton:
    group = np.unique(mask, return_inverse=True)[1].ravel()
    while True:
        finer = _distinct_rows(np.column_stack([group, group[table]]))
        if finer.max() == group.max():
            break
        group = finer
    first = np.unique(group, return_index=True)[1]
    small, small_mask = group[table[first]], mask[first]
    place = np.empty(len(first), np.int64)  # accepting states last
    by = np.argsort(small_mask != 0, kind="stable")
    place[by] = np.arange(len(first))
    small, small_mask = place[small][by], small_mask[by]
    width = table.shape[1]
    quiet = int((small_mask == 0).sum())
    dead = [i for i in range(quiet) if (small[i] == i).all()]
    return Automaton(classes, width, (small * width).ravel(), int(place[group[start]]) * width, quiet * width, small_mask, dead[0] * width if dead else -1)


@dataclass(frozen=True)
class Scanner:
    """All rules in one forward pass; per rule, an automaton of its reversed regex that finds where a match
    begins and an anchored one that finds the longest end from there."""

    forward: Automaton
    backward: list[Automaton]
    anchored: list[Automaton]

    def find(self, data: bytes) -> list[list[tuple[int, int]]]:
        """For each rule its leftmost, longest, non-overlapping matches as (start, end) in bytes."""
        d = self.forward
        table, state, accepting = d.fast, d.start, d.accepting
        hits = []
        for at, c in enumerate(data.translate(d.classes)):
            state = table[state + c]
            if state >= accepting:
                hits.append((at, state))
        found: list[list[tuple[int, int]]] = [[] for _ in self.backward]
        if not hits:
            return found
        last = [0] * len(found)
        for at, s in hits:
            bits = int(d.mask[s // d.width])
            while bits:
                k = (bits & -bits).bit_length() - 1
                bits &= bits - 1
                if at < last[k]:  # inside the match found before
                    continue
                start = _reach(self.backward[k], data, at, last[k] - 1, -1)
                if start is not None:
                    last[k] = _reach(self.anchored[k], data, start, len(data), 1) + 1
                    found[k].append((start, last[k]))
        return found


def _reach(a: Automaton, data: bytes, at: int, stop: int, step: int) -> int | None:
    """The farthest place, from at on, whose byte is the last of a match of the automaton."""
    state, table, classes, found = a.start, a.fast, a.classes, None
    for i in range(at, stop, step):
        state = table[state + classes[data[i]]]
        if state >= a.accepting:
            found = i
        elif state == a.dead:
            break
    return found


def compile_rules(patterns: list[str]) -> Scanner:
    trees = [_Parser(p).parse() for p in patterns]
    return Scanner(build(trees, True), [build([_reversed(t)], False) for t in trees], [build([t], False) for t in trees])
