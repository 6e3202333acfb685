"""Secret scans: all rules in one deterministic automaton over bytes.

Rule patterns are parsed to a nondeterministic automaton, made deterministic by subset construction
over byte classes, and minimised. Two automata come out of the same rules:

* the alarm automaton recognises "anything, then the beginning of a match of any rule": the head and a first
  byte of the tail, or the least length of a rule without a head. One pass over the bytes of a text ends
  in its absorbing state or shows that no rule can have an accepted match;
* the match automata, one per rule, are anchored. They run only over texts with an alarm and give leftmost,
  longest, non-overlapping spans; matches that are too short use up text, as they do in a search, and go.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from wavecairn.llm.common import column, inputs, map_rows, raw_texts


@dataclass(frozen=True)
class Rule:
    """``head`` and then one or more bytes of ``tail``; accepted if the whole match (or the tail alone) has ``least`` bytes.

    Heads must be such that the longest match is the greedy one. ``folded``: letters of the head stand for
    either case. ``base``: counted and digested by the query.
    """

    kind: str
    head: str
    tail: str
    least: int
    tail_only: bool = False
    folded: bool = False
    base: bool = True


#: The three base rules; then the further ones.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 12, tail_only=True, folded=True),
    Rule("access", r"AKIA", r"[A-Z0-9]", 18),
    Rule("hex", r"", r"[0-9a-f]", 16),
    Rule("hub", r"gh[pousr]_", r"[A-Za-z0-9]", 40, base=False),
    Rule("chat", r"xox[baprs]-", r"[A-Za-z0-9-]", 20, base=False),
)


class _Nfa:
    """Thompson construction for literals, escapes, classes, groups, alternatives and ``? * + {m}``."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def byte(self, allowed: frozenset) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.moves[a] = (allowed, b)
        return a, b

    def parse(self, text: str, folded: bool = False) -> tuple[int, int]:
        self.text, self.at, self.folded = text, 0, folded
        part = self._choice()
        if self.at != len(text):
            raise ValueError(f"cannot read {text[self.at:]!r}")
        return part

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _choice(self) -> tuple[int, int]:
        parts = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            parts.append(self._sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = self.state(), self.state()
        for x, y in parts:
            self.empty[a].append(x)
            self.empty[y].append(b)
        return a, b

    def _sequence(self) -> tuple[int, int]:
        first = last = self.state()
        while self._peek() not in ("", "|", ")"):
            begin, (x, y) = self.at, self._atom()
            source = self.text[begin : self.at]
            mark = self._peek()
            if mark and mark in "?*+":
                self.at += 1
                if mark != "?":
                    self.empty[y].append(x)
                if mark != "+":
                    skip = self.state()
                    self.empty[skip] += [x]
                    end = self.state()
                    self.empty[y].append(end)
                    self.empty[skip].append(end)
                    x, y = skip, end
            elif mark == "{":
                times, self.at = re.match(r"\{(\d+)\}", self.text[self.at :]), self.text.index("}", self.at) + 1
                keep = self.text, self.at
                for _ in range(int(times[1]) - 1):
                    self.text, self.at = source, 0
                    u, v = self._atom()
                    self.empty[y].append(u)
                    y = v
                self.text, self.at = keep
            self.empty[last].append(x)
            last = y
        return first, last

    def _literal(self) -> int:
        c = self._peek()
        self.at += 1
        if c == "\\":
            c = self._peek()
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def _atom(self) -> tuple[int, int]:
        c = self._peek()
        if c == "(":
            self.at += 1
            part = self._choice()
            self.at += 1
            return part
        if c != "[":
            b = self._literal()
            both = {b, ord(chr(b).swapcase())} if self.folded and chr(b).isalpha() else {b}
            return self.byte(frozenset(both))
        self.at += 1
        allowed: set[int] = set()
        while self._peek() != "]":
            low = high = self._literal()
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._literal()
            allowed |= set(range(low, high + 1))
        self.at += 1
        return self.byte(frozenset(allowed))


@dataclass
class Automaton:
    """``step[state, class]`` and the byte classes; ``accepts[state]`` is a bit per rule. State 0 is dead."""

    step: np.ndarray
    classes: bytes
    accepts: np.ndarray
    start: int

    def rows(self) -> list[list]:
        """Transition rows that refer to each other: following a byte is one list access."""
        rows = [[None] * 256 for _ in self.step]
        wide = self.step[:, np.frombuffer(self.classes, dtype=np.uint8)]
        for row, targets in zip(rows, wide.tolist()):
            row[:] = [rows[t] for t in targets]
        return rows


def _byte_classes(nfa: _Nfa) -> tuple[bytes, list[int]]:
    """Bytes that no move tells apart share a class; one byte stands for each."""
    signature: dict[tuple, int] = {}
    sets = list({m[0] for m in nfa.moves if m})
    classes, samples = bytearray(256), []
    for b in range(256):
        key = tuple(b in s for s in sets)
        if key not in signature:
            signature[key] = len(signature)
            samples.append(b)
        classes[b] = signature[key]
    return bytes(classes), samples


def _determinise(nfa: _Nfa, start: int, final: dict[int, int], absorb: bool) -> Automaton:
    classes, samples = _byte_classes(nfa)

    def closure(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    dead, done = frozenset(), frozenset([-1])
    index: dict[frozenset, int] = {dead: 0}
    order, step, accepts = [dead], [], []

    def number(states: frozenset) -> int:
        if absorb and any(s in final for s in states):
            states = done
        if states not in index:
            index[states] = len(order)
            order.append(states)
        return index[states]

    begin = number(closure([start]))
    for states in order:  # grows meanwhile
        accepts.append(1 if states == done else int(np.bitwise_or.reduce([final.get(s, 0) for s in states] or [0])))
        if states == done:
            step.append([index[done]] * len(samples))
            continue
        row = []
        for b in samples:
            row.append(number(closure({nfa.moves[s][1] for s in states if nfa.moves[s] and b in nfa.moves[s][0]})))
        step.append(row)
    return _minimise(Automaton(np.array(step), classes, np.array(accepts), begin))


def _minimise(a: Automaton) -> Automaton:
    """Partition refinement: states stay together while accepts and all successors' blocks agree."""
    _, block = np.unique(a.accepts, return_inverse=True)
    while True:
        _, first, finer = np.unique(np.column_stack([block, block[a.step]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.ravel()
        if len(first) == len(np.unique(block)):
            break
        block = finer
    # The block of the dead state becomes 0.
    rank = np.arange(len(first))
    rank[finer[0]], rank[0] = 0, finer[0]
    where = np.empty_like(first)
    where[rank] = first
    label = rank[finer]
    return Automaton(label[a.step[where]], a.classes, a.accepts[where], int(label[a.start]))


def match_automaton(rule: Rule) -> Automaton:
    """Anchored: accepts after the head and one or more bytes of the tail."""
    nfa = _Nfa()
    a, b = nfa.parse(rule.head, rule.folded)
    x, y = nfa.parse(f"{rule.tail}+")
    nfa.empty[b].append(x)
    return _determinise(nfa, a, {y: 1}, absorb=False)


def alarm_automaton(rules: tuple[Rule, ...]) -> Automaton:
    """Unanchored: absorbing once any rule's head and first tail byte, or its headless least length, was read."""
    nfa = _Nfa()
    start, final = nfa.state(), {}
    nfa.moves[start] = (frozenset(range(256)), start)
    for rule in rules:
        a, b = nfa.parse(rule.head, rule.folded)
        x, y = nfa.parse(rule.tail if rule.head else f"{rule.tail}{{{rule.least}}}")
        nfa.empty[start].append(a)
        nfa.empty[b].append(x)
        final[y] = 1
    return _determinise(nfa, start, final, absorb=True)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        alarm = alarm_automaton(rules)
        rows = alarm.rows()
        self.alarm_start, self.alarmed = rows[alarm.start], rows[int(np.flatnonzero(alarm.accepts)[0])]
        self.match = []
        for rule in rules:
            anchored = match_automaton(rule)
            rows = anchored.rows()
            self.match.append((rows[anchored.start], rows[0], {id(r) for r, bit in zip(rows, anchored.accepts) if bit}))

    def alarm(self, data: bytes) -> bool:
        """One pass for all rules."""
        row = self.alarm_start
        for b in data:
            row = row[b]
        return row is self.alarmed

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, accepted matches only, by start and then rule."""
        found: list[tuple[int, int, int]] = []
        size = len(data)
        for n, (rule, (start, dead, ends)) in enumerate(zip(self.rules, self.match)):
            begin = 0
            while begin < size:
                row = start[data[begin]]
                if row is dead:
                    begin += 1
                    continue
                first = last = 0
                at = begin + 1
                while True:
                    if id(row) in ends:
                        first, last = first or at, at
                    if at == size:
                        break
                    row = row[data[at]]
                    if row is dead:
                        break
                    at += 1
                if not last:
                    begin += 1
                    continue
                if (last - first + 1 if rule.tail_only else last - begin) >= rule.least:
                    found.append((begin, last, n))
                begin = last
        return sorted(found, key=lambda s: (s[0], s[2]))

    def scan(self, data: bytes) -> list[tuple[int, int, str]]:
        """Spans of a text in code points, end exclusive."""
        if not self.alarm(data):
            return []
        spans = self.spans(data)
        if not data.isascii() and spans:
            starts = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80).tolist()
            spans = [(bisect_left(starts, a), bisect_left(starts, b), n) for a, b, n in spans]
        return [(a, b, self.rules[n].kind) for a, b, n in spans]


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of every document: doc_id, found array of (start, finish, kind).

    Code points, ``finish`` exclusive, ordered by start and then by rule. One row per input row; null and
    empty texts have none; texts of any length are scanned whole, row by row, without a shuffle.
    """

    def run(batch) -> dict:
        tool = _scanner(rules)
        found = [[{"start": a, "finish": b, "kind": k} for a, b, k in tool.scan(data)] for data in raw_texts(batch)]
        return {"doc_id": column(batch, "doc_id"), "found": found}

    return map_rows(inputs(docs, doc_id="doc_id", text="text"), run, "doc_id bigint, found array<struct<start: bigint, finish: bigint, kind: string>>")


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
