"""One deterministic automaton for many rules: subset construction, minimisation, and a one-pass byte scan.

A rule is a regular expression over bytes in two parts: a word of bounded
length, and what follows it. The automaton of a rule makes the choices of a
leftmost, non-overlapping search while it reads: a state holds the match that
has its word and is still possible (the earliest), the words under way, and
whether the match is complete. A complete match goes on as long as it can, and
no other begins inside it. All rules together are one automaton whose states
tell, for each rule, how long a word is that ends at this byte, and whether a
complete match ends here. So starts and ends of all matches of all rules come
out of one passage over the bytes, and each byte costs one look-up in a
transition array, whatever the number of rules.
"""

from __future__ import annotations

import functools
import re._constants as C
import re._parser as parser
from dataclasses import dataclass

import numpy as np

RESET = 0xFF  # never part of UTF-8: parts texts in a buffer, and leads every state back to the start
WARM, LANE = 64, 1024
CHUNK = 4 << 20  # bytes whose states are held at a time


class _Nfa:
    """Thompson's construction."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def pattern(self, source: bytes) -> tuple[int, int]:
        """The first and the last state of what ``source`` matches."""
        parsed, first = parser.parse(source), self.state()
        return first, self.sequence(parsed, first, bool(parsed.state.flags & C.SRE_FLAG_IGNORECASE))

    def sequence(self, items, at: int, folded: bool) -> int:
        for op, arg in items:
            at = self.add(op, arg, at, folded)
        return at

    def add(self, op, arg, at: int, folded: bool) -> int:
        """Adds what one parsed item matches from ``at`` on; returns the state behind it."""
        if op is C.SUBPATTERN:
            _, on, off, items = arg
            return self.sequence(items, at, (folded or bool(on & C.SRE_FLAG_IGNORECASE)) and not off & C.SRE_FLAG_IGNORECASE)
        if op is C.BRANCH:
            end = self.state()
            for items in arg[1]:
                self.empty[self.sequence(items, at, folded)].append(end)
            return end
        if op is C.MAX_REPEAT:
            low, high, items = arg
            for _ in range(low):
                at = self.sequence(items, at, folded)
            if high is C.MAXREPEAT:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self.sequence(items, loop, folded)].append(loop)
                return loop
            end = self.state()
            for _ in range(high - low):
                self.empty[at].append(end)
                at = self.sequence(items, at, folded)
            self.empty[at].append(end)
            return end
        end = self.state()
        self.moves[at].append((self.bytes_of(op, arg, folded), end))
        return end

    @staticmethod
    def bytes_of(op, arg, folded: bool) -> frozenset[int]:
        if op is C.LITERAL:
            found = {arg}
        elif op is C.IN:
            found = set()
            for kind, x in arg:
                if kind is C.LITERAL:
                    found.add(x)
                elif kind is C.RANGE:
                    found.update(range(x[0], x[1] + 1))
                elif kind is not C.NEGATE:
                    raise ValueError(f"unsupported in a class: {kind}")
            if arg[0][0] is C.NEGATE:
                found = set(range(256)) - found - {RESET}
        else:
            raise ValueError(f"unsupported: {op}")
        if folded:
            found |= {ord(f(chr(b))) for b in found if b < 128 for f in (str.lower, str.upper)}
        return frozenset(found)

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def step(self, states, byte: int) -> frozenset[int]:
        return self.closure({t for s in states for chars, t in self.moves[s] if byte in chars})


@dataclass(frozen=True)
class _State:
    """Of one rule: the earliest match with its word, whether it is complete, later ones with theirs, words under way with their ages, and the length of a word that ends here and leads."""

    lead: frozenset[int] = frozenset()
    complete: bool = False
    later: frozenset[int] = frozenset()
    words: frozenset[tuple[int, int]] = frozenset()
    length: int = 0


class _Rule:
    def __init__(self, nfa: _Nfa, word: bytes, rest: bytes):
        self.nfa, self.name = nfa, word + rest
        (self.w0, self.w1), (self.r0, self.r1) = nfa.pattern(word), nfa.pattern(rest)

    def step(self, s: _State, byte: int) -> _State:
        """The state after ``byte``. Raises ValueError for a rule of which an earlier match could fail beside a later one: it needs more than one reading."""
        lead = self.nfa.step(s.lead, byte)
        if s.complete and lead:
            if self.r1 not in lead:
                raise ValueError(f"a complete match must stay one while it goes on: {self.name!r}")
            return _State(lead, True)
        later = self.nfa.step(s.later, byte)
        if later and not lead:
            raise ValueError(f"a later match outlives an earlier one: {self.name!r}")
        words = set()
        for q, age in {*s.words, *((q, 0) for q in self.nfa.closure([self.w0]))}:
            words |= {(x, age + 1) for x in self.nfa.step([q], byte)}
        length = max((age for q, age in words if q == self.w1), default=0)
        if length == 1 or length and any(age > length for _, age in words):
            raise ValueError(f"a word must have two bytes or more and no other word inside it: {self.name!r}")
        new = self.nfa.closure([self.r0]) if length else frozenset()
        if lead:
            later, length = later | new, 0
        else:
            lead = new
        return _State(lead, True, length=length) if self.r1 in lead else _State(lead, False, later, frozenset(words), length)


@dataclass(frozen=True)
class Automaton:
    """table[state * width + classes[byte]] is the next state times width; state 0 is the start.

    ``lengths[state, rule]`` is the length of a word of the rule that ends there,
    ``complete[state, rule]`` whether a match does. States that tell anything
    come last, from ``first`` (times width) on.
    """

    classes: np.ndarray
    width: int
    table: np.ndarray
    lengths: np.ndarray
    complete: np.ndarray
    first: int

    @property
    def states(self) -> int:
        return len(self.lengths)

    @functools.cached_property
    def lists(self) -> tuple[list[int], list[int]]:
        """The transitions and classes as lists, which single look-ups read faster."""
        return self.table.tolist(), self.classes.tolist()


def _minimal(moves: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block of each state, split by what states tell and where they lead until nothing splits, and a state of each block."""
    _, block = np.unique(told, axis=0, return_inverse=True)
    block = block.ravel()
    while True:
        _, sample, finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_index=True, return_inverse=True)
        if len(sample) == block.max() + 1:
            return finer.ravel(), sample
        block = finer.ravel()


def _of_rule(rule: _Rule, of_class: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The minimal automaton of one rule: moves by class, and (length, complete) of each state; state 0 is the start."""
    number, order, rows = {_State(): 0}, [_State()], []
    for s in order:
        row = []
        for byte in of_class:
            to = rule.step(s, byte)
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    moves, told = np.array(rows), np.array([(s.length, s.complete) for s in order])
    block, sample = _minimal(moves, told)
    rank = np.argsort(np.argsort(np.where(np.arange(len(sample)) == block[0], -1, np.arange(len(sample)))))
    back = np.argsort(rank)
    return rank[block[moves[sample[back]]]], told[sample[back]]


def compile_rules(rules: list[tuple[bytes, bytes]]) -> Automaton:
    """Of rules (word, rest): one automaton, the minimal one of all that the rules tell together."""
    nfa = _Nfa()
    made = [_Rule(nfa, word, rest) for word, rest in rules]

    # Bytes that no rule tells apart share a class.
    sets = sorted({b for moves in nfa.moves for b, _ in moves}, key=sorted)
    marks: dict[tuple[bool, ...], int] = {}
    classes = np.array([marks.setdefault(tuple(b in s for s in sets), len(marks)) for b in range(256)], np.uint8)
    width = len(marks)
    each = [_of_rule(r, [int(np.flatnonzero(classes == c)[0]) for c in range(width)]) for r in made]

    # A state of all rules together is a state of each, written as one number; those that can be reached are found in waves.
    sizes = [len(m) for m, _ in each]
    digits = np.cumprod([1, *sizes[:-1]])
    known, fresh, rows = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(fresh):
        parts = [fresh // d % n for d, n in zip(digits, sizes, strict=True)]
        to = sum(m[p].astype(np.int64) * d for (m, _), p, d in zip(each, parts, digits, strict=True))
        rows.append((fresh, to))
        fresh = np.setdiff1d(to, known)
        known = np.union1d(known, fresh)
    start = np.concatenate([f for f, _ in rows])
    moves = np.searchsorted(known, np.concatenate([t for _, t in rows])[np.argsort(start)])
    told = np.column_stack([t[known // d % n] for (_, t), d, n in zip(each, digits, sizes, strict=True)])
    block, sample = _minimal(moves, told)

    told = told[sample]
    tells = told.any(axis=1)
    rank = np.empty(len(sample), np.int64)
    rank[np.lexsort((np.arange(len(sample)) != block[0], tells))] = np.arange(len(sample))
    back = np.argsort(rank)
    table = rank[block[moves[sample[back]]]] * width
    told = told[back].reshape(len(sample), len(rules), 2)
    return Automaton(classes, width, np.ascontiguousarray(table.ravel(), np.intp), told[:, :, 0].astype(np.uint8), told[:, :, 1] != 0, int((~tells).sum()) * width)


def _passage(dfa: Automaton, data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The places of ``data`` at which the automaton tells something, its states there, and its state behind the last byte; ``state`` is that before the first.

    The bytes are cut into lanes, which all move on by one byte at a time. A
    lane begins WARM bytes early from the start state. Where the lane before
    it ended in another state, the lane is read again from there, until it
    meets the states that it had: the result is that of one passage from the
    first byte, however long a match is.
    """
    n = len(data)
    lanes = max(1, -(-n // LANE))
    padded = np.full(WARM + lanes * LANE, RESET, np.uint8)
    padded[WARM : WARM + n] = data
    padded = dfa.classes[padded]
    columns = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (lanes, WARM + LANE), (LANE, 1)).T)
    now, at = np.zeros(lanes, np.intp), np.empty(lanes, np.intp)
    for t in range(WARM):
        np.add(now, columns[t], out=at)
        np.take(dfa.table, at, out=now, mode="clip")
    now[0] = state
    began = now
    held = np.empty((LANE, lanes), np.intp)
    for t in range(LANE):
        np.add(now, columns[WARM + t], out=at)
        now = held[t]
        np.take(dfa.table, at, out=now, mode="clip")
    table, _ = dfa.lists
    for k in (np.flatnonzero(began[1:] != held[-1, :-1]) + 1).tolist():
        # A lane that is read again to its end may leave the next one wrong.
        while k < lanes:
            s = int(held[-1, k - 1])
            for t, c in enumerate(columns[WARM:, k].tolist()):
                s = table[s + c]
                if s == held[t, k]:
                    break
                held[t, k] = s
            else:
                k += 1
                continue
            break
    step, lane = np.nonzero(held >= dfa.first)
    pos = lane * LANE + step
    order = np.argsort(pos)
    order = order[pos[order] < n]
    return pos[order], held[step[order], lane[order]] // dfa.width, int(held[(n - 1) % LANE, (n - 1) // LANE]) if n else state


def find(dfa: Automaton, data: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each rule the starts, ends (exclusive) and the places of the first complete bytes of its matches in ``data``, ascending."""
    raw, state, places, states = np.frombuffer(data, np.uint8), 0, [], []
    for lo in range(0, len(raw), CHUNK):
        pos, at, state = _passage(dfa, raw[lo : lo + CHUNK], state)
        places.append(pos + lo)
        states.append(at)
    pos = np.concatenate(places) if places else np.empty(0, np.int64)
    at = np.concatenate(states) if states else np.empty(0, np.int64)
    out = []
    for k in range(dfa.lengths.shape[1]):
        length = dfa.lengths[at, k]
        word = length > 0
        begun, ends = pos[word] + 1 - length[word], pos[word]
        done = pos[dfa.complete[at, k]]
        first = np.flatnonzero(np.diff(done, prepend=-2) != 1)
        last = np.append(first[1:], len(done)) - 1 if len(first) else first
        # The word of a match is the last one that led before it was complete.
        out.append((begun[np.searchsorted(ends, done[first], "right") - 1], done[last] + 1, done[first]))
    return out
