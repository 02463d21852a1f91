"""Rule regexes compiled together into one deterministic byte automaton.

Rules are trees built by lit, cls, seq, alt, opt, star, plus and repeat. Thompson's construction makes one NFA of all rules,
subset construction a DFA whose accepting states carry a bit mask of rules, and partition refinement merges equal states.
Bytes that no rule tells apart share a column, so the table stays small enough for the processor's caches.
"""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

Node = tuple


def cls(chars: str | Iterable[int]) -> Node:
    return ("cls", frozenset(ord(c) if isinstance(c, str) else c for c in chars))


def span(*ranges: str) -> frozenset[int]:
    """Bytes of ranges such as "az" or "09", or of single characters."""
    return frozenset(b for r in ranges for b in (range(ord(r[0]), ord(r[1]) + 1) if len(r) == 2 else [ord(r)]))


def lit(text: str, either_case: bool = False) -> Node:
    return seq(*[cls({ord(c.lower()), ord(c.upper())} if either_case else {ord(c)}) for c in text])


def seq(*parts: Node) -> Node:
    return ("seq", parts)


def alt(*parts: Node) -> Node:
    return ("alt", parts)


def opt(part: Node) -> Node:
    return ("alt", (part, seq()))


def star(part: Node) -> Node:
    return ("star", part)


def plus(part: Node) -> Node:
    return seq(part, star(part))


def repeat(part: Node, n: int) -> Node:
    """Exactly n of part."""
    return seq(*[part] * n)


@dataclass(frozen=True)
class Automaton:
    """column: of each byte; table: next state by state and column; accepts: bit mask of rules by state. State 0 starts."""

    column: np.ndarray
    table: np.ndarray
    accepts: np.ndarray


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append(None)
        return len(self.free) - 1

    def add(self, node: Node, start: int) -> int:
        """Put node after start; the state where it ends."""
        kind, value = node
        if kind == "cls":
            end, mid = self.state(), self.state()
            self.free[start].append(mid)
            self.moves[mid] = (value, end)
            return end
        if kind == "seq":
            for part in value:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "alt":
            for part in value:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(part, begin)].append(end)
        else:  # star
            begin = self.state()
            self.free[start] += [begin, end]
            self.free[self.add(value, begin)] += [begin, end]
        return end


def compile_rules(rules: list[Node], search: bool) -> Automaton:
    """All rules in one automaton. search: a match may begin at any byte; else only at the first."""
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    if search:
        loop = nfa.state()
        nfa.free[start].append(loop)
        nfa.moves[loop] = (frozenset(range(256)), start)
    for k, rule in enumerate(rules):
        begin = nfa.state()
        nfa.free[start].append(begin)
        ends[nfa.add(rule, begin)] = 1 << k

    sets = {m[0] for m in nfa.moves if m}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    names = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    column = np.array([names[s] for s in signature], np.uint8)
    sample = [signature.index(s) for s in names]  # one byte of each column

    def closure(state: int) -> int:
        """The states reached without a byte, as a bit mask; of them only those that move or end count."""
        todo, seen = [state], {state}
        while todo:
            for s in nfa.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return sum(1 << s for s in seen if nfa.moves[s] or s in ends)

    after: dict[int, list[int]] = {}  # of a moving state, the mask of next states by column
    for s, move in enumerate(nfa.moves):
        if move:
            to = closure(move[1])
            after[s] = [to if b in move[0] else 0 for b in sample]

    first = closure(start)
    number, order, table, accepts = {first: 0}, [first], [], []
    for states in order:  # grows while it is walked
        row, accepted, rest = [0] * len(sample), 0, states
        while rest:
            s = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            accepted |= ends.get(s, 0)
            if s in after:
                row = [x | y for x, y in zip(row, after[s], strict=True)]
        for to in row:
            if to not in number:
                number[to] = len(order)
                order.append(to)
        table.append([number[to] for to in row])
        accepts.append(accepted)
    return _minimised(column, np.array(table, np.int32), np.array(accepts, np.int64))


def _minimised(column: np.ndarray, table: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Refine the partition by accepted rules until successors agree (Moore)."""
    block = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    firsts = np.unique(block, return_index=True)[1]
    rank = np.empty(len(firsts), np.int32)
    swap = np.argsort(block[firsts] != block[0], kind="stable")  # the starting block comes first
    rank[swap] = np.arange(len(firsts))
    firsts = firsts[swap]
    return Automaton(column, rank[block[table[firsts]]].astype(np.int32), accepts[firsts])


def scan_all(auto: Automaton, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bit mask, per text, of the rules that accept anywhere in it: one pass over the bytes, all texts in step.

    data holds the texts' bytes; begins and sizes say where each lies. Texts go longest first, so those still running are a
    prefix of the lanes, and a step costs a few array operations however many texts run.
    """
    order = np.argsort(-sizes, kind="stable")
    seen = np.full(len(sizes), auto.accepts[0])
    if not len(sizes) or not sizes.max():
        return seen
    flat, at, ends = auto.column[data], begins[order].astype(np.int64), sizes[order]
    width = auto.table.shape[1]
    table = np.ascontiguousarray(auto.table * width).reshape(-1)  # a state is kept as the place of its row
    accepts = np.repeat(auto.accepts, width)
    state, lanes = np.zeros(len(sizes), np.int32), seen.copy()
    running = np.searchsorted(-ends, -np.arange(int(ends[0])), side="left")  # lanes with more than t bytes
    for t, k in enumerate(running.tolist()):
        now = table[state[:k] + flat[at[:k]]]
        state[:k] = now
        at[:k] += 1
        lanes[:k] |= accepts[now]
    seen[order] = lanes
    return seen


class Matcher:
    """Spans of each rule of an anchored automaton, with its tables as plain lists for walking single texts."""

    def __init__(self, auto: Automaton) -> None:
        reach = auto.accepts.copy()
        while ((more := reach | np.bitwise_or.reduce(reach[auto.table], axis=1)) != reach).any():
            reach = more
        self.rows, self.column, self.accepts, self.reach = auto.table.tolist(), auto.column.tolist(), auto.accepts.tolist(), reach.tolist()

    def spans(self, text: bytes, rule: int) -> list[tuple[int, int, int]]:
        """Leftmost longest matches of one rule, from left to right and not overlapping, as (start, end, body).

        body is the place of the first byte that led to an accepting state. All starts advance in one pass: of those that meet in a
        state the earliest goes on, as all would match alike, so there are never more than states, however often a match may begin.
        One that is accepted ends all that began after it.
        """
        bit, rows, column, reach, accepts = 1 << rule, self.rows, self.column, self.reach, self.accepts
        begins = bytes(b for b in range(256) if reach[rows[0][column[b]]] & bit)
        first = re.compile(b"[" + re.escape(begins) + b"]")
        done: list[tuple[int, int, int]] = []  # by start
        live: list[tuple[int, int, int, int]] = []  # (start, end, body, state) by start
        at, n = 0, len(text)
        while at < n:
            if not live:
                found = first.search(text, at)
                if not found:
                    break
                at = found.start()
            byte = text[at]
            c = column[byte]
            if byte in begins:
                live.append((at, -1, -1, 0))
            at += 1
            states: set[int] = set()
            going = []
            for start, end, body, state in live:
                state = rows[state][c]
                if not reach[state] & bit or state in states:
                    if end >= 0:
                        insort(done, (start, end, body))
                    continue
                states.add(state)
                if not accepts[state] & bit:
                    going.append((start, end, body, state))
                    continue
                going.append((start, at, at - 1 if body < 0 else body, state))
                while done and done[-1][0] > start:
                    done.pop()
                break
            live = going
        for start, end, body, _ in live:
            if end >= 0:
                insort(done, (start, end, body))
        return done
