"""Regular expressions over bytes compiled to minimal deterministic automata as flat transition arrays.

Syntax is Python's own parser's: literals, sets, groups, alternation, bounded and unbounded greedy repeats, and the
inline flag i for ASCII letters. Automata find leftmost-longest matches.
"""

from __future__ import annotations

import re
from collections import defaultdict
from re import _constants as C
from re import _parser as P

ALL = frozenset(range(256))


def _set(items: list, fold: bool) -> frozenset[int]:
    out: set[int] = set()
    negate = False
    for op, arg in items:
        if op is C.NEGATE:
            negate = True
        elif op is C.LITERAL:
            out.add(arg)
        elif op is C.RANGE:
            out.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"unsupported in a set: {op}")
    if fold:
        out |= {ord(f(chr(b))) for b in out if b < 128 for f in (str.lower, str.upper)}
    return ALL - out if negate else frozenset(out)


class Nfa:
    """Thompson's construction; reverse builds the automaton of the reversed expression."""

    def __init__(self, reverse: bool) -> None:
        self.reverse, self.moves, self.empty = reverse, [], []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def byte(self, bytes_: frozenset[int], a: int) -> int:
        b = self.state()
        self.moves[a].append((bytes_, b))
        return b

    def parse(self, pattern: bytes, a: int) -> int:
        return self.sequence(P.parse(pattern), a, False)

    def sequence(self, tree, a: int, fold: bool) -> int:
        for item in reversed(list(tree)) if self.reverse else tree:
            a = self.item(item, a, fold)
        return a

    def item(self, item, a: int, fold: bool) -> int:
        op, arg = item
        if op is C.LITERAL:
            return self.byte(_set([(op, arg)], fold), a)
        if op is C.IN:
            return self.byte(_set(arg, fold), a)
        if op is C.ANY:
            return self.byte(ALL - {10}, a)
        if op is C.SUBPATTERN:
            return self.sequence(arg[3], a, (fold or bool(arg[1] & re.IGNORECASE)) and not arg[2] & re.IGNORECASE)
        if op is C.BRANCH:
            end = self.state()
            for tree in arg[1]:
                at = self.state()
                self.empty[a].append(at)
                self.empty[self.sequence(tree, at, fold)].append(end)
            return end
        if op is C.MAX_REPEAT:
            least, most, tree = arg
            for _ in range(least):
                a = self.sequence(tree, a, fold)
            end = self.state()
            if most is C.MAXREPEAT:
                loop = self.state()
                self.empty[a].append(loop)
                self.empty[self.sequence(tree, loop, fold)].append(loop)
                a = loop
            else:
                for _ in range(most - least):
                    self.empty[a].append(end)
                    a = self.sequence(tree, a, fold)
            self.empty[a].append(end)
            return end
        raise ValueError(f"unsupported: {op}")


class Dfa:
    """``table[state + classes[byte]]`` is the next state; states are multiples of ``width``, accepting ones from ``accepts`` up.

    ``rules[state // width]`` is the tuple of the rules accepted there. State ``start`` begins; ``dead`` has no way on.
    """

    def __init__(self, patterns: list[bytes], reverse: bool = False, anywhere: bool = False) -> None:
        nfa = Nfa(reverse)
        first = nfa.state()
        final: dict[int, int] = {}
        for rule, p in enumerate(patterns):
            at = nfa.state()
            nfa.empty[first].append(at)
            final[nfa.parse(p, at)] = rule
        if anywhere:
            nfa.moves[first].append((ALL, first))
        self._classes(nfa)
        self._subsets(nfa, first, final)

    def _classes(self, nfa: Nfa) -> None:
        sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
        of: dict[tuple, int] = {}
        self.classes = bytes(of.setdefault(tuple(b in s for s in sets), len(of)) for b in range(256))
        self.width = len(of)
        self.sample = [self.classes.index(c) for c in range(self.width)]

    def _closure(self, nfa: Nfa, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def _subsets(self, nfa: Nfa, first: int, final: dict[int, int]) -> None:
        by_class = [[[t for s, t in moves if b in s] for b in self.sample] for moves in nfa.moves]
        begin = self._closure(nfa, {first})
        ids, todo, rows = {begin: 0}, [begin], []
        while todo:
            now = todo.pop(0)
            row = []
            for c in range(self.width):
                new = self._closure(nfa, {t for s in now for t in by_class[s][c]})
                if new not in ids:
                    ids[new] = len(ids)
                    todo.append(new)
                row.append(ids[new])
            rows.append(row)
        accept = [tuple(sorted(final[s] for s in now if s in final)) for now in ids]
        self._minimise(rows, accept)

    def _minimise(self, rows: list[list[int]], accept: list[tuple]) -> None:
        """Moore's refinement: states stay together while they accept alike and move to states that are together."""
        names: dict[tuple, int] = {}
        part = [names.setdefault(a, len(names)) for a in accept]
        while True:
            new: dict[tuple, int] = {}
            refined = [new.setdefault((part[i], *(part[t] for t in rows[i])), len(new)) for i in range(len(rows))]
            if len(new) == len(names):
                break
            part, names = refined, new
        members: dict[int, int] = {}
        for i, p in enumerate(part):
            members.setdefault(p, i)
        order = sorted(members, key=lambda p: bool(accept[members[p]]))
        at = {p: k for k, p in enumerate(order)}
        w = self.width
        self.table = [at[part[t]] * w for p in order for t in rows[members[p]]]
        self.rules = [accept[members[p]] for p in order]
        self.accepts = w * sum(not r for r in self.rules)
        self.start = at[part[0]] * w
        self.dead = next((k * w for k in range(len(order)) if not self.rules[k] and all(t == k * w for t in self.table[k * w : (k + 1) * w])), -1)


class Scanner:
    """All leftmost-longest, non-overlapping matches of every rule, each rule by itself.

    One backward pass of the combined automaton marks where a match of any rule starts; a rule's own forward automaton
    then runs over its matches only.
    """

    def __init__(self, patterns: list[bytes]) -> None:
        self.back = Dfa(patterns, reverse=True, anywhere=True)
        self.forward = [Dfa([p]) for p in patterns]

    def starts(self, data: bytes) -> dict[int, list[int]]:
        dfa = self.back
        table, accepts, width, s, at, hits = dfa.table, dfa.accepts, dfa.width, dfa.start, len(data), []
        for c in reversed(data.translate(dfa.classes)):
            at -= 1
            s = table[s + c]
            if s >= accepts:
                hits.append((at, s))
        found = defaultdict(list)
        for at, s in reversed(hits):
            for rule in dfa.rules[s // width]:
                found[rule].append(at)
        return found

    def end(self, rule: int, data: bytes, start: int) -> int:
        dfa = self.forward[rule]
        table, classes, accepts, dead, s, last = dfa.table, dfa.classes, dfa.accepts, dfa.dead, dfa.start, -1
        for at in range(start, len(data)):
            s = table[s + classes[data[at]]]
            if s >= accepts:
                last = at + 1
            elif s == dead:
                break
        return last

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """``(rule, start, end)`` in bytes, by rule and start."""
        out = []
        for rule, starts in sorted(self.starts(data).items()):
            done = 0
            for at in starts:
                if at >= done:
                    done = self.end(rule, data, at)
                    out.append((rule, at, done))
        return out
