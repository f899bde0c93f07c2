"""Probabilistic automata inferred from example strings by merging compatible states of their prefix tree."""

from __future__ import annotations

import math

#: Symbols are kinds of characters; other characters are symbols of their own.
KINDS = "".join(
    "d" if chr(i).isdigit() else "h" if chr(i) in "abcdef" else "l" if "a" <= chr(i) <= "z" else "H" if chr(i) in "ABCDEF" else "L" if "A" <= chr(i) <= "Z" else chr(i)
    for i in range(128)
)
#: Log probability of a step that no example took.
UNSEEN = math.log(1e-4)


def symbols(text: str) -> str:
    return "".join(KINDS[ord(c)] if ord(c) < 128 else "?" for c in text)


class Automaton:
    """ALERGIA: states of the prefix tree are merged while their end and step frequencies agree by the Hoeffding bound."""

    def __init__(self, examples: list[str], alpha: float = 0.01, longest: int = 64):
        self.n, self.end, self.step = [0], [0], [{}]  # per state: visits, ends, symbol -> [next, visits]
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        for x in examples:
            self._add(symbols(x)[:longest])
        self._merge_all()
        self.log = [
            {s: math.log(c / n) for s, (_, c) in step.items()} | ({"": math.log(e / n)} if e else {})
            for n, e, step in zip(self.n, self.end, self.step)
        ]
        self.next = [{s: q for s, (q, _) in step.items()} for step in self.step]

    def _add(self, x: str) -> None:
        q = 0
        for s in x:
            self.n[q] += 1
            if s not in self.step[q]:
                self.step[q][s] = [len(self.n), 0]
                self.n.append(0)
                self.end.append(0)
                self.step.append({})
            edge = self.step[q][s]
            edge[1] += 1
            q = edge[0]
        self.n[q] += 1
        self.end[q] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self._bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            na, nb = self.n[a], self.n[b]
            if not na or not nb:
                continue
            if self._differ(self.end[a], na, self.end[b], nb):
                return False
            sa, sb = self.step[a], self.step[b]
            for s in sa.keys() | sb.keys():
                if self._differ(sa[s][1] if s in sa else 0, na, sb[s][1] if s in sb else 0, nb):
                    return False
                if s in sa and s in sb:
                    stack.append((sa[s][0], sb[s][0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.n[a] += self.n[b]
            self.end[a] += self.end[b]
            for s, (q, c) in self.step[b].items():
                if s in self.step[a]:
                    self.step[a][s][1] += c
                    stack.append((self.step[a][s][0], q))
                else:
                    self.step[a][s] = [q, c]

    def _merge_all(self) -> None:
        red, i = [0], 0
        while i < len(red):  # states are taken breadth first
            for s in sorted(self.step[red[i]]):
                child = self.step[red[i]][s][0]
                if child in red:
                    continue
                for r in red:
                    if self._compatible(r, child):
                        self.step[red[i]][s][0] = r
                        self._fold(r, child)
                        break
                else:
                    red.append(child)
            if all(self.step[red[i]][s][0] in red for s in self.step[red[i]]):
                i += 1

    def score(self, text: str) -> float:
        """Log probability of the string's format."""
        q, total = 0, 0.0
        for s in symbols(text):
            total += self.log[q].get(s, UNSEEN)
            q = self.next[q].get(s, 0)
        return total + self.log[q].get("", UNSEEN)

    def states(self) -> int:
        seen, todo = {0}, [0]
        while todo:
            for q in self.next[todo.pop()].values():
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        return len(seen)
