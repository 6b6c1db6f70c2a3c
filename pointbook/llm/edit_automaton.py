"""Levenshtein automata of all terms of a lexicon at once, as one automaton over its trie.

A term is a whole word, or a stem that any ending may follow. The lexicon is a
trie; a state of the automaton is the set of (node, edits) that can be reached
with the characters read so far, where an edit is a wrong, missing or extra
character. States are made when a text first reaches them, and kept in a table
(state, character class) -> state, so that many words are run at a time by
looking up whole columns of characters.
"""

from __future__ import annotations

import numpy as np


def edits_allowed(term: str, stem: bool) -> int:
    """Edits that a misspelling of the term may have: short terms none, and stems one less than words of their length."""
    n = len(term) - 2 * stem
    return 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """Finds the term that a word is, or misspells, with the fewest edits (then the longest, then the first)."""

    def __init__(self, terms: list[tuple[str, bool]]):
        """``terms``: (text, whether it is a stem)."""
        self.terms = terms
        alphabet = sorted({c for t, _ in terms for c in t})
        self.codes = np.array([ord(c) for c in alphabet], np.uint32)  # class i + 1; class 0 is any other character
        number = {c: i + 1 for i, c in enumerate(alphabet)}
        self.children: list[dict[int, int]] = [{}]
        self.allowed, self.whole, self.stem = [0], [-1], [-1]
        for i, (text, stem) in enumerate(terms):
            path, node = [0], 0
            for c in text:
                if number[c] not in self.children[node]:
                    self.children[node][number[c]] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                    self.whole.append(-1)
                    self.stem.append(-1)
                node = self.children[node][number[c]]
                path.append(node)
            ends = self.stem if stem else self.whole
            if ends[node] < 0:
                ends[node] = i
            for n in path:  # edits that some term below may have
                self.allowed[n] = max(self.allowed[n], edits_allowed(text, stem))
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.accept: list[tuple[int, int]] = []
        self.table = np.full((64, len(alphabet) + 1), -1, np.int32)
        self._state(frozenset())  # state 0 is the dead end
        self.start = self._state(self._closed({0: 0}, {}))

    def _closed(self, at: dict[int, int], sealed: dict[int, int]) -> frozenset:
        """With characters of the terms left out, and stems that are complete. Nodes: fewest edits each; ``sealed``: complete stems."""
        todo = list(at)
        while todo:
            n = todo.pop()
            e = at[n] + 1
            for child in self.children[n].values():
                if e <= self.allowed[child] and e < at.get(child, 99):
                    at[child] = e
                    todo.append(child)
        for n, e in at.items():
            i = self.stem[n]
            if i >= 0 and e <= edits_allowed(*self.terms[i]) and e < sealed.get(i, 99):
                sealed[i] = e
        if sealed:  # one complete stem is enough: the one that would be told
            i = min(sealed, key=lambda i: self._order(i, sealed[i]))
            sealed = {i: sealed[i]}
        return frozenset([(n, e) for n, e in at.items()] + [(-1 - i, e) for i, e in sealed.items()])

    def _order(self, i: int, e: int) -> tuple:
        return e, -len(self.terms[i][0]), i

    def _state(self, found: frozenset) -> int:
        if found not in self.number:
            self.number[found] = len(self.sets)
            self.sets.append(found)
            ends = [(-1 - n, e) for n, e in found if n < 0]
            ends += [(self.whole[n], e) for n, e in found if n >= 0 and self.whole[n] >= 0 and e <= edits_allowed(*self.terms[self.whole[n]])]
            self.accept.append(min(ends, key=lambda x: self._order(*x)) if ends else (-1, 0))
            if len(self.sets) > len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
        return self.number[found]

    def _step(self, state: int, c: int) -> int:
        at: dict[int, int] = {}
        sealed: dict[int, int] = {}

        def reach(n: int, e: int) -> None:
            if e <= self.allowed[n] and e < at.get(n, 99):
                at[n] = e

        for n, e in self.sets[state]:
            if n < 0:
                sealed[-1 - n] = e
                continue
            if c in self.children[n]:
                reach(self.children[n][c], e)
            reach(n, e + 1)  # an extra character
            for child in self.children[n].values():
                reach(child, e + 1)  # a wrong one
        return self._state(self._closed(at, sealed))

    def run(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the term or -1, edits) of each word."""
        size = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(self.codes):
            at = np.searchsorted(self.codes, code)
            kind = np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == code, at + 1, 0)
        else:
            kind = np.zeros(len(code), np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        state = np.full(len(words), self.start, np.int64)
        live, j = np.flatnonzero(size > 0), 0
        while len(live):
            s, c = state[live], kind[begin[live] + j]
            got = self.table[s, c]
            if (got < 0).any():
                for a, b in {*zip(s[got < 0].tolist(), c[got < 0].tolist())}:
                    to = self._step(a, b)
                    self.table[a, b] = to
                got = self.table[s, c]
            state[live] = got
            j += 1
            live = live[(got > 0) & (size[live] > j)]
        ends = np.array(self.accept)
        return ends[state, 0], ends[state, 1]
