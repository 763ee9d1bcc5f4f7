"""Generalised suffix automaton over words."""

from __future__ import annotations

import numpy as np


class Automaton:
    """All substrings of some word sequences.

    A state stands for the substrings that end at the same places; ``link`` leads to
    the state of the longest suffix that ends at more places, ``size`` is the length
    of the longest substring of a state, and ``step`` maps (state, word) to the next
    state.  Word numbers are below ``1 << 32``."""

    def __init__(self):
        self.step: dict[int, int] = {}
        self.link, self.size = [-1], [0]
        self._out: list[set] = [set()]       # words that leave a state, while it is built

    def _state(self, size: int) -> int:
        self.link.append(-1)
        self.size.append(size)
        self._out.append(set())
        return len(self.size) - 1

    def _edge(self, state: int, word: int, to: int) -> None:
        self.step[state << 32 | word] = to
        self._out[state].add(word)

    def _split(self, state: int, word: int, old: int) -> int:
        """A copy of ``old`` for the substrings no longer than one that reaches it
        from ``state``."""
        copy = self._state(self.size[state] + 1)
        for w in self._out[old]:
            self._edge(copy, w, self.step[old << 32 | w])
        self.link[copy] = self.link[old]
        self.link[old] = copy
        while state >= 0 and self.step.get(state << 32 | word) == old:
            self.step[state << 32 | word] = copy
            state = self.link[state]
        return copy

    def add(self, words) -> None:
        """Add a sequence, from the start state on."""
        at = 0
        for word in words:
            to = self.step.get(at << 32 | word)
            if to is not None:
                at = to if self.size[to] == self.size[at] + 1 else self._split(at, word, to)
                continue
            new, back = self._state(self.size[at] + 1), at
            while back >= 0 and back << 32 | word not in self.step:
                self._edge(back, word, new)
                back = self.link[back]
            if back < 0:
                self.link[new] = 0
            else:
                to = self.step[back << 32 | word]
                self.link[new] = to if self.size[to] == self.size[back] + 1 else self._split(back, word, to)
            at = new

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges (state << 32 | word, next state), links and sizes."""
        n = len(self.step)
        return (np.fromiter(self.step.keys(), np.int64, n), np.fromiter(self.step.values(), np.int32, n),
                np.array(self.link, np.int32), np.array(self.size, np.int32))

    @classmethod
    def of(cls, keys, to, link, size) -> "Automaton":
        made = cls()
        made.step = dict(zip(keys.tolist(), to.tolist()))
        made.link, made.size, made._out = link.tolist(), size.tolist(), []
        return made

    def read(self, words, state: int = 0, length: int = 0):
        """Yield (state, length) after each word: the longest suffix of what was read
        that is a substring of a sequence."""
        step, link, size = self.step, self.link, self.size
        for word in words:
            to = step.get(state << 32 | word)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = step.get(state << 32 | word)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            yield state, length
