"""Exact merge-type encoding without merging, over strings of bytes or characters.

A sequence of tokens is the encoding of its text if, and only if, every two
neighbours are what merging makes of their concatenation. Whether two
tokens fit is decided by undoing their last merges, inward from the
seam, in reverse order: a merge over the seam that ranks before the merge just
undone would have come first.
"""

from __future__ import annotations

from collections.abc import Callable

PAIRS = 400_000


class Backtracker:
    """``tokens`` in merge order, single symbols first; ``join(a, b)`` is the number of the merge of two tokens or None."""

    def __init__(self, tokens: list[str], halves: list[tuple[int, int] | None], join: Callable[[int, int], int | None]):
        import ahocorasick

        self.tokens, self.join, self.halves = tokens, join, halves
        self.number = {t: k for k, t in enumerate(tokens)}
        self.size = [len(t) for t in tokens]
        self.width = len(tokens)
        self.known: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(tokens):
            if halves[k] is not None or len(t) == 1:
                self.automaton.add_word(t, k)
        self.usable = {t for k, t in enumerate(tokens) if halves[k] is not None or len(t) == 1}
        self.automaton.make_automaton()
        self.longest = self.automaton.iter_long
        self.shorter = [-1] * self.width
        for k, t in enumerate(tokens):
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in self.usable:
                    self.shorter[k] = self.number[t[:n]]
                    break

    def fit(self, a: int, b: int) -> bool:
        key = a * self.width + b
        out = self.known.get(key)
        if out is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            out = self.known[key] = self._fit(a, b)
        return out

    def _fit(self, a: int, b: int) -> bool:
        halves, before = self.halves, self.width
        while True:
            over = self.join(a, b)
            if over is not None and over < before:
                return False
            ha, hb = halves[a], halves[b]
            if ha is None and hb is None:
                return True
            # The later merge is undone first; of equal ones the right, since merging goes from the left.
            if hb is None or (ha is not None and a > b):
                before, a = a, ha[1]
            else:
                before, b = b + 1, hb[0]

    def greedy(self, word: str) -> list[int] | None:
        """Longest matches from the left, if they cover the word and all neighbours fit: then they are its encoding."""
        out = [k for _, k in self.longest(word)]
        size, known, width = self.size, self.known, self.width
        if sum([size[k] for k in out]) != len(word):
            return None
        a = out[0]
        for b in out[1:]:
            ok = known.get(a * width + b)
            if not (self.fit(a, b) if ok is None else ok):
                return None
            a = b
        return out

    def encode(self, word: str) -> list[int] | None:
        """Token numbers of a word; None if a symbol isn't in the vocabulary."""
        out = self.greedy(word) if word else []
        return self.search(word) if out is None else out

    def search(self, word: str) -> list[int] | None:
        n = len(word)
        best = [-1] * n
        size, shorter, fit, known, width = self.size, self.shorter, self.fit, self.known, self.width
        # Matches come in order of their ends, so the last one from a position is the longest.
        for end, k in self.automaton.iter(word):
            best[end - size[k] + 1] = k
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        pos, k = 0, best[0]
        while pos < n:
            if k < 0:  # nothing leads on from here
                if not out:
                    return None
                failed[pos >> 3] |= 1 << (pos & 7)
                k = out.pop()
                pos -= size[k]
                k = shorter[k]
                continue
            end = pos + size[k]
            ok = not failed[end >> 3] >> (end & 7) & 1
            if ok and out:
                ok = known.get(out[-1] * width + k)
                if ok is None:
                    ok = fit(out[-1], k)
            if ok:
                out.append(k)
                pos = end
                k = best[pos] if pos < n else -1
            else:
                k = shorter[k]
        return out
