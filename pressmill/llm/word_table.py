"""Sums over a text's words of a vector that each distinct word has.

A worker keeps the words it has seen in a bounded table and works out the
vectors of new ones in one batch, so a model costs by distinct words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words kept, characters of them, numbers of their vectors: a table beyond one starts afresh.
ENTRIES, CHARACTERS, NUMBERS = 600_000, 32 << 20, 64 << 20


class WordTable(dict):
    """word -> row of ``matrix``; ``vectors(words)`` fills in the new rows."""

    def __init__(self, vectors: Callable[[list[str]], np.ndarray], width: int, entries: int = ENTRIES):
        super().__init__()
        self.vectors, self.entries, self.characters = vectors, max(1, min(entries, NUMBERS // width)), 0
        self.new: list[str] = []
        self.matrix, self.known = np.zeros((1024, width), np.float32), 0

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self.characters += len(word)
        i = self[word] = len(self)
        return i

    def rows(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(row of every word in turn, words of each text)."""
        if len(self) > self.entries or self.characters > CHARACTERS:
            self.clear()
            self.known = self.characters = 0
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        get = self.__getitem__
        at = np.fromiter((i for w in words for i in map(get, w)), np.int64, int(lengths.sum()))
        if self.new:
            if len(self) > len(self.matrix):
                grown = np.zeros((max(len(self), 2 * len(self.matrix)), self.matrix.shape[1]), np.float32)
                grown[: self.known] = self.matrix[: self.known]
                self.matrix = grown
            for k in range(0, len(self.new), 50_000):
                part = self.new[k : k + 50_000]
                self.matrix[self.known : self.known + len(part)] = self.vectors(part)
                self.known += len(part)
            self.new = []
        return at, lengths


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of ``values``, ``lengths`` of them each, in double precision."""
    out = np.zeros((len(lengths), values.shape[1]))
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        out[full] = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    return out


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the constant last, means, scales) by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale
