"""Subword ids of words, by the rank file of a public byte-level vocabulary.

A text's ids are those of its words (a blank in front of each) end to end, so a
word's ids are worked out once while a worker remembers it.  The library merges a
run without a cut in time that grows with its square; a word of over ``RUN`` bytes
is cut there first: its ids still spell it.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import tiktoken

from . import chunk_ids

RUN = 400
#: Words a worker keeps, and their bytes: a table beyond one starts afresh.
ENTRIES, BYTES = 500_000, 32 << 20


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(chunk_ids.resolve(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def size(path: str) -> int:
    """Ids of the vocabulary, which are 0 and up."""
    return encoding(path).max_token_value + 1


@lru_cache(maxsize=2)
def _leading(path: str) -> np.ndarray:
    """For each id: does it start with a blank?"""
    return np.array([encoding(path).decode_single_token_bytes(i)[:1] == b" " for i in range(size(path))])


def ids_of(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words end to end, how many each has); words hold no ASCII blanks."""
    encode = encoding(path).encode_to_numpy
    if any(len(w) > RUN for w in words):
        parts = [np.concatenate([encode(x, disallowed_special=()) for x in _cut(w)]) for w in words]
        return np.concatenate(parts), np.array([len(p) for p in parts])
    # Blanks lead a piece: no merge reaches from a word into the next.
    found = encode(b"".join(b" " + w for w in words).decode(), disallowed_special=()) if words else np.zeros(0, np.uint32)
    starts = np.flatnonzero(_leading(path)[found])
    return found, np.diff(np.append(starts, len(found)))


def _cut(word: bytes) -> list[str]:
    text = f" {word.decode()}"
    return [text[k : k + RUN] for k in range(0, len(text), RUN)]


class Words(dict):
    """word -> its place; ``rows`` fills in ids and values of those that are new."""

    def __init__(self, path: str, values: dict[bytes, float]):
        super().__init__()
        self.path, self.of = path, values
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.words: list[bytes] = []
        self.bytes = self.done = self.used = 0
        self.values, self.counts, self.starts = np.zeros(1024), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self.bytes += len(word)
        i = self[word] = len(self)
        return i

    def rows(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(place of every word in turn, words of each text)."""
        if len(self) > ENTRIES or self.bytes > BYTES:
            self.reset()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
        for k in range(self.done, len(self.words), 20_000):
            self._add(self.words[k : k + 20_000])
        return at, lengths

    def _add(self, new: list[bytes]) -> None:
        ids, counts = ids_of(new, self.path)
        a, b = self.done, self.done + len(new)
        self.values, self.counts, self.starts = (_grown(x, b) for x in (self.values, self.counts, self.starts))
        self.flat = _grown(self.flat, self.used + len(ids))
        self.values[a:b] = [self.of.get(w, np.nan) for w in new]
        self.counts[a:b], self.starts[a:b] = counts, self.used + np.cumsum(counts) - counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.done, self.used = b, self.used + len(ids)

    def ids(self, at: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts end to end, each with ``end`` behind it, how many each has)."""
        n = self.counts[at]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        words = self.flat[np.repeat(self.starts[at], n) + inside]
        upto = np.append(0, np.cumsum(n))[np.cumsum(lengths)]  # ids of all texts so far
        each = np.diff(upto, prepend=0)
        out = np.empty(len(words) + len(lengths), np.uint32)
        last = upto + np.arange(len(lengths))
        keep = np.ones(len(out), bool)
        keep[last] = False
        out[last], out[keep] = end, words
        return out, each + 1


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out
