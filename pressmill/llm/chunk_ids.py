"""Exact token ids of whole texts through a table of white-space-bound chunks.

Both public vocabularies split a text into pre-tokens that never reach across
certain cut points, and merges stay inside a pre-token.  So a text may be cut
there, each piece encoded alone by the library, and the ids joined:

* ``word``: white space is dropped and every other pattern excludes it, hence
  every run of white space is a cut.  NFC and lower-casing act inside a run of
  other characters.  Python's ``split`` also cuts at U+001C..U+001F, which the
  vocabulary counts as text; such texts go to the library whole.
* ``byte``: a pre-token that has a non-space holds white space only as one
  leading blank, so a blank between two non-spaces starts a new pre-token.
  Texts with other white space beside a blank go to the library whole.

Special strings hold no white space, so the library finds them in a piece as
it does in the text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Pieces kept in a worker's table, and the longest piece kept.
TABLE_ENTRIES, TABLE_CHARS = 500_000, 48

#: Letters that NFC leaves alone and that lower-case one to one, then ASCII marks.
PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-/:-@\[-`{-~]*)\Z")
_WIDE_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def resolve(path: str) -> str:
    """A path as given, or the place of a public vocabulary file of that name."""
    return path if "/" in path else public_tokenizers.path(path)


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(resolve(path))


def kind_of(tokenizer: Tokenizer) -> str:
    """``word`` or ``byte``, as the module text describes; else ``whole``."""
    pre = str(tokenizer.pre_tokenizer)
    if tokenizer.normalizer is None and pre.startswith("ByteLevel(") and "add_prefix_space=False" in pre and "use_regex=True" in pre:
        return "byte"
    if r"[^\s\p{L}\p{N}]+" in pre and "behavior=Removed" in pre and r"\s+" in str(tokenizer.normalizer):
        return "word"
    return "whole"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [rest.get(b) or chr(b) for b in range(256)]


_LETTERS = byte_letters()


def spelled(word: str) -> str:
    """A word as the byte-level vocabulary spells it."""
    return word if word.isascii() else "".join(map(_LETTERS.__getitem__, word.encode()))


class Aging(dict):
    """A self-filling table in two generations: a full one ages, then goes."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}

    def make(self, piece: str):
        raise NotImplementedError

    def __missing__(self, piece: str):
        if (value := self.old.get(piece)) is None:
            value = self.make(piece)
        if len(piece) <= TABLE_CHARS:
            if len(self) >= TABLE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value


class _Stems(Aging):
    """pre-token of letters, as spelled -> ids: merges only."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.merge = Tokenizer(tokenizer.model).encode

    def make(self, piece: str) -> bytes:
        return np.array(self.merge(piece).ids, "<u4").tobytes()


class _Table(Aging):
    """piece -> little-endian unsigned 32-bit ids."""

    def __init__(self, tokenizer: Tokenizer, kind: str):
        super().__init__()
        self.encode, self.kind, self.stems = tokenizer.encode, kind, _Stems(tokenizer)
        self.marks: dict[str, bytes] = {}

    def library(self, piece: str) -> bytes:
        return np.array(self.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def marked(self, marks: str) -> bytes:
        if not marks:
            return b""
        if (ids := self.marks.get(marks)) is None:
            ids = self.library(marks)
            if len(self.marks) < 10_000:
                self.marks[marks] = ids
        return ids

    def bare(self, piece: str) -> bytes:
        """A piece as it stands, with no blank before it."""
        if m := PLAIN.match(piece):
            return self.stems[spelled(m[1].lower() if self.kind == "word" else m[1])] + self.marked(m[2])
        return self.library(piece)

    def make(self, piece: str) -> bytes:
        if self.kind == "word":
            return self.bare(piece)
        if m := PLAIN.match(piece):
            return self.stems[f"Ġ{spelled(m[1])}"] + self.marked(m[2])
        left, line_end, right = piece.partition("\n")
        if left and line_end and PLAIN.match(right):  # a lone line end is a pre-token
            return self[left] + self.marked("\n") + self.bare(right)
        return self.library(f" {piece}")


def _single_blanks(text: str) -> bool:
    """Every blank stands between two non-spaces (others may hold white space)."""
    if "  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace():
        return False
    if any(x in text for x in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"):
        return False
    return text.isascii() or not _WIDE_SPACE.search(text)


class ChunkEncoder:
    """``ids(text)``: the library's ids of a whole text, as bytes."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.kind = kind_of(self.tokenizer)
        self.table = _Table(self.tokenizer, self.kind)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        get = self.table.__getitem__
        if self.kind == "word" and not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text):
            return b"".join(map(get, text.split()))
        if self.kind == "byte" and _single_blanks(text):
            first, *rest = text.split(" ")
            return self.table.bare(first) + b"".join(map(get, rest))
        return self.table.library(text)


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One encoder a Python worker; its table outlives the task."""
    return ChunkEncoder(path)
