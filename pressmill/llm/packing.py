"""Sequence packing: order-preserving dynamic programming over cut points.

The rows of a partition form one stream of ids in their stored order.  Cuts may
fall at document ends (free), sentence ends (a penalty), and, where neither
comes for long, at fixed steps (a larger penalty).  With positions p, the least
cost up to cut j is

    f(j) = w(j) + min over p(j) - p(i) <= S of  f(i) + S - (p(j) - p(i))

Since S - p(j) doesn't depend on i, the minimum of f(i) + p(i) over a sliding
window is kept in a monotone queue: one push and one pop a cut, O(n) in all.

A partition is packed in blocks of ``block`` sequences; what lies behind a
block's best last cut opens the next block, so memory is bounded by a block and
a row.  The partition's last sequence is cut into powers of two, which need no
padding.  There is no shuffle: tasks repeat exactly on the rows of their split,
and a sequence id is (partition, number).

Nulls: a null text packs as its end id alone; a null doc_id is kept.  Repeated
rows are packed each.  Any other column is ignored; an empty table gives an
empty result; a text of any length is cut as needed.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunk_ids, common

VOCABULARY, END_ID, SEQUENCE = "word_bpe_49k.json", 2, 4096
SENTENCE_PENALTY, HARD_PENALTY, HARD_STEP, BLOCK = 24, 96, 256, 96
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut string"


@lru_cache(maxsize=4)
def sentence_ends(path: str) -> np.ndarray:
    """For each id: does its text end a sentence (., !, ?, or a CJK stop)?"""
    tokenizer = chunk_ids.load(path)
    end = tokenizer.model.end_of_word_suffix or ""
    flags = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    back = {c: b for b, c in enumerate(chunk_ids.byte_letters())}
    for token, i in tokenizer.get_vocab().items():
        raw = bytes(back.get(c, 0) for c in token.removesuffix(end)).decode(errors="ignore")
        flags[i] = token.endswith(end) and raw.endswith((".", "!", "?", "。", "！", "？"))
    return flags


def best_cuts(positions: list[int], penalties: list[int], size: int) -> tuple[list[int], list[int]]:
    """(f, previous) for ascending positions, the first being the start."""
    cost, back = [0] * len(positions), [0] * len(positions)
    queue, keys = deque([0]), [positions[0]] + [0] * (len(positions) - 1)
    for j in range(1, len(positions)):
        p = positions[j]
        while p - positions[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        back[j] = i
        cost[j] = keys[i] + size - p + penalties[j]
        key = keys[j] = cost[j] + p
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    return cost, back


def powers_of_two(length: int, size: int) -> list[int]:
    """Lengths, each a power of two or ``size``, that sum to ``length``."""
    out = []
    while length:
        out.append(min(size, 1 << (length.bit_length() - 1)))
        length -= out[-1]
    return out


class Packer:
    """Feed rows in order; pieces come out once their sequences are settled."""

    def __init__(self, size: int, ends: np.ndarray, first_sequence: int, block: int = BLOCK, sentence: int = SENTENCE_PENALTY, hard: int = HARD_PENALTY):
        self.size, self.ends, self.sequence, self.block = size, ends, first_sequence, block * size
        self.sentence, self.hard = sentence, hard
        self.rows: list[tuple] = []  # (doc_id, ids as bytes, first id not packed yet, ids)
        self.held = 0
        self.out: list[list] = [[] for _ in range(8)]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.rows.append((doc_id, ids, 0, len(ids) // 4))
        self.held += len(ids) // 4
        if self.held >= self.block:
            self.settle(last=False)

    def points(self) -> tuple[list[int], list[int]]:
        positions, penalties, base = [0], [0], 0
        step = min(HARD_STEP, self.size)
        for _, ids, first, n in self.rows:
            left = n - first
            inner = np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")[first:-1]]) + 1
            inner = inner[inner < left]
            bounds = np.concatenate(([0], inner, [left]))
            gaps = np.diff(bounds)
            if gaps.max() > step:
                marks = [(b, self.sentence) for b in inner.tolist()]
                for b, gap in zip(bounds.tolist(), gaps.tolist()):
                    marks += [(b + k, self.hard) for k in range(step, gap, step)]
                marks.sort()
                positions += [base + b for b, _ in marks]
                penalties += [w for _, w in marks]
            else:
                positions += (inner + base).tolist()
                penalties += [self.sentence] * len(inner)
            base += left
            positions.append(base)
            penalties.append(0)
        return positions, penalties

    def settle(self, last: bool) -> None:
        if not self.rows:
            return
        positions, penalties = self.points()
        cost, back = best_cuts(positions, penalties, self.size)
        total, j = positions[-1], len(positions) - 1
        best = min((k for k in range(j, -1, -1) if positions[k] > total - self.size), key=cost.__getitem__)
        cuts = []
        while best:
            cuts.append(positions[best])
            best = back[best]
        cuts.reverse()
        if last:
            at = cuts[-1] if cuts else 0
            for length in powers_of_two(total - at, self.size):
                cuts.append(at := at + length)
        self.emit(cuts)

    def emit(self, cuts: list[int]) -> None:
        row = at = 0
        for cut in cuts:
            offset = 0
            while at < cut:
                doc_id, ids, first, n = self.rows[row]
                length = min(cut - at, n - first)
                piece = ids[4 * first : 4 * (first + length)]
                done = first + length == n
                kind = "document" if done else "sentence" if self.ends[int.from_bytes(piece[-4:], "little")] else "hard"
                for column, value in zip(self.out, (doc_id, first, length, common.crc(piece), n, self.sequence, offset, kind), strict=True):
                    column.append(value)
                at, offset = at + length, offset + length
                self.rows[row] = (doc_id, ids, first + length, n)
                row += done
            self.sequence += 1
        self.rows = self.rows[row:]
        self.held -= at

    def taken(self) -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.out, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
        self.out = [[] for _ in range(8)]
        return batch


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: where its ids lie in their document and their sequence.

    ``cut`` says why the piece ends: ``document``, ``sentence`` or ``hard``.
    """
    common.bounded_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_ids.encoder(vocabulary)
        ends = sentence_ends(vocabulary)
        if len(ends) <= end_id:
            ends = np.append(ends, np.zeros(end_id + 1 - len(ends), bool))
        packer = Packer(size, ends, TaskContext.get().partitionId() << 40)
        for part, texts in common.text_slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                packer.add(doc_id, encoder.ids(text) + end)
            yield packer.taken()
        packer.settle(last=True)
        yield packer.taken()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
