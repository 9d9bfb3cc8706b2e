"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz.

A run is a stretch of words with smallest period q that no neighbouring word
extends, of at least max(LENGTH, EXPONENT * q) words.  Shifted by q it overlaps
itself in at least GRAM = min over q of max(LENGTH, EXPONENT * q) - q words, and
the two copies of that overlap cover it.  So every word of a run lies in a GRAM-gram
that its document holds twice, and all other words are masked.  What is left falls
into segments; a run lies in one of them whole, since the words that could extend
it would be covered too.

Main-Lorentz divides each segment in halves.  A run across the middle has at least
EXPONENT / 2 periods on one side; for every period that fits there the longest
extensions to the right and to the left of the middle and of its copy one period
away give the run.  Runs within a half are found there.  All segments of a batch
are divided together, level by level, as array operations; the extensions come
from classes of equal stretches of 1, 2, 4, .. words (each class numbered by the
pair of its halves' classes, so equality is exact).  A stretch found under several
periods has the least of them.

A document is one task's work and needs memory for its surviving words times the
logarithm of its longest segment; nothing is shuffled, so hot sources don't matter
and a lost task is simply run again.

Nulls: a null text has no words; a null id is kept, and no rewriting is asked for.
Empty texts give empty runs and an empty text.  Repeated rows and ids each give a
row.  Other columns are ignored whatever their names; an empty table gives an empty
result.  Runs come by start, then period; there are no other ties.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, EXPONENT = 6, 4
#: Bytes of text whose words are numbered together (a longer text comes alone).
GROUP_BYTES = 4 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def gram(length: int = LENGTH, exponent: int = EXPONENT) -> int:
    """The least overlap of a run with itself one period on."""
    return min(max(length, exponent * q) - q for q in range(1, length + 1))


def repeated(words: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that occurs twice in their document (or in one
    that shares its hash: a word too many masks nothing away)."""
    n = len(words) - k + 1
    out = np.zeros(len(words), bool)
    if n < 2:
        return out
    h = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        h = (h ^ words[i : i + n].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    at = at[np.argsort(h[at], kind="stable")]
    same = h[at][1:] == h[at][:-1]
    hit = np.zeros(n, bool)
    hit[at[1:][same]] = hit[at[:-1][same]] = True
    for i in range(k):
        out[i : i + n] |= hit
    return out


class Extensions:
    """How far two places agree, to the right and to the left."""

    def __init__(self, text: np.ndarray, longest: int):
        """``text`` has every separator once, so nothing agrees across one."""
        classes = np.unique(text, return_inverse=True)[1].astype(np.int32)
        self.levels = [classes]
        while 2 << (len(self.levels) - 1) <= longest:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            pair = last[:-half].astype(np.int64) * (len(text) + 1) + last[half:]
            found, classes = np.unique(pair, return_inverse=True)
            self.levels.append(classes.astype(np.int32))
            if len(found) == len(pair):  # all differ, and so will longer ones
                break

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words from a on that equal those from b on."""
        out = np.zeros(len(a), np.int64)
        for level in reversed(range(len(self.levels))):
            of, step = self.levels[level], 1 << level
            while True:  # the top level may fit several times
                x, y = a + out, b + out
                fits = np.flatnonzero(np.maximum(x, y) < len(of))
                fits = fits[of[x[fits]] == of[y[fits]]]
                out[fits] += step
                if level < len(self.levels) - 1 or not len(fits):
                    break
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words up to and with a that equal those up to b."""
        out = np.zeros(len(a), np.int64)
        for level in reversed(range(len(self.levels))):
            of, step = self.levels[level], 1 << level
            while True:
                x, y = a - out - step + 1, b - out - step + 1
                fits = np.flatnonzero(np.minimum(x, y) >= 0)
                fits = fits[of[x[fits]] == of[y[fits]]]
                out[fits] += step
                if level < len(self.levels) - 1 or not len(fits):
                    break
        return out


def _counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, 1..n of it) for every number up to n."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(1, len(which) + 1) - np.repeat(np.cumsum(n) - n, n)


def main_lorentz(text: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs within the segments lo..hi of ``text``."""
    reach = Extensions(text, int((hi - lo).max(initial=1)))
    found = [[np.zeros(0, np.int64)] * 3]
    while len(lo):
        mid = (lo + hi) // 2
        which, q = _counted((hi - mid) * 2 // exponent)
        a = mid[which]
        near = (text[a] == text[a + q]) | (exponent == 2)  # beyond 2, the first words must agree
        a, q = a[near], q[near]
        more = reach.right(a, a + q)
        enough = 2 * more >= (exponent - 2) * q
        a, q, more = a[enough], q[enough], more[enough]
        found.append([a - reach.left(a - 1, a - 1 + q), a + q + more, q])
        which, q = _counted((mid - lo) * 2 // exponent)
        a = mid[which] - 1
        near = (text[a] == text[a - q]) | (exponent == 2)
        a, q = a[near], q[near]
        more = reach.left(a, a - q)
        enough = 2 * more >= (exponent - 2) * q
        a, q, more = a[enough], q[enough], more[enough]
        found.append([a + 1 - q - more, a + 1 + reach.right(a + 1, a + 1 - q), q])
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        large = hi - lo >= length
        lo, hi = lo[large], hi[large]
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    run = end - start >= np.maximum(length, exponent * period)
    start, end, period = start[run], end[run], period[run]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs(words: np.ndarray, doc: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs among numbered words; ``doc`` numbers their
    documents in order, and no run crosses from one to the next."""
    live = repeated(words, doc, gram(length, exponent))
    live = np.concatenate([[False], live, [False]])
    cut = np.zeros(len(live), bool)
    cut[2:-1] = doc[1:] != doc[:-1]
    lo = np.flatnonzero(live[1:] & (~live[:-1] | cut[1:]))
    hi = np.flatnonzero(live[:-1] & (~live[1:] | cut[1:]))
    long = hi - lo >= length
    lo, hi = lo[long], hi[long]
    if not len(lo):
        return lo, lo, lo
    # The segments alone, a separator of its own behind each.
    size = hi - lo + 1
    base = np.cumsum(size) - size
    text = np.zeros(size.sum(), np.int64)
    text[base + size - 1] = -1 - np.arange(len(lo))
    which, inside = _counted(size - 1)
    text[base[which] + inside - 1] = words[lo[which] + inside - 1]
    start, end, period = main_lorentz(text, base, base + size - 1, length, exponent)
    of = np.searchsorted(base, start, "right") - 1
    back = lo[of] - base[of]
    return start + back, end + back, period


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[int, int], np.ndarray | None] | None = None, length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every document's runs, and its words
    without those that a run holds after its first period.

    ``rewrite(doc_id, words)`` may give the numbers of the words to read instead
    of 0, 1, 2, ..; None leaves the text as it is."""
    common.bounded_batches(docs.sparkSession)
    if exponent < 2 or length < 2:
        raise ValueError("runs repeat at least once")

    def grouped(sizes: list[int]) -> Iterator[tuple[int, int]]:
        begin = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > GROUP_BYTES:
                yield begin, i
                begin, held = i, 0
            held += n
        if begin < len(sizes):
            yield begin, len(sizes)

    def one(ids: list, texts: list) -> pa.RecordBatch:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        tokens, coded = [], []
        for i, text in zip(ids, texts, strict=True):
            mine = (text or b"").split()
            at = None if rewrite is None or i is None else rewrite(i, len(mine))
            if at is not None:
                mine = [mine[j] for j in at.tolist()]
            tokens.append(mine)
            coded.append(np.fromiter(map(number.__getitem__, mine), np.int64, len(mine)))
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        offset = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(tokens)), sizes)
        start, end, period = runs(np.concatenate(coded), doc, length, exponent)
        at = doc[start]
        # A word goes if more of these stretches began than ended.
        change = np.zeros(len(doc) + 1, np.int32)
        np.add.at(change, start + period, 1)
        np.add.at(change, end, -1)
        gone = np.cumsum(change[:-1]) > 0
        bounds = np.searchsorted(at, np.arange(len(tokens) + 1))
        kept = []
        for k in range(len(tokens)):
            if bounds[k] < bounds[k + 1]:
                stay = np.flatnonzero(~gone[offset[k] : offset[k] + sizes[k]])
                kept.append(b" ".join([tokens[k][j] for j in stay.tolist()]))
            else:
                kept.append(b" ".join(tokens[k]))
        fields = [pa.array(x.astype(np.int64)) for x in (start - offset[at], end - start, period)]
        spans = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), spans, pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in grouped(sizes):
                part = batch.slice(a, b - a)
                yield one(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def strongest(spans: Column) -> Column:
    """The run with the greatest exact length / period; the first of equals."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(spans, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda a, b: F.when(better(a, b), b).otherwise(a))


def digest(found: DataFrame) -> DataFrame:
    """A row per document: counts, the strongest run, hashes of all runs and of the text left."""
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(doc_id: int, n: int) -> np.ndarray | None:
    """The stated rewriting of one document in ten: from a word on, its text repeats."""
    h = common.crc(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


#: Words that share a 5-gram q apart, in a row, are a run of period q.  crc32 comes
#: from its table of 256 values, made by shifting.
ORACLE_SQL = r"""
with recursive shifting as (
  select b::bigint as b, b::bigint as c, 0 as k from range(256) t(b)
  union all
  select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from shifting where k < 8
), steps as (
  select list(c order by b) as t from shifting where k = 8
), split as (
  select doc_id, [w for w in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if w != ''] as words,
    xor(list_reduce(list_prepend(4294967295, [ascii(x)::bigint for x in string_split(doc_id::varchar, '')]), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) as h
  from documents, steps
), planned as (
  select *, len(words) as n, case when h % 10 = 0 and len(words) > 0 then (h // 10) % len(words) else len(words) end as a, 3 + (h // 10) % 8 as parts from split
), texts as (
  select doc_id, n, case when a = n then words else words[1:a] || [words[1 + a + i % (1 + (n - a) // parts)] for i in range(n - a)] end as words from planned
), w as (
  select doc_id, unnest(range(n)) as i, unnest(words) as w from texts
), grams as (
  select doc_id, i, list(w) over (partition by doc_id order by i rows between current row and 4 following) as g from w
), pairs as (
  select a.doc_id, a.i, b.i - a.i as q from (select * from grams where len(g) = 5) a join (select * from grams where len(g) = 5) b on a.doc_id = b.doc_id and a.g = b.g and a.i < b.i
), islands as (
  select doc_id, q, min(i) as s, max(i) + 5 + q as e from (select *, i - row_number() over (partition by doc_id, q order by i) as island from pairs) group by doc_id, q, island
), runs as (
  select doc_id, s, e - s as l, min(q) as q from islands where e - s >= greatest(6, 4 * q) group by doc_id, s, e
), described as (
  select doc_id, count(*) as n_runs, arg_max({'s': s, 'l': l, 'q': q}, {'x': l::decimal(18, 0) * 1000000000000 // q, 's': -s, 'q': -q}) as b,
    sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q)) as runs_sha256
  from runs group by doc_id
), gone as (
  select distinct doc_id, unnest(range(s + q, s + l)) as i from runs
), kept as (
  select w.doc_id, sha256(string_agg(w, ' ' order by w.i)) as c from w anti join gone on w.doc_id = gone.doc_id and w.i = gone.i group by w.doc_id
)
select t.doc_id, coalesce(n_runs, 0) as n_runs, b.s as start, b.l as length, b.q as period, (1000 * b.l) // b.q as exponent_milli,
  coalesce(runs_sha256, sha256('')) as runs_sha256, coalesce(c, sha256('')) as collapsed_sha256
from texts t left join described d on t.doc_id = d.doc_id left join kept k on t.doc_id = k.doc_id
"""
