"""Language ID: interpolated Kneser-Ney character models.

A language's model sees words (lower case, split at white space) as characters
between marks.  The highest order has raw counts, lower ones the number of
distinct characters seen before; an absolute discount, n1 / (n1 + 2 n2) of each
order, goes to the next lower one, down to a uniform start.  All languages
share one sorted array of 64-bit n-gram hashes an order, and one of contexts,
with a column of probabilities or back-off weights a language; look-ups are
binary searches.  The language with the lowest cross-entropy a character wins.

The score is the chance that the winner is right, a logistic function of its
lead over the second and of the length, fitted on training documents that models
of the others did not see; the final models then learn from all of the sample.
``rejected`` marks scores below ``REJECT``.

Only training rows are learned from: a bounded sample, ``SAMPLE`` documents of a
language on average (chosen by a hash of the id; of those longer than LONGEST
characters, a passage of that length at a place by hash), for every language.
Every row is scored over its whole text.

Nulls: a null text, or one without a letter, is ``und`` with score 0; null ids
are kept and count as training rows; null languages are not learned from.
Repeated rows each give a row; ties go to the first language by name.  Other
columns are ignored; an empty table gives an empty result; without any
training row every text is ``und``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .word_table import WordTable, logistic, sums

ORDER, SAMPLE, LONGEST, REJECT = 4, 1500, 100_000, 0.5
#: n-grams kept of a language and order, the most frequent ones.
KEPT = 200_000
#: Documents that calibrate, of all languages together, on average; a quarter at most.
CHECKS = 4000
START, END = "\x02", "\x03"
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def symbols(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with marks, positions to predict, positions of each word)."""
    pad = START * (order - 1)
    codes = np.frombuffer("".join(f"{pad}{w}{END}" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(lengths + order - 1) - lengths
    at = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return codes, at, lengths


def gram_hashes(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n symbols that end at each position."""
    h = np.full(len(at), 7, np.uint64)
    for k in range(n - 1, -1, -1):
        h = (h ^ codes[at - k].astype(np.uint64)) * _MULTIPLY
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    names: list[str]
    order: int
    grams: list[np.ndarray]  # sorted hashes, by order
    probs: list[np.ndarray]  # a row a hash, a column a language; 0: not seen
    contexts: list[np.ndarray]
    weights: list[np.ndarray]  # back-off weights, 1: not seen
    floor: np.ndarray
    calibration: tuple = ()

    def log10(self, words: list[str]) -> np.ndarray:
        """Sum of log10 probabilities of each word, a column a language, and its symbols."""
        codes, at, lengths = symbols(words, self.order)
        p = np.broadcast_to(self.floor, (len(at), len(self.names)))
        context = np.full(len(at), 7, np.uint64)
        for n in range(1, self.order + 1):
            if n > 1:
                context = gram_hashes(codes, at - 1, n - 1)
            w = _found(self.contexts[n - 1], self.weights[n - 1], context, 1.0)
            p = _found(self.grams[n - 1], self.probs[n - 1], gram_hashes(codes, at, n), 0.0) + w * p
        logs = np.add.reduceat(np.log10(p), np.cumsum(lengths) - lengths, axis=0)
        return np.column_stack([logs, lengths])


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[i] == wanted)[:, None], values[i], np.float32(other))


def _one_language(counts: Counter, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, discounted share, contexts, back-off weights) for each order."""
    words = list(counts)
    codes, at, lengths = symbols(words, order)
    times = np.repeat(np.fromiter(counts.values(), np.float64, len(words)), lengths)
    out = []
    for n in range(1, order + 1):
        gram, context = gram_hashes(codes, at, n), gram_hashes(codes, at - 1, n - 1) if n > 1 else np.full(len(at), 7, np.uint64)
        keys, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
        if n == order:
            c = np.bincount(inverse, times)
        else:  # distinct symbols before it
            longer = np.unique(gram_hashes(codes, at, n + 1), return_index=True)[1]
            c = np.bincount(inverse[longer], minlength=len(keys)).astype(float)
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        hs, h = np.unique(context[first], return_inverse=True)
        total, kinds = np.bincount(h, c), np.bincount(h)
        share, weight = (c - d) / total[h], d * kinds / total
        if len(keys) > KEPT:  # what goes is given to the lower orders
            keep = np.sort(np.argpartition(-c, KEPT)[:KEPT])
            weight = 1 - np.bincount(h[keep], share[keep], minlength=len(hs))
            keys, share = keys[keep], share[keep]
        out.append((keys, share, hs, weight))
    return out


def train_models(samples: dict[str, Counter], order: int = ORDER) -> Model:
    """Models from word counts by language."""
    names = sorted(samples)
    parts = [_one_language(samples[x], order) for x in names]
    alphabet = len({c for s in samples.values() for w in s for c in w}) + 1  # and the end; one more for what is unknown
    model = Model(names, order, [], [], [], [], np.full(len(names), 1 / (alphabet + 1), np.float32))
    for n in range(order):
        for keys, values, k, other in ((model.grams, model.probs, 0, 0.0), (model.contexts, model.weights, 2, 1.0)):
            union = np.unique(np.concatenate([p[n][k] for p in parts]))
            table = np.full((len(union), len(names)), other, np.float32)
            for j, p in enumerate(parts):
                table[np.searchsorted(union, p[n][k]), j] = p[n][k + 1]
            keys.append(union)
            values.append(table)
    return model


def features(logs: np.ndarray) -> np.ndarray:
    """(lead over the second a symbol, log of the symbols) from summed logs."""
    n = np.maximum(logs[:, -1], 1)
    each = np.sort(logs[:, :-1] / n[:, None], axis=1)
    lead = each[:, -1] - each[:, -2] if each.shape[1] > 1 else np.ones(len(each))
    return np.column_stack([lead, np.minimum(lead * n, 50), np.log1p(n)])


def sample_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text, check): a bounded sample of each language, long texts as passages."""
    known = docs.filter("lang is not null and text is not null and not held_out")
    shares = known.groupBy("lang").agg(F.least(F.lit(1.0), sample / F.count("*")).alias("share"))  # a row a language
    mix = lambda what: F.pmod(F.xxhash64("doc_id", F.lit(what)), F.lit(1_000_000)) / 1e6
    check = mix("calibration") < min(0.25, CHECKS / (sample * max(1, known.select("lang").distinct().count())))
    start = F.floor(mix("passage") * (F.length("text") - LONGEST + 1)).cast("int") + 1
    text = F.when(F.length("text") > LONGEST, F.substring(F.col("text"), start, F.lit(LONGEST))).otherwise(F.col("text"))
    return known.join(F.broadcast(shares), "lang").filter(mix("language sample") < F.col("share")).select("lang", text.alias("text"), check.alias("check"))


def fit(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> Model | None:
    """Models and calibration from a bounded sample, on the driver."""
    counts: dict[str, Counter] = {}
    others: dict[str, Counter] = {}
    checks = []
    for row in sample_rows(docs, sample).toLocalIterator():
        words = words_of(row["text"])
        (others if row["check"] else counts).setdefault(row["lang"], Counter()).update(words)
        if row["check"]:
            checks.append((row["lang"], words))
    whole = {k: counts.get(k, Counter()) + others.get(k, Counter()) for k in counts | others}
    whole, counts = {k: v for k, v in whole.items() if v}, {k: v for k, v in counts.items() if v}
    if not whole:
        return None
    final = train_models(whole, order)
    final.calibration = calibrated(train_models(counts, order), checks) if counts else UNCALIBRATED
    return final


#: Where nothing can be told apart: a fixed slope on the lead.
UNCALIBRATED = (np.array([2.0, 2.0, 0.5, 2.0]), np.array([0.05, 5.0, 5.0]), np.array([0.1, 10.0, 2.0]))


def calibrated(model: Model, checks: list[tuple[str, list[str]]]) -> tuple:
    """The logistic function that tells right winners, from documents that ``model`` did not see."""
    table = WordTable(model.log10, len(model.names) + 1)
    checks = [x for x in checks if x[1] and x[0] in model.names]
    at, lengths = table.rows([w for _, w in checks])
    logs = sums(table.matrix[at], lengths)
    right = np.array([model.names[i] == lang for i, (lang, _) in zip(logs[:, :-1].argmax(1), checks, strict=True)], float) if checks else np.zeros(0)
    return logistic(features(logs), right) if len(right) and right.min() != right.max() else UNCALIBRATED


_table: list = [None, None]


def predict(docs: DataFrame, held_out, order: int = ORDER, sample: int = SAMPLE, reject: float = REJECT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row.

    ``held_out``: a boolean column; rows where it is true are not learned from.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out.alias("held_out"))
    model = fit(rows, order, sample)
    shared = spark.sparkContext.broadcast(model)  # bounded by KEPT, orders and languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m is not None and _table[0] is not m:
            _table[:] = [m, WordTable(m.log10, len(m.names) + 1)]
        for part, texts in common.text_slices(batches):
            if m is None:
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
            else:
                at, lengths = _table[1].rows([words_of(x) for x in texts])
                logs = sums(_table[1].matrix[at], lengths)
                w, mean, scale = m.calibration
                z = np.column_stack([(features(logs) - mean) / scale, np.ones(len(texts))]) @ w
                letters = np.array([any(map(str.isalpha, x)) for x in texts], bool)
                scores = np.where(letters, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
                names = [m.names[i] if ok else "und" for i, ok in zip(logs[:, :-1].argmax(1), letters, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(scores < reject, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
