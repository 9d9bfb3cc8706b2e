"""Toxicity: compression-distance classification.

Two zstandard dictionaries are trained, one on ordinary text and one on what
toxic texts hold beyond it; the toxic one also has the ordinary content, so
that ordinary wording costs the same under both.  A window is a word between
blanks, between the halves of a fixed carrier that both dictionaries hold (else so
short a window would be stored raw and show nothing, and the library looks for no
match in an input's last bytes).  Its gain is the length under the
ordinary dictionary less the length under the toxic one.  Windows are counted by
the gain they reach (GAINS); a logistic score of the counts and the text's
length is fitted on labelled documents that the dictionaries did not see, and
shifted such that 0.3 is the best cut there.

Equal windows have equal lengths, so each distinct one is compressed once while
a worker remembers it; every window of every text counts.

Training has one result for one set of rows, whatever their order, partitions or the
interpreter's hash seed: every list is sorted, ties by id or bytes.

Only labelled rows that are not held out are learned from: a bounded sample of
``SAMPLE`` documents of either label on average, of at most LONGEST characters.
One in CHECKS of them is kept from the dictionaries and calibrates; the model that
is calibrated is the one that is used.

Nulls: a null text is empty and scores as no window; null ids are kept, have no
label and count as not held out.  Repeated labels of an id: toxic if any is.
Repeated rows each give a row; other columns are ignored; an empty table gives
an empty result; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .chunk_ids import Aging
from .word_table import WordTable, logistic, sums

SAMPLE, LONGEST, CUT, CHECKS = 2500, 60_000, 0.3, 5
DICT_BYTES, TOXIC_BYTES, TAIL_BYTES = 32 << 10, 6 << 10, 16 << 10
#: Times its chance that a telling string comes, and by how many deviations.
RATIO, CERTAIN = 8, 6
#: Windows are counted by the bytes they gain at least.
GAINS = (4, 5, 6, 7, 8)
_BEFORE, _BEHIND = b"(the carrier of a window:", b"and what follows it)"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def window(word: str) -> bytes:
    return f" {word.strip(string.punctuation)} ".encode(errors="surrogatepass")


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content zstandard's trainer picks; the samples' end if they are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(content: bytes):
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(16, min_match=3, source_size=128, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress


class Gains(Aging):
    """window -> bytes it gains; a worker remembers those of late."""

    def __init__(self, plain, toxic):
        super().__init__()
        self.plain, self.toxic = plain, toxic

    def make(self, piece: bytes) -> int:
        data = _BEFORE + piece + _BEHIND
        return len(self.plain(data)) - len(self.toxic(data))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple = ()

    def compressors(self) -> tuple:
        """Both, and a table of the gains of windows so far (words differ in marks)."""
        plain, toxic = _compressor(self.ordinary + _BEFORE + _BEHIND), _compressor(self.ordinary + self.toxic + _BEFORE + _BEHIND)
        return plain, toxic, Gains(plain, toxic)

    def hits(self, words: list[str], press: tuple) -> np.ndarray:
        """For each window and each of GAINS: does it gain as much?"""
        _, _, memo = press
        gains = np.zeros(len(words), np.int16)
        for i, word in enumerate(words):
            data = window(word)
            gains[i] = memo[data]
        return (gains[:, None] >= np.array(GAINS)).astype(np.float32)

    def score(self, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        """0 to 1 from the windows that reach each gain, and all windows."""
        w, mean, scale, shift = self.weights
        z = np.column_stack([(_features(hits, words) - mean) / scale, np.ones(len(hits))]) @ w + shift
        return np.where(hits[:, 0] > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def _features(hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    rate = np.log(np.maximum(hits, 0.3) / np.maximum(words, 1)[:, None])
    return np.column_stack([np.log1p(hits), np.minimum(hits, 1), rate])


def _grams(data: bytes) -> set[bytes]:
    return {data[i : i + n] for n in range(min(4, len(data)), 8) for i in range(len(data) - n + 1)}


def _telling_spans(data: bytes, telling: set[bytes]) -> list[bytes]:
    """The stretches of a window that telling strings cover."""
    spans: list[list[int]] = []
    for i in range(len(data)):
        ends = [i + n for n in range(4, 8) if data[i : i + n] in telling and i + n <= len(data)]
        if ends:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], *ends)
            else:
                spans.append([i, max(ends)])
    return [data[a:b] for a, b in spans]


def distinct_documents(docs: list[list[str]]) -> list[list[str]]:
    """Those of which at least half the word triples are new: near copies of one
    document would make its rare words look like something many share."""
    seen: set[int] = set()
    kept = []
    for d in docs:
        triples = {xxhash.xxh3_64_intdigest("\n".join(x).encode(errors="surrogatepass")) for x in (zip(d, d[1:], d[2:]) if len(d) > 2 else [d])}
        if 2 * len(triples - seen) >= len(triples):
            kept.append(d)
        seen |= triples
    return kept


def dictionaries(ordinary: list[list[str]], toxic: list[list[str]]) -> Model:
    """Train both dictionaries from the words of documents.

    The toxic one is trained on the windows that hold a byte string (4 to 7 long,
    blanks included) that toxic documents have RATIO times as often as its share
    among ordinary ones lets expect, and beyond doubt: what toxic texts share with each other but not with the rest.
    """
    ordinary, toxic = distinct_documents(ordinary), distinct_documents(toxic)
    plain = [b"".join(window(w) for w in d[k : k + 12]) for d in ordinary for k in range(0, len(d), 12)]
    in_toxic: Counter = Counter()
    for d in toxic:
        in_toxic.update({g for w in set(d) for g in _grams(window(w))})
    often = {g for g, n in in_toxic.items() if n >= 4}
    in_plain: Counter = Counter()
    for d in ordinary:
        in_plain.update({g for w in set(d) for g in _grams(window(w))} & often)
    telling = set()
    for g in often:
        chance = (in_plain[g] + 0.5) * len(toxic) / (len(ordinary) + 1)
        if in_toxic[g] >= RATIO * chance and in_toxic[g] - chance >= CERTAIN * (chance + 0.5) ** 0.5:
            telling.add(g)
    picked = Counter(x for d in toxic for x in {y for w in set(d) for y in _telling_spans(window(w), telling)})
    ranked = sorted(picked.items(), key=lambda x: (-x[1], x[0]))  # ties by their bytes: sets have no order to rely on
    kept = [x for x, n in ranked for _ in range(min(n, 20))]
    samples = [b"".join(kept[k : k + 20]) for k in range(0, len(kept), 20)] * 2
    content = _trained(samples, TOXIC_BYTES) if kept else b""
    # The trainer may leave out short strings: all follow it, the most frequent ones last,
    # where they are nearest; what is beyond TAIL_BYTES was met least.
    tail = b"".join(x for x, _ in reversed(ranked))[-TAIL_BYTES:]
    return Model(_trained(plain, DICT_BYTES), content + tail)


def calibrate(model: Model, docs: list[list[str]], toxic: np.ndarray) -> Model:
    """The score, and its shift that makes CUT the best cut, from unseen documents."""
    press = model.compressors()
    table = WordTable(lambda w: model.hits(w, press), len(GAINS))
    at, lengths = table.rows(docs)
    hits = sums(table.matrix[at], lengths)
    w, mean, scale = logistic(_features(hits, lengths), toxic.astype(float), ridge=0.5)
    model.weights = (w, mean, scale, 0.0)
    scores = model.score(hits, lengths)
    cuts = np.unique(np.concatenate([[CUT], scores]))
    f1 = [2 * ((scores >= c) & toxic).sum() / max(1, (scores >= c).sum() + toxic.sum()) for c in cuts]
    top = cuts[np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)]
    below = scores[scores < top[0]].max(initial=0.0)
    cut = np.clip((top[0] + below) / 2, 1e-6, 1 - 1e-6)  # in the middle of the gap
    logit = lambda p: np.log(p / (1 - p))
    model.weights = (w, mean, scale, float(logit(CUT) - logit(cut)))
    return model


def fit(docs: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Dictionaries and thresholds from a bounded sample, on the driver."""
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.withColumn("held", held_out(F.col("id"))).filter("not held").groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.filter("toxic in (0, 1)").groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    mix = F.pmod(F.xxhash64("id", F.lit("toxicity sample")), F.lit(1_000_000)) / 1e6
    picked = marked.filter(mix < F.when(F.col("toxic") == 1, F.lit(min(1.0, sample / counts[1]))).otherwise(F.lit(min(1.0, sample / counts[0]))))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter((F.coalesce(F.length("text"), F.lit(0)) > 0) & (F.length("text") <= LONGEST))
    # At most about 2 * sample ids, whatever the table's size.
    rows = texts.join(F.broadcast(picked), "id").select("id", "text", "toxic", (F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(CHECKS)) == 0).alias("check"))
    # Of texts that share an id, the first in their own order.
    one = rows.groupBy("id").agg(F.min(F.struct("text", "toxic", "check")).alias("x")).select("id", "x.text", "x.toxic", "x.check")
    # In order of ids: near copies, the trainer's samples and sums of floats depend on it.
    found = [(t, check, w) for _, t, check, w in sorted((r["id"], r["toxic"], r["check"], words_of(r["text"])) for r in one.toLocalIterator())]
    train = {k: [w for t, check, w in found if t == k and not check] for k in (0, 1)}
    checks = [(t, w) for t, check, w in found if check]
    if not train[0] or not train[1] or len({t for t, _ in checks}) < 2:
        train = {k: [w for t, _, w in found if t == k] for k in (0, 1)}
        checks = [(t, w) for t, _, w in found]
    if not train[0] or not train[1]:
        return None
    return calibrate(dictionaries(train[0], train[1]), [w for _, w in checks], np.array([t == 1 for t, _ in checks]))


_table: list = [None, None]


def score(docs: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, hits, best_gain) for every row.

    ``held_out``: a function of an id column, true where labels must not be used.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs, labels, held_out, sample, id_col, text_col)
    return with_scores(rows, model, cut).select("doc_id", "held_out", "score", "predicted", "hits")


def with_scores(docs: DataFrame, model: Model | None, cut: float = CUT, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with score, predicted and hits (named with a prefix) behind its own columns."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of fixed size
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m is not None and _table[0] is not m:
            press = m.compressors()
            _table[:] = [m, WordTable(lambda w: m.hits(w, press), len(GAINS))]
        for part, texts in common.text_slices(batches, text_col):
            hits, scores = np.zeros((len(texts), 1)), np.zeros(len(texts))
            if m is not None:
                at, lengths = _table[1].rows([words_of(x) for x in texts])
                hits = sums(_table[1].matrix[at], lengths)
                scores = m.score(hits, lengths)
            more = [pa.array(scores, pa.float64()), pa.array((scores >= cut).astype(np.int32)), pa.array(hits[:, 0].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *(f"{prefix}{x}" for x in ("score", "predicted", "hits"))])

    return docs.mapInArrow(run, f"{schema}, `{prefix}score` double, `{prefix}predicted` int, `{prefix}hits` long")


def drop_toxic(docs: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic, columns as they are."""
    scored = with_scores(docs, fit(docs, labels, held_out, sample, id_col, text_col), cut, text_col, "__tox_")
    return scored.filter("__tox_predicted = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
