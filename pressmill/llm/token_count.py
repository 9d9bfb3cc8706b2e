"""Token counts: whole-token shortcut.

Offline, every vocabulary string is encoded alone by the library; those that
come back as exactly their own id are proven whole tokens.  A pre-token equal
to one of them counts 1 without merging, since merges never leave a pre-token.
Only the rest is merged, once for each distinct piece a worker sees.

Nulls: a null text counts as the empty text (0 bytes, 0 tokens); a null doc_id
is kept.  Repeated rows each give a row.  Any other column is ignored.  An
empty table gives an empty result.  A text of any length is counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunk_ids, common

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048

_BYTES = {c: b for b, c in enumerate(chunk_ids.byte_letters())}


def _surface(token: str) -> str:
    """The text of a byte-level vocabulary string, or '' if it has none."""
    try:
        return bytes(_BYTES[c] for c in token).decode()
    except (KeyError, UnicodeDecodeError):
        return ""


@lru_cache(maxsize=2)
def whole_tokens(path: str = VOCABULARY) -> frozenset[str]:
    """Texts proven to encode alone as one token (bounded by the vocabulary)."""
    tokenizer = chunk_ids.load(path)
    end = tokenizer.model.end_of_word_suffix or ""
    texts = {}
    for token, i in tokenizer.get_vocab().items():
        if token.endswith(end) and (text := _surface(token[: len(token) - len(end)])):
            texts[text] = i
    names = sorted(texts)
    found = tokenizer.encode_batch_fast(names, add_special_tokens=False)
    return frozenset(t for t, e in zip(names, found, strict=True) if e.ids == [texts[t]])


class _Counts(chunk_ids.Aging):
    """piece -> tokens."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__()
        tokenizer = chunk_ids.load(path)
        self.encode, self.merge, self.whole = tokenizer.encode, chunk_ids.Tokenizer(tokenizer.model).encode, whole
        self.stems: dict[str, int] = {}

    def library(self, piece: str) -> int:
        return len(self.encode(piece, add_special_tokens=False))

    def make(self, piece: str) -> int:
        if piece in self.whole:
            return 1
        if not (m := chunk_ids.PLAIN.match(piece)):
            return self.library(piece)
        word, marks = m[1].lower(), m[2]
        if word in self.whole:
            n = 1
        elif (n := self.stems.get(word)) is None:
            if len(self.stems) >= chunk_ids.TABLE_ENTRIES // 2:
                self.stems.clear()
            n = self.stems[word] = len(self.merge(chunk_ids.spelled(word)))
        if marks:
            n += 1 if marks in self.whole else self.library(marks)
        return n


_tables: dict[str, _Counts] = {}


def count(text: str, table: _Counts) -> int:
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return table.library(text)  # Python cuts there, the vocabulary doesn't
    return sum(map(table.__getitem__, text.split()))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; no shuffle.

    The vocabulary must drop white space and have the word-end pre-tokens that
    ``chunk_ids`` calls ``word``.
    """
    spark = docs.sparkSession
    if chunk_ids.kind_of(chunk_ids.load(vocabulary)) != "word":
        raise ValueError(f"{vocabulary}: its pre-tokens can't be cut at white space")
    common.bounded_batches(spark)
    proven = spark.sparkContext.broadcast(whole_tokens(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _tables.get(vocabulary)
        if table is None:
            table = _tables[vocabulary] = _Counts(vocabulary, proven.value)
        for part, texts in common.text_slices(batches):
            counts = [count(x, table) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
