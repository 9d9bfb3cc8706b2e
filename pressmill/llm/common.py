"""Shared plumbing: shared scratch folders, bounded Arrow batches, id rules."""

from __future__ import annotations

import ctypes
import glob
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import SLICE_BYTES, bounded_batches, discard, scratch, stored  # noqa: F401  (operators use them from here)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """(slice, texts) with about SLICE_BYTES of text each; null texts are ''."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(text))
        lengths = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_pylist()
        begin = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > SLICE_BYTES:
                part = batch.slice(begin, i - begin)
                yield part, [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                begin, held = i, 0
            held += n
        if begin < batch.num_rows:
            part = batch.slice(begin)
            yield part, [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None)).cast("string").cast("binary")) % modulus


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(id_remainder(doc_id, modulus) == remainder, F.lit(False))


@lru_cache(maxsize=1)
def one_thread() -> bool:
    """Matrix products of this process in one thread: a task has one core, and the
    library's threads would wait for each other in busy loops.  False: no such library."""
    for path in glob.glob(f"{os.path.dirname(os.path.dirname(np.__file__))}/numpy.libs/*openblas*"):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                return True
    return False


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


import pyarrow.compute  # noqa: E402  (text_slices uses pa.compute)
