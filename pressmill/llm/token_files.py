"""Token-id files: bit-plane shuffled, zstandard-compressed blocks with an index.

A shard is one self-contained byte string (all integers little-endian):

    header   "PMBP", version u8, plane unit u8 (1: bits, 8: bytes), block u32
    planes   for each block of ``block`` ids: plane after plane, each a
             zstandard frame, or the raw plane where that is no shorter
    index    for each block: offset u64, ids u32, planes u8, then u32 a plane
             (its stored size; the top bit marks a raw plane)
    table    zstandard frame: for each document its id i64, null flag u8, ids u64
    footer   index offset u64, table offset u64, blocks u32, documents u64,
             ids u64, crc32 of all before u32, "PMBP"

Writing: rows are range-partitioned by (doc_id, text hash), so that a hot id
is split too, sorted, encoded, and rolled into shards of about ``shard`` ids
(documents stay whole).  Shards are rows of a Parquet table in the shared
folder: Spark's commit protocol drops what a lost executor left half done.
Reading decodes each shard alone; a document's start is its place in the shard
plus the totals of the shards before it (one small row a range partition).

Nulls: a null text is its end id alone; null doc_ids sort first.  Repeated ids
are ordered by text hash.  Any other column is ignored; an empty table gives an
empty result; a text of any length lies in one shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_ids, common

VOCABULARY, END_ID, BLOCK, SHARD, LEVEL = "byte_bpe_50k.json", 0, 1 << 16, 1 << 21, 1
MAGIC, RAW = b"PMBP", 1 << 31
FOOTER = struct.Struct("<QQIQQI4s")
SHARD_SCHEMA = "part int, shard int, first_id long, n_ids long, n_docs long, content binary"


def to_planes(ids: np.ndarray, unit: int) -> list[bytes]:
    """The id block transposed into bit or byte planes, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    width = max(1, int(ids.max(initial=0)).bit_length())
    if unit == 8:
        return [raw[:, k].tobytes() for k in range((width + 7) // 8)]
    bits = np.unpackbits(raw[:, : (width + 7) // 8], axis=1, count=width, bitorder="little")
    return list(map(bytes, np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")))


def from_planes(planes: list[bytes], n: int, unit: int) -> np.ndarray:
    if unit == 8:
        raw = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
    else:
        rows = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
        bits = np.zeros((n, 32), np.uint8)
        bits[:, : len(planes)] = np.unpackbits(rows, axis=1, count=n, bitorder="little").T
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.view("<u4").reshape(-1)


def write_shard(doc_ids: list[int | None], ids: list[bytes], unit: int = 1, block: int = BLOCK, level: int = LEVEL) -> bytes:
    press = zstandard.ZstdCompressor(level=level, write_content_size=True)
    stream = np.frombuffer(b"".join(ids), "<u4")
    out, index, at = [MAGIC + struct.pack("<BBI", 1, unit, block)], [], 10
    for k in range(0, len(stream), block):
        part = stream[k : k + block]
        sizes, begin = [], at
        for plane in to_planes(part, unit):
            small = press.compress(plane)
            raw = len(small) >= len(plane)
            out.append(plane if raw else small)
            sizes.append(len(out[-1]) | RAW * raw)
            at += len(out[-1])
        index.append(struct.pack(f"<QIB{len(sizes)}I", begin, len(part), len(sizes), *sizes))
    index_at = at
    out += index
    table_at = at + sum(map(len, index))
    table = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids) + np.array([len(x) // 4 for x in ids], "<u8").tobytes()
    out.append(press.compress(table))
    body = b"".join(out)
    return body + FOOTER.pack(index_at, table_at, len(index), len(ids), len(stream), common.crc(body), MAGIC)


def shard_index(content: bytes) -> tuple[list[tuple[int, int, list[int]]], dict]:
    """Each block's (offset, ids, stored sizes), and the footer's fields."""
    index_at, table_at, blocks, docs, total, checksum, magic = FOOTER.unpack_from(content, len(content) - FOOTER.size)
    if magic != MAGIC or content[:4] != MAGIC:
        raise ValueError("not a shard")
    found, at = [], index_at
    for _ in range(blocks):
        offset, n, planes = struct.unpack_from("<QIB", content, at)
        found.append((offset, n, list(struct.unpack_from(f"<{planes}I", content, at + 13))))
        at += 13 + 4 * planes
    return found, {"unit": content[5], "table_at": table_at, "docs": docs, "ids": total, "crc32": checksum}


def read_block(content: bytes, entry: tuple[int, int, list[int]], unit: int) -> np.ndarray:
    """One block's ids, without touching any other block."""
    at, n, sizes = entry
    press, planes = zstandard.ZstdDecompressor(), []
    for size in sizes:
        data = content[at : at + (size & ~RAW)]
        planes.append(data if size & RAW else press.decompress(data))
        at += size & ~RAW
    return from_planes(planes, n, unit)


def read_shard(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids of each document, all ids); raises on a damaged shard."""
    index, foot = shard_index(content)
    if common.crc(content[: len(content) - FOOTER.size]) != foot["crc32"]:
        raise ValueError("damaged shard")
    table = zstandard.ZstdDecompressor().decompress(content[foot["table_at"] : len(content) - FOOTER.size])
    n = foot["docs"]
    keys, nulls, lengths = np.frombuffer(table, "<i8", n), table[8 * n : 9 * n], np.frombuffer(table, "<u8", n, 9 * n)
    blocks = [read_block(content, e, foot["unit"]) for e in index]
    return [None if null else k for k, null in zip(keys.tolist(), nulls, strict=True)], lengths.astype(np.int64), np.concatenate(blocks) if blocks else np.zeros(0, "<u4")


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, unit: int = 1, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row in ascending doc_id order into shards under ``path``."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_ids.encoder(vocabulary)
        part, number, first, held = TaskContext.get().partitionId(), 0, 0, 0
        keys: list[int | None] = []
        ids: list[bytes] = []

        def rolled() -> pa.RecordBatch:
            row = [part, number, first, held, len(keys), write_shard(keys, ids, unit)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in SHARD_SCHEMA.split(", ")])

        for rows, texts in common.text_slices(batches):
            for doc_id, text in zip(rows.column(0).to_pylist(), texts, strict=True):
                keys.append(doc_id)
                ids.append(encoder.ids(text) + end)
                held += len(ids[-1]) // 4
                if held >= shard:
                    yield rolled()
                    number, first, held, keys, ids = number + 1, first + held, 0, [], []
        if keys:
            yield rolled()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(common.shuffle_partitions(spark), F.col("doc_id").asc_nulls_first(), "tie")
    ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").drop("tie").mapInArrow(run, SHARD_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    base, at = {}, 0
    for row in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row a range partition
        base[row["part"]] = at
        at += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys, lengths, ids = read_shard(content)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                pieces = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(keys, pa.int64()), pa.array(ends - lengths + (base[part] + first), pa.int64()), pa.array(lengths, pa.int64()), pa.array([common.crc(p) for p in pieces], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return shards.select("part", "first_id", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
