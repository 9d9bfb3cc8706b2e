"""SimHash near-dedup: deletion-variant signatures.

With at most k = 4 differing bits, three segments (of 21, 21 and 22 bits) hold
at least one that differs in one bit at most, where an exact-match index would
need five.  Each segment is indexed with every single bit blanked in turn: two
segments that differ in one bit agree in the variant that blanks it, and equal
ones agree in all.  So fingerprints within k bits share a key
(blanked bit, rest of its segment); equal keys are brought together and the
whole fingerprints compared.

What keeps the work and the rows bounded: documents with one fingerprint are a
single row before indexing; a key's fingerprints are compared inside its task,
which passes on links only.  A key with over BIG fingerprints is indexed once more
inside its task: the bits outside its segment are cut into three parts, of which
one differs by at most one bit, so the same one-wildcard variants divide it.  What
still shares a key in numbers is searched from one fingerprint to the next
unvisited ones within k bits, so that a large group of near copies costs a scan
for each member still apart, and passes on a spanning tree, which loses no
connection.  Components then follow from the links.

Nulls: a null text has no words (fingerprint zero); rows with null ids are
returned, their component is the smallest id reachable, null if there is none.
Repeated rows and ids each give a row.  Other columns are ignored; an empty
table gives an empty result.  Long texts are hashed whole, in slices.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, components

WORDS, DISTANCE, SEED = 4, 4, 42
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Keys with more fingerprints than this are searched, not compared in pairs.
SMALL = 24
#: Keys with more are divided by the rest of their bits first.
BIG = 2048
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SLICE = 1 << 15


def hashes(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    tokens = text.encode().translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - words + 1]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, each 1 if set in over half the shingle hashes."""
    found = hashes(text, words, seed)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(found), _SLICE):
        part = np.unpackbits(found[k : k + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(part, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(found), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, for every row."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.text_slices(batches):
            fps = np.array([fingerprint(x, words, seed) for x in texts], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def variant_keys(fp: Column) -> Column:
    """Every (blanked bit, rest of its segment) of a fingerprint, as longs."""
    keys = []
    for low, bits in SEGMENTS:
        segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))
        for bit in range(bits):
            keys.append(segment.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << bit))).bitwiseOR(F.lit((low + bit) << 22)))
    return F.array(*keys)


def _first_shared(diff: np.ndarray) -> np.ndarray:
    """The lowest blanked bit at which two fingerprints with this XOR meet."""
    out = np.full(len(diff), 64, np.int64)
    for low, bits in reversed(SEGMENTS):
        part = (diff >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        ones = np.bitwise_count(part)
        out[ones == 1] = low + np.log2(part[ones == 1].astype(np.float64)).astype(np.int64)
        out[ones == 0] = low
    return out


def _search(members: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of the links among many fingerprints."""
    left = members
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found, left = left[near], left[~near]
                queue += list(found)
                yield at, found


def _divided(members: np.ndarray, bit: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the many fingerprints of one key, which blanks ``bit``: those that
    share a one-wildcard variant of a third of the other segments' bits are compared."""
    rest, width = np.zeros(len(members), np.uint64), 0
    for low, bits in SEGMENTS:
        if not low <= bit < low + bits:
            rest |= ((members >> np.uint64(low)) & np.uint64((1 << bits) - 1)) << np.uint64(width)
            width += bits
    third = -(-width // 3)
    for low in range(0, width, third):
        part = (rest >> np.uint64(low)) & np.uint64((1 << min(third, width - low)) - 1)
        for blank in range(min(third, width - low)):
            key = part & ~np.uint64(1 << blank)
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
            sizes = np.diff(np.append(starts, len(order)))
            for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
                rows = members[order[starts[sizes == size][:, None] + np.arange(size)]]
                for step in range(1, size):
                    a, b = rows[:, step:].ravel(), rows[:, :-step].ravel()
                    near = np.bitwise_count(a ^ b) <= distance
                    yield a[near], b[near]
            for i in np.flatnonzero(sizes > SMALL):
                for at, found in _search(members[order[starts[i] : starts[i] + sizes[i]]], distance):
                    yield np.full(len(found), at, np.uint64), found


def links_of(keys: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of each key; ``keys`` are sorted."""
    us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
    sizes = np.diff(starts)
    alone = np.repeat(sizes, sizes)
    pick = (alone > 1) & (alone <= SMALL)
    k, f = keys[pick], fps[pick]
    for step in range(1, min(SMALL, len(k))):
        same = k[step:] == k[:-step]
        if not same.any():
            break
        a, b, at = f[step:][same], f[:-step][same], k[step:][same] >> 22
        diff = a ^ b
        near = np.bitwise_count(diff) <= distance
        a, b, at, diff = a[near], b[near], at[near], diff[near]
        mine = _first_shared(diff) == at  # they meet at several keys: one speaks
        us.append(a[mine])
        vs.append(b[mine])
    for i in np.flatnonzero(sizes > SMALL):
        members = np.unique(fps[starts[i] : starts[i + 1]])
        if len(members) > BIG:
            pairs = _divided(members, int(keys[starts[i]]) >> 22, distance)
        else:
            pairs = ((np.full(len(found), at, np.uint64), found) for at, found in _search(members, distance))
        for u, v in pairs:
            us.append(u)
            vs.append(v)
    return np.concatenate(us), np.concatenate(vs)


def _find_links(batches: Iterable[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key that runs on is held for the next batch."""
    held_k, held_f = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]

    def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        u, v = links_of(k, f, distance)
        return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], names=["u", "v"])

    for batch in batches:
        k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        held_k.append(k)
        held_f.append(f.astype(np.uint64))
        if len(k) and k[0] != k[-1]:
            k, f = np.concatenate(held_k), np.concatenate(held_f)
            cut = int(np.searchsorted(k, k[-1]))
            yield out(k[:cut], f[:cut])
            held_k, held_f = [k[cut:]], [f[cut:]]
    yield out(np.concatenate(held_k), np.concatenate(held_f))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp), enough to connect
    all that are within ``distance`` bits."""
    if distance > 2 * len(SEGMENTS) - 1:
        raise ValueError("more bits apart than the segments allow for")
    keyed = fps.select(F.explode(variant_keys(F.col("fp"))).alias("key"), "fp")
    dealt = keyed.repartition(common.shuffle_partitions(fps.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: _find_links(batches, distance), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    component_id: the smallest doc_id reachable over links of at most
    ``distance`` differing bits, the row's own id included.
    """
    rows = common.stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    groups = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "groups")
    near = components.roots(links(groups.select("fp"), distance))
    member = groups.join(near, groups.fp == near.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    least = member.filter("linked").groupBy("root").agg(F.min("least").alias("reached")).withColumnRenamed("root", "top")
    # Only fingerprints of several rows or with links need a lookup.
    label = member.filter("linked or n > 1").join(least, F.col("root") == F.col("top"), "left").select(F.col("fp").alias("known"), F.coalesce("reached", "least").alias("component"))
    return rows.join(label, rows.fp == label.known, "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("known").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component, columns as they are.

    A row goes by a hash of its id and text: rows that repeat both are one, rows
    that share an id only are not, and null ids need no care.  Of rows with one
    hash only those with equal second hashes (128 bits in all) count as repeated.
    """
    keyed = docs.withColumns({"__near_key": F.xxhash64(F.col(id_col), F.col(text_col)), "__near_more": F.xxhash64(F.lit("more"), F.col(text_col), F.col(id_col))})
    found = near_duplicates(keyed, "__near_key", text_col, words, distance)
    keep = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    return keyed.join(keep, F.col("__near_key") == F.col("__kept"), "left_semi").dropDuplicates(["__near_key", "__near_more"]).drop("__near_key", "__near_more")
