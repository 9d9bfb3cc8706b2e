"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Fitted on a bounded sample: coarse centroids by k-means, and codebooks of 256
entries for each slice of the residuals (at most ``WIDTH`` dimensions).  The sample has ``SAMPLE`` vectors, or
8 * sqrt(rows) if that is more, so that the sqrt(rows) lists grow with the table.
Every vector is indexed under its centroid with its codes.

Equal vectors are one member of the index with their k + 1 smallest ids (no other
can be among the best k), and equal query vectors are searched once.

Calibration: ``CHECKED`` of the queries are answered by brute force over all members,
and what holds TARGET of those true neighbours is searched: so many lists, and a pool
(at least ``POOL``) so deep in the order of quantised scores.

Search: a query probes the centroids with the largest inner products.  The inverted lists hold list, codes
and the number of members with these codes, nothing else.  Lists are packed into
parts of about ``PART`` codes, a part and a chunk of its queries are one task, and
an asymmetric distance table of each query (its inner product with every codebook
entry) scores the codes of its lists by look-ups.  Of all of a query's lists and
parts together the best members by that score, the pool, go on, with all others of
the last one's code (near copies whose codes differ by chance are told apart no
better than the codes do).  Only their vectors are fetched, for chunks of queries that
probe the same list first, and scored exactly in double precision.

No task holds a whole list, cell or group of copies: large lists are cut by their
codes, members of a chunk by their vectors, queries by hashes.  Only counts of
lists, parts and chunks come to the driver.

Vectors that are null, zero, hold null or non-finite components, or differ in
length from the sample's most frequent length take no part.  Null ids take no
part either.  Rows that repeat an id count once, with the best score; a query
never finds its own id.  Ties go to the smaller id.  Other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

K, SAMPLE, SLICES, POOL = 20, 20_000, 16, 200
#: Dimensions of a slice at most; residuals that a codebook learns from; queries that calibrate.
WIDTH, LEARNED, CHECKED = 4, 8192, 128
#: Codes of a part, queries of a chunk, members that a chunk compares at once.
PART, CHUNK, BLOCK = 262_144, 2048, 32_768
#: Share of the checked queries' true neighbours that the probed lists, and of those the pools, must hold.
TARGET = 0.99
#: Scaled components beyond this are cut for the index; exact scores are of the whole vectors.
LARGEST = 1e8
#: Numbers that a search step holds at once, at most (or one query's).
STEP = 4_000_000


@dataclass
class Index:
    centroids: np.ndarray  # lists x d
    books: np.ndarray  # slices x 256 x width
    probes: int
    scale: float = 1.0  # of the rows, so that single precision can hold them

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def kmeans(x: np.ndarray, k: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        at = nearest(x, centers)
        counts = np.bincount(at, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
        if not full.all():
            centers[~full] = x[rng.choice(len(x), (~full).sum())]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centers**2).sum(1) / 2
    for k in range(0, len(x), 8192):
        out[k : k + 8192] = (half - x[k : k + 8192] @ centers.T).argmin(1)
    return out


def train(x: np.ndarray, lists: int, slices: int = SLICES, target: float = TARGET, seed: int = 7) -> Index:
    """Centroids and codebooks from a sample (rows of ``x``)."""
    rng = np.random.default_rng(seed)
    scale = 2.0 ** -int(np.clip(np.floor(np.log2(np.median(np.abs(x).max(1)))), -1000, 1000))
    x = scaled(x, scale)
    centroids = kmeans(x, lists, 12, rng)
    some = rng.permutation(len(x))[:LEARNED]
    residual = x[some] - centroids[nearest(x[some], centroids)]
    slices = min(max(slices, -(-x.shape[1] // WIDTH)), x.shape[1])
    width = -(-x.shape[1] // slices)
    residual = np.pad(residual, ((0, 0), (0, width * slices - x.shape[1])))
    books = np.zeros((slices, 256, width), np.float32)
    for s in range(slices):
        part = residual[:, s * width : (s + 1) * width]
        found = kmeans(part, 256, 8, rng)
        books[s, : len(found)] = found
        books[s, len(found) :] = found[0]
    asked = rng.choice(len(x), min(400, len(x)), replace=False)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    top = np.argpartition(-scores, min(K, len(x)) - 1, axis=1)[:, : min(K, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[asked] @ centroids.T), axis=1), axis=1)
    at = np.take_along_axis(place, nearest(x, centroids)[top], 1) if top.size else np.zeros(1)
    return Index(centroids, books, min(len(centroids), int(np.quantile(at, target)) + 1), scale)


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(x.astype(np.float64) * scale, -LARGEST, LARGEST).astype(np.float32)


def unit(q: np.ndarray) -> np.ndarray:
    """Queries of length one: the order of their answers is the same."""
    q = q.astype(np.float64)
    q = q / np.abs(q).max(1, keepdims=True)
    return (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32)


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, codes) of each row."""
    x = scaled(x, index.scale)
    cell = nearest(x, index.centroids)
    slices, _, width = index.books.shape
    residual = np.pad(x - index.centroids[cell], ((0, 0), (0, slices * width - x.shape[1])))
    codes = np.stack([nearest(residual[:, s * width : (s + 1) * width], index.books[s]) for s in range(slices)], axis=1)
    return cell, codes.astype(np.uint8)


def decoded(index: Index, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The vectors that lists and codes stand for."""
    parts = np.concatenate([index.books[s][codes[:, s]] for s in range(len(index.books))], axis=1)
    return index.centroids[cell] + parts[:, : index.dim]


def adc_pool(index: Index, cell: np.ndarray, codes: np.ndarray, n: np.ndarray, q: np.ndarray, probed: list[np.ndarray], pool: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, code row, score): for each query the best codes of its lists by
    the asymmetric distance table, until they have ``pool`` members; codes are
    sorted by cell, ``n`` counts the members of each."""
    slices, _, width = index.books.shape
    cells, starts = np.unique(cell, return_index=True)
    ends, q = np.append(starts[1:], len(cell)), q.astype(np.float32)
    sliced = np.pad(q, ((0, 0), (0, slices * width - q.shape[1]))).reshape(len(q), slices, width)
    by_slice = np.ascontiguousarray(codes.T)
    asked = np.zeros((len(q), len(cells)), bool)
    for i, mine in enumerate(probed):
        asked[i] = np.isin(cells, mine)
    outs: list[list[np.ndarray]] = [[], [], []]
    step, keep = max(1, STEP // max(len(cell), slices * 256)), min(pool, len(cell))
    for i in range(0, len(q), step):
        table = np.einsum("nsw,scw->nsc", sliced[i : i + step], index.books)
        base = q[i : i + step] @ index.centroids[cells].T
        near = np.full((len(table), len(cell)), -np.inf, np.float32)
        for c in np.flatnonzero(asked[i : i + step].any(0)):
            rows, a, b = np.flatnonzero(asked[i : i + step, c]), starts[c], ends[c]
            total = np.repeat(base[rows, c][:, None], b - a, axis=1)
            for s in range(slices):
                total += table[rows, s][:, by_slice[s, a:b]]
            near[rows, a:b] = total
        top = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
        score = np.take_along_axis(near, top, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        top, score = np.take_along_axis(top, order, 1), np.take_along_axis(score, order, 1)
        row, at = np.nonzero((np.cumsum(n[top], axis=1) - n[top] < pool) & (score > -np.inf))
        for out, values in zip(outs, (row + i, top[row, at], score[row, at]), strict=True):
            out.append(values)
    return tuple(np.concatenate(o) for o in outs)


def best_exact(x: np.ndarray, ids: list[np.ndarray], q: np.ndarray, row: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score): each query's best k of its members (pairs of a query
    row and a row of ``x``), in double precision, an id once."""
    some = max(1, STEP // max(1, x.shape[1]))
    score = np.concatenate([np.einsum("nd,nd->n", x[at[j : j + some]], q[row[j : j + some]]) for j in range(0, max(1, len(at)), some)])
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    starts, flat = np.cumsum(sizes) - sizes, np.concatenate([*ids, np.zeros(0, np.int64)])
    times = sizes[at]
    row, score, inside = np.repeat(row, times), np.repeat(score, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    vec = flat[np.repeat(starts[at], times) + inside]
    order = np.lexsort((-score, vec, row))
    row, vec, score = row[order], vec[order], score[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (vec[1:] != vec[:-1])  # an id's best
    row, vec, score = row[once], vec[once], score[once]
    order = np.lexsort((vec, -score, row))
    row, vec, score = row[order], vec[order], score[order]
    there = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[there], vec[there], score[there]


def packed(counts: dict[int, int], room: int) -> dict[int, tuple[int, int]]:
    """cell -> (first part, parts): neighbouring cells share a part while they fit;
    one beyond ``room`` is cut into several of its own."""
    out, part, held = {}, 0, 0
    for cell, n in sorted(counts.items()):
        if held and held + n > room:
            part, held = part + 1, 0
        out[cell] = (part, max(1, -(-n // room)))
        held += n
        if held >= room:
            part, held = part + out[cell][1], 0
    return out


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def fit(vectors: DataFrame, sample: int = SAMPLE, target: float = TARGET, lists: int | None = None) -> tuple[Index | None, int]:
    """(index, rows): ``vectors`` has vec_id and v (array<double>), usable rows only."""
    n = vectors.count()
    sample = max(sample, int(8 * n**0.5))
    share = min(1.0, 1.1 * sample / max(1, n))
    mix = F.pmod(F.xxhash64("vec_id", F.lit("index sample")), F.lit(1_000_000_007)) / 1_000_000_007
    rows = vectors.filter(mix < share).select("v").limit(2 * sample).collect()  # bounded: about ``sample`` rows
    if not rows:
        return None, n
    dim = Counter(len(r["v"]) for r in rows).most_common(1)[0][0]
    x = np.array([r["v"] for r in rows if len(r["v"]) == dim], np.float64)
    return train(x, lists or max(1, min(int(n**0.5), len(x) // 8)), target=target), n


def _pieces(column: pa.Array, kind, width: int) -> np.ndarray:
    """A binary column of equally long values as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def calibrated(members: DataFrame, shared, queries: np.ndarray, kind: np.dtype, code: np.dtype, k: int, target: float, pool: int) -> tuple[int, int]:
    """(lists to probe, depth of the pool): what holds ``target`` of the true neighbours
    of ``queries`` (rows), by brute force over ``members`` (code, x)."""
    index: Index = shared.value
    spark, many, dim = members.sparkSession, len(queries), index.dim
    asked = spark.sparkContext.broadcast(queries.astype(np.float64))  # CHECKED vectors

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.one_thread()
        best: list[list] = [[] for _ in range(many)]
        for batch in batches:
            x, codes = _pieces(batch.column(1), kind, dim).astype(np.float64), batch.column(0)
            scores = x @ asked.value.T
            for i in range(many):
                s, q = scores[:, i], asked.value[i]
                top = np.argpartition(-s, k)[: k + 1] if len(s) > k + 1 else np.arange(len(s))
                if len(best[i]) > k:
                    top = top[s[top] > best[i][-1][0]]
                if len(top):
                    mine = [(s[j], codes[int(j)].as_py()) for j in top if not np.array_equal(x[j], q)]
                    best[i] = sorted(best[i] + mine, key=lambda z: -z[0])[:k]
        rows = [(i, float(s), c) for i, found in enumerate(best) for s, c in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.binary())], names=["i", "score", "code"])

    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "code"))
    true = members.select("code", "x").mapInArrow(exact, "i int, score double, code binary").withColumn("place", place).filter(F.col("place") <= k).select("i", "code").collect()  # k rows a checked query
    if not true:
        return index.probes, pool
    of, both = np.array([r["i"] for r in true]), np.frombuffer(b"".join(r["code"] for r in true), code)
    q = unit(queries)
    order = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")
    at = np.argsort(order, axis=1)[of, both["cell"]]
    probes = int(np.quantile(at, target, method="higher")) + 1
    probed = np.zeros((len(index.centroids), many), bool)
    probed[order[:, :probes], np.arange(many)[:, None]] = True
    near = np.einsum("nd,nd->n", decoded(index, both["cell"], both["codes"]), q[of])
    near -= 1e-6 * (1 + np.abs(near))  # sums of another order
    limits = [np.sort(near[(of == i) & (at < probes)]) for i in range(many)]
    told = spark.sparkContext.broadcast((q, probed, limits))

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.one_thread()
        q, probed, limits = told.value
        counts = np.zeros((many, k + 1), np.int64)
        for batch in batches:
            mine = np.frombuffer(b"".join(batch.column(0).to_pylist()), code)
            scores = decoded(shared.value, mine["cell"], mine["codes"]) @ q.T
            scores[~probed[mine["cell"]]] = -np.inf
            for i in range(many):
                counts[i] += np.bincount(np.searchsorted(limits[i], scores[:, i], "right"), minlength=k + 1)
        i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(counts[i, j])], names=["i", "j", "n"])

    counts = np.zeros((many, k + 1), np.int64)
    for r in members.select("code").mapInArrow(deeper, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # k + 1 rows a checked query
        counts[r["i"], r["j"]] = r["n"]
    ranks = np.concatenate([counts[i, ::-1].cumsum()[::-1][1 : len(limits[i]) + 1] for i in range(many)])
    return probes, max(pool, int(np.quantile(ranks, target, method="higher")))


def neighbours(table: DataFrame, is_query: Column, k: int = K, sample: int = SAMPLE, target: float = TARGET, pool: int = POOL, part: int = PART, chunk: int = CHUNK, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (of id ``vec_id``) holds."""
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    small = table.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = np.dtype("<f4" if small else "<f8")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("raw")).filter(usable(F.col("raw")) & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", F.col("raw").cast("array<double>").alias("v"))
    index, _ = fit(rows, sample, target)
    if index is None:
        return spark.createDataFrame([], schema)
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(index)  # grows as the root of the table
    dim, slices = index.dim, index.books.shape[0]
    code = np.dtype([("cell", "<i4"), ("codes", "u1", (slices,))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.one_thread()
        for batch in batches:
            x = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            cells, codes = encode(shared.value, x)
            both = np.empty(len(x), code)
            both["cell"], both["codes"] = cells, codes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in both], pa.binary()), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], names=["vec_id", "code", "x"])

    fitting = rows.filter(F.size("v") == dim)
    each = fitting.mapInArrow(encoded, "vec_id long, code binary, x binary").groupBy("x", "vec_id").agg(F.first("code").alias("code"))
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    # At most k + 1 ids a vector.
    members = common.stored(ranked.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("code").alias("code")), "index-members")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.frombuffer(b"".join(batch.column(0).to_pylist()), code)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both["cell"].astype(np.int32)), batch.column(1)], names=["code", "cell", "n"])

    lists = common.stored(members.groupBy("code").agg(F.count("*").alias("n")).mapInArrow(opened, "code binary, cell int, n long"), "inverted-lists")
    sizes = {r["cell"]: r["n"] for r in lists.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a list
    parts = packed(sizes, part)
    where = spark.sparkContext.broadcast(parts)  # a row a list

    def plan(found: dict[int, tuple[int, int]]) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(c, *v) for c, v in found.items()], "of int, first int, parts int"))  # a row a list

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], names=["query_id", "q"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.one_thread()
        for batch in batches:
            q = unit(_pieces(batch.column(0), kind, dim))
            cells = np.argsort(-(q @ shared.value.centroids.T), axis=1, kind="stable")[:, :lists_probed].astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells[:, 0]), pa.array([r.tobytes() for r in cells], pa.binary())], names=["q", "nearest", "cells"])

    asked = common.stored(fitting.filter(is_query).mapInArrow(asking, "query_id long, q binary"), "queries")
    some = asked.select("q").distinct().orderBy(F.xxhash64("q"), "q").limit(CHECKED).toArrow().column("q").combine_chunks()
    if not len(some):
        return spark.createDataFrame([], schema)
    lists_probed, pool = calibrated(members, shared, _pieces(some, kind, dim), kind, code, k, target, pool)
    probes = common.stored(asked.select("q").distinct().mapInArrow(probing, "q binary, nearest int, cells binary").withColumn("qid", F.monotonically_increasing_id()), "probes")
    together = packed({r["nearest"]: r["n"] for r in probes.groupBy("nearest").agg(F.count("*").alias("n")).collect()}, chunk)  # a row a list
    dealt = probes.join(plan(together), F.col("nearest") == F.col("of")).withColumn("group", F.col("first") + F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int")).select("qid", "q", "cells", "group")

    def touching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at = [], []
            for i, cells in enumerate(batch.column(2).to_pylist()):
                mine = {p for c in np.frombuffer(cells, "<i4").tolist() if c in where.value for p in range(where.value[c][0], sum(where.value[c]))}
                found += sorted(mine)
                at += [i] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(batch.column(j).take(pa.array(at, pa.int64())) for j in range(4))], names=["part", "qid", "q", "cells", "group"])

    touched = dealt.mapInArrow(touching, "part int, qid long, q binary, cells binary, group int")
    asks = {r["part"]: -(-r["n"] // chunk) for r in touched.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
    chunks = F.broadcast(spark.createDataFrame(sorted(asks.items()), "in int, chunks int"))
    left = lists.join(plan(parts), F.col("cell") == F.col("of")).withColumn("part", F.col("first") + F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"))
    left = left.join(chunks, F.col("part") == F.col("in")).select("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "code", "n")
    right = touched.join(chunks, F.col("part") == F.col("in")).select("part", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int").alias("chunk"), "qid", "q", "cells", "group")

    def searched(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()
        common.one_thread()
        both = np.frombuffer(b"".join(a["code"]), code)
        order = np.argsort(both["cell"], kind="stable")
        both, n = both[order], a["n"].to_numpy()[order]
        q = unit(np.frombuffer(b"".join(b["q"]), kind).reshape(-1, dim))
        row, at, score = adc_pool(shared.value, both["cell"], both["codes"], n, q, [np.frombuffer(c, "<i4") for c in b["cells"]], pool)
        return pd.DataFrame({"group": b["group"].to_numpy()[row], "qid": b["qid"].to_numpy()[row], "code": [both[i].tobytes() for i in at], "n": n[at], "score": score})

    keys = ["part", "chunk"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(searched, "group int, qid long, code binary, n long, score float")
    earlier = Window.partitionBy("qid").orderBy(F.desc("score"), "code").rowsBetween(Window.unboundedPreceding, -1)
    pooled = common.stored(scored.withColumn("better", F.sum("n").over(earlier)).filter(F.coalesce("better", F.lit(0)) < pool).select("group", "qid", "code", "n"), "pools")

    need = pooled.groupBy("group", "code").agg(F.first("n").alias("n"))
    blocks = need.groupBy("group").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks")).withColumnRenamed("group", "at")  # a row a chunk of queries
    fetched = need.select("group", "code").join(members, "code").join(blocks, F.col("group") == F.col("at")).select("group", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("block"), "code", "ids", "x")
    wishes = pooled.groupBy("group", "qid").agg(F.collect_list("code").alias("codes"))  # at most ``pool`` codes
    wishes = wishes.join(probes.select("qid", "q"), "qid").join(blocks, F.col("group") == F.col("at")).select(F.col("group").alias("to"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("piece"), "qid", "q", "codes")

    def reranked(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()
        x = np.frombuffer(b"".join(a["x"]), kind).reshape(-1, dim).astype(np.float64)
        q = np.frombuffer(b"".join(b["q"]), kind).reshape(-1, dim).astype(np.float64)
        of: dict[bytes, list[int]] = {}
        for i, c in enumerate(a["code"]):
            of.setdefault(bytes(c), []).append(i)
        of, ids, out = {c: np.array(m) for c, m in of.items()}, [np.asarray(i, np.int64) for i in a["ids"]], []
        held: list[np.ndarray] = []
        first = pairs = 0
        for i, codes in enumerate(b["codes"]):
            held.append(np.concatenate([*(of[c] for c in map(bytes, codes) if c in of), np.zeros(0, np.int64)]))
            pairs += len(held[-1])
            if pairs * k > STEP or i + 1 == len(b):
                row = np.repeat(np.arange(first, i + 1), [len(m) for m in held])
                out.append(best_exact(x, ids, q, row, np.concatenate(held), k + 1))
                held, first, pairs = [], i + 1, 0
        row, vec, score = map(np.concatenate, zip(*out, strict=True))
        return pd.DataFrame({"qid": b["qid"].to_numpy()[row], "vec_id": vec, "score": score})

    found = fetched.groupBy("group", "block").cogroup(wishes.groupBy("to", "piece")).applyInPandas(reranked, "qid long, vec_id long, score double")
    best = found.groupBy("qid", "vec_id").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= k + 1)
    answers = best.groupBy("qid").agg(F.collect_list(F.struct("vec_id", "score")).alias("answers"))  # at most k + 1
    own = asked.distinct().join(probes.select("q", "qid"), "q").join(answers, "qid").select("query_id", F.explode("answers").alias("a")).select("query_id", "a.vec_id", "a.score").filter("vec_id != query_id")
    merged = own.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
