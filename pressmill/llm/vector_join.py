"""Near-duplicate vectors: an epsilon grid order join.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2t).  They are turned onto
principal axes, found on a bounded sample of about ``SAMPLE`` vectors (any axes give
the same result; good ones skip more), and sorted in the order of their grid cells of
width eps along the leading ``DIMS`` of them.  The sorted sequence is cut into strips
of equal numbers of rows.  Two strips are compared unless their boxes along these axes
are more than eps apart, which proves that no pair of theirs is near; strips find each
other by their cells along the first axis.  A pair of strips is one task, which joins
the two sequences recursively: intervals are halved while their boxes are within eps,
down to leaves that are compared by matrix products.  These are in single precision;
what lies near t is computed again in double.

Equal vectors are one member of the join that counts as many times as it has rows.  A
task gives each vector's number of links and the root of its component in this task,
never the links themselves, so a group of copies costs rows in its size, not in its
square.  Roots are linked on to components of the whole table, round by round.

No task holds a whole cell: strips divide cells.  Rows of vectors with so many copies
that they could be a thousandth of the table (at most a thousand vectors) are labelled
by a broadcast, all others by a join.  Only counts of range partitions come to the
driver.

Vectors that are null, empty, zero, hold null or non-finite components, or differ in
length from the most frequent length (the least of equals) link with nothing.  Each
row gives a row, repeated ids too.  A null id is kept; its component is the smallest
id reachable, null if there is none, and it is kept if there is none.  There are no
ties to break but equal ids.  Other columns are ignored whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components
from .ann import usable

COSINE, SAMPLE, DIMS = 0.95, 20_000, 8
#: Rows of a leaf; of a strip, at least and at most.
LEAF, LEAST, MOST = 256, 2048, 32_768
#: Vectors with over this share of the rows are labelled by a broadcast.
HEAVY = 0.001


def epsilon(cosine: float) -> float:
    """No pair of unit vectors this near may be missed, nor by rounding."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine))) * (1 + 1e-9) + 1e-7


def axes(sample: np.ndarray, dims: int) -> np.ndarray:
    """Principal axes of unit vectors, the widest first: dimensions x axes."""
    centred = sample - sample.mean(0) if len(sample) else np.eye(sample.shape[1])
    return np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :dims]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class Sequence:
    """Rows in grid order, with the boxes of their leaves, of pairs of these, and so on."""

    x: np.ndarray
    weight: np.ndarray
    boxes: list[tuple[np.ndarray, np.ndarray]]
    leaf: int

    @classmethod
    def of(cls, x: np.ndarray, weight: np.ndarray, basis: np.ndarray, leaf: int = LEAF) -> Sequence:
        at = x @ basis
        starts = np.arange(0, len(x), leaf)
        boxes = [(np.minimum.reduceat(at, starts), np.maximum.reduceat(at, starts))]
        while len(boxes[-1][0]) > 1:
            pairs = np.arange(0, len(boxes[-1][0]), 2)
            boxes.append((np.minimum.reduceat(boxes[-1][0], pairs), np.maximum.reduceat(boxes[-1][1], pairs)))
        return cls(x, weight, boxes, leaf)

    def rows(self, i: int) -> slice:
        return slice(i * self.leaf, min((i + 1) * self.leaf, len(self.x)))


def near_leaves(a: Sequence, b: Sequence, eps: float) -> np.ndarray:
    """Pairs of leaves (rows of two numbers) that are not provably apart, by halving
    the intervals of both; of one sequence with itself only pairs in order."""
    top = max(len(a.boxes), len(b.boxes)) - 1
    now = np.zeros((1, 2), np.int64)
    for level in range(top, -1, -1):
        sides = []
        for s, at in ((a, now[:, 0]), (b, now[:, 1])):
            low, high = s.boxes[min(level, len(s.boxes) - 1)]
            sides.append((low[at], high[at]))
        gap = np.maximum(0, np.maximum(sides[0][0] - sides[1][1], sides[1][0] - sides[0][1]))
        now = now[(gap * gap).sum(1) <= eps * eps]
        if level:
            halves = []
            for s, at in ((a, now[:, 0]), (b, now[:, 1])):
                n = len(s.boxes[level - 1][0]) if level < len(s.boxes) else 0
                halves.append([2 * at, 2 * at + 1] if n else [at])
            now = np.concatenate([np.stack([u, v], 1) for u in halves[0] for v in halves[1]])
            sizes = [len(s.boxes[min(level - 1, len(s.boxes) - 1)][0]) for s in (a, b)]
            now = now[(now[:, 0] < sizes[0]) & (now[:, 1] < sizes[1])]
            if a is b:
                now = now[now[:, 0] <= now[:, 1]]
    return now


def lowest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For n nodes and links u-v, the lowest node that each can reach."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        least, most = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(label, most, least)
        while (label[label] != label).any():
            label = label[label]
    return label


def join(a: Sequence, b: Sequence, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """(links, roots) of the rows of ``a`` and then, if it is another, ``b``."""
    shift = 0 if a is b else len(a.x)
    n = shift + len(b.x)
    links, root = np.zeros(n, np.int64), np.arange(n)
    margin = (a.x.shape[1] + 8) * 2.0**-22
    small = [s.x.astype(np.float32) for s in (a, b)]
    for i, j in near_leaves(a, b, epsilon(cosine)).tolist():
        left, right = a.rows(i), b.rows(j)
        score = small[0][left] @ small[1][right].T
        if score.max() < cosine - margin:
            continue
        hit = score >= cosine + margin
        u, v = np.nonzero((score >= cosine - margin) & ~hit)
        if len(u):
            hit[u, v] = np.einsum("nd,nd->n", a.x[left][u], b.x[right][v]) >= cosine
        if a is b and i == j:
            np.fill_diagonal(hit, False)
        links[left] += hit @ b.weight[right]
        if a is not b or i != j:
            links[shift + right.start : shift + right.stop] += a.weight[left] @ hit
        u, v = np.nonzero(hit)
        u, v = u + left.start, v + shift + right.start
        apart = root[u] != root[v]  # what is known to be one needs no more links
        if apart.any():
            root = lowest(n, root[u[apart]], root[v[apart]])[root]
    return links, root


def _strips(batches: Iterator[pa.RecordBatch], kind: np.dtype, basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row a strip, from rows sorted by strip and place."""
    now, held = None, []

    def out() -> pa.RecordBatch:
        ids, n, raw = (pa.chunked_array([h.column(k) for h in held]).to_pylist() for k in (1, 2, 3))
        at = unit(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)) @ basis
        held.clear()
        values = [[now], [np.array(ids, "<i8").tobytes()], [np.array(n, "<i8").tobytes()], [b"".join(raw)], [at.min(0).tolist()], [at.max(0).tolist()]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], names=["strip", "ids", "n", "raw", "low", "high"])

    for batch in batches:
        strip = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero(strip[1:] != strip[:-1]) + 1, [len(strip)])) if len(strip) else np.zeros(1, int)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and strip[a] != now:
                yield out()
            now = int(strip[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield out()


def _pairs(batches: Iterator[pa.RecordBatch], kind: np.dtype, basis: np.ndarray, cosine: float, leaf: int) -> Iterator[pa.RecordBatch]:
    """Links and roots of each pair of strips; rows come sorted by pair and side."""
    common.one_thread()
    first: tuple | None = None
    for batch in batches:
        for row in batch.to_pylist():
            ids, n = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["n"], "<i8")
            mine = ids, Sequence.of(unit(np.frombuffer(row["raw"], kind).reshape(len(ids), -1)), n, basis, leaf)
            if row["i"] == row["j"]:
                links, root = join(mine[1], mine[1], cosine)
            elif row["side"] == 0:
                first = mine
                continue
            else:
                links, root = join(first[1], mine[1], cosine)
                ids = np.concatenate([first[0], ids])
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(ids[root[at]])], names=["gid", "links", "root"])


def joined(groups: DataFrame, n: int, dim: int, kind: np.dtype, cosine: float = COSINE, sample: int = SAMPLE, dims: int = DIMS, leaf: int = LEAF, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(gid, links, root): for every vector that has links, its links in one pair of
    strips and the root there.  ``groups`` has gid, n and v, ``n`` rows of length ``dim``."""
    spark = groups.sparkSession
    share = F.pmod(F.xxhash64("gid", F.lit("axes")), F.lit(1_000_000_007)) / 1_000_000_007
    some = np.array([r["v"] for r in groups.filter(share < min(1.0, 1.1 * sample / n)).select("v").limit(2 * sample).collect()], np.float64)  # bounded: about ``sample`` rows
    shared = spark.sparkContext.broadcast(axes(unit(some.reshape(-1, dim)), dims))
    eps, size = epsilon(cosine), int(min(max(n / 6, least), most))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            at = unit(x) @ shared.value
            cells = [pa.array(np.floor(at * k / eps).astype(np.int64).tolist(), pa.list_(pa.int64())) for k in (1, 8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), *cells], names=["gid", "n", "raw", "cells", "fine"])

    order = ["cells", "fine", "gid"]
    celled_rows = groups.select("gid", "n", "v").mapInArrow(celled, "gid long, n long, raw binary, cells array<long>, fine array<long>")
    # Places in the whole order: range partitions, their counts, and the place within each.
    ordered = celled_rows.repartitionByRange(min(max(1, n // size), 10_000), *order).sortWithinPartitions(*order).select("gid", "n", "raw").withColumn("at", F.monotonically_increasing_id())
    ordered = common.stored(ordered, "grid-order")
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).orderBy("part").collect()  # a row a range partition
    before = np.cumsum([0] + [r["rows"] for r in counts]).tolist()
    offsets = F.broadcast(spark.createDataFrame([(r["part"], b) for r, b in zip(counts, before, strict=False)], "part long, before long"))  # likewise
    placed = ordered.withColumn("part", part).join(offsets, "part").withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    strips = -(-n // size)
    dealt = placed.select(F.expr(f"place div {size}").alias("strip"), "gid", "n", "raw", "place").repartition(min(max(strips, common.shuffle_partitions(spark)), 100_000), "strip").sortWithinPartitions("strip", "place").drop("place")
    packed = common.stored(dealt.mapInArrow(lambda b: _strips(b, kind, shared.value), "strip long, ids binary, n binary, raw binary, low array<double>, high array<double>"), "strips")
    common.discard(ordered)

    salts = -(-strips // 1000)
    box = packed.select("strip", "low", "high", F.floor(F.col("low")[0] / eps).alias("from"), F.floor(F.col("high")[0] / eps).alias("to"))
    home = box.select(F.col("strip").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"), F.pmod("strip", F.lit(salts)).cast("int").alias("salt"), F.explode(F.sequence("from", "to")).alias("cell"))
    away = box.select(F.col("strip").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"), F.explode(F.sequence(F.col("from") - 1, F.col("to") + 1)).alias("cell")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    gaps = F.zip_with(F.zip_with("low_i", "high_j", lambda a, b: a - b), F.zip_with("low_j", "high_i", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    pairs = common.stored(home.join(away, ["cell", "salt"]).filter((F.col("i") <= F.col("j")) & (apart <= eps * eps)).select("i", "j").distinct(), "strip-pairs")
    side = lambda k, of: pairs.join(packed.withColumnRenamed("strip", of), of).select("i", "j", F.lit(k).alias("side"), "ids", "n", "raw")
    both = side(0, "i").unionByName(side(1, "j").filter("i != j"))
    tasks = both.repartition(max(common.shuffle_partitions(spark), min(strips * strips // 2, 100_000)), "i", "j").sortWithinPartitions("i", "j", "side")
    return tasks.mapInArrow(lambda b: _pairs(b, kind, shared.value, cosine, leaf), "gid long, links long, root long")


def near_duplicates(table: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: other rows with a cosine of
    at least ``cosine``, the smallest id reachable over such links, and whether it is
    the row's own."""
    spark = table.sparkSession
    common.bounded_batches(spark)
    kind = np.dtype("<f4" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    good = usable(F.col("v"))
    lengths = rows.filter(good).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    alone = lambda of: of.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if lengths is None:
        return alone(rows)
    takes_part = good & (F.size("v") == lengths["d"])
    keyed = rows.filter(takes_part).select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("more"), F.reverse("v")).alias("k2"))
    groups = keyed.groupBy("k1", "k2", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("gid", F.monotonically_increasing_id())
    groups = common.stored(groups, "distinct-vectors")
    found = common.stored(joined(groups, groups.count(), lengths["d"], kind, cosine, **how), "linked-vectors")
    links = found.groupBy("gid").agg(F.sum("links").alias("links"))
    roots = components.roots(found.select(F.col("gid").alias("u"), F.col("root").alias("v")))
    member = groups.select("k1", "k2", "least", "n", "gid").join(links, "gid", "left").join(roots.withColumnRenamed("node", "gid"), "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    labels = member.join(least, "root").select("k1", "k2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("component").alias("component_id"))
    labels = common.stored(labels, "vector-labels")
    heavy = F.col("n") > max(4096, HEAVY * lengths["n"])
    ids = rows.filter(takes_part).select("vec_id", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("more"), F.reverse("v")).alias("k2"))
    many = F.broadcast(labels.filter(heavy).drop("n"))  # at most 1 / HEAVY rows
    told = ids.join(many, ["k1", "k2"]).unionByName(ids.join(many.select("k1", "k2"), ["k1", "k2"], "left_anti").join(labels.filter(~heavy).drop("n"), ["k1", "k2"]))
    told = told.select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"))
    return told.unionByName(alone(rows.filter(~takes_part)))


ORACLE_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95
), reach as (
  select vec_id, vec_id as r from embeddings union select reach.vec_id, l.v from reach join l on reach.r = l.u
), n as (
  select u, count(*) as n from l group by u
)
select reach.vec_id, coalesce(any_value(n.n), 0) as n_links, min(r) as component_id, reach.vec_id = min(r) as kept
from reach left join n on reach.vec_id = n.u group by reach.vec_id
"""
