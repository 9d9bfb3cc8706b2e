"""Hard negatives by a vector-approximation file.

Components become integers; each dimension is cut into at most CELLS cells, whose
inner borders are quantiles of a bounded sample of about ``SAMPLE`` vectors and
whose outer borders are the least and greatest component of the whole table.  The
file holds a byte a component, the number of its cell.

For an anchor, a table per dimension gives the least and the greatest product of its
component with any value of each cell; the sums of looked-up entries bound the score
of every vector from below and above.  A vector is scored exactly only if its bounds
let it in:

    positives   its upper bound reaches the best k-th exact score of the anchor's
                label so far (or the k-th lower bound of this step, if better)
    negatives   its bounds meet the window of a positive, and its upper bound
                reaches the k-th best found within that window, likewise

so results are exact.  Blocks of the file stream through tasks of one chunk of
anchors and one split of the blocks; a task remembers k rows an anchor or window,
and passes on those alone.  Chunks follow the number of anchors, splits the number
of rows, and nothing but counts and the cells' borders comes to the driver.

Anchors are a stated set of rows against all rows.  Labels need no care when one
holds many of them: blocks don't follow labels.

Rows with a null id, label or vector, a null or non-finite component, or a length
other than the most frequent one (the least of equals) take no part.  Rows that
repeat an id are rows of their own: all of them are candidates, an anchor among them
gives results of its own, and no row is a partner for its own id.  Zero vectors take
part with score 0.  Ties go to the smaller id.  Scores beyond a long count as the
nearest long.  Other columns are ignored whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
SAMPLE, CELLS = 20_000, 256
#: Anchors of a task; rows compared at once; rows of a split, at least and at most.
CHUNK, BLOCK, LEAST, MOST = 1024, 16_384, 8192, 4_194_304
_WIDE, _LONG = 2.0**53, (-(2**63), 2**63 - 1)


@dataclass
class Cells:
    low: np.ndarray  # dimensions x cells: the least value of each
    high: np.ndarray
    widest: float  # the greatest absolute value

    @property
    def dim(self) -> int:
        return len(self.low)

    @property
    def exact(self) -> bool:
        """Every score of this table is exact in double precision."""
        return self.dim * self.widest * self.widest < _WIDE

    @property
    def kind(self) -> str:
        """How values are stored."""
        return "<i2" if self.widest < 2**15 else "<i4" if self.widest < 2**31 else "<f8"

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The cells of integer rows: dimensions x rows."""
        return np.stack([np.searchsorted(self.low[d, 1:], x[:, d], "right") for d in range(self.dim)]).astype(np.uint8)


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(scale * x.astype(np.float64)))


def cells_of(sample: np.ndarray, least: np.ndarray, most: np.ndarray, cells: int = CELLS) -> Cells:
    """Borders from a sample of integer rows and the range of all rows."""
    low = np.full((len(least), cells), np.inf)
    high = np.full((len(least), cells), -np.inf)
    for d in range(len(least)):
        inner = np.unique(np.quantile(sample[:, d], np.arange(1, cells) / cells, method="higher")) if len(sample) else np.zeros(0)
        inner = inner[(inner > least[d]) & (inner <= most[d])]
        n = len(inner) + 1
        low[d, :n] = np.append(least[d], inner)
        high[d, :n] = np.append(inner - 1, most[d])
        low[d, n:], high[d, n:] = np.inf, most[d]
    widest = max(float(np.abs(least).max(initial=0)), float(np.abs(most).max(initial=0)))
    return Cells(low, high, widest)


def tables(cells: Cells, anchor: np.ndarray) -> tuple[np.ndarray, float]:
    """(table, slack): for each dimension and cell the least product as the real, the
    greatest as the imaginary part; what rounding may take from a sum of them."""
    with np.errstate(all="ignore"):
        a, b = anchor[:, None] * np.where(np.isinf(cells.low), 0, cells.low), anchor[:, None] * cells.high
        out = np.empty(a.shape, np.complex128)
        out.real, out.imag = np.minimum(a, b), np.maximum(a, b)
        slack = 0.0 if cells.exact else float(np.abs([a, b]).max(axis=(0, 2)).sum() * cells.dim * 2.0**-52)
    return out, slack


def bounds(table: np.ndarray, slack: float, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of rows with these cells (numbers of a
    machine word, dimensions x rows)."""
    total = np.zeros(codes.shape[1], np.complex128)
    part = np.empty_like(total)
    with np.errstate(all="ignore"):
        for d in range(len(codes)):
            np.take(table[d], codes[d], out=part, mode="clip")
            total += part
        if not slack:
            return total.real, total.imag
        return np.nan_to_num(total.real - slack, nan=-np.inf, neginf=-np.inf), np.nan_to_num(total.imag + slack, nan=np.inf, posinf=np.inf)


def scores(cells: Cells, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products, as longs."""
    if cells.exact:
        return (rows.astype(np.float64) @ anchor).astype(np.int64)
    mine = [int(v) for v in anchor]
    found = [sum(int(v) * m for v, m in zip(r, mine, strict=True)) for r in rows.tolist()]
    return np.array([min(max(f, _LONG[0]), _LONG[1]) for f in found], np.int64)


@dataclass
class Best:
    """The k best of the scores offered, ties to the smaller id."""

    k: int
    low: int = _LONG[0]
    high: int = _LONG[1]
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def wanted(self, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Which rows may still enter, by their bounds."""
        below = lambda v: np.nextafter(float(v), -np.inf)  # noqa: E731  a long need not be a double
        inside = (upper >= below(self.low)) & (lower <= np.nextafter(float(self.high), np.inf)) if self.low > _LONG[0] else np.ones(len(upper), bool)
        if len(self.score) == self.k:
            inside &= upper >= below(self.score[-1])
        if inside.sum() > 4 * self.k:  # those surely within give a limit of their own
            sure = lower[inside & (lower > below(self.low + 1)) & (upper <= below(self.high))]
            if len(sure) >= self.k:
                inside &= upper >= np.partition(sure, len(sure) - self.k)[len(sure) - self.k]
        return inside

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        fits = (score >= self.low) & (score <= self.high)
        score, ids = np.concatenate([self.score, score[fits]]), np.concatenate([self.ids, ids[fits]])
        order = np.lexsort((ids, ~score))[: self.k]
        self.score, self.ids = score[order], ids[order]


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def _ranges(rows: DataFrame, scale: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(rows, length, least, most) for the most frequent length of vectors."""
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return 0, 0, np.zeros(0), np.zeros(0)
    d = lengths["d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = np.full(d, np.inf), np.full(d, -np.inf)
        for batch in batches:
            x = integers(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), scale)
            if len(x):
                least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(least), pa.array(most)], names=["at", "least", "most"])

    both = rows.filter(F.size("v") == d).select("v").mapInArrow(run, "at long, least double, most double").groupBy("at").agg(F.min("least").alias("least"), F.max("most").alias("most")).orderBy("at").collect()  # a row a dimension
    return lengths["n"], d, np.array([r["least"] for r in both]), np.array([r["most"] for r in both])


_BLOCK = "n int, ids binary, labels binary, codes binary, x binary"


def _streamed(batches: Iterator[pa.RecordBatch], cells: Cells) -> Iterator[tuple]:
    """('anchor', rows) before ('block', ids, labels, codes, x), by task group; blocks
    are put together to BLOCK rows.  Ends every group with ('end',)."""
    now, held = None, []

    def block() -> tuple:
        ids, labels = (np.concatenate([np.frombuffer(h[k], "<i8") for h in held]) for k in ("ids", "labels"))
        codes = np.concatenate([np.frombuffer(h["codes"], np.uint8).reshape(cells.dim, -1) for h in held], axis=1)
        x = np.concatenate([np.frombuffer(h["x"], cells.kind).reshape(-1, cells.dim) for h in held])
        held.clear()
        return "block", ids, labels, codes.astype(np.intp), x

    for batch in batches:
        for row in batch.to_pylist():
            key = row["chunk"], row["split"]
            if key != now:
                if held:
                    yield block()
                if now is not None:
                    yield ("end",)
                now = key
            if row["kind"] == 0:
                yield "anchor", row
            else:
                held.append(row)
                if sum(h["n"] for h in held) >= BLOCK:
                    yield block()
    if held:
        yield block()
    if now is not None:
        yield ("end",)


def _search(batches: Iterator[pa.RecordBatch], cells: Cells, positives: int, negatives: int, low: int, high: int, windows: bool) -> Iterator[pa.RecordBatch]:
    """The best rows of each anchor's label, or of each window, in one split."""
    anchors: dict[int, list[tuple]] = {}  # by label
    for what, *rest in _streamed(batches, cells):
        if what == "anchor":
            row = rest[0]
            x = np.frombuffer(row["x"], cells.kind).astype(np.float64)
            found = np.frombuffer(row["positives"], ">i8").tolist() if windows else [None]
            # 30 p <= 100 s <= 90 p, in whole numbers
            best = [Best(negatives, -(-low * p // 100), high * p // 100) if windows else Best(positives) for p in found]
            label = int(np.frombuffer(row["labels"], "<i8")[0])
            anchors.setdefault(label, []).append((row["key"], np.frombuffer(row["ids"], "<i8")[0], x, best, *tables(cells, x)))
        elif what == "block":
            ids, labels, codes, x = rest
            for label, some in anchors.items():
                at = np.flatnonzero((labels == label) != windows)
                its = np.ascontiguousarray(codes[:, at])
                for _, anchor, mine, best, table, slack in some:
                    lower, upper = bounds(table, slack, its)
                    lower[ids[at] == anchor] = upper[ids[at] == anchor] = -np.inf
                    may = np.zeros(len(at), bool)
                    for b in best:
                        may |= b.wanted(lower, upper)
                    pick = at[may & (ids[at] != anchor)]
                    if len(pick):
                        score = scores(cells, x[pick], mine)
                        for b in best:
                            b.offer(score, ids[pick])
        else:
            out = [(key, i, s, v) for some in anchors.values() for key, _, _, best, *_ in some for i, b in enumerate(best) for s, v in zip(b.score.tolist(), b.ids.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["key", "at", "score", "id"])
            anchors = {}


def mine(table: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, sample: int = SAMPLE, cells: int = CELLS, chunk: int = CHUNK, least: int = LEAST, most: int = MOST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` and ``label`` are columns over ``table``.  A positive is one of the
    best ``positives`` other rows of the anchor's label; its negatives are the best
    rows of other labels whose score is ``low`` to ``high`` hundredths of its own."""
    spark = table.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    common.bounded_batches(spark)
    rows = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("raw"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("raw"))).select("id", "label", "anchor", F.col("raw").cast("array<double>").alias("v"))
    n, dim, smallest, largest = _ranges(rows, scale)
    if not n:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == dim)
    share = F.pmod(F.xxhash64("id", "v", F.lit("cell borders")), F.lit(1_000_000_007)) / 1_000_000_007
    some = np.array([r["v"] for r in rows.filter(share < min(1.0, 1.1 * sample / n)).select("v").limit(2 * sample).collect()])  # bounded: about ``sample`` rows
    shared = spark.sparkContext.broadcast(cells_of(integers(some.reshape(-1, dim), scale), smallest, largest, cells))  # 2 * cells numbers a dimension

    def pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
        """Rows of ``size`` vectors each, a partition's last one smaller."""
        none = np.zeros(0, np.int64)
        ids, labels, x = none, none, np.zeros((0, dim))
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                ids, labels = (np.concatenate([old, batch.column(j).to_numpy(zero_copy_only=False)]) for j, old in enumerate((ids, labels)))
                x = np.concatenate([x, integers(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)])
            stop = len(ids) - len(ids) % size if batch is not None else len(ids)
            cuts = [slice(k, min(k + size, stop)) for k in range(0, stop, size)]
            values = [[len(ids[c]) for c in cuts], *([v[c].tobytes() for c in cuts] for v in (ids, labels)), [shared.value.codes(x[c]).tobytes() for c in cuts], [x[c].astype(shared.value.kind).tobytes() for c in cuts]]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if not j else pa.binary()) for j, v in enumerate(values)], names=["n", "ids", "labels", "codes", "x"])
            ids, labels, x = ids[stop:], labels[stop:], x[stop:]

    columns = rows.select("id", "label", "v")
    file = common.stored(columns.mapInArrow(lambda b: pack(b, BLOCK // 4), _BLOCK).withColumn("key", F.monotonically_increasing_id()), "approximation-file")
    anchors = common.stored(rows.filter("anchor").select("id", "label", "v").mapInArrow(lambda b: pack(b, 1), _BLOCK).withColumn("key", F.monotonically_increasing_id()), "anchors")
    asked = anchors.count()
    if not asked:
        return spark.createDataFrame([], schema)
    chunks = -(-asked // chunk)
    splits = max(-(-n // most), min(-(-n // least), -(-2 * common.shuffle_partitions(spark) // chunks)))
    of = lambda what, parts: F.pmod(F.xxhash64("key", F.lit(what)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def searched(wanted: DataFrame, windows: bool) -> DataFrame:
        left = wanted.select(of("chunk", chunks).alias("chunk"), every(splits).alias("split"), F.lit(0).alias("kind"), "key", "n", "ids", "labels", "codes", "x", "positives")
        right = file.select(every(chunks).alias("chunk"), of("split", splits).alias("split"), F.lit(1).alias("kind"), "key", "n", "ids", "labels", "codes", "x", F.lit(None).cast("binary").alias("positives"))
        dealt = left.unionByName(right).repartition(max(common.shuffle_partitions(spark), min(chunks * splits, 100_000)), "chunk", "split").sortWithinPartitions("chunk", "split", "kind", "key")
        return dealt.mapInArrow(lambda b: _search(b, shared.value, positives, negatives, low, high, windows), "key long, at int, score long, id long")

    near = searched(anchors.withColumn("positives", F.lit(None).cast("binary")), False)
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    near = common.stored(near.withColumn("at", place("key")).filter(F.col("at") <= positives).select("key", (F.col("at") - 1).alias("at"), "id", "score"), "positives")
    # At most ``positives`` an anchor, in their order, as big-endian longs.
    listed = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "score"))).alias("p"))
    listed = listed.select("key", F.unhex(F.array_join(F.transform("p", lambda p: F.lpad(F.hex(p["score"]), 16, "0")), "")).alias("positives"))
    found = searched(anchors.join(listed, "key"), True)
    found = found.withColumn("rank", place("key", "at")).filter(F.col("rank") <= negatives)
    names = anchors.select("key", "ids").mapInArrow(_opened, "key long, anchor_id long")
    result = found.select("key", "at", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(near.select("key", "at", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["key", "at"]).join(names, "key")
    return result.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8"))], names=["key", "anchor_id"])


ORACLE_SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), p as (
  select anchor_id, id, score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select s.anchor_id, p.id as positive_id, row_number() over (partition by s.anchor_id, p.id order by s.score desc, s.id)::int as rank, s.id as negative_id, p.score as positive_score, s.score as negative_score
from s join p on s.anchor_id = p.anchor_id where not same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
qualify rank <= 10
"""
