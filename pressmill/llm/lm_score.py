"""LM scoring: a unigram base from exact corpus counts, and the attention model.

Counts: each task counts the words of its training rows and passes on one row a
distinct word; summed by word, they are a table in the shared folder that grows
with the corpus.  The ``HOT`` most frequent words of it are broadcast; all other
words of a document meet the table in a join by word, so every count is exact
and no word that is hot in training rows is dealt to one task.

Model: ``attention`` on the words' subword ids, which are made once and stored.  Every window
of every training row trains.  One pass counts the ids and picks, by a hash of row
and place, the STEPS * BATCH windows (all, if fewer) that open the training at the
driver.  Then tasks go over all windows, in ROUNDS parts: each task trains a copy of
the model on its windows of the round, in stretches of blocks in a row (keys are fetched
once for both windows that see them), and the copies are averaged, number by number,
weighted by what Adagrad has seen of it; only changed numbers are sent.  A document's
score is the log10 probability of its ids and the end.

Nulls: a null text is empty and has its end alone; null ids are kept and count
as training rows.  Repeated rows each give a row and count each time.  Other
columns are ignored; an empty table gives an empty result; without training
rows all counts are 0.  Texts of any length are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention, common, subwords

VOCABULARY, HOT = "byte_bpe_multi_50k.tiktoken", 150_000
#: Distinct words a counting task holds before it passes them on.
HELD = 300_000
#: Ids that are scored at once.
SCORED = 1 << 18
#: Parts of the training rows after each of which copies are averaged; windows of a step in
#: a task; windows of a task and round, if the cores allow; numbers of the model that are
#: averaged together.
ROUNDS, TASK_BATCH, TASK_WINDOWS, BUCKET = 4, 384, 1 << 19, 1 << 16
#: Characters of the texts whose words are looked up at once (a longer one comes alone).
STEP = 3 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def counted(texts: pa.Array) -> pa.StructArray:
    """(values, counts): how often ``words_of`` finds each word in the texts, without an object a word."""
    found = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts.drop_null())).flatten().value_counts()
    return found.filter(pa.compute.not_equal(found.field("values"), ""))  # blanks at the ends of a text leave empty words


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over all texts of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        held: list[pa.Table] = []
        for part, _ in common.text_slices(batches):
            found = counted(part.column("text"))
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            if sum(map(len, held)) > 2 * HELD:
                held = [merged()]
                if len(held[0]) > HELD:
                    yield from held.pop().to_batches()
        if held:
            yield from merged().to_batches()

    return rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def texts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rids, ids end to end, lengths) with about SCORED ids each (a longer text comes alone)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(1)).to_numpy() // 4
        part = (np.cumsum(sizes) - sizes) // SCORED
        for n in np.unique(part):
            a, b = np.searchsorted(part, [n, n + 1])
            ids = np.frombuffer(b"".join(batch.column(1).slice(a, b - a).to_pylist()), "<u4").astype(np.int64)
            yield batch.column(0).slice(a, b - a).to_numpy(), ids, sizes[a:b].astype(np.int64)


def counts_and_windows(encoded: DataFrame, size: int, share: float) -> DataFrame:
    """Rows (cell, n) that count the ids, and rows (mix, window) of a share of all training windows."""
    kind = "<u2" if size + 2 <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cell=(), n=(), mix=(), window=()) -> pa.RecordBatch:
            some, more = len(cell), len(mix)
            return pa.RecordBatch.from_arrays([pa.array([*cell, *[None] * more], pa.int32()), pa.array([*n, *[None] * more], pa.int64()), pa.array([*[None] * some, *mix], pa.int64()), pa.array([*[None] * some, *window], pa.binary())], names=["cell", "n", "mix", "window"])

        total = np.zeros(size, np.int64)
        for rids, ids, lengths in texts_of(batches):
            total += np.bincount(ids, minlength=size)
            mixes: list[np.ndarray] = []

            def pick(text: np.ndarray, place: np.ndarray, rids=rids, mixes=mixes) -> np.ndarray:
                h = rids[text].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)
                for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                    h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
                chosen = (h >> np.uint64(11)) / 2.0**53 < share
                mixes.append(h[chosen].astype(np.int64))
                return chosen

            rows = attention.windows(ids, lengths, size, pick).astype(kind)
            if len(rows):
                yield out(mix=mixes[0].tolist(), window=[r.tobytes() for r in rows])
        at = np.flatnonzero(total)
        yield out(cell=at.tolist(), n=total[at].tolist())

    return common.stored(encoded.mapInArrow(run, "cell int, n long, mix long, window binary"), "counts-and-windows")


def window_batches(rows: DataFrame, size: int) -> Iterator[np.ndarray]:
    """All windows once in random order, a batch at a time; the driver holds a partition."""
    kind, held = "<u2" if size + 2 <= 1 << 16 else "<u4", []
    mixed = common.stored(rows.repartition(common.shuffle_partitions(rows.sparkSession), "mix").sortWithinPartitions("mix"), "training-windows")

    def batch() -> np.ndarray:
        return np.frombuffer(b"".join(held), kind).reshape(len(held), -1).astype(np.int64)

    for row in mixed.select("window").toLocalIterator():
        held.append(bytes(row["window"]))
        if len(held) == attention.BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def trained(model: attention.Model, seen: dict[str, np.ndarray], texts: Iterable[tuple[np.ndarray, np.ndarray]], rate: float, seed: int) -> None:
    """Train ``model`` in place on every window of the texts (ids end to end, lengths)."""
    rng = np.random.default_rng(seed)
    for ids, lengths in texts:
        x, y = attention.stretches(ids, lengths, model.size)
        order, each = rng.permutation(len(x)), TASK_BATCH // attention.RUN
        for k in range(0, len(order), each):
            some = order[k : k + each]
            attention.descend(model, seen, attention.stretch_gradients(model.tables, model.tree, x[some], y[some]), rate)


def averaged_rounds(encoded: DataFrame, windows: int, model: attention.Model, seen: dict[str, np.ndarray]) -> attention.Model:
    """The model after all windows of ``encoded`` have trained it, in tasks."""
    spark = encoded.sparkSession
    parts = encoded.coalesce(max(2 * spark.sparkContext.defaultParallelism, windows // (ROUNDS * TASK_WINDOWS)))
    values, held = attention.flat(model.tables), attention.flat(seen)
    buckets = -(-len(values) // BUCKET)

    def one_round(number: int) -> None:
        shared = spark.sparkContext.broadcast((model.tree, model.tables, seen))  # bounded by the vocabulary
        rate = attention.RATE * (1 - number / ROUNDS)

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.one_thread()
            tree, tables, before = shared.value
            mine, own = attention.Model(tree, {k: v.copy() for k, v in tables.items()}), {k: v.copy() for k, v in before.items()}
            trained(mine, own, ((ids, lengths) for _, ids, lengths in texts_of(batches)), rate, number)
            weight, moved = attention.flat(own), attention.flat(mine.tables)
            weight -= attention.flat(before)
            moved -= attention.flat(tables)
            moved *= weight
            for n in range(buckets):
                w = weight[n * BUCKET : (n + 1) * BUCKET]
                at = np.flatnonzero(w)
                if len(at):
                    m = moved[n * BUCKET : (n + 1) * BUCKET][at]
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype("<u2"), m, w[at]))], names=["bucket", "at", "moved", "weight"])

        def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}  # a few buckets
            for batch in batches:
                for row in batch.to_pylist():
                    at, total = np.frombuffer(row["at"], "<u2"), sums.setdefault(row["bucket"], np.zeros((3, BUCKET)))
                    total[0, at] += np.frombuffer(row["moved"], np.float32)
                    total[1, at] += np.frombuffer(row["weight"], np.float32)
                    total[2, at] += 1
            for n, (m, w, copies) in sums.items():
                at = np.flatnonzero(copies)
                out = at.astype("<u2"), (m[at] / w[at]).astype(np.float32), (w[at] / copies[at]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in out)], names=["bucket", "at", "moved", "weight"])

        schema = "bucket int, at binary, moved binary, weight binary"
        rows = parts.filter(F.pmod(F.xxhash64("rid"), F.lit(ROUNDS)) == number)
        changes = rows.mapInArrow(train, schema).repartition(min(buckets, common.shuffle_partitions(spark)), "bucket")
        for row in changes.mapInArrow(averaged, schema).toArrow().to_pylist():  # the model's size at most
            at = row["bucket"] * BUCKET + np.frombuffer(row["at"], "<u2").astype(np.int64)
            values[at] += np.frombuffer(row["moved"], np.float32)
            held[at] += np.frombuffer(row["weight"], np.float32)
        shared.unpersist()

    for number in range(ROUNDS):
        one_round(number)
        model, seen = attention.Model(model.tree, attention.unflat(values, model.tables)), attention.unflat(held, seen)
    return model


def fit(encoded: DataFrame, windows: int, size: int, seed: int = 11) -> attention.Model:
    """The attention model from all training rows, ``encoded`` (rid, ids), with so many windows."""
    common.one_thread()
    rng = np.random.default_rng(seed)
    opening = min(1.0, attention.STEPS * attention.BATCH / max(1, windows))
    rows = counts_and_windows(encoded, size, opening)
    counts, found = np.zeros(size, np.int64), rows.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # a row an id
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    picked = rows.filter("mix is not null").select("mix", "window")
    if not windows:
        return attention.learn(counts, (), 0, rng)
    if opening < 1:
        model, seen = attention.opened(counts, window_batches(picked, size), -(-picked.count() // attention.BATCH), rng)
        return averaged_rounds(encoded, windows, model, seen)
    # At most STEPS * BATCH windows, each at least once.
    _, steps = attention.share_and_steps(windows)
    return attention.learn(counts, attention.drawn(np.concatenate(list(window_batches(picked, size))), steps, rng), steps, rng)


def score(docs: DataFrame, held_out: Column, vocabulary: str = VOCABULARY, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    training = rows.filter("not held_out")
    counts = common.stored(word_counts(training), "word-counts")
    trained = training.select("doc_id").count()
    sums = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    tokens, kinds = sums["n"] + trained, sums["v"] + (trained > 0)
    whole = tokens + kinds + 1
    most = counts.orderBy(F.desc("n"), "word").limit(hot).toArrow()
    top = {w.encode(): math.log10((n + 1) / whole) for w, n in zip(most["word"].to_pylist(), most["n"].to_pylist(), strict=True)}
    shared = spark.sparkContext.broadcast(top)  # HOT words
    size = subwords.size(vocabulary) + 1
    at_end = math.log10((trained + 1) / whole)
    columns = "rid long, word string, tf long, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_base double, n_ids long, ids binary"

    names = [x.split()[0] for x in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = subwords.Words(vocabulary, shared.value)
        for part, texts in common.text_slices(batches):
            sizes = np.cumsum([len(x) for x in texts]) // STEP
            for number in np.unique(sizes):
                a, b = np.searchsorted(sizes, [number, number + 1])
                rows = part.slice(a, b - a)
                at, lengths = table.rows([words_of(x) for x in texts[a:b]])
                logs = table.values[at]
                text, seldom = np.repeat(np.arange(len(rows)), lengths), np.isnan(logs)
                known = np.bincount(text[~seldom], minlength=len(rows)) + (trained > 0)
                base = np.bincount(text[~seldom], logs[~seldom], len(rows)) + at_end
                ids, n_ids = table.ids(at, lengths, size - 1)
                packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.append(0, 4 * np.cumsum(n_ids)).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                own = [rows.column(3), pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.int64()), rows.column(0), rows.column(2), pa.array(lengths + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(n_ids), packed]
                yield pa.RecordBatch.from_arrays(own, names=names)
                pairs, tf = np.unique(text[seldom] * (len(table) + 1) + at[seldom], return_counts=True)
                rids, m = rows.column(3).to_numpy()[pairs // (len(table) + 1)], len(pairs)
                words = pa.array([table.words[i] for i in (pairs % (len(table) + 1)).tolist()], pa.binary()).cast(pa.string())
                rare = [pa.array(rids), words, pa.array(tf), *(pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(rare, names=names)

    written = common.stored(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, columns), "subword-ids")
    own = written.filter("word is null")
    windows = own.filter("not held_out").select(F.sum(F.ceil(F.col("n_ids") / attention.BLOCK))).first()[0] or 0
    model = spark.sparkContext.broadcast(fit(own.filter("not held_out").select("rid", "ids"), windows, size))  # bounded by the vocabulary

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.one_thread()
        for rids, ids, lengths in texts_of(batches):
            scores = attention.log10_probabilities(model.value, ids, lengths)
            yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(scores, pa.float64())], names=["rid", "score"])

    rare = written.filter("word is not null").select("rid", "word", "tf")
    met = rare.join(counts.select(F.col("word").alias("seen"), F.col("n").alias("c")), F.col("word") == F.col("seen"), "left")
    term = F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(whole)))
    terms = met.select("rid", F.when(F.col("c") > 0, F.col("tf")).otherwise(F.lit(0)).alias("known"), term.alias("base"))
    plain = own.select("rid", F.col("hot_known").alias("known"), F.col("hot_base").alias("base"), "doc_id", "held_out", "n_tokens")
    scores = own.select("rid", "ids").mapInArrow(scored, "rid long, score double")
    each = plain.unionByName(terms, allowMissingColumns=True).unionByName(scores, allowMissingColumns=True).groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("known").cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.max("score").alias("score"),
    )
    return each.drop("rid")
