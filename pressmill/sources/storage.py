"""Tables written by plans: publishing, upserts, idempotent inserts, schemas."""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions of the stored schemas, in order: (version, table, DDL).
MIGRATIONS = (
    (1, "documents", "document_key string, source_name string, source_message_id string, source_attachment_id string, sender string, original_filename string, content_hash string, raw_path string, import_status string, created_at timestamp, seq long, issue_date string, source_message_internal_date string"),
    (2, "import_run_items", "id long, run_id string, item_type string, item_key string, message_id string, attachment_id string, link_url string, status string, detail_code string, detail_message string, document_key string, created_at timestamp"),
    (3, "import_checkpoints", "source_name string, checkpoint_type string, checkpoint_value string, updated_at timestamp, seq long"),
    (4, "parse_runs", "parse_run_id string, document_key string, status string, parser_name string, publication_date string, started_at timestamp, finished_at timestamp, error_message string, seq long"),
    (5, "article_fragments", "parse_run_id string, source_order int, title string, body_text string, continued_to_page string, continued_from_page string, page_number int"),
    (6, "final_articles", "article_id string, parse_run_id string, document_key string, article_key string, article_order int, title string, body_text string"),
    (7, "processing_events", "key string, event string, payload string, at timestamp, seq long"),
    (8, "import_runs", "run_id string, source_name string, trigger_type string, status string, fetched_message_count long, imported_attachment_count long, created_document_count long, skipped_document_count long, failed_item_count long, skipped_item_count long, checkpoint_before string, checkpoint_after string, started_at timestamp, finished_at timestamp, seq long"),
    (9, "failed_messages", "source_name string, message_id string, retry_attempt_count int, retry_state string, updated_at timestamp, seq long"),
    (10, "continuation_matches", "parse_run_id string, front_source_order int, back_source_order int, decision_status string, decision_reason string"),
    (11, "final_article_fragments", "article_id string, source_order int, fragment_role string, sequence_index int"),
    (12, "enrichment_runs", "enrichment_run_id string, article_id string, status string, input_hash string, started_at timestamp, finished_at timestamp, error_message string, seq long"),
    (13, "enrichment_outputs", "enrichment_run_id string, translated_title_zh string, translated_body_zh string, summary_zh string, content_type string, classification_reason string"),
    (14, "article_tags", "enrichment_run_id string, tag_order int, tag string"),
    (15, "document_processing_runs", "key string, status string, current_step string, automatic_failure_count int, last_failure_step string, last_error_message string, last_attempt_started_at timestamp, locked_by string, lock_expires_at timestamp, updated_at timestamp, seq long"),
    (16, "article_processing_runs", "key string, article_id string, status string, current_step string, automatic_failure_count int, last_error_message string, last_success_input_hash string, last_attempt_started_at timestamp, locked_by string, lock_expires_at timestamp, updated_at timestamp, seq long"),
    (17, "scheduler_runs", "scheduler_run_id string, trigger_type string, status string, selected long, completed long, failed long, started_at timestamp, finished_at timestamp, seq long"),
    (18, "article_images", "article_id string, image_order int, image_path string, width int, height int"),
    (19, "page_parse_states", "document_key string, page_number int, file_name string, batch_id string, state string, markdown_text string"),
    (20, "import_retries", "run_id string, retry_run_id string, retried_message_count long, resolved_message_count long, failed_final_message_count long"),
    (21, "queue_events", "key string, expected long, event string, writer string, at timestamp, lease_seconds long, message string, input_hash string, article_id string, step string, commit long"),
)


#: Bytes of text handed to one Python call at most (a longer row comes alone).
SLICE_BYTES = 16 << 20


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches small: whole texts vary from one word to many MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(size, None)
    if now is None or not re.fullmatch(r"\d+", str(now)) or int(now) > 4 * SLICE_BYTES:
        spark.conf.set(size, str(4 * SLICE_BYTES))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own; a cluster must
    name one, since a machine-local folder would lose files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints/pressmill"
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for a table that cuts lineage."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Where tables of ``stored`` lie, by the plans that read them.
_PLACES: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    if path := _PLACES.pop(df, None):
        fs, there = _hadoop(df.sparkSession, path)
        fs.delete(there, True)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """(file system, path) as Hadoop has them."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def claim(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a file with ``text`` unless it is there: of several writers one gets true.

    The file is written under another name and then given its own, which fails where
    that is taken: a link on a local file system, a rename elsewhere."""
    fs, target = _hadoop(spark, path)
    if fs.getScheme() == "file":
        name = target.toUri().getPath()
        os.makedirs(os.path.dirname(name), exist_ok=True)
        part = f"{name}.{uuid.uuid4().hex}"
        with open(part, "w") as f:
            f.write(text)
        try:
            os.link(part, name)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
    jvm = spark.sparkContext._jvm
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(part, target, none)
        return True
    except Exception as e:
        if fs.exists(target):
            return False
        raise OSError(f"cannot create {path}") from e
    finally:
        fs.delete(part, False)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder, none where there is no folder."""
    fs, there = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(there)) if fs.exists(there) else []


def content(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, there = _hadoop(spark, path)
    stream = fs.open(there)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


@contextmanager
def locked(spark: SparkSession, folder: str, seconds: float = 60, wait: float = 0.05, clock=time.time, sleep=time.sleep) -> Iterator[int]:
    """Hold a folder's lock; gives its turn.

    Turns are files 1, 2, ..; the next one is free to claim once the last is done or
    its ``seconds`` are over, so a holder that died blocks nobody for longer."""
    while True:
        names = names_in(spark, folder)
        turn = max((int(n) for n in names if n.isdigit()), default=0)
        if not turn or f"{turn}.done" in names or float(content(spark, f"{folder}/{turn}")) <= clock():
            if claim(spark, f"{folder}/{turn + 1}", str(clock() + seconds)):
                break
        else:
            sleep(wait)
    try:
        yield turn + 1
    finally:
        claim(spark, f"{folder}/{turn + 1}.done")


def migrate(spark: SparkSession, root: str, seconds: float = 60) -> list[int]:
    """Create missing tables in order; a table that is there stays as it is. Returns the versions applied.

    Processes that start together take turns, and the later ones find all done."""
    marker = f"{root}/_schema_version"
    with locked(spark, f"{root}/_migration_turns", seconds):
        done = {r["version"] for r in _read(spark, marker, "version int").collect()}
        new = [v for v, _, _ in MIGRATIONS if v not in done]
        for version, table, ddl in MIGRATIONS:
            if version in new:
                spark.createDataFrame([], ddl).write.mode("append").parquet(f"{root}/{table}")
        if new:
            spark.createDataFrame([(v,) for v in new], "version int").write.mode("append").parquet(marker)
    return new


def inspect(spark: SparkSession, root: str) -> dict:
    """Whether the tables are there: ok, or error and what lacks; versions applied and missing."""
    done = sorted(r["version"] for r in _read(spark, f"{root}/_schema_version", "version int").collect())
    pending = [v for v, _, _ in MIGRATIONS if v not in done]
    detail = "no table was ever made" if not done else "tables are missing" if pending else "all tables are there"
    return {"status": "error" if pending else "ok", "detail": detail, "applied": done, "pending": pending}


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    fs, there = _hadoop(spark, path)
    if not fs.exists(there):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(path)


def ddl(table: str) -> str:
    return next(d for _, n, d in MIGRATIONS if n == table)


def conformed(df: DataFrame, table: str) -> DataFrame:
    """``df`` with just the columns of a table, null where it has none."""
    known = df.sparkSession.createDataFrame([], ddl(table)).schema
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in known])


def put_batch(df: DataFrame, root: str, table: str, batch: str) -> None:
    """Rows that ``batch`` adds to a table; writing them again replaces them.

    They are seen once the batch's row in ``import_runs`` is, so that comes last."""
    conformed(df, table).write.mode("overwrite").parquet(f"{root}/_batches/{table}/batch={batch}")


def batches_done(spark: SparkSession, root: str) -> DataFrame:
    """(batch): those whose rows are all there."""
    return _read(spark, f"{root}/_batches/import_runs", f"{ddl('import_runs')}, batch string").select("batch").distinct()


def published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table's rows: what was appended, and what whole batches added."""
    base = _read(spark, f"{root}/{table}", ddl(table))
    added = _read(spark, f"{root}/_batches/{table}", f"{ddl(table)}, batch string").join(batches_done(spark, root), "batch", "left_semi").drop("batch")
    return base.unionByName(added)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def insert_new(rows: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """What an insert that ignores known keys would add; the first row of a new key."""
    return rows.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Newest row of each key over both; ``rows`` win on a tie."""
    both = target.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in keys and c != "__new"]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(order, "__new")).alias("__x"))
    return best.select(*keys, *[F.col(f"__x.{c}") for c in columns])


def publish_run(root: str, run: DataFrame, parts: dict[str, DataFrame]) -> None:
    """A parse run's tables, then its own row: readers that start from runs never
    see half of one."""
    for name, df in parts.items():
        append(df, f"{root}/{name}")
    append(run, f"{root}/parse_runs")


def opened(spark: SparkSession, root: str, table: str, **run) -> None:
    """A run's first row: running, with its sequence number 0."""
    columns = spark.createDataFrame([], dict((n, d) for _, n, d in MIGRATIONS)[table]).schema
    append(spark.createDataFrame([{"status": "running", "seq": 0} | run], columns), f"{root}/{table}")


def closed(spark: SparkSession, root: str, table: str, key: str, **run) -> None:
    """A later row of a run: what is given replaces what was there, the rest stays."""
    schema = spark.createDataFrame([], dict((n, d) for _, n, d in MIGRATIONS)[table]).schema
    now = states(spark, root, table, key).filter(F.col(key) == run[key]).limit(1).collect()
    if not now:
        raise LookupError(f"not found: {key} {run[key]}")
    append(spark.createDataFrame([now[0].asDict() | run | {"seq": now[0]["seq"] + 1}], schema), f"{root}/{table}")


def states(spark: SparkSession, root: str, table: str, key: str) -> DataFrame:
    """The newest row of each run."""
    rows = _read(spark, f"{root}/{table}", dict((n, d) for _, n, d in MIGRATIONS)[table])
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("x")).select(key, *[F.col(f"x.{c}") for c in rest])


def write_blobs(rows: DataFrame, root: str, path_col: str = "raw_path", content_col: str = "content") -> DataFrame:
    """Store each content under its path once; gives the paths and whether they are new.

    ``root`` is an address that every task reaches, of any file system pyarrow knows
    (hdfs://, s3://, gs://, file://) or a folder that all executors mount.  Contents get
    another name first, so a file is whole once it has its own; a task that runs twice
    writes the same bytes."""

    def put(frames):
        from pyarrow import fs as stores

        store, base = stores.FileSystem.from_uri(root)
        for frame in frames:
            new = []
            for path, content in zip(frame[path_col], frame[content_col], strict=True):
                target = f"{base.rstrip('/')}/{path}"
                fresh = store.get_file_info(target).type == stores.FileType.NotFound
                if fresh:
                    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    part = f"{target}.{uuid.uuid4().hex}"
                    with store.open_output_stream(part) as f:
                        f.write(bytes(content))
                    store.move(part, target)
                new.append(fresh)
            yield frame[[path_col]].assign(was_new=new)

    return rows.select(path_col, content_col).mapInPandas(put, f"{path_col} string, was_new boolean")


def blob_path(message: Column, attachment: Column, content_hash: Column, filename: Column) -> Column:
    suffix = F.lower(F.coalesce(F.regexp_extract(filename, r"(\.[^./]+)$", 1), F.lit("")))
    return F.concat(F.lit("raw/mail/"), message, F.lit("/"), attachment, F.lit("-"), content_hash, F.when(suffix == "", ".pdf").otherwise(suffix))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def log_line(event: str, **fields) -> str:
    """A log event as JSON with sorted keys."""
    return json.dumps({"event": event} | fields, sort_keys=True, ensure_ascii=False, default=str)


def validated(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined with a reason) of enrichment outputs."""
    n = F.size("tags")
    reason = (
        F.when(~F.col("content_type").isin("article", "advertisement", "uncertain"), "content type")
        .when((F.col("translation_status") == "succeeded") & (F.trim("translated_body") == ""), "empty translation")
        .when((F.col("summary_status") == "succeeded") & (F.trim("summary") == ""), "empty summary")
        .when((F.col("tagging_status") == "succeeded") & ~n.between(3, 8), "tag count")
    )
    marked = outputs.withColumn("fault", reason)
    return marked.filter("fault is null").drop("fault"), marked.filter("fault is not null")
