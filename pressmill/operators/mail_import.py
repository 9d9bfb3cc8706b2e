"""A mail import as one run: documents, audit, checkpoint, queue, failed messages, retry.

A run's rows are written table by table under its name and seen once its own row is
there, which comes last (``storage.put_batch``).  So a run that dies halfway leaves
nothing, and one that is run again under its name writes the same places again; if
its row is there already, nothing happens.  One writer a root at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import mail, storage
from . import control, ingest

SOURCE = "mail"
#: Places in a message: attachments, then as many links.
PLACES = 2_000_000
#: Kinds of rows that a run of its name adds.
TABLES = ("documents", "import_run_items", "failed_messages", "import_checkpoints", "document_processing_runs")


@dataclass(frozen=True)
class Summary:
    run_id: str
    status: str
    fetched: int
    imported: int
    created: int
    retried: int = 0
    resolved: int = 0
    failed_final: int = 0


def failed_states(spark: SparkSession, root: str, source: str = SOURCE) -> DataFrame:
    """The newest row of each message that ever failed."""
    rows = storage.published(spark, root, "failed_messages").filter(F.col("source_name") == source)
    rest = [c for c in rows.columns if c != "message_id"]
    return rows.groupBy("message_id").agg(F.max_by(F.struct(*rest), "seq").alias("x")).select("message_id", *[f"x.{c}" for c in rest])


def retryable(spark: SparkSession, root: str, source: str = SOURCE) -> DataFrame:
    """Pending messages that no retry has claimed."""
    return failed_states(spark, root, source).filter("retry_state = 'pending' and retry_attempt_count < 1")


def checkpoint_of(spark: SparkSession, root: str, source: str = SOURCE) -> int | None:
    rows = storage.published(spark, root, "import_checkpoints").filter(F.col("source_name") == source)
    row = rows.agg(F.max_by("checkpoint_value", "seq").alias("v")).first()
    return int(row["v"]) if row and row["v"] else None


def pending_after(before: DataFrame, items: DataFrame, messages: DataFrame, now: str, source: str = SOURCE) -> DataFrame:
    """Rows of the failed-message table after a run: messages with a failed item and a
    date are pending (one more attempt is counted if they had left that state),
    known messages without one are resolved."""
    bad = items.filter("status = 'failed' and message_id is not null").select("message_id").distinct().withColumn("bad", F.lit(True))
    seen = messages.select("message_id", "internal_date").dropDuplicates(["message_id"]).join(bad, "message_id", "left")
    old = before.select("message_id", F.col("retry_state").alias("was"), F.col("retry_attempt_count").alias("tried"), F.col("seq").alias("at"))
    met = seen.join(old, "message_id", "left").filter((F.col("bad") & (F.coalesce("internal_date", F.lit("")) != "")) | (F.col("bad").isNull() & F.col("was").isNotNull()))
    again = F.when(F.col("bad") & (F.col("was") != "pending"), 1).otherwise(0)
    return met.select(F.lit(source).alias("source_name"), "message_id", (F.coalesce("tried", F.lit(0)) + F.coalesce(again, F.lit(0))).cast("int").alias("retry_attempt_count"), F.when(F.col("bad"), "pending").otherwise("resolved").alias("retry_state"), control.at(now).alias("updated_at"), (F.coalesce("at", F.lit(-1)) + 1).cast("long").alias("seq"))


def _parsed(messages: DataFrame, config: mail.MailConfig, make: Callable | None, label: str) -> tuple[DataFrame, DataFrame]:
    """(attachments with downloaded links, all links with their verdicts), each read once."""
    fetch = (lambda: getattr(make(), "attachment", None)) if make is not None else None
    found = mail.attachments(messages, fetch)
    if not config.body_links:
        make = None
    links = mail.sorted_links(mail.candidate_links(mail.bodies(messages)), config.allowed_domains)
    refused = links.filter("verdict != 'allowed'" if config.body_links else "false").select("message_id", F.col("pos").cast("int").alias("pos"), F.col("url").alias("link_url"), "verdict", F.lit(None).cast("string").alias("error"))
    got = storage.stored(mail.downloads(links, make, config.link_words), f"{label}-links") if make is not None else None
    every = storage.stored(ingest.with_links(found, got) if got is not None else found.withColumn("link_url", F.lit(None).cast("string")), f"{label}-attachments")
    return every, refused if got is None else refused.unionByName(got.select(*refused.columns))


def run_import(spark: SparkSession, root: str, run_id: str, messages: DataFrame, config: mail.MailConfig, make: Callable | None, now: str, fallback_year: int, source: str = SOURCE, trigger: str = "manual", after: Callable[[str], None] | None = None, move_checkpoint: bool = True, failures: DataFrame | None = None) -> Summary:
    """Import (message_id, sender, internal_date, payload, seq) as run ``run_id``.

    ``make()`` gives a client of links and of ``attachment(message_id, attachment_id)``.
    ``failures``: audit rows of messages that could not be fetched at all.
    ``after`` is told each table written, for tests of what a crash leaves."""
    told = after or (lambda table: None)
    done = storage.states(spark, f"{root}/_batches", "import_runs", "run_id").filter(F.col("run_id") == run_id).first()
    if done is not None:
        return Summary(run_id, done["status"], done["fetched_message_count"], done["imported_attachment_count"], done["created_document_count"])
    messages = storage.stored(messages, f"{run_id}-messages")
    attachments, links = _parsed(messages, config, make, run_id)
    known = storage.published(spark, root, "documents")
    known = known.select("document_key", "content_hash", "source_name", F.coalesce("issue_date", F.lit("")).alias("issue_date"), "seq")
    rows = storage.stored(ingest.imported(messages, attachments, config.allowed_senders, fallback_year, known), f"{run_id}-imported")
    items = ingest.audit_items(messages, attachments, config.allowed_senders, rows).unionByName(ingest.link_items(links, messages))
    if failures is not None:
        items = items.unionByName(failures.select(*ingest.AUDIT))
    items = storage.stored(items, f"{run_id}-items")
    chosen = mail.selected(messages, attachments.filter("content is not null"), config.allowed_senders)
    before = checkpoint_of(spark, root, source)
    row = chosen.agg(F.max(F.col("internal_date").try_cast("bigint")).alias("ms")).first()
    checkpoint = str(row["ms"]) if move_checkpoint and row["ms"] is not None else None

    last = known.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("n")).first()["n"]
    order = F.col("seq") * PLACES + F.col("pos") + (last + 1)
    created = ingest.new_documents(rows).withColumn("created_at", control.at(now)).join(rows.select("document_key", order.alias("seq")), "document_key")
    storage.put_batch(created, root, "documents", run_id)
    told("documents")
    storage.put_batch(items.withColumns({"id": F.xxhash64(F.lit(run_id), "item_key"), "run_id": F.lit(run_id), "created_at": control.at(now)}), root, "import_run_items", run_id)
    told("import_run_items")
    storage.put_batch(pending_after(failed_states(spark, root, source), items, messages, now, source), root, "failed_messages", run_id)
    told("failed_messages")
    if checkpoint is not None:
        step = storage.published(spark, root, "import_checkpoints").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("n")).first()["n"] + 1
        mark = spark.createDataFrame([(source, "message_internal_date", checkpoint, step)], "source_name string, checkpoint_type string, checkpoint_value string, seq long")
        storage.put_batch(mark.withColumn("updated_at", control.at(now)), root, "import_checkpoints", run_id)
        told("import_checkpoints")
    queue = storage.published(spark, root, "document_processing_runs").select("key", "status", "current_step", "automatic_failure_count", "updated_at", "seq")
    keys = ingest.enqueue_documents(queue, rows, now).join(queue.select("key"), "key", "left_anti")
    storage.put_batch(keys, root, "document_processing_runs", run_id)
    told("document_processing_runs")
    fetched = messages.count()
    result = ingest.run_result(run_id, items, fetched, checkpoint)
    result = result.withColumns({"source_name": F.lit(source), "trigger_type": F.lit(trigger), "checkpoint_before": F.lit(None if before is None else str(before)).cast("string"), "started_at": control.at(now), "finished_at": control.at(now), "seq": F.lit(1).cast("long")})
    storage.put_batch(result, root, "import_runs", run_id)  # from here on all of it is seen
    told("import_runs")
    n = result.first()
    return Summary(run_id, n["status"], fetched, n["imported_attachment_count"], n["created_document_count"])


def retry_failed(spark: SparkSession, root: str, run_id: str, config: mail.MailConfig, make: Callable, now: str, fallback_year: int, source: str = SOURCE) -> Summary | None:
    """One more attempt at each pending message, as a run of its own; None if none is due.

    The claim is published first, so a message is tried once even if the retry dies."""
    with storage.locked(spark, f"{root}/_retry_turns"):  # of two that retry at once, the second finds nothing due
        due = storage.stored(retryable(spark, root, source), "retry-due")
        if due.isEmpty():
            return None
        claimed = due.withColumns({"retry_attempt_count": F.col("retry_attempt_count") + 1, "updated_at": control.at(now), "seq": F.col("seq") + 1})
        storage.append(storage.conformed(claimed, "failed_messages"), f"{root}/failed_messages")
    ids = due.orderBy(F.desc("updated_at"), F.desc("message_id")).select("message_id", F.monotonically_increasing_id().alias("seq"))
    got = storage.stored(mail.fetched_by_id(ids, make, keep_errors=True), "retry-fetched")
    none = F.lit(None).cast("string")
    lost = got.filter("error is not null").select(
        F.lit("message").alias("item_type"), F.concat(F.lit("message:"), "message_id").alias("item_key"), "message_id", none.alias("attachment_id"), none.alias("link_url"), F.lit("failed").alias("status"),
        F.lit("retry_message_fetch_failed").alias("detail_code"), F.col("error").alias("detail_message"), none.alias("document_key"), none.alias("message_internal_date"))
    done = run_import(spark, root, run_id, got.filter("error is null").drop("error"), config, make, now, fallback_year, source, "retry", move_checkpoint=False, failures=lost)
    items = storage.published(spark, root, "import_run_items").filter(F.col("run_id") == run_id)
    bad = items.filter("status = 'failed'").select("message_id").distinct().withColumn("bad", F.lit(True))
    final = due.select("message_id").join(bad, "message_id", "left").join(failed_states(spark, root, source).drop("source_name", "retry_state", "retry_attempt_count"), "message_id")
    final = final.join(due.select("message_id", "source_name", (F.col("retry_attempt_count") + 1).alias("retry_attempt_count")), "message_id")
    final = storage.stored(final.withColumns({"retry_state": F.when(F.col("bad"), "failed_final").otherwise("resolved"), "updated_at": control.at(now), "seq": F.col("seq") + 1}), "retry-final")
    storage.append(storage.conformed(final, "failed_messages"), f"{root}/failed_messages")
    n = final.groupBy("retry_state").count().collect()
    counts = {r["retry_state"]: r["count"] for r in n}
    return Summary(run_id, done.status, done.fetched, done.imported, done.created, sum(counts.values()), counts.get("resolved", 0), counts.get("failed_final", 0))


def import_mail(spark: SparkSession, root: str, run_id: str, config: mail.MailConfig, make: Callable, now: str, fallback_year: int, source: str = SOURCE) -> Summary:
    """Search after the checkpoint, import what is found, then retry what had failed."""
    messages = mail.fetched(spark, make, config, checkpoint_of(spark, root, source), config.label_ids)
    done = run_import(spark, root, run_id, messages, config, make, now, fallback_year, source)
    again = retry_failed(spark, root, f"{run_id}-retry", config, make, now, fallback_year, source)
    if again is None:
        return done
    row = spark.createDataFrame([(run_id, again.run_id, again.retried, again.resolved, again.failed_final)], storage.ddl("import_retries"))
    storage.append(row, f"{root}/import_retries")
    return Summary(run_id, done.status, done.fetched, done.imported, done.created, again.retried, again.resolved, again.failed_final)
