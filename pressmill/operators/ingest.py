"""Messages to imported documents, audit items and queue entries, as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from ..functions import dates
from ..sources import mail
from ..sources.storage import blob_path
from . import control, identity

AUDIT = ("item_type", "item_key", "message_id", "attachment_id", "link_url", "status", "detail_code", "detail_message", "document_key", "message_internal_date")
#: What an audit row says beyond its code. The codes.
DETAILS = {
    "message_selected": "The sender is allowed.", "sender_not_allowed": "The sender is not allowed.", "document_created": "A new document.", "duplicate_document": "A document that was there before.",
    "link_domain_not_allowed": "The link's domain is not allowed.", "link_not_importable": "The link leads to no PDF.", "body_link_filename_filtered": "The link leads to a translated copy.",
}


def is_link(attachment: Column) -> Column:
    return attachment.startswith("link:")


def link_reference(attachment: Column, link: Column) -> Column:
    """The address of a body link: as it was found, or as the attachment's id names it."""
    return F.when(is_link(attachment), F.coalesce(F.when(link != "", link), F.regexp_replace(attachment, "^link:", "")))


def item_key(message: Column, attachment: Column, link: Column) -> Column:
    """The audit key of a message's attachment or body link."""
    kind = F.when(is_link(attachment), F.lit(":body_link:")).otherwise(F.lit(":attachment:"))
    return F.concat(F.lit("message:"), message, kind, F.coalesce(link_reference(attachment, link), attachment))


def with_links(attachments: DataFrame, downloads: DataFrame) -> DataFrame:
    """Attachments and downloaded body links as one list, in order of ``pos`` for each message.

    Links that led to no file are no attachments: ``link_items`` tells of them."""
    links = downloads.filter("content is not null").withColumn("pos", F.col("pos") + 1_000_000).drop("verdict", "error")
    return attachments.withColumn("link_url", F.lit(None).cast("string")).unionByName(links, allowMissingColumns=True)


def detailed(code: Column, error: Column | None = None) -> Column:
    said = F.create_map(*[F.lit(x) for kv in DETAILS.items() for x in kv])
    return F.coalesce(*([error] if error is not None else []), said[code])


def link_items(links: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Audit rows of body links that gave no attachment: refused by the allow-list
    (``mail.sorted_links``), or ``mail.downloads`` says why.  Only a link that could
    not be fetched has failed."""
    url = F.col("link_url" if "link_url" in links.columns else "url")
    rows = links.filter("verdict not in ('allowed', 'downloaded')")
    if messages is not None:
        rows = rows.join(messages.select("message_id", "internal_date"), "message_id", "left")
    code = F.col("verdict")
    return rows.select(
        F.lit("body_link").alias("item_type"), F.concat(F.lit("message:"), F.col("message_id"), F.lit(":body_link:"), url).alias("item_key"), "message_id", F.concat(F.lit("link:"), url).alias("attachment_id"), url.alias("link_url"),
        F.when(code == "link_fetch_failed", "failed").otherwise("skipped").alias("status"), code.alias("detail_code"), detailed(code, F.col("error") if "error" in links.columns else None).alias("detail_message"),
        F.lit(None).cast("string").alias("document_key"), (F.col("internal_date") if messages is not None else F.lit(None).cast("string")).alias("message_internal_date"))


def imported(messages: DataFrame, attachments: DataFrame, senders: tuple[str, ...], fallback_year: int, known: DataFrame | None = None) -> DataFrame:
    """A row a PDF of the selected messages: its document, and whether it is new.

    ``messages``: (message_id, sender, internal_date, seq); ``attachments``:
    (message_id, pos, attachment_id, filename, mime_type, content, link_url).
    ``known``: documents so far, (document_key, content_hash, source_name,
    issue_date, seq); they come before all arrivals.  In order of message and
    attachment a PDF reuses the document with its bytes, or with its source and
    issue where the name tells both.  What has no content gives no document.
    """
    chosen = messages.filter(F.col("sender").isin(*senders))
    pdfs = attachments.filter(mail.is_pdf(F.col("mime_type"), F.col("filename")) & F.col("content").isNotNull()).join(chosen, "message_id")
    sha = F.sha2(F.col("content"), 256)
    issue, source = dates.filename_date(F.col("filename"), F.col("internal_date"), fallback_year), dates.source_name(F.col("filename"))
    rows = pdfs.select("message_id", "attachment_id", "filename", "sender", "internal_date", "link_url", "seq", "pos", sha.alias("content_hash"), source.alias("source_name"), issue.alias("issue_date"))
    rows = rows.withColumn("document_key", F.sha2(F.concat_ws("|", "message_id", "attachment_id", "content_hash").cast("binary"), 256))
    rows = rows.withColumn("raw_path", blob_path(F.col("message_id"), F.regexp_replace("attachment_id", "/", "_"), F.col("content_hash"), F.col("filename")))
    order = F.struct(F.lit(1).alias("late"), "seq", "pos", "attachment_id")
    issue_key = F.when((F.col("source_name") != "") & (F.col("issue_date") != ""), F.concat_ws("|", "source_name", "issue_date"))
    arrivals = rows.select("document_key", "content_hash", issue_key.alias("issue_key"), order.alias("at"))
    if known is not None:
        before = F.struct(F.lit(0).alias("late"), F.col("seq").cast("long").alias("seq"), F.lit(0).alias("pos"), F.lit("").alias("attachment_id"))
        arrivals = known.select("document_key", "content_hash", issue_key.alias("issue_key"), before.alias("at")).unionByName(arrivals.withColumn("at", F.col("at").cast("struct<late:int,seq:long,pos:int,attachment_id:string>")))
    # The order as text sorts as the rows do, which greedy_dedup takes for its sequence.
    place = lambda c: F.concat_ws("|", F.col(f"{c}.late").cast("string"), F.lpad(F.col(f"{c}.seq").cast("string"), 19, "0"), F.lpad(F.col(f"{c}.pos").cast("string"), 10, "0"), F.col(f"{c}.attachment_id"), F.col("document_key"))
    placed = arrivals.withColumn("seq", place("at"))
    kept = identity.greedy_dedup(placed.select("seq", "content_hash", "issue_key"))
    keys = placed.select(F.col("seq").alias("kept_seq"), F.col("document_key").alias("canonical_key"))
    told = placed.filter("at.late = 1").select("seq", "document_key").join(kept, "seq").join(keys, "kept_seq")
    return rows.join(told.select("document_key", "canonical_key", (F.col("seq") == F.col("kept_seq")).alias("was_created")), "document_key")


def new_documents(rows: DataFrame) -> DataFrame:
    """The documents that ``imported`` adds."""
    return rows.filter("was_created").select("document_key", "source_name", F.col("message_id").alias("source_message_id"), F.col("attachment_id").alias("source_attachment_id"), "sender", F.col("filename").alias("original_filename"), "content_hash", "raw_path", F.lit("imported").alias("import_status"), F.col("internal_date").alias("source_message_internal_date"), F.nullif("issue_date", F.lit("")).alias("issue_date"))


def audit_items(messages: DataFrame, attachments: DataFrame, senders: tuple[str, ...], rows: DataFrame) -> DataFrame:
    """A row a message, a row an item of messages that weren't allowed, a row a PDF."""
    allowed = F.coalesce(F.col("sender").isin(*senders), F.lit(False))
    none = F.lit(None).cast("string")
    said = messages.select(
        F.lit("message").alias("item_type"), F.concat(F.lit("message:"), F.col("message_id")).alias("item_key"), "message_id", none.alias("attachment_id"), none.alias("link_url"), F.when(allowed, "succeeded").otherwise("skipped").alias("status"),
        F.when(allowed, "message_selected").otherwise("sender_not_allowed").alias("detail_code"), none.alias("document_key"), F.col("internal_date").alias("message_internal_date"))
    kind = F.when(is_link(F.col("attachment_id")), "body_link").otherwise("attachment").alias("item_type")
    common = (kind, item_key(F.col("message_id"), F.col("attachment_id"), F.col("link_url")).alias("item_key"), F.col("message_id"), F.col("attachment_id"), link_reference(F.col("attachment_id"), F.col("link_url")).alias("link_url"))
    refused = attachments.join(messages.filter(~allowed).select("message_id", "internal_date"), "message_id")
    left = refused.select(*common, F.lit("skipped").alias("status"), F.lit("sender_not_allowed").alias("detail_code"), none.alias("document_key"), F.col("internal_date").alias("message_internal_date"))
    made = rows.select(*common, F.when(F.col("was_created"), "succeeded").otherwise("skipped").alias("status"), F.when(F.col("was_created"), "document_created").otherwise("duplicate_document").alias("detail_code"), F.col("canonical_key").alias("document_key"), F.col("internal_date").alias("message_internal_date"))
    every = said.unionByName(left).unionByName(made)
    return every.withColumn("detail_message", detailed(F.col("detail_code"))).select(*AUDIT)



def run_counts(items: DataFrame, *keys: str, **also: Column) -> DataFrame:
    """Counts of audit rows, by ``keys`` if any, and the status they give a run: partial
    if an item failed; with further aggregates by name."""
    n = lambda when: F.coalesce(F.count_if(when), F.lit(0).cast("long"))
    of, code = F.col("status"), F.col("detail_code")
    counts = items.groupBy(*keys).agg(n(of == "failed").alias("failed_item_count"), n(of == "skipped").alias("skipped_item_count"), n(code.isin("document_created", "duplicate_document")).alias("imported_attachment_count"), n(code == "document_created").alias("created_document_count"), n(code == "duplicate_document").alias("skipped_document_count"), *[c.alias(k) for k, c in also.items()])
    return counts.withColumn("status", F.when(F.col("failed_item_count") > 0, "partial").otherwise("succeeded"))


def run_result(run_id: str, items: DataFrame, fetched: int = 0, checkpoint: str | None = None, failed: bool = False) -> DataFrame:
    """An import run's closing row: what its items say, or failed if the run did."""
    counts = run_counts(items)
    status = F.lit("failed") if failed else F.col("status")
    return counts.select(F.lit(run_id).alias("run_id"), status.alias("status"), F.lit(fetched).cast("long").alias("fetched_message_count"), *[c for c in counts.columns if c != "status"], F.lit(checkpoint).cast("string").alias("checkpoint_after"))


def enqueue_documents(queue: DataFrame, rows: DataFrame, now: str) -> DataFrame:
    """Every imported or reused document is in the queue once; known ones stay as they are."""
    return control.enqueue_once(queue, rows.select(F.col("canonical_key").alias("key")), now)
