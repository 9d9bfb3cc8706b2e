"""Mail messages as a source: attachments, body links, selection, resolution.

Messages: (message_id, sender, internal_date, payload) with payload as JSON of
nested parts; network clients are injected and made in each task.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .settings import load, setting
from .storage import SLICE_BYTES, bounded_batches

#: The prefix and the parts of names (in lower case) of translated copies.
TRANSLATED_PREFIX = "【译】"
TRANSLATED_NAMES = ("中文-华尔街日报", "中文-金融时报", "【译】the_economist_(web_edition)_0205.pdf")


class FetchError(OSError):
    """A link or message that a client could not fetch; so are all errors of its base class."""


@dataclass(frozen=True)
class MailConfig:
    """Typed settings of a mailbox with their defaults."""

    query: str = setting("query", "")
    allowed_senders: tuple[str, ...] = setting("allowed_senders", ())
    allowed_domains: tuple[str, ...] = setting("allowed_link_domains", ())
    max_results: int = setting("max_results", 25)
    include_spam: bool = setting("include_spam_trash", False)
    label_ids: tuple[str, ...] = setting("label_ids", ())
    body_links: bool = setting("enable_body_links", True)
    link_words: tuple[str, ...] = setting("download_link_keywords", ("download", "pdf", "下载"))

    @classmethod
    def load(cls, values: dict | str) -> MailConfig:
        return load(cls, values)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("message_id string, sender string, internal_date string, payload string").json(path)


def since(messages: DataFrame, checkpoint_ms: int | None) -> DataFrame:
    """Only messages after the checkpoint, in whole seconds as the service counts."""
    if not checkpoint_ms:
        return messages
    return messages.filter(F.col("internal_date").try_cast("bigint") >= (checkpoint_ms // 1000) * 1000)


def checkpoint(selected: DataFrame, *keys: str) -> DataFrame:
    """The largest date of the selected messages, as a number, failed items or not; by ``keys`` if any."""
    return selected.groupBy(*keys).agg(F.max(F.col("internal_date").try_cast("bigint")).alias("checkpoint_ms"))


def parts_of(payload: dict) -> Iterator[dict]:
    """All MIME parts, depth first, without recursion: nesting is unbounded."""
    todo = [payload]
    while todo:
        part = todo.pop()
        yield part
        todo.extend(reversed(part.get("parts") or []))


def decode(data: str) -> bytes:
    return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))


def attachments(messages: DataFrame, make_fetch: Callable[[], Callable[[str, str], bytes]] | None = None) -> DataFrame:
    """(message_id, pos, attachment_id, filename, mime_type, content) of PDF parts."""

    columns = ["message_id", "pos", "attachment_id", "filename", "mime_type", "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = make_fetch() if make_fetch else None
        for batch in batches:
            rows, held = [], 0
            for m in batch.itertuples():
                for i, part in enumerate(parts_of(json.loads(m.payload or "{}"))):
                    name, mime, body = part.get("filename") or "", part.get("mimeType") or "", part.get("body") or {}
                    if name and (mime == "application/pdf" or name.lower().endswith(".pdf")):
                        key = body.get("attachmentId") or part.get("partId") or name
                        rows.append((m.message_id, i, key, name, mime, decode(body["data"]) if body.get("data") else fetch(m.message_id, key) if fetch else b""))
                        held += len(rows[-1][-1] or b"")
                        if held > SLICE_BYTES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    bounded_batches(messages.sparkSession)
    return messages.mapInPandas(run, "message_id string, pos int, attachment_id string, filename string, mime_type string, content binary")


def bodies(messages: DataFrame) -> DataFrame:
    """(message_id, mime_type, body) of the text parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(m.message_id, p["mimeType"], decode(p["body"]["data"]).decode(errors="replace")) for m in batch.itertuples() for p in parts_of(json.loads(m.payload or "{}")) if p.get("mimeType") in ("text/plain", "text/html") and (p.get("body") or {}).get("data") and not p.get("filename")]
            yield pd.DataFrame(rows, columns=["message_id", "mime_type", "body"])

    bounded_batches(messages.sparkSession)
    return messages.mapInPandas(run, "message_id string, mime_type string, body string")


def is_translated(filename: Column) -> Column:
    """A translated copy, by its name."""
    base = F.element_at(F.split(F.regexp_replace(filename, "/+$", ""), "/"), -1)
    name = F.lower(base)
    translated = base.startswith(TRANSLATED_PREFIX)
    for part in TRANSLATED_NAMES:
        translated = translated | name.contains(part)
    return translated


def is_pdf(mime: Column, filename: Column) -> Column:
    """A PDF by type or name that is no translated copy."""
    return ((mime == "application/pdf") | F.lower(filename).endswith(".pdf")) & ~is_translated(filename)


def selected(messages: DataFrame, pdfs: DataFrame, senders: tuple[str, ...]) -> DataFrame:
    """Messages of allowed senders, spelled as they are, with at least one PDF."""
    ok = pdfs.filter(is_pdf(F.col("mime_type"), F.col("filename"))).select("message_id").distinct()
    return messages.filter(F.col("sender").isin(*senders)).join(ok, "message_id", "left_semi")


def candidate_links(body: DataFrame) -> DataFrame:
    """(message_id, url) once a message, in order: anchors of HTML, addresses of plain text."""
    found = F.when(F.col("mime_type") == "text/html", F.transform(tx.anchors("body"), lambda a: a["href"])).otherwise(tx.urls(F.col("body")))
    rows = body.select("message_id", F.posexplode(found).alias("pos", "url")).filter(F.col("url").rlike("^https?://"))
    return rows.groupBy("message_id", "url").agg(F.min("pos").alias("pos"))


def sorted_links(links: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """``links`` with link_id and a verdict for the audit; without ``domains`` all are allowed."""
    allowed = F.coalesce(tx.host(F.col("url")).isin(*[d.lower() for d in domains]), F.lit(False)) if domains else F.lit(True)
    return links.withColumns({"link_id": tx.link_id(F.col("url")), "verdict": F.when(allowed, "allowed").otherwise("link_domain_not_allowed")})


def resolve(url: Column, landing: Column, head: Column, html: Column, words: tuple[str, ...] = ("download", "pdf", "下载")) -> Column:
    """Where a link's file is: a PDF path, the landing service's answer, the link
    itself if it serves a PDF, a PDF anchor, or an address within a script."""
    links = tx.anchors(html)
    named = lambda label: reduce(Column.__or__, [F.contains(F.lower(label), F.lit(w.lower())) for w in words], F.lit(False))
    wanted = F.filter(links, lambda a: tx.looks_like_pdf_url(a["href"]) | named(a["label"]))
    script = tx.match(html, r"[\"'](https?://[^\"']+\.pdf[^\"']*)[\"']")
    return F.coalesce(
        F.when(tx.looks_like_pdf_url(url), url), F.when(landing != "", landing), F.when(head.startswith("%PDF"), url),
        F.try_element_at(F.transform(wanted, lambda a: a["href"]), F.lit(1)), tx.nullif_empty(script))


def batches_of(rows: DataFrame, order: list[str], size: int = 30) -> DataFrame:
    """Rows of each document numbered into batches of at most ``size`` files."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("document_key").orderBy(*order))
    return rows.withColumn("batch", F.floor((place - 1) / size).cast("int"))


def incremental_query(query: str, checkpoint_ms: int | None) -> str:
    """The search with what is newer than a checkpoint, in whole seconds."""
    return " ".join(x for x in (query, f"after:{checkpoint_ms // 1000}" if checkpoint_ms else "") if x)


def fetched(spark: SparkSession, make: Callable, config: MailConfig, checkpoint_ms: int | None = None, label_ids: tuple[str, ...] = (), partitions: int = 4) -> DataFrame:
    """(message_id, sender, internal_date, payload, seq) of the first page of a search.

    ``make()`` gives a client with ``list(query, max_results, label_ids,
    include_spam) -> ids`` and ``get(id) -> message``; only ids, at most
    ``max_results``, come to the driver, messages are fetched by tasks."""
    ids = list(make().list(incremental_query(config.query, checkpoint_ms), config.max_results, list(label_ids), config.include_spam))[: config.max_results]
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "message_id string, seq long").repartition(max(1, min(partitions, len(ids))))
    return fetched_by_id(rows, make).drop("error")


def message_row(message: dict, key: str) -> tuple:
    """(message_id, From header, internal_date, payload) of a message as the service gives it."""
    payload = message.get("payload") or {}
    sender = next((h.get("value", "") for h in payload.get("headers", []) if h.get("name", "").lower() == "from"), "")
    return message.get("id", key), sender, message.get("internalDate"), json.dumps(payload)


def fetched_by_id(rows: DataFrame, make: Callable, keep_errors: bool = False) -> DataFrame:
    """Messages of the ids in (message_id, seq); with ``keep_errors`` an OSError of the
    client is told in ``error`` instead of ending the run."""

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for batch in batches:
            found = []
            for key, seq in zip(batch["message_id"], batch["seq"], strict=True):
                try:
                    found.append((*message_row(client.get(key), key), seq, None))
                except OSError as e:
                    if not keep_errors:
                        raise
                    found.append((key, "", None, None, seq, str(e) or type(e).__name__))
            yield pd.DataFrame(found, columns=["message_id", "sender", "internal_date", "payload", "seq", "error"])

    got = rows.select("message_id", "seq").mapInPandas(get, "message_id string, sender string, internal_date string, payload string, seq long, error string")
    return got.withColumn("sender", tx.sender_address("sender"))


def downloads(links: DataFrame, make: Callable, words: tuple[str, ...] = ("download", "pdf", "下载")) -> DataFrame:
    """What became of each allowed link: an attachment, or why there is none.

    ``make()`` gives a client with ``fetch_html(url)``, ``download_binary(url)`` and,
    where a service has one, ``landing(url)``: an address, (address, file name) or
    None.  ``verdict`` is downloaded, link_fetch_failed (an OSError of the client),
    link_not_importable (it leads to no file) or body_link_filename_filtered (a
    translated copy, which isn't fetched); other errors end the run.  Where a link
    leads is decided by ``resolve``; a file that a look has brought along isn't
    fetched again."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for batch in batches:
            seen = []
            for url, direct in zip(batch["url"], batch["direct"], strict=True):
                place, name, data, page, error = "", None, None, "", None
                if not direct:
                    try:
                        found = client.landing(url) if hasattr(client, "landing") else None
                        place, name = (found, None) if isinstance(found, str) else found or ("", None)
                        if not place:
                            try:
                                data = client.download_binary(url)
                            except OSError:
                                data = None  # not a file: the page may tell more
                            if not (data or b"").startswith(b"%PDF"):
                                data, page = None, client.fetch_html(url) or ""
                    except OSError as e:
                        error = str(e) or type(e).__name__
                seen.append((place, name, data, page, error))
            yield batch.assign(**{c: [x[i] for x in seen] for i, c in enumerate(("landing", "landing_name", "content", "html", "error"))})

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for batch in batches:
            contents, errors = [], []
            for target, wanted, content, error in zip(batch["target"], batch["wanted"], batch["content"], batch["error"], strict=True):
                if wanted and content is None:
                    try:
                        content = client.download_binary(target)
                    except OSError as e:
                        error = str(e) or type(e).__name__
                contents.append(content)
                errors.append(error)
            yield batch.assign(content=contents, error=errors)

    key = "message_id string, url string, pos int, link_id string"
    rows = links.filter("verdict = 'allowed'").select("message_id", "url", F.col("pos").cast("int").alias("pos"), "link_id", F.coalesce(tx.looks_like_pdf_url(F.col("url")), F.lit(False)).alias("direct"))
    seen = rows.mapInPandas(look, f"{key}, direct boolean, landing string, landing_name string, content binary, html string, error string")
    head = F.when(F.col("content").isNotNull(), "%PDF").otherwise("")
    aimed = seen.withColumn("target", F.when(F.col("error").isNull(), resolve(F.col("url"), F.col("landing"), head, F.col("html"), words)))
    aimed = aimed.withColumn("filename", F.coalesce("landing_name", tx.filename_from_url(F.col("target")))).withColumn("translated", F.coalesce(is_translated(F.col("filename")), F.lit(False)))
    aimed = aimed.select(*[x.split()[0] for x in key.split(", ")], "target", "filename", "translated", "content", "error", (F.col("target").isNotNull() & ~F.col("translated")).alias("wanted"))
    got = aimed.mapInPandas(take, f"{key}, target string, filename string, translated boolean, content binary, error string, wanted boolean")
    verdict = F.when(F.col("error").isNotNull(), "link_fetch_failed").when(F.col("target").isNull(), "link_not_importable").when(F.col("translated"), "body_link_filename_filtered").otherwise("downloaded")
    return got.select("message_id", "pos", F.col("link_id").alias("attachment_id"), "filename", F.lit("application/pdf").alias("mime_type"), F.when(verdict == "downloaded", F.col("content")).alias("content"), F.col("url").alias("link_url"), verdict.alias("verdict"), "error")
