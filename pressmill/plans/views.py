"""Versioned-read views: latest runs, usable enrichments, cards, facets, paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.adapters import Tables
from ..sources.storage import stored

USABLE = ("succeeded", "partial", "skipped_advertisement")
AD = "skipped_advertisement"
NO_ERROR = "当前没有错误。"


def latest_per(rows: DataFrame, keys: list[str], order: list[Column], ties: bool = False) -> DataFrame:
    """Rows that come first by ``order`` within ``keys``; all tied ones if asked."""
    place = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def latest_runs(t: Tables) -> DataFrame:
    """The newest succeeded parse run of each document; rows of one second by seq.

    A maximum of (time, seq) aggregates partly before the shuffle, unlike a window."""
    done = t.parse_runs().filter("status = 'succeeded'")
    best = done.groupBy("document_key").agg(F.max(F.struct("finished_at", "seq", "parse_run_id")).alias("x"))
    return best.select("document_key", "x.parse_run_id", "x.finished_at")


def usable_enrichments(t: Tables) -> DataFrame:
    """The newest usable enrichment runs of each article; ties all stay."""
    return latest_per(t.enrichment_runs().filter(F.col("status").isin(*USABLE)), ["article_id"], [F.desc("finished_at")], ties=True)


def advertisements(t: Tables) -> DataFrame:
    """Articles of which one of the newest usable runs (of ties, any) is an advertisement.

    Maxima of plain values aggregate by hash before the shuffle: no window, no sort."""
    runs = t.enrichment_runs().filter(F.col("status").isin(*USABLE))
    ad = F.col("status") == AD
    newest = runs.groupBy("article_id").agg(F.max("finished_at").alias("last"), F.max(F.when(ad, F.col("finished_at"))).alias("last_ad"), F.max(ad).alias("known"))
    return newest.filter(F.col("known") & F.col("last").eqNullSafe(F.col("last_ad"))).select("article_id")


def visible_articles(t: Tables) -> DataFrame:
    """Articles of the latest succeeded runs that aren't advertisements."""
    runs = latest_runs(t).select("parse_run_id", "document_key").join(t.documents().select("document_key", "source_name"), "document_key")
    return t.articles().join(runs, "parse_run_id").join(advertisements(t), "article_id", "left_anti")


def numbered(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``rows`` with their ``place`` in a total order: counts of the range partitions
    before, and a number within each."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), label)
    before, at = [], 0
    for r in sorted(ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()):  # a row a partition
        before.append((r["__part"], at))
        at += r["n"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "__part int, __before long"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(starts, "__part").withColumn("place", F.col("__before") + within).drop("__part", "__before")


def document_detail(t: Tables) -> DataFrame:
    """Every document as its queue and its files have it, a row each visible article of
    its latest run (one without, if it has none)."""
    q = t.document_queue().withColumn("error_summary", document_error()).withColumnRenamed("status", "queued")
    shown = visible_articles(t).select("document_key", "article_id", "publication_date", "title").join(translated(t).select("article_id", "title_zh", "summary_zh", "enrichment_status"), "article_id", "left")
    count = shown.groupBy("document_key").agg(F.count("*").alias("n"))
    rows = t.documents().join(t.document_files(), "document_key").join(q, "document_key", "left").join(count, "document_key", "left").join(shown, "document_key", "left")
    reading = F.when(F.col("article_id").isNotNull(), F.when(F.col("enrichment_status").isNotNull(), "ready").otherwise("english_fallback"))
    return rows.select(
        "document_key", "source_name", "original_filename", "sender", "raw_path", "import_status", F.coalesce("queued", F.lit("unknown")).alias("status"), "current_step", "automatic_failure_count", "last_failure_step", "last_error_message", "locked_by", "updated_at",
        F.coalesce("error_summary", F.lit(NO_ERROR)).alias("error_summary"), F.coalesce("n", F.lit(0).cast("long")).alias("visible_article_count"), "article_id", "publication_date", F.col("title").alias("title_en"), "title_zh", "summary_zh", reading.alias("reading_status"))


def document_error() -> Column:
    """A queued document's error with the step it failed in, where that is known."""
    said = F.col("last_error_message")
    return F.when(said.isNull() | (said == ""), NO_ERROR).when(F.col("last_failure_step").isNotNull(), F.concat_ws(": ", "last_failure_step", said)).otherwise(said)


def source_pages(t: Tables) -> DataFrame:
    """(article_id, source_pages): the pages of its fragments, each once, ascending."""
    return t.lineage().groupBy("article_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("page_number")), lambda p: p.cast("string")), "|").alias("source_pages"))


def paging(page: int | None, size: int | None, limit: int | None = None) -> tuple[int, int]:
    """(page, size), each at least 1; ``limit`` takes the place of the size."""
    return max(1, page or 1), max(1, limit if limit is not None else size or 1)


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    page, size = paging(page, size)
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def pagination(rows: DataFrame, page: int, size: int) -> DataFrame:
    page, size = paging(page, size)
    return rows.agg(F.count("*").alias("total")).select(F.lit(page).alias("page"), F.lit(size).alias("page_size"), "total", F.ceil(F.col("total") / size).cast("long").alias("total_pages"))


def article_filters(t: Tables, rows: DataFrame, source: str = "", tag: str = "", date_from: str = "", date_to: str = "", reading_status: str = "", processing_status: str = "") -> DataFrame:
    """Empty filters, and unknown reading or processing states, are ignored."""
    if source:
        rows = rows.filter(F.col("source_name") == source)
    if date_from:
        rows = rows.filter(F.col("publication_date") >= F.to_date(F.lit(date_from)))
    if date_to:
        rows = rows.filter(F.col("publication_date").isNull() | (F.col("publication_date") <= F.to_date(F.lit(date_to))))
    if tag:  # of any succeeded or partial run, not only the latest
        rows = rows.join(t.tags().filter(F.col("tag") == tag).select("article_id").distinct(), "article_id", "left_semi")
    usable = t.enrichment_runs().filter(F.col("status").isin(*USABLE)).select("article_id").distinct()
    if reading_status in ("ready", "english_fallback"):
        rows = rows.join(usable, "article_id", "left_semi" if reading_status == "ready" else "left_anti")
    if processing_status in ("succeeded", "partial"):
        rows = rows.join(usable_enrichments(t).filter(F.col("status") == processing_status).select("article_id").distinct(), "article_id", "left_semi")
    elif processing_status == "pending":
        rows = rows.join(usable, "article_id", "left_anti")
    return rows


CARD_ORDER = [F.desc, F.asc]


def card_order() -> list[Column]:
    return [F.col("publication_date").desc(), F.col("article_order").asc(), F.col("article_id").asc()]


def latest_enrichment(t: Tables) -> DataFrame:
    """One usable enrichment an article, the newest, then the latest written; tags in order."""
    return latest_of(t.enrichment_runs())


def latest_of(runs: DataFrame) -> DataFrame:
    best = runs.filter(F.col("status").isin(*USABLE)).groupBy("article_id").agg(F.max(F.struct("finished_at", "seq", "enrichment_run_id", "status")).alias("x"))
    return best.select("article_id", "x.enrichment_run_id", "x.status", "x.finished_at")


def ordered_tags(t: Tables) -> DataFrame:
    return ordered(t.tags())


def ordered(tags: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("tag_order", "tag")))
    return tags.groupBy("enrichment_run_id").agg(F.array_join(F.transform(listed, lambda x: x["tag"]), "|").alias("tags"))


def hero_images(images: DataFrame) -> DataFrame:
    """(article_id, hero_image): the largest by area, the first of equal ones."""
    area = F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0).cast("long"))
    return images.groupBy("article_id").agg(F.max_by("image_path", F.struct(area.alias("area"), (-F.col("image_order")).alias("first"))).alias("hero_image"))


def of_page(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a page's keys alone: a page is small, so it goes to them."""
    return rows.join(F.broadcast(keys.select(key)), key, "left_semi")


def article_cards(t: Tables, page: int = 1, size: int = 20, **filters: str) -> DataFrame:
    """One page of cards with enrichment, tags and the largest image.

    The page is made first (``size`` rows), then only what belongs to it is gathered."""
    rows = page_of(article_filters(t, visible_articles(t), **filters), card_order(), page, size)
    rows = t.spark.createDataFrame(rows.collect(), rows.schema)  # at most ``size`` rows
    best = latest_of(of_page(t.enrichment_runs(), rows, "article_id")).withColumnRenamed("status", "enrichment_status").drop("finished_at")
    best = F.broadcast(best)  # a row a card
    tags = ordered(of_page(t.tags(), best, "enrichment_run_id"))
    cards = rows.join(best, "article_id", "left").join(tags, "enrichment_run_id", "left").join(hero_images(of_page(t.images(), rows, "article_id")), "article_id", "left")
    reading = F.when(F.col("enrichment_status").isNotNull(), "ready").otherwise("english_fallback")
    badge = F.when(F.col("enrichment_status") == "partial", "partial_enrichment").otherwise("")
    return cards.select("article_id", "document_key", "source_name", "publication_date", "article_order", "title", reading.alias("reading_status"), badge.alias("badge"), F.coalesce("tags", F.lit("")).alias("tags"), "hero_image")


def focus_feed(t: Tables, focus: list[str], each: int = 20) -> DataFrame:
    """At most ``each`` newest articles a tag; an article comes at its first tag."""
    ranks = t.spark.createDataFrame([(x, i) for i, x in enumerate(focus)], "tag string, tag_rank int")
    tagged = t.tags().join(F.broadcast(ranks), "tag").select("article_id", "tag", "tag_rank").distinct()
    rows = visible_articles(t).join(tagged, "article_id")
    place = F.row_number().over(Window.partitionBy("tag_rank").orderBy(*card_order()))
    top = rows.withColumn("pos", place).filter(F.col("pos") <= each)
    return latest_per(top, ["article_id"], [F.col("tag_rank"), F.col("pos")]).select("article_id", "tag", "tag_rank", "pos")


def overview(t: Tables, today: str) -> DataFrame:
    """Five counters in a row. Documents parsed twice today count twice, as specified."""
    day = F.to_date(F.lit(today))
    created = t.audit_items().filter((F.to_date("created_at") == day) & (F.col("status") == "imported")).agg(F.count("*").alias("created_documents"))
    done = t.parse_runs().filter((F.col("status") == "succeeded") & (F.to_date("finished_at") == day)).select("parse_run_id")
    ads = advertisements(t)
    parsed = t.articles().join(done, "parse_run_id", "left_semi").join(ads, "article_id", "left_anti").agg(F.count("*").alias("articles_today"))
    succeeded = t.enrichment_runs().filter("status = 'succeeded'").select("article_id")
    pending = visible_articles(t).join(succeeded, "article_id", "left_anti").agg(F.count("*").alias("pending_articles"))
    queue = t.processing_runs().agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status").isin("failed_retryable", "failed_terminal", "manual_retry_requested")).alias("exceptions"))
    out = created
    for one in (parsed, pending, queue):
        out = out.join(F.broadcast(one))  # a row each
    return out


def filter_options(t: Tables) -> DataFrame:
    done = t.parse_runs().filter("status = 'succeeded'").select("document_key").distinct()
    sources = t.documents().join(done, "document_key", "left_semi").select(F.lit("source").alias("facet"), F.col("source_name").alias("value")).distinct()
    tags = t.tags().join(advertisements(t), "article_id", "left_anti").select(F.lit("tag").alias("facet"), F.col("tag").alias("value")).distinct()
    return sources.unionByName(tags)


def listed(facets: DataFrame) -> DataFrame:
    """(facet, values): the values of each facet in ascending order, as the interface shows them."""
    return facets.groupBy("facet").agg(F.sort_array(F.collect_set("value")).alias("values"))


def translated(t: Tables) -> DataFrame:
    """(enrichment_run_id, article_id, enrichment_status, title_zh, summary_zh, body_zh, content_type, reason):
    the latest usable enrichment with its output; what an output lacks has its default.

    Without tags: an unused join would still be made."""
    best = latest_enrichment(t).select("article_id", "enrichment_run_id", F.col("status").alias("enrichment_status"))
    said = ["title_zh", "summary_zh", "body_zh", "content_type", "reason"]
    # An article's few outputs come to it by its id, so that nothing moves by the runs' ids as well.
    outputs = t.outputs().groupBy("article_id").agg(F.collect_list(F.struct("enrichment_run_id", *said)).alias("outputs"))
    own = F.get(F.filter("outputs", lambda o: o["enrichment_run_id"] == F.col("enrichment_run_id")), F.lit(0))
    rows = best.join(outputs, "article_id", "left").withColumn("output", own)
    rows = rows.select("article_id", "enrichment_run_id", "enrichment_status", *[F.col(f"output.{c}").alias(c) for c in said])
    return rows.withColumns({"content_type": F.coalesce("content_type", F.lit("article")), "reason": F.coalesce("reason", F.lit(""))})


def enriched(t: Tables) -> DataFrame:
    """``translated`` with its tags in order."""
    tags = t.tags().groupBy("article_id").agg(F.collect_list(F.struct("enrichment_run_id", "tag_order", "tag")).alias("tagged"))
    own = F.array_sort(F.filter("tagged", lambda x: x["enrichment_run_id"] == F.col("enrichment_run_id")))
    rows = translated(t).join(tags, "article_id", "left")
    return rows.withColumn("tags", F.coalesce(F.array_join(F.transform(own, lambda x: x["tag"]), "|"), F.lit(""))).drop("enrichment_run_id", "tagged")


def own_enrichment(rows: DataFrame) -> DataFrame:
    """``rows`` with the newest usable one of their nested ``enrichments``, as ``translated`` has it:
    ``enrichment_status``, and ``output``, a row each output of that run."""
    order = ("finished_at", "seq", "enrichment_run_id", "status")
    usable = F.filter("enrichments", lambda e: e["status"].isin(*USABLE))
    rows = rows.withColumn("best", F.array_max(F.transform(usable, lambda e: F.struct(*[e[c].alias(c) for c in order]))))
    wrote = lambda e: (e["enrichment_run_id"] == F.col("best.enrichment_run_id")) & e["status"].isin("succeeded", "partial")
    rows = rows.withColumns({"enrichment_status": F.col("best.status"), "outputs": F.filter("enrichments", wrote)})
    return rows.select("*", F.explode_outer("outputs").alias("output"))


def article_detail(t: Tables) -> DataFrame:
    """Every article with its document, images in order (the first is the hero here),
    enrichment and the three states; its translated body without local images.

    Articles come with what is nested in them, and move as numbers: once each by themselves, by run and by part."""
    runs = t.parse_runs().select("parse_run_id", "document_key", F.col("status").alias("parse_status"))
    # Runs are told of their documents first: fewer rows than articles.
    runs = runs.join(t.documents().select("document_key", "source_name"), "document_key", "left").join(document_states(t), "document_key", "left")
    rows = own_enrichment(t.nested_articles(runs))
    rows = rows.select("*", F.explode("dates").alias("publication_date"))
    pictures = F.transform(F.array_sort("images"), lambda x: x["image_path"])
    # A run has the tags of its article's part once for each of its outputs.
    tags = F.transform(F.array_sort(F.flatten(F.transform("outputs", lambda o: F.col("tags")))), lambda x: x["tag"])
    body = F.col("output.body_zh")
    return rows.select(
        "article_id", "document_key", F.coalesce("source_name", F.lit("")).alias("source_name"), "publication_date", "title", "body_en", "output.title_zh", "output.summary_zh", F.when(body.isNotNull(), tx.clean_text(body)).alias("body_zh"), F.coalesce(F.array_join(tags, "|"), F.lit("")).alias("tags"),
        F.array_join(pictures, "|").alias("images"), F.get(pictures, F.lit(0)).alias("hero_image"),
        F.coalesce("document_status", F.lit("unknown")).alias("document_status"), F.coalesce("parse_status", F.lit("unknown")).alias("parse_status"), F.coalesce("enrichment_status", F.lit("unavailable")).alias("enrichment_status"))


def document_states(t: Tables) -> DataFrame:
    """(document_key, document_status): its state in the queue of documents."""
    return t.document_queue().select("document_key", F.col("status").alias("document_status"))


def processing_detail(t: Tables) -> DataFrame:
    """Every queued article with its document, error summary and latest enrichment.

    Articles come with what is nested in them, and move as numbers: once each by themselves, by key and by run."""
    rows = own_enrichment(t.nested_queue(documents_of_runs(t))).select("*", F.explode("dates").alias("publication_date"))
    pages = F.array_join(F.transform(F.sort_array("pages"), lambda p: p.cast("string")), "|")
    return rows.select(
        pages.alias("source_pages"), "last_success_input_hash", "last_attempt_started_at", "last_attempt_finished_at", "locked_by", "lock_expires_at", "created_at",
        "article_key", "article_id", "document_key", "source_name", "original_filename", "publication_date", "title", "status", "current_step", "automatic_failure_count", "last_error_message", "updated_at", error_summary().alias("error_summary"),
        F.coalesce("output.content_type", F.lit("article")).alias("content_type"), F.coalesce("output.reason", F.lit("")).alias("reason"), "enrichment_status")


def lookup(rows: DataFrame, **key) -> Row:
    """The row with this key; LookupError if there is none."""
    (column, value), *_ = key.items()
    found = rows.filter(F.col(column) == value).limit(1).collect()
    if not found:
        raise LookupError(f"not found: {column} {value}")
    return found[0]


def optional(rows: DataFrame, order: list[Column], limit: int | None = None, **values) -> DataFrame:
    """Rows under the filters that are not None, in order; ``limit`` is no filter if None."""
    for column, value in values.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


class BadRequest(ValueError):
    """A parameter that is no number, or a negative one."""


def int_parameter(query: dict[str, list[str]], name: str, default: int | None = None) -> int | None:
    """The first value of a parameter as a number; missing or blank: the default.

    Without a default the parameter is optional, and must not be negative."""
    text = (query.get(name) or [""])[0].strip()
    if not text:
        return default
    try:
        n = int(text)
    except ValueError as e:
        raise BadRequest(f"{name} must be an integer") from e
    if default is None and n < 0:
        raise BadRequest(f"{name} must not be negative")
    return n


def unknown_keys(given: dict, allowed: set[str]) -> list[str]:
    """Filter names that nothing knows, in order of name."""
    return sorted(set(given) - allowed)


def where(status: str = "", source: str = "", step: str = "", error: str = "", min_failures: int | None = None) -> dict[str, Column]:
    """Conditions by name; '' is no filter, but a minimum of 0 is one."""
    out = {k: F.col(c) == v for k, c, v in (("status", "status", status), ("source", "source_name", source), ("step", "current_step", step), ("error", "last_error_message", error)) if v}
    if min_failures is not None:
        out["failures"] = F.col("automatic_failure_count") >= min_failures
    return out


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def processing_rows(t: Tables) -> DataFrame:
    return of_runs(t, t.processing_runs())


def documents_of_runs(t: Tables) -> DataFrame:
    return t.parse_runs().select("parse_run_id", "document_key").join(t.documents().select("document_key", "source_name", "original_filename"), "document_key")


def of_runs(t: Tables, queued: DataFrame) -> DataFrame:
    """Queued articles with the document of their run; runs, fewer than articles, are told first."""
    return queued.join(documents_of_runs(t), "parse_run_id")


def error_summary() -> Column:
    message, step = F.col("last_error_message"), F.col("current_step")
    return F.when(message.isNotNull() & (step != ""), F.concat(step, F.lit(": "), message)).when(message.isNotNull(), message).otherwise(F.lit(NO_ERROR))


def processing_cards(t: Tables, page: int = 1, size: int = 50, **filters) -> DataFrame:
    rows = processing_rows(t).filter(both(list(where(**filters).values())))
    return page_of(rows, [F.col("updated_at").desc(), F.col("article_key").desc()], page, size).select("article_key", "article_id", "document_key", "source_name", "status", "current_step", "automatic_failure_count", error_summary().alias("error_summary"), "updated_at")


def self_excluding_facets(t: Tables, **filters) -> DataFrame:
    """Each facet's values under all filters but its own; the scan is shared.

    Every row is told for which facets it counts, then values are made distinct."""
    conditions = where(**filters)
    facets = {"status": "status", "source": "source_name", "step": "current_step", "error": "last_error_message"}
    named = F.array(*[F.when(both([c for k, c in conditions.items() if k != name]), F.struct(F.lit(name).alias("facet"), F.col(column).alias("value"))) for name, column in facets.items()])
    return processing_rows(t).select(F.explode(F.array_compact(named)).alias("x")).select("x.facet", "x.value").filter("value is not null").distinct()
