"""Registered read views, joins, aggregations, windows and paging, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import control, enrich, ingest, layout, outline
from ..sources import mail, ocr
from ..sources.adapters import Tables, with_tables
from . import views as v

QUERIES, ORACLE = {}, {}
DAY, FOCUS = "1996-03-13", ["size-1", "size-3"]


def query(name: str, sql: str | None = None):
    """Register a function of the tables, and its SQL over the same tables."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_tables(sql)
        return f

    return put


def text(column: str) -> F:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


_ENRICHED = (
    "(select b.article_id, b.status as enrichment_status, o.title_zh, o.summary_zh, o.body_zh, coalesce(o.content_type, 'article') as content_type, coalesce(o.reason, '') as reason, coalesce(g.tags, '') as tags "
    "from (select article_id, enrichment_run_id, status from (select *, row_number() over (partition by article_id order by finished_at desc, seq desc) as rn from enr where status in ('succeeded', 'partial', 'skipped_advertisement')) where rn = 1) b "
    "left join outs o using (enrichment_run_id) left join (select enrichment_run_id, string_agg(tag, '|' order by tag_order) as tags from tags group by 1) g using (enrichment_run_id))"
)


_CARDS = "select article_id, document_key, source_name, strftime(publication_date, '%Y-%m-%d') as publication_date, article_order from visible"
_ORDER = "order by v.publication_date desc, v.article_order, v.article_id"


@query("S1_table_scan", "select document_key, source_name, original_filename from docs")
def _(t):
    return t.documents()


@query("J1_article_document_run", "select a.article_id, d.source_name, r.status from arts a join runs r using (parse_run_id) join docs d using (document_key)")
def _(t):
    return t.articles().join(t.parse_runs(), "parse_run_id").join(t.documents(), "document_key").select("article_id", "source_name", "status")


@query("J2_run_article_document", "select p.article_key, p.status, d.original_filename from proc p join runs r using (parse_run_id) join docs d using (document_key)")
def _(t):
    return v.processing_rows(t).select("article_key", "status", "original_filename")


@query("J3_run_outputs_left", "select e.enrichment_run_id, e.status, coalesce(n, 0) as n_tags from enr e left join (select enrichment_run_id, count(*) as n from tags group by 1) using (enrichment_run_id)")
def _(t):
    n = t.tags().groupBy("enrichment_run_id").agg(F.count("*").alias("n"))
    return t.enrichment_runs().join(n, "enrichment_run_id", "left").select("enrichment_run_id", "status", F.coalesce("n", F.lit(0).cast("long")).alias("n_tags"))


@query("J4_latest_run", "select document_key, parse_run_id from latest_runs")
def _(t):
    return v.latest_runs(t).select("document_key", "parse_run_id")


@query("J5_latest_usable", "select article_id, enrichment_run_id, status from usable")
def _(t):
    return v.usable_enrichments(t).select("article_id", "enrichment_run_id", "status")


@query("J6_not_advertisement", "select article_id from arts where article_id not in (select article_id from ads)")
def _(t):
    return t.articles().select("article_id").join(v.advertisements(t), "article_id", "left_anti")


@query("J7_tag_exists", "select article_id from visible where article_id in (select article_id from tags where tag = 'size-1')")
def _(t):
    return v.article_filters(t, v.visible_articles(t), tag="size-1").select("article_id")


@query("J8_reading_status", "select article_id from visible where article_id not in (select article_id from enr where status in ('succeeded', 'partial', 'skipped_advertisement'))")
def _(t):
    return v.article_filters(t, v.visible_articles(t), reading_status="english_fallback").select("article_id")


@query("J9_pending_articles", "select document_key, count(*) as pending from visible where article_id not in (select article_id from enr where status = 'succeeded') group by 1")
def _(t):
    done = t.enrichment_runs().filter("status = 'succeeded'").select("article_id")
    return v.visible_articles(t).join(done, "article_id", "left_anti").groupBy("document_key").agg(F.count("*").alias("pending"))


@query("J10_tag_chain", "select distinct tag from tags where article_id not in (select article_id from ads)")
def _(t):
    return t.tags().join(v.advertisements(t), "article_id", "left_anti").select("tag").distinct()


@query("J11_reuse_lookup", "select article_key, enrichment_run_id from (select article_key, enrichment_run_id, row_number() over (partition by article_key order by e.finished_at desc, e.seq desc, enrichment_run_id desc) as rn from arts join enr e using (article_id) where e.status = 'succeeded') where rn = 1")
def _(t):
    done = t.enrichment_runs().filter("status = 'succeeded'").join(t.articles().select("article_id", "article_key"), "article_id")
    best = done.groupBy("article_key").agg(F.max(F.struct("finished_at", "seq", "enrichment_run_id")).alias("x"))
    return best.select("article_key", "x.enrichment_run_id")


@query("J12_lineage_orders", "select parse_run_id, string_agg(distinct cast(article_order as varchar), ',' order by cast(article_order as varchar)) as orders from arts group by 1")
def _(t):
    return t.articles().groupBy("parse_run_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("article_order").cast("string"))), ",").alias("orders"))


@query("J12_source_pages", "select article_id, string_agg(page_number, '|' order by page_number) as source_pages from (select distinct article_id, page_number from lineage) group by 1")
def _(t):
    return v.source_pages(t)


@query("J11_reuse_by_input", "with e as (select a.article_key, e.*, l_partkey % 4 as h from arts a join enr e using (article_id) where e.status = 'succeeded'), w as (select distinct article_key, k as h from arts, range(4) r(k)) select w.article_key, w.h as input_hash, b.enrichment_run_id from w left join (select article_key, h, enrichment_run_id from (select *, row_number() over (partition by article_key, h order by finished_at desc, seq desc, enrichment_run_id desc) as rn from e) where rn = 1) b on b.article_key = w.article_key and b.h = w.h")
def _(t):
    wanted = t.articles().select("article_key").distinct().withColumn("input_hashes", F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))
    runs = t.enrichment_runs().filter("status = 'succeeded'").join(t.articles().select("article_id", "article_key"), "article_id").withColumn("input_hash", F.col("l_partkey") % 4)
    return enrich.looked_up(wanted, runs)


_PAGES = "f as (select doc_id as document_key, unnest(range(1, doc_id % 7 + 1)) as n from documents), st as (select document_key, n, case when (document_key + n) % 3 = 0 then 'done' else 'submitted' end as state, 'b' || n // 3 as batch_id from f where (document_key + n) % 4 <> 0)"


def page_states(t):
    """(files, states of those that were sent) of documents with up to six pages."""
    files = ocr.page_files(t.raw("documents").select(F.col("doc_id").alias("document_key"), (F.col("doc_id") % 7).alias("total_pages")))
    at = F.col("document_key") + F.col("page_number")
    return files, files.filter(at % 4 != 0).withColumns({"state": F.when(at % 3 == 0, "done").otherwise("submitted"), "batch_id": F.concat(F.lit("b"), F.floor(F.col("page_number") / 3).cast("string"))})


@query("J19_resume_states", f"with {_PAGES} select f.document_key, string_agg('page-' || lpad(f.n::varchar, 4, '0') || '.pdf', ',' order by f.n) as left_over from f left join st on st.document_key = f.document_key and st.n = f.n where coalesce(st.state, '') <> 'done' group by 1")
def _(t):
    return ocr.unfinished(*page_states(t)).select("document_key", F.array_join("file_names", ",").alias("left_over"))


@query("S8_batch_ids", f"with {_PAGES} select document_key, string_agg(batch_id, ',' order by n) as batches from (select document_key, batch_id, min(n) as n from st group by 1, 2) group by 1")
def _(t):
    return ocr.batch_ids(page_states(t)[1]).select("document_key", F.array_join("batch_ids", ",").alias("batches"))


@query("A5_max_failures", "select coalesce(max(automatic_failure_count), 0) as max_failures from proc")
def _(t):
    return t.processing_runs().agg(F.coalesce(F.max("automatic_failure_count"), F.lit(0).cast("long")).alias("max_failures"))


@query("A7_items_by_status", "select run_id, count(*) filter (status = 'imported') as imported, count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'failed') as failed, case when count(*) filter (status = 'failed') > 0 then 'partial' else 'succeeded' end as run_status from items group by 1")
def _(t):
    counts = ingest.run_counts(t.audit_items(), "run_id", imported=F.count_if(F.col("status") == "imported"))
    return counts.select("run_id", "imported", F.col("skipped_item_count").alias("skipped"), F.col("failed_item_count").alias("failed"), F.col("status").alias("run_status"))


@query("A8_pagination", "select 2 as page, 20 as page_size, count(*) as total, cast(ceil(count(*) / 20.0) as bigint) as total_pages from visible")
def _(t):
    return v.pagination(v.visible_articles(t), 2, 20)


@query("A9_checkpoint_max", "select item_type, cast(max(epoch_us(created_at) // 1000) as bigint) as checkpoint_ms from items group by 1")
def _(t):
    return mail.checkpoint(t.audit_items().select("item_type", F.unix_millis(F.col("created_at").cast("timestamp")).cast("string").alias("internal_date")), "item_type")


@query("A10_largest_image", "select article_id, image_path as hero_image from (select *, row_number() over (partition by article_id order by cast(width as bigint) * height desc, image_order) as rn from imgs) where rn = 1")
def _(t):
    return v.hero_images(t.images())


@query("A11_retry_summary", "select count(*) as matched, count(*) filter (status in ('failed_retryable', 'failed_terminal')) as updated, count(*) - count(*) filter (status in ('failed_retryable', 'failed_terminal')) as skipped from proc where current_step = 'await_summary'")
def _(t):
    return control.retry_summary(t.processing_runs(), F.col("current_step") == "await_summary")


@query(
    "A13_running_headers",
    "with l as (select doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos, unnest(string_split(coalesce(text, ''), chr(10))) as t from documents) "
    "select doc_id as document_key, trim(regexp_replace(lower(t), '[^0-9a-z]+', ' ', 'g')) as key from l where pos % 3 = 0 and regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> '' and trim(regexp_replace(lower(t), '[^0-9a-z]+', ' ', 'g')) not in ('', 'bloomberg businessweek') group by all having count(distinct pos // 3) >= 2",
)
def _(t):
    rows = t.raw("documents").select(F.col("doc_id").alias("document_key"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block_index", "text"))
    rows = rows.select("*", F.when(F.col("block_index") % 3 == 0, "header").otherwise("text").alias("type"), F.floor(F.col("block_index") / 3).cast("int").alias("page_idx"), F.expr("struct(0 as y0, 0 as y1)").alias("bbox"))
    return layout.running_sections(layout.with_keys(rows))


@query("A16_ordered_tags", "select enrichment_run_id, string_agg(tag, '|' order by tag_order) as tags from tags group by 1")
def _(t):
    return v.ordered_tags(t)


@query("A17_failed_not_resolved", "select distinct run_id from items where status = 'failed' and run_id not in (select run_id from items where item_type = 'purchase')")
def _(t):
    items = t.audit_items()
    return items.filter("status = 'failed'").select("run_id").distinct().join(items.filter("item_type = 'purchase'").select("run_id").distinct(), "run_id", "left_anti")


@query("W2_running_order", "select article_id, row_number() over (partition by parse_run_id order by article_order, article_id) as source_order from arts")
def _(t):
    return t.articles().select("article_id", F.row_number().over(Window.partitionBy("parse_run_id").orderBy("article_order", "article_id")).cast("long").alias("source_order"))


@query("W5_topmost_per_run", "select parse_run_id, article_id from (select *, row_number() over (partition by parse_run_id order by article_order, article_id) as rn from arts) where rn = 1")
def _(t):
    return t.articles().groupBy("parse_run_id").agg(F.min_by("article_id", F.struct("article_order", "article_id")).alias("article_id"))


@query("W7_next_boundary", "select article_id, coalesce(lead(publication_date) over (partition by parse_run_id order by publication_date, article_id), date '2100-01-01') as next_date from arts")
def _(t):
    w = Window.partitionBy("parse_run_id").orderBy("publication_date", "article_id")
    return t.articles().select("article_id", F.coalesce(F.lead("publication_date").over(w), F.to_date(F.lit("2100-01-01"))).alias("next_date"))


@query("J16_next_greater", "select a.article_id, coalesce((select min(b.article_order) from arts b where b.parse_run_id = a.parse_run_id and b.article_order > a.article_order), 99) as end_order from arts a")
def _(t):
    entries = t.articles().select(F.col("parse_run_id").alias("document_key"), F.col("article_id").alias("ordinal"), "title", F.lit("").alias("section"), F.col("article_order").alias("start_page"), F.lit(True).alias("is_leaf"))
    pages = t.parse_runs().select(F.col("parse_run_id").alias("document_key"), F.lit(98).alias("total_pages"))
    return outline.ranges(entries, pages).select(F.col("ordinal").alias("article_id"), F.col("end_page").alias("end_order"))


@query("O1_processing_order", "select article_key, row_number() over (order by updated_at desc, article_key desc) as place from proc")
def _(t):
    return v.numbered(t.processing_runs().select("article_key", "updated_at"), [F.desc("updated_at"), F.desc("article_key")], "processing-order").select("article_key", "place")


@query("O2_page_three", "select v.article_id from visible v order by v.publication_date desc, v.article_order, v.article_id limit 20 offset 40")
def _(t):
    return v.page_of(v.visible_articles(t), v.card_order(), 3, 20).select("article_id")


@query("O4_newest_succeeded", "select parse_run_id from runs where status = 'succeeded' order by finished_at desc, seq desc limit 1")
def _(t):
    return t.parse_runs().filter("status = 'succeeded'").orderBy(F.desc("finished_at"), F.desc("seq")).limit(1).select("parse_run_id")


@query("P1_dynamic_filter", "select article_key from proc where status = 'failed_retryable' and automatic_failure_count >= 0")
def _(t):
    return t.processing_runs().filter(v.both(list(v.where(status="failed_retryable", min_failures=0).values()))).select("article_key")


@query("P2_card_filters", "select article_id from visible where source_name = 'BUILDING' and publication_date >= date '1995-01-01' and publication_date <= date '1996-12-31'")
def _(t):
    return v.article_filters(t, v.visible_articles(t), source="BUILDING", date_from="1995-01-01", date_to="1996-12-31", reading_status="no such state").select("article_id")


@query("P9_error_summary", f"select article_key, case when last_error_message is not null then current_step || ': ' || last_error_message else '{v.NO_ERROR}' end as error_summary from proc")
def _(t):
    return t.processing_runs().select("article_key", v.error_summary().alias("error_summary"))


@query("P11_stale_runs", "select article_key from proc where status = 'running' and updated_at <= timestamp '1997-01-01 00:00:00' - interval 3600 second")
def _(t):
    rows = t.processing_runs().withColumn("last_attempt_started_at", F.col("updated_at").cast("timestamp"))
    return rows.filter(control.is_stale("1997-01-01 00:00:00", 3600)).select("article_key")


@query("P14_finished_today", f"select parse_run_id from runs where cast(finished_at as date) = date '{DAY}'")
def _(t):
    return t.parse_runs().filter(F.to_date("finished_at") == F.to_date(F.lit(DAY))).select("parse_run_id")


@query(
    "V1_overview",
    f"select (select count(*) from items where status = 'imported' and cast(created_at as date) = date '{DAY}') as created_documents, "
    f"(select count(*) from arts where parse_run_id in (select parse_run_id from runs where status = 'succeeded' and cast(finished_at as date) = date '{DAY}') and article_id not in (select article_id from ads)) as articles_today, "
    "(select count(*) from visible where article_id not in (select article_id from enr where status = 'succeeded')) as pending_articles, "
    "(select count(*) from proc where status = 'running') as running, (select count(*) from proc where status in ('failed_retryable', 'failed_terminal', 'manual_retry_requested')) as exceptions",
)
def _(t):
    return v.overview(t, DAY)


_BEST = "best as (select article_id, enrichment_run_id, status from (select *, row_number() over (partition by article_id order by finished_at desc, seq desc) as rn from enr where status in ('succeeded', 'partial', 'skipped_advertisement')) where rn = 1), tagged as (select enrichment_run_id, string_agg(tag, '|' order by tag_order) as tags from tags group by 1)"


_HERO = "(select article_id, image_path from (select *, row_number() over (partition by article_id order by cast(width as bigint) * height desc, image_order) as rn from imgs) where rn = 1)"


def _cards_sql(page_sql: str) -> str:
    base = with_tables("select 1 from visible, enr, tags, imgs")
    head = base[: base.rindex(" select 1")]
    return f"{head}, {_BEST}, pg as ({page_sql}) select v.article_id, v.document_key, v.source_name, v.publication_date, v.article_order, v.title, case when b.status is not null then 'ready' else 'english_fallback' end as reading_status, case when b.status = 'partial' then 'partial_enrichment' else '' end as badge, coalesce(t.tags, '') as tags, h.image_path as hero_image from pg v left join best b using (article_id) left join tagged t using (enrichment_run_id) left join {_HERO} h on h.article_id = v.article_id"


@query("V2_article_cards")
def _(t):
    return v.article_cards(t, page=1, size=20)


ORACLE["V2_article_cards"] = _cards_sql(f"select * from visible v {_ORDER} limit 20")


@query("V2_article_cards_filtered")
def _(t):
    return v.article_cards(t, page=2, size=10, source="BUILDING", tag="size-1")


ORACLE["V2_article_cards_filtered"] = _cards_sql(f"select * from visible v where source_name = 'BUILDING' and article_id in (select article_id from tags where tag = 'size-1') {_ORDER} limit 10 offset 10")


@query("V4_filter_options", "select distinct 'source' as facet, source_name as value from docs where document_key in (select document_key from runs where status = 'succeeded') union all select distinct 'tag', tag from tags where article_id not in (select article_id from ads)")
def _(t):
    return v.filter_options(t)


@query(
    "V5_focus_tags",
    "select article_id, tag, tag_rank, pos from (select *, row_number() over (partition by article_id order by tag_rank, pos) as rn from ("
    "select v.article_id, g.tag, case g.tag when 'size-1' then 0 else 1 end as tag_rank, cast(row_number() over (partition by g.tag order by v.publication_date desc, v.article_order, v.article_id) as int) as pos from visible v join (select distinct article_id, tag from tags where tag in ('size-1', 'size-3')) g using (article_id)) where pos <= 20) where rn = 1",
)
def _(t):
    return v.focus_feed(t, FOCUS)


@query("V6_document_processing", "select r.document_key, count(*) as runs, count(*) filter (r.status = 'failed') as failed, max(r.finished_at) as last_finished from runs r group by 1")
def _(t):
    return t.parse_runs().groupBy("document_key").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("finished_at").alias("last_finished"))


@query(
    "V7_document_detail",
    "select d.document_key, d.source_name, d.original_filename, f.sender, f.raw_path, f.import_status, coalesce(q.status, 'unknown') as status, q.current_step, q.automatic_failure_count, q.last_failure_step, q.last_error_message, q.locked_by, q.updated_at, "
    f"case when q.last_error_message is null then '{v.NO_ERROR}' when q.last_failure_step is not null then q.last_failure_step || ': ' || q.last_error_message else q.last_error_message end as error_summary, count(v.article_id) over (partition by d.document_key) as visible_article_count, "
    "v.article_id, strftime(v.publication_date, '%Y-%m-%d') as publication_date, v.title as title_en, e.title_zh, e.summary_zh, case when v.article_id is null then null when e.article_id is null then 'english_fallback' else 'ready' end as reading_status "
    f"from docs d join dfiles f using (document_key) left join dqueue q on q.document_key = d.document_key left join visible v on v.document_key = d.document_key left join {_ENRICHED} e on e.article_id = v.article_id",
)
def _(t):
    return v.document_detail(t).withColumn("publication_date", text("publication_date"))


@query("V8_processing_cards", f"select article_key, article_id, document_key, source_name, p.status, current_step, automatic_failure_count, case when last_error_message is not null then current_step || ': ' || last_error_message else '{v.NO_ERROR}' end as error_summary, updated_at from proc p join runs r using (parse_run_id) join docs d using (document_key) where p.status = 'failed_retryable' order by updated_at desc, article_key desc limit 50")
def _(t):
    return v.processing_cards(t, status="failed_retryable")


_FACET = "select distinct '{0}' as facet, {1} as value from pd where {2} and {1} is not null"


@query("V10_self_excluding_facets")
def _(t):
    return v.self_excluding_facets(t, status="failed_retryable", source="BUILDING")


_head = with_tables("select 1 from proc, runs, docs")
ORACLE["V10_self_excluding_facets"] = _head[: _head.rindex(" select 1")] + ", pd as (select p.*, d.source_name from proc p join runs r using (parse_run_id) join docs d using (document_key)) " + " union all ".join(
    _FACET.format(name, column, cond)
    for name, column, cond in (("status", "status", "source_name = 'BUILDING'"), ("source", "source_name", "status = 'failed_retryable'"), ("step", "current_step", "status = 'failed_retryable' and source_name = 'BUILDING'"), ("error", "last_error_message", "status = 'failed_retryable' and source_name = 'BUILDING'"))
)


@query("V11_import_items", "select id, item_type, status from items where status = 'failed'")
def _(t):
    return t.audit_items().filter("status = 'failed'").select("id", "item_type", "status")


@query("V12_lineage", "select r.parse_run_id, r.status, count(a.article_id) as articles from runs r left join arts a using (parse_run_id) group by 1, 2")
def _(t):
    return t.parse_runs().join(t.articles(), "parse_run_id", "left").groupBy("parse_run_id", "status").agg(F.count("article_id").alias("articles"))


@query("V13_latest_articles", "select r.document_key, a.article_id from arts a join latest_runs r using (parse_run_id)")
def _(t):
    return t.articles().join(v.latest_runs(t), "parse_run_id").select("document_key", "article_id")


@query("V14_latest_enrichment", "select article_id, enrichment_run_id, status from (select *, row_number() over (partition by article_id order by finished_at desc, seq desc) as rn from enr where status in ('succeeded', 'partial', 'skipped_advertisement')) where rn = 1")
def _(t):
    return v.latest_enrichment(t).select("article_id", "enrichment_run_id", "status")


@query("V14_enrichment_with_output", f"select * from {_ENRICHED}")
def _(t):
    from ..functions import text as tx

    return v.enriched(t).withColumn("body_zh", F.when(F.col("body_zh").isNotNull(), tx.clean_text(F.col("body_zh"))))


@query(
    "V3_article_detail",
    "select a.article_id, r.document_key, coalesce(d.source_name, '') as source_name, strftime(a.publication_date, '%Y-%m-%d') as publication_date, a.title, 'Body ' || split_part(a.article_key, ':', 1) as body_en, e.title_zh, e.summary_zh, e.body_zh, coalesce(e.tags, '') as tags, coalesce(i.images, '') as images, i.hero_image, "
    "coalesce(l.status, 'unknown') as document_status, coalesce(r.status, 'unknown') as parse_status, coalesce(e.enrichment_status, 'unavailable') as enrichment_status "
    "from arts a join runs r using (parse_run_id) left join docs d using (document_key) left join dqueue l on l.document_key = r.document_key "
    f"left join {_ENRICHED} e on e.article_id = a.article_id left join (select article_id, string_agg(image_path, '|' order by image_order) as images, min_by(image_path, image_order) as hero_image from imgs group by 1) i on i.article_id = a.article_id",
)
def _(t):
    return v.article_detail(t).withColumn("publication_date", text("publication_date"))


@query(
    "V9_processing_detail",
    f"select coalesce(g.pages, '') as source_pages, x.last_success_input_hash, x.last_attempt_started_at, x.last_attempt_finished_at, x.locked_by, x.lock_expires_at, x.created_at, p.article_key, p.article_id, document_key, d.source_name, d.original_filename, strftime(a.publication_date, '%Y-%m-%d') as publication_date, a.title, p.status, p.current_step, p.automatic_failure_count, p.last_error_message, p.updated_at, "
    f"case when last_error_message is not null then current_step || ': ' || last_error_message else '{v.NO_ERROR}' end as error_summary, coalesce(e.content_type, 'article') as content_type, coalesce(e.reason, '') as reason, e.enrichment_status "
    f"from proc p join runs r using (parse_run_id) join docs d using (document_key) join arts a on a.article_id = p.article_id left join {_ENRICHED} e on e.article_id = p.article_id "
    "join leases x on x.article_key = p.article_key left join (select article_id, string_agg(page_number, '|' order by page_number) as pages from (select distinct article_id, page_number from lineage) group by 1) g on g.article_id = p.article_id",
)
def _(t):
    return v.processing_detail(t).withColumn("publication_date", text("publication_date"))


@query("V6_document_list", "select document_key, source_name, original_filename, status, place from (select d.*, coalesce(l.status, 'unknown') as status, row_number() over (order by l.finished_at desc nulls last, d.document_key desc) as place from docs d left join (select * from (select *, row_number() over (partition by document_key order by finished_at desc, seq desc) as rn from runs) where rn = 1) l using (document_key))")
def _(t):
    latest = t.parse_runs().groupBy("document_key").agg(F.max(F.struct("finished_at", "seq", "status")).alias("x")).select("document_key", F.col("x.status").alias("last"), F.col("x.finished_at").alias("at"))
    rows = t.documents().join(latest, "document_key", "left").withColumn("status", F.coalesce("last", F.lit("unknown")))
    return v.numbered(rows, [F.col("at").desc_nulls_last(), F.desc("document_key")], "document-list").select("document_key", "source_name", "original_filename", "status", "place")


@query("V12_run_articles", "select r.parse_run_id, r.document_key, r.status, a.article_order, a.article_id, a.title from runs r join arts a using (parse_run_id)")
def _(t):
    return t.parse_runs().join(t.articles(), "parse_run_id").select("parse_run_id", "document_key", "status", "article_order", "article_id", "title")


@query("O5_sorted_facets", "select facet, string_agg(value, '|' order by value) as listed from (select distinct 'source' as facet, source_name as value from docs where document_key in (select document_key from runs where status = 'succeeded') union all select distinct 'tag', tag from tags where article_id not in (select article_id from ads)) group by 1")
def _(t):
    return v.listed(v.filter_options(t)).select("facet", F.array_join("values", "|").alias("listed"))


@query("P4_optional_filters", "select parse_run_id, document_key from runs where status = 'failed'")
def _(t):
    return v.optional(t.parse_runs(), [F.desc("finished_at"), F.desc("seq")], status="failed", document_key=None).select("parse_run_id", "document_key")


@query("P8_enrichment_defaults", f"select article_id, content_type, reason from {_ENRICHED}")
def _(t):
    return v.translated(t).select("article_id", "content_type", "reason")


@query("P7_domains", "select url, case when regexp_extract(lower(url), '^[a-z]+://([^/:?#]*)', 1) in ('blog.tionsh.example.net', 'thther.example.org', 'blog.ththan.example.net') then 'allowed' else 'link_domain_not_allowed' end as verdict from (select distinct url from pages)")
def _(t):
    return mail.sorted_links(t.raw("pages").select("url").distinct(), ("Blog.tionsh.example.net", "thther.example.org", "blog.ththan.example.net")).select("url", "verdict")
