"""Registered text functions and pipelines over the documents and pages tables.

Plain texts hold no markdown: every fourth line is made a heading, and pages are
the text's halves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text as tx
from ..operators import identity, layout, outline, segment

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def docs(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def markdown_pages(spark, d) -> DataFrame:
    line = F.split(F.coalesce("text", F.lit("")), "\n")
    marked = F.transform(line, lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("# "), x)).otherwise(x))
    half = F.floor(F.size(marked) / 2).cast("int")
    pages = F.array(F.struct(F.lit(1).alias("page_number"), F.slice(marked, 1, F.greatest(half, F.lit(1))).alias("l")), F.struct(F.lit(2).alias("page_number"), F.slice(marked, F.greatest(half, F.lit(1)) + 1, F.size(marked)).alias("l")))
    return docs(spark, d).select(F.col("doc_id").alias("document_key"), F.explode(pages).alias("p")).select("document_key", "p.page_number", F.array_join("p.l", "\n").alias("markdown_text"))


def blocks(spark, d) -> DataFrame:
    """Lines as blocks: ten a page; the first of a page is its headline."""
    lines = docs(spark, d).select(F.col("doc_id").alias("document_key"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block_index", "text"))
    place = F.col("block_index") % 10
    kind = F.when(place == 8, "header").when(place == 9, "page_number").otherwise("text")
    return lines.select("document_key", "block_index", kind.alias("type"), F.when(place == 0, 1).otherwise(0).alias("text_level"), F.floor(F.col("block_index") / 10).cast("int").alias("page_idx"), F.struct(F.lit(0).alias("x0"), (place * 10).cast("int").alias("y0"), F.lit(100).alias("x1"), (place * 10 + 40).cast("int").alias("y1")).alias("bbox"), F.when(place == 8, F.lit("section head")).otherwise(F.col("text")).alias("text"), F.lit("").alias("img_path"))


@query("TA_fragments")
def _(spark, d):
    return segment.fragments(markdown_pages(spark, d)).select("document_key", "page_number", "source_order", "title", F.sha2(F.col("body_text").cast("binary"), 256).alias("body_sha256"))


_LINES = "l as (select doc_id as document_key, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as n, unnest(string_split(coalesce(text, ''), chr(10))) as t from documents)"
#: Pairs of the lines, and their decisions one by one, with the numbers used so far.
_DECIDED = (
    f"with recursive {_LINES}, c as (select document_key, max(n) as top from l group by 1), "
    "p as (select l.document_key, n as front, n + 1 + n % 3 - case when n % 11 = 0 then 1 + n % 3 else 0 end as back, top, n + 1 + n % 3 - case when n % 11 = 0 then 1 + n % 3 else 0 end > top as unknown, n % 11 = 0 as self, n % 5 = 0 or (n + 1 + n % 3) % 7 = 0 as weak from l join c using (document_key)), "
    "d as (select distinct document_key, 0::bigint as front, null::bigint as back, null::varchar as said, []::bigint[] as used from p union all "
    "select p.document_key, p.front, p.back, case when unknown then 'unknown' when self then 'self' when list_contains(used, p.front) or list_contains(used, p.back) then 'used' when weak then 'pair' else 'ok' end, "
    "case when unknown or self or weak or list_contains(used, p.front) or list_contains(used, p.back) then used else list_concat(used, [p.front, p.back]) end from d join p on p.document_key = d.document_key and p.front = d.front + 1), "
    "s as (select document_key, front as seq, front, back, case said when 'ok' then 'accepted' when 'used' then 'ignored' else 'invalid' end as decision_status, "
    f"case said {' '.join(f"when '{k}' then '{v}'" for k, v in segment.REASONS.items())} end as decision_reason from d where front > 0) "
)


def line_fragments(spark, d) -> tuple[DataFrame, DataFrame]:
    """(fragments, raw matches): every line a fragment that says it goes on, but for
    every 5th, and that it began elsewhere, but for every 7th; each is matched with one
    of the next three, every 11th with itself."""
    rows = docs(spark, d).select(F.col("doc_id").alias("document_key"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "title"))
    n = F.col("source_order").cast("long")
    rows = rows.select("document_key", (F.col("pos") + 1).alias("source_order"), "title", F.col("title").alias("body_text"))
    frags = rows.withColumns({"continued_to_page": F.when(n % 5 == 0, "").otherwise("A2"), "continued_from_page": F.when(n % 7 == 0, "").otherwise("A1")})
    pairs = rows.select("document_key", n.alias("seq"), n.alias("front"), F.when(n % 11 == 0, n).otherwise(n + 1 + n % 3).alias("back"))
    return frags, pairs


@query(
    "TC_stitched_articles",
    _DECIDED + "select l.document_key, cast(row_number() over (partition by l.document_key order by l.n) as int) as article_order, cast(l.n as int) as primary_source_order, case when a.back is null then 1 else 2 end as source_fragment_count, l.t as title "
    "from l left join (select * from s where decision_status = 'accepted') a on a.document_key = l.document_key and a.front = l.n where not exists (select 1 from s b where b.decision_status = 'accepted' and b.document_key = l.document_key and b.back = l.n)",
)
def _(spark, d):
    frags, pairs = line_fragments(spark, d)
    done = segment.stitch(frags, segment.decisions(pairs, frags))
    return done.select("document_key", "article_order", "primary_source_order", "source_fragment_count", "title")


@query("J15_pair_decisions", _DECIDED + "select * from s")
def _(spark, d):
    frags, pairs = line_fragments(spark, d)
    return segment.decisions(pairs, frags)


_HEADS = "select document_key, n - 1 as block_index, (n - 1) // 2 as page_idx, length(t) % 60 as height, t as title, (n - 1) % 4 = 3 as byline"


@query(
    "W6_split_headlines",
    f"with recursive {_LINES}, h as ({_HEADS}, n from l), w as (select distinct document_key, 0::bigint as n, null::bigint as block_index, null::bigint as page_idx, null::bigint as height, null::varchar as title, true as parted from h union all "
    "select document_key, m, case when byline or goes_on then block_index else b2 end, case when byline or goes_on then page_idx else p2 end, case when byline or goes_on then height else h2 end, case when byline then title when goes_on then title || ' ' || t2 else t2 end, case when byline then parted or block_index is null or b2 > block_index when goes_on then parted else false end "
    "from (select w.*, h.n as m, h.block_index as b2, h.page_idx as p2, h.height as h2, h.title as t2, h.byline, not h.byline and not parted and w.block_index is not null and h.page_idx - w.page_idx between 0 and 1 and abs(h.height - w.height) < 40 as goes_on from w join h on h.document_key = w.document_key and h.n = w.n + 1)) "
    "select document_key, arg_max(title, n) as title, cast(any_value(page_idx) as int) as page_idx, cast(block_index as int) as block_index from w where block_index is not null group by document_key, block_index",
)
def _(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("document_key"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block_index", "title"))
    return layout.split_headlines(rows.select("document_key", F.floor(F.col("block_index") / 2).cast("int").alias("page_idx"), "block_index", (F.length("title") % 60).alias("height"), "title", (F.col("block_index") % 4 == 3).alias("byline")))


@query(
    "J17_block_owner",
    f"with {_LINES}, h as (select document_key, n, max(case when length(t) % 9 = 0 and n % 2 = 0 then n - 1 end) over (partition by document_key order by n) as owner from l) select document_key, n - 1 as block_index, owner from h where owner is not null",
)
def _(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("document_key"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block_index", "t"))
    heads = rows.filter("length(t) % 9 = 0 and block_index % 2 = 1").select("document_key", "block_index", F.struct("block_index").alias("head"))
    return layout.owners(rows, heads).select("document_key", F.col("block_index").cast("long").alias("block_index"), F.col("owner.block_index").cast("long").alias("owner"))


@query("TD_layout_articles")
def _(spark, d):
    return layout.articles(blocks(spark, d)).select("document_key", "title", "section", "start_page", "end_page")


@query(
    "J18_pull_quotes",
    "with l as (select doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos, unnest(string_split(coalesce(text, ''), chr(10))) as t from documents), "
    "b as (select doc_id as document_key, cast(pos as int) as block_index, pos // 10 as page, pos % 10 as place, t, trim(regexp_replace(lower(t), '[^0-9a-z]+', ' ', 'g')) as k from l), "
    "hay as (select document_key, page, k from b where place between 1 and 7 and length(t) > 120) "
    "select distinct h.document_key, h.block_index from b h join hay on hay.document_key = h.document_key and abs(hay.page - h.page) <= 2 where h.place = 0 and length(h.k) >= 15 and contains(hay.k, h.k)",
)
def _(spark, d):
    return layout.pull_quotes(layout.with_keys(blocks(spark, d)))


_ADS = tx.AD_TOKENS.replace("(?iu)", "(?i)").replace("'", "''")


@query(
    "C11_page_kinds",
    "with l as (select doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos, unnest(string_split(coalesce(text, ''), chr(10))) as t from documents), "
    "m as (select doc_id, pos, case when pos % 10 = 8 then 'section head' else t end as t from l), b as (select doc_id as document_key, pos, cast(pos // 10 as int) as page_idx, pos % 10 as place, t, regexp_replace(t, '^\\s+|\\s+$', '', 'g') as said, trim(regexp_replace(lower(t), '[^0-9a-z]+', ' ', 'g')) as k from m), "
    "s as (select document_key, k from b where place in (8) and said <> '' and k <> '' and k <> 'bloomberg businessweek' group by all having count(distinct page_idx) >= 2), "
    "p as (select document_key, page_idx, bool_or(place = 9) as folio, bool_or(said[1] in ('●', '○') and contains(k[1:6], 'by')) as byline, coalesce(min_by(said, pos) filter (place = 8 and (document_key, k) in (select document_key, k from s)), '') as section, "
    f"bool_or(place = 8 and k = 'advertisement') as advertorial, regexp_matches(string_agg(t, ' ' order by pos), '{_ADS}') as selling from b group by all), "
    "q as (select *, advertorial or (not folio and (selling or (section = '' and not byline))) as ad from p) "
    "select document_key, page_idx, case when ad then 'ad' else 'editorial' end as kind, case when ad then '' else section end as section from q",
)
def _(spark, d):
    keyed = layout.with_keys(blocks(spark, d))
    return layout.page_kinds(keyed, layout.running_sections(keyed))


@query(
    "TE_outline_articles",
    "with l as (select doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i, unnest(string_split(coalesce(text, ''), chr(10))) as t, len(string_split(coalesce(text, ''), chr(10))) as n from documents), "
    "p as (select doc_id, case when i < greatest(n // 2, 1) then 1 else 2 end as page, bool_or(i % 4 = 0 or trim(t) <> '') as there from l group by 1, 2) "
    "select doc_id as document_key, cast(page as int) as article_order, cast(page as int) as start_page, cast(page + 1 as int) as end_page from p where there",
)
def _(spark, d):
    rows = markdown_pages(spark, d).withColumnRenamed("markdown_text", "raw_text")
    entries = rows.select("document_key", F.col("page_number").alias("ordinal"), F.lit("t").alias("title"), F.lit("s").alias("section"), F.col("page_number").alias("start_page"), F.lit(True).alias("is_leaf"))
    total = rows.groupBy("document_key").agg(F.max("page_number").alias("total_pages"))
    return outline.edition_articles(entries, total, rows).select("document_key", "article_order", "start_page", "end_page")


@query(
    "F1_greedy_dedup",
    "with recursive d as (select row_number() over (order by doc_id) as n, doc_id as seq, coalesce(sha256(text), chr(1) || doc_id) as h, concat_ws('|', source, lang, cast(doc_id % 30 as varchar)) as i from documents), "
    "g as (select cast(0 as bigint) as n, cast(null as bigint) as seq, cast(null as bigint) as kept_seq, cast([] as varchar[]) as hs, cast([] as varchar[]) as iss, cast([] as bigint[]) as ks "
    "union all select n, seq, coalesce(found, seq), case when found is null then list_append(hs, h) else hs end, case when found is null then list_append(iss, i) else iss end, case when found is null then list_append(ks, seq) else ks end "
    "from (select d.n, d.seq, d.h, d.i, g.hs, g.iss, g.ks, coalesce(g.ks[nullif(list_position(g.hs, d.h), 0)], g.ks[nullif(list_position(g.iss, d.i), 0)]) as found from g join d on d.n = g.n + 1)) "
    "select seq, kept_seq from g where n > 0",
)
def _(spark, d):
    return identity.greedy_dedup(docs(spark, d).select(F.col("doc_id").alias("seq"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.concat_ws("|", "source", "lang", (F.col("doc_id") % 30).cast("string")).alias("issue_key")))


@query("J14_article_identity")
def _(spark, d):
    """Two runs of every document; the second has lost each title's third letter."""
    runs = F.explode(F.array(F.lit(1), F.lit(2))).alias("run_seq")
    rows = docs(spark, d).select(F.col("source").alias("document_key"), runs, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    title = F.substring("text", 1, 80)
    title = F.when(F.col("run_seq") == 2, F.concat(F.substring(title, 1, 2), F.substring(title, 4, 80))).otherwise(title)
    return identity.article_keys(rows.select("document_key", "run_seq", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("run_seq").cast("string")).alias("article_id"), title.alias("title"), F.col("text").alias("body_text"), F.array((F.col("doc_id") % 50 + 1).cast("int")).alias("pages")))


@query("D4_content_hash", "select doc_id, sha256(text) as content_hash from documents where text is not null")
def _(spark, d):
    return docs(spark, d).filter("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query("D5_input_hash", """select doc_id, sha256('{"article_key": ' || to_json(cast(doc_id as varchar)) || ', "body_text_en": ' || coalesce(to_json(text), 'null') || ', "publication_date": ' || coalesce(to_json(source), 'null') || ', "title_en": ' || coalesce(to_json(lang), 'null') || '}') as input_hash from documents""")
def _(spark, d):
    return docs(spark, d).select("doc_id", tx.input_hash(F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("text")).alias("input_hash"))


@query("C6_line_classes", "select doc_id, pos, case when length(l) - length(replace(l, '.', '')) >= 8 then 'dots' when regexp_matches(l, '^#') then 'heading' else 'other' end as kind from (select doc_id, unnest(range(len(string_split(text, chr(10))))) as pos, trim(unnest(string_split(text, chr(10)))) as l from documents where text is not null)")
def _(spark, d):
    rows = docs(spark, d).filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "l")).withColumn("l", F.trim("l"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.when(tx.leader_dots(F.col("l")), "dots").when(F.col("l").startswith("#"), "heading").otherwise("other").alias("kind"))


@query("C17_excerpt", "select doc_id, substr(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 1, 700) as excerpt from documents where text is not null")
def _(spark, d):
    return docs(spark, d).filter("text is not null").select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


@query("C18_link_id", "select page_id, 'link:body-' || substr(sha256(trim(url)), 1, 24) as link_id from pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", tx.link_id(F.col("url")).alias("link_id"))


@query(
    "C19_filename_from_url",
    "select page_id, case when regexp_matches(n, '(^|/)[^/]+\\.[^./]+$') then n else n || '.pdf' end as filename from (select page_id, coalesce(nullif(url_decode(regexp_extract(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '([^/]*)/*$', 1)), ''), 'download.pdf') as n from pages)",
)
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", tx.filename_from_url(F.col("url")).alias("filename"))


@query("C20_anchors")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.posexplode(tx.anchors("html")).alias("pos", "a")).select("page_id", "pos", "a.href", "a.label")


@query("P7_domain_allowed", "select page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) as host from pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", tx.host(F.col("url")).alias("host"))


@query("D1_filename_date")
def _(spark, d):
    name = F.concat("source", F.lit("-"), F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 500).cast("int")), "yyyy-MM-dd"), F.lit(".pdf"))
    return docs(spark, d).select("doc_id", dates.filename_date(name, F.lit(None).cast("string"), 2026).alias("issue_date"), dates.source_name(name).alias("source_name"))


ORACLE["D1_filename_date"] = "select doc_id, strftime(date '2024-01-01' + cast(doc_id % 500 as int), '%Y-%m-%d') as issue_date, source as source_name from documents"


@query(
    "K10_merged_markdown",
    "with l as (select doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: case when i % 4 = 1 then '# ' || x else x end) as l from documents), "
    "h as (select doc_id, l, greatest(len(l) // 2, 1) as n from l) "
    "select doc_id as document_key, sha256('<!-- PDF_PAGE_NUMBER: 1 -->' || chr(10) || array_to_string(l[1:n], chr(10)) || chr(10) || chr(10) || '<!-- PDF_PAGE_NUMBER: 2 -->' || chr(10) || coalesce(array_to_string(l[n + 1:], chr(10)), '')) as markdown_sha256 from h",
)
def _(spark, d):
    return segment.page_markers(markdown_pages(spark, d)).select("document_key", F.sha2(F.col("markdown_text").cast("binary"), 256).alias("markdown_sha256"))
