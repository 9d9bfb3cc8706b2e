"""Registered functions, sources and table writes over the given tables, with SQL.

Plain texts hold none of the marks that most functions look for, so each query puts them
into the texts' lines by a rule of the line's number, in code and SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text as tx
from ..operators import control, layout, outline, routing
from ..sources import mail, storage
from ..sources.adapters import Tables, with_tables
from .control_queries import NOW, queue

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLE[name] = with_tables(sql)
        return f

    return put


#: Lines of all texts: number n from 1, and t.
_L = "l as (select doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as n, unnest(string_split(coalesce(text, ''), chr(10))) as t from documents)"
_KEY = "trim(regexp_replace(lower(t), '[^0-9a-z]+', ' ', 'g'))"


def lines(t: Tables) -> DataFrame:
    rows = t.raw("documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "t"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("n"), "t")


def said(*cases):
    """The text of a line by the remainder of its number, the last for all others."""
    n = len(cases)
    out = cases[-1]
    for i, c in list(enumerate(cases[:-1]))[::-1]:
        out = F.when(F.col("n") % n == i, c).otherwise(out)
    return out


def num():
    """A line's number as text."""
    return F.col("n").cast("string")


def line():
    return F.col("t")



@query("C3_continued_to", f"with {_L}, b as (select doc_id, n, case n % 4 when 0 then t || chr(10) || 'please  turn to Page a' || n when 1 then t || ' ► ' || n || ' ' when 2 then t || ' ► ' || n || ' more' else t end as t from l) select doc_id, n, coalesce(nullif(upper(regexp_extract(t, '(?i)please\\s*turn\\s*to\\s*page\\s*([A-Z]\\d+)', 1)), ''), regexp_extract(t, '[►▶]\\s*(\\d+)\\s*$', 1)) as page from b")
def _(t):
    body = said(F.concat(line(), F.lit("\nplease  turn to Page a"), num()), F.concat(line(), F.lit(" ► "), num(), F.lit(" ")), F.concat(line(), F.lit(" ► "), num(), F.lit(" more")), line())
    return lines(t).select("doc_id", "n", tx.continued_to_page(body).alias("page"))


@query("C4_continued_from", f"with {_L}, b as (select doc_id, n, case n % 4 when 0 then 'Continued from page B' || n || ' ' || t when 1 then 'continued from Page One ' || t when 2 then '◀ ' || n || t else t end as t from l), m as (select doc_id, n, t, regexp_replace(regexp_extract(t, '(?i)continued\\s*from\\s*(PageOne|page\\s*[A-Z]\\d+)', 1), '\\s+', '', 'g') as s from b) select doc_id, n, case when s = '' then regexp_extract(t, '^\\s*[◄◀]\\s*(\\d+)', 1) when lower(s) = 'pageone' then 'PageOne' else regexp_replace(regexp_replace(s, '^page', ''), '^Page', '') end as page from m")
def _(t):
    body = said(F.concat(F.lit("Continued from page B"), num(), F.lit(" "), line()), F.concat(F.lit("continued from Page One "), line()), F.concat(F.lit("◀ "), num(), line()), line())
    return lines(t).select("doc_id", "n", tx.continued_from_page(body).alias("page"))


@query("C5_merged_bodies", f"with {_L} select doc_id, n, sha256(regexp_replace(t, '\\s+$', '') || chr(10) || regexp_replace(t, '^\\s+', '')) as body_sha256 from l where t <> ''")
def _(t):
    front = said(F.concat(line(), F.lit("\nPlease turn to page A7 ")), F.concat(line(), F.lit(" ► 12 ")), line())
    back = said(F.concat(F.lit("Continued from page A1 "), line()), F.concat(F.lit("◄ 3 "), line()), line())
    return lines(t).filter("t != ''").select("doc_id", "n", F.sha2(tx.merged_body(front, back), 256).alias("body_sha256"))


@query("C7_title_key", f"with {_L} select doc_id, n, {_KEY} as key from l")
def _(t):
    return lines(t).select("doc_id", "n", tx.title_key(line()).alias("key"))


@query("C9_ad_tokens", f"with {_L}, b as (select doc_id, n, case n % 4 when 0 then t || ' Member – NYSE' when 1 then t || ' www.shop.org!' when 2 then t || ' (212) 555' else t end as t from l) select doc_id, n, regexp_matches(t, '{tx.AD_TOKENS.replace('(?iu)', '(?i)')}') as ad from b")
def _(t):
    body = said(F.concat(line(), F.lit(" Member – NYSE")), F.concat(line(), F.lit(" www.shop.org!")), F.concat(line(), F.lit(" (212) 555")), line())
    return lines(t).select("doc_id", "n", body.rlike(tx.AD_TOKENS).alias("ad"))


@query("C10_bylines", f"with {_L}, b as (select doc_id, n, case n % 3 when 0 then '● By ' || t when 1 then '○ ' || t else t end as t from l) select doc_id, n, regexp_replace(t, '^\\s+', '')[1] in ('●', '○') and contains(substr({_KEY}, 1, 6), 'by') as byline from b")
def _(t):
    rows = lines(t).select("doc_id", "n", said(F.concat(F.lit("● By "), line()), F.concat(F.lit("○ "), line()), line()).alias("text"), F.expr("struct(0 as y0, 0 as y1)").alias("bbox"))
    return layout.with_keys(rows).select("doc_id", "n", "byline")


@query("C12_repairs", f"with {_L} select doc_id, n, case when regexp_matches(t, '^[a-z]') then 'T' || t else 'T ' || t end as dropcap, regexp_replace(t, '\\s+$', '') as ended, case when t = '' then '' else 'Go ' || t end as mirrored from l")
def _(t):
    twice = F.when(line() == "", "").otherwise(F.concat(F.lit("Go Go "), F.regexp_replace(line(), r"\s+", "_")))
    once = F.regexp_replace(tx.demirror(twice), "^Go .*$", "Go ")
    return lines(t).select("doc_id", "n", tx.repair_dropcap(F.concat(F.lit("T  "), line())).alias("dropcap"), tx.trim_end_marker(F.concat(line(), F.lit(" <BW> —With x"))).alias("ended"), F.when(line() == "", once).otherwise(F.concat(once, line())).alias("mirrored")).withColumn("dropcap", F.regexp_replace("dropcap", "^T  ", "T "))


@query("C1_images", f"with {_L} select doc_id, n, case n % 3 when 0 then 'images/' || n || '.png' when 1 then 'a.jpg|images/' || n || '.png' else '' end as paths, sha256(regexp_replace(replace(t, chr(9), ' '), '^\\s+|\\s+$', '', 'g')) as text_sha256 from l where not contains(t, '![') and not regexp_matches(lower(t), '(png|jpe?g|webp)')")
def _(t):
    image = F.concat(F.lit("![x](images/"), num(), F.lit(".png)"))
    body = said(F.concat(image, F.lit("\n"), line()), F.concat(F.lit("a.jpg\n\n"), image, F.lit("\n "), line(), F.lit(" \n"), image), F.concat(line(), F.lit("\n![y](https://e.x/i.gif)")))
    rows = lines(t).filter("not contains(t, '![') and not lower(t) rlike '(png|jpe?g|webp)'").withColumn("body", body)
    clean = F.regexp_replace(tx.clean_text(F.col("body")), r"\n?!\[y\]\(https://e.x/i.gif\)$", "")
    return rows.select("doc_id", "n", F.array_join(tx.image_paths(F.col("body")), "|").alias("paths"), F.sha2(F.replace(clean, F.lit("\t"), F.lit(" ")), 256).alias("text_sha256"))


@query("C8_contents", f"with {_L}, b as (select doc_id, n, trim(t) as t, n % 150 as folio from l where n <= 120 and trim(t) <> ''), k as (select *, {_KEY} as key from b) select doc_id as document_key, arg_min(t, n) as title, cast(arg_min(folio, n) as int) as folio from k where key <> '' and key not in ({', '.join(repr(w) for w in layout.SECTION_WORDS)}) group by doc_id, key")
def _(t):
    rows = lines(t).filter("trim(t) != ''").select(F.col("doc_id").alias("document_key"), (F.col("n") - 1).cast("int").alias("block_index"), F.floor((F.col("n") - 1) / 10).cast("int").alias("page_idx"), F.lit("text").alias("type"), F.concat(line(), F.lit("  "), (F.col("n") % 150).cast("string")).alias("text"))
    return layout.contents(rows)


@query("C13_edition_text", f"with {_L} select doc_id, n, regexp_replace(t, '^\\s+|\\s+$', '', 'g') as body, 'https://e.x/' || doc_id || '-' || n as url from l where n <= 3")
def _(t):
    raw = F.concat(line(), F.lit("\n■\n| 下一项 | 章节菜单 |\n\nThis article was downloaded by calibre from\n\nhttps://e.x/"), F.col("doc_id").cast("string"), F.lit("\n-"), num(), F.lit("\n\nrest"))
    rows = lines(t).filter("n <= 3").withColumn("raw", raw)
    return rows.select("doc_id", "n", outline.cleaned(F.col("raw"), tx.folded(F.col("raw"))).alias("body"), outline.source_url("raw").alias("url"))


@query("C15_identity_text", f"with {_L} select doc_id, n, replace(regexp_replace(lower(t), '\\s+', '', 'g'), 'ß', 'ss') as identity from l")
def _(t):
    return lines(t).select("doc_id", "n", tx.identity_text("t").alias("identity"))


@query("C21_senders", "select doc_id, case doc_id % 3 when 0 then 'A.' || doc_id || '@Ex.com' when 1 then 'b@ex.com' else 'nobody' end as sender from documents")
def _(t):
    key = F.col("doc_id").cast("string")
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("News Inc <A."), key, F.lit("@Ex.com>"))).when(F.col("doc_id") % 3 == 1, "b@ex.com").otherwise("nobody")
    return t.raw("documents").withColumn("head", head).select("doc_id", tx.sender_address("head").alias("sender"))


@query("D2_publication_dates", "select doc_id, case doc_id % 5 when 0 then '2020-01-02' when 1 then '2024-03-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') when 3 then '2021-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') else '' end as date, case doc_id % 5 when 2 then 'invalid date' when 4 then 'no publication date' else '' end as error from documents")
def _(t):
    k, day = F.col("doc_id") % 5, (F.col("doc_id") % 28 + 1).cast("string")
    name = F.when(k == 1, F.concat(F.lit("x-2024-3-"), day, F.lit(".pdf"))).when(k == 2, "x-2024-13-01.pdf").otherwise("x.pdf")
    body = F.when(k == 3, F.concat(F.lit("on January "), day, F.lit(", 2021 it"))).otherwise("no date")
    found = dates.publication_date(F.when(k == 0, "2020-01-02"), name, F.lit(None).cast("string"), 2026, body)
    return t.raw("documents").select("doc_id", found.alias("d")).select("doc_id", "d.date", "d.error")


@query("D6_tags", f"with {_L}, g as (select doc_id, n, list_filter(list_transform(string_split(t, ' ')[1:9], lambda x: trim(x)), lambda x: x <> '') as g from l), u as (select doc_id, n, list_filter(g, lambda x, i: list_position(g, x) = i) as u from g) select doc_id, n, case when len(u) between 3 and 8 then array_to_string(u, '|') end as tags from u")
def _(t):
    return lines(t).select("doc_id", "n", F.array_join(tx.normalized_tags(F.slice(F.split("t", " "), 1, 9)), "|").alias("tags"))


@query("D8_timestamps", "select event_id, case when event_id % 3 = 2 then null else date_trunc('second', ts) end as at from events")
def _(t):
    said = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", "dd/MM/yyyy"))
    return t.raw("events").select("event_id", dates.stored_timestamp(said).cast("timestamp_ntz").alias("at"))


def _settled(t: Tables, outcome: str) -> DataFrame:
    q = queue(t)
    told = q.filter("status = 'running'").select("key", F.lit(outcome).alias("outcome"), F.lit("said").alias("message"), F.lit("h").alias("input_hash"))
    rows = control.settle(q, told, NOW)
    return rows.select("key", "status", "current_step", F.col("automatic_failure_count").cast("long").alias("failures"), F.coalesce("last_error_message", F.lit("")).alias("message"), F.coalesce("last_success_input_hash", F.lit("")).alias("input_hash"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query("F6_rate_limited", f"select article_key as key, case when status = 'running' then 'failed_retryable' else status end as status, current_step, automatic_failure_count as failures, case when status = 'running' then 'said' else coalesce(last_error_message, '') end as message, case when status = 'succeeded' then article_id else '' end as input_hash, case when status = 'running' then '{NOW}' else strftime(updated_at, '%Y-%m-%d %H:%M:%S') end as updated from proc")
def _(t):
    return _settled(t, "rate_limited")


@query("F7_success", f"select article_key as key, case when status = 'running' then 'succeeded' else status end as status, case when status = 'running' then 'completed' else current_step end as current_step, automatic_failure_count as failures, case when status = 'running' then '' else coalesce(last_error_message, '') end as message, case when status = 'running' then 'h' when status = 'succeeded' then article_id else '' end as input_hash, case when status = 'running' then '{NOW}' else strftime(updated_at, '%Y-%m-%d %H:%M:%S') end as updated from proc")
def _(t):
    return _settled(t, "succeeded")


@query("K4_validated", "select doc_id, case when doc_id % 5 = 0 then 'content type' when doc_id % 5 = 1 then 'empty translation' when doc_id % 5 = 2 then 'empty summary' when doc_id % 5 = 3 and n not between 3 and 8 then 'tag count' else '' end as fault from (select doc_id, len(string_split(coalesce(text, ''), chr(10))) as n from documents)")
def _(t):
    k = F.col("doc_id") % 5
    tags = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = t.raw("documents").select("doc_id", F.when(k == 0, "news").otherwise("article").alias("content_type"), F.lit("succeeded").alias("translation_status"), F.when(k == 1, " ").otherwise("b").alias("translated_body"), F.lit("succeeded").alias("summary_status"), F.when(k == 2, "").otherwise("s").alias("summary"), F.when(k == 3, "succeeded").otherwise("failed").alias("tagging_status"), tags.alias("tags"))
    good, bad = storage.validated(rows)
    return good.select("doc_id", F.lit("").alias("fault")).unionByName(bad.select("doc_id", "fault"))


@query("K5_insert_new", "select document_key, source_name from docs where document_key % 3 <> 0")
def _(t):
    rows = t.documents().select("document_key", "source_name")
    return storage.insert_new(rows.union(rows), rows.filter("document_key % 3 = 0"), ["document_key"])


@query("K6_upsert", "select document_key, case when document_key % 3 = 0 then 'new' else source_name end as source_name, case when document_key % 3 = 0 then 1 else document_key % 2 end as seq from docs union all select -document_key, 'new', 1 from docs where document_key % 3 = 0 and document_key <> 0")
def _(t):
    target = t.documents().select("document_key", "source_name", (F.col("document_key") % 2).alias("seq"))
    new = target.filter("document_key % 3 = 0").select("document_key", F.lit("new").alias("source_name"), F.lit(1).cast("long").alias("seq"))
    return storage.upsert(target, new.unionByName(new.filter("document_key != 0").withColumn("document_key", -F.col("document_key"))), ["document_key"])


@query("K12_json_rows", "select '{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\"}' as json from documents")
def _(t):
    return storage.as_json(t.raw("documents").select("doc_id", "source"))


_MAIL = "m as (select doc_id::varchar as message_id, source, doc_id, case doc_id % 4 when 0 then 'a.pdf' when 1 then 'A.PDF' when 2 then '【译】a.pdf' else 'a.txt' end as filename, case when doc_id % 8 = 3 then 'application/pdf' else 'text/plain' end as mime, 1700000000000 + doc_id * 700 as ms, sha256(coalesce(text, '')) as h from documents)"


def mails(t: Tables) -> DataFrame:
    """A message a document, its text an attachment; names and types by the id."""
    k = F.col("doc_id")
    name = F.when(k % 4 == 0, "a.pdf").when(k % 4 == 1, "A.PDF").when(k % 4 == 2, "【译】a.pdf").otherwise("a.txt")
    data = F.regexp_replace(F.translate(F.regexp_replace(F.base64(F.coalesce("text", F.lit("")).cast("binary")), r"\s", ""), "+/", "-_"), "=+$", "")
    part = F.struct(name.alias("filename"), F.when(k % 8 == 3, "application/pdf").otherwise("text/plain").alias("mimeType"), F.struct(data.alias("data")).alias("body"), F.lit("7").alias("partId"))
    href = F.concat(F.lit('<a href="https://e.x/'), k.cast("string"), F.lit('">x</a><a href="mailto:y">y</a>'))
    html = F.struct(F.lit(None).cast("string").alias("filename"), F.lit("text/html").alias("mimeType"), F.struct(F.regexp_replace(F.base64(href.cast("binary")), r"\s|=", "").alias("data")).alias("body"), F.lit(None).cast("string").alias("partId"))
    payload = F.to_json(F.struct(F.array(F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(part, html).alias("parts"))).alias("parts")))
    return t.raw("documents").select(k.cast("string").alias("message_id"), F.col("source").alias("sender"), (F.lit(1700000000000) + k * 700).cast("string").alias("internal_date"), payload.alias("payload"))


@query("S4_attachments", f"with {_MAIL} select message_id, filename, '7' as attachment_id, h as content_sha256 from m where mime = 'application/pdf' or lower(filename) like '%.pdf'")
def _(t):
    return mail.attachments(mails(t)).select("message_id", "filename", "attachment_id", F.sha2("content", 256).alias("content_sha256"))


@query("P5_selected_messages", f"with {_MAIL} select message_id from m where source in ('src1', 'src2', 'src3', 'src4') and (mime = 'application/pdf' or lower(filename) like '%.pdf') and filename not like '【译】%'")
def _(t):
    rows = mails(t)
    return mail.selected(rows, mail.attachments(rows), ("src1", "src2", "src3", "src4")).select("message_id")


@query("S3_after_checkpoint", f"with {_MAIL} select message_id from m where ms >= 1700000350000 // 1000 * 1000")
def _(t):
    return mail.since(mails(t), 1700000350400).select("message_id")


@query("S5_candidate_links", f"with {_MAIL} select message_id, 'https://e.x/' || message_id as url, 'link:body-' || substr(sha256('https://e.x/' || message_id), 1, 24) as link_id, 'allowed' as verdict from m")
def _(t):
    return mail.sorted_links(mail.candidate_links(mail.bodies(mails(t))), ()).select("message_id", "url", "link_id", "verdict")


@query("S6_resolved_links", "select page_id, case page_id % 5 when 0 then 'https://e.x/' || page_id || '.PDF?x=1' when 1 then 'https://land.x/f' when 2 then 'https://e.x/' || page_id when 3 then 'https://e.x/in.pdf' else null end as target from pages")
def _(t):
    k, key = F.col("page_id") % 5, F.col("page_id").cast("string")
    url = F.concat(F.lit("https://e.x/"), key, F.when(k == 0, ".PDF?x=1").otherwise(""))
    html = F.when(k == 3, "<a href='https://e.x/other'>x</a><a href='https://e.x/in.pdf'>y</a>").otherwise("<p>none</p>")
    rows = t.raw("pages").select("page_id", k.alias("k"), url.alias("url"), html.alias("html"))
    return rows.select("page_id", mail.resolve(F.col("url"), F.when(F.col("k") == 1, "https://land.x/f").otherwise(""), F.when(F.col("k") == 2, "%PDF").otherwise(""), F.col("html")).alias("target"))


@query("S12_routes", "select doc_id, case when doc_id % 3 = 0 and doc_id % 4 >= 1 then 'outline' when doc_id % 3 = 1 and doc_id % 2 = 0 then 'layout' else 'markdown' end as route from documents")
def _(t):
    k = F.col("doc_id")
    files = t.raw("documents").select("doc_id", F.when(k % 3 == 0, "calibre 7").otherwise("x").alias("producer"), F.when(k % 3 == 0, "The Economist").otherwise("t").alias("title"), (k % 4 + 2).cast("int").alias("leaves"), F.lit("").alias("outline_sample"), F.when(k % 3 == 1, F.concat(F.lit("BLOOMBERG Businessweek "), F.when(k % 2 == 0, "Contents").otherwise("contents"))).otherwise("").alias("layout_sample"))
    return routing.routed(files).select("doc_id", "route")


@query("S13_image_sizes", "select doc_id, case when doc_id % 4 = 3 then null else n_chars % 5000 + 1 end as width, case when doc_id % 4 = 3 then null else doc_id % 900 + 1 end as height from documents")
def _(t):
    hexed = lambda c: F.lpad(F.hex(c), 8, "0")
    w, h = F.col("n_chars") % 5000 + 1, F.col("doc_id") % 900 + 1
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed(w), hexed(h), F.lit("0806")))
    rows = t.raw("documents").select("doc_id", F.when(F.col("doc_id") % 4 == 3, F.lit(b"GIF89a")).otherwise(png).alias("content"))
    return rows.select("doc_id", tx.image_size("content").alias("s")).select("doc_id", "s.width", "s.height")
