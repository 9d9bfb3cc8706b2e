"""Registered control-plane steps over the adapted queue, with SQL where it has one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import control, enrich, ingest, queue_log
from ..sources.adapters import Tables, with_tables

QUERIES, ORACLE = {}, {}
NOW = "1998-01-01 00:00:00"


def queue(t: Tables) -> DataFrame:
    p = t.processing_runs()
    return p.select(F.col("article_key").alias("key"), "status", "current_step", F.col("automatic_failure_count").cast("int").alias("automatic_failure_count"), "last_error_message", F.when(F.col("status") == "succeeded", F.col("article_id")).alias("last_success_input_hash"), F.col("updated_at").cast("timestamp").alias("last_attempt_started_at"), F.lit(None).cast("string").alias("locked_by"), F.lit(None).cast("timestamp").alias("lock_expires_at"), F.col("updated_at").cast("timestamp").alias("updated_at"), F.lit(0).cast("long").alias("seq"))


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = with_tables(sql)
        return f

    return put


@query("W10_queue_rank", "select article_key as key, row_number() over (order by case status when 'manual_retry_requested' then 0 when 'pending' then 1 else 2 end, updated_at, article_key) as place from proc where status in ('pending', 'failed_retryable', 'manual_retry_requested')")
def _(t):
    from .views import numbered

    return numbered(control.eligible(queue(t), NOW), control.queue_order(), "queue-rank").select("key", "place")


def leased(t: Tables) -> DataFrame:
    """The queue with its articles, and leases on every row whose count is odd."""
    odd = F.col("automatic_failure_count") % 2 == 1
    q = queue(t).join(t.processing_runs().select(F.col("article_key").alias("key"), "article_id"), "key")
    return q.withColumns({"locked_by": F.when(odd, "w0"), "lock_expires_at": F.when(odd, F.to_timestamp(F.lit("1999-01-01 00:00:00")))})


def told(rows: DataFrame) -> DataFrame:
    """All columns, times as text and nulls as ''."""
    time = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c)
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("key", "article_id", "status", "current_step", F.col("automatic_failure_count").cast("long").alias("failures"), none("last_error_message"), time("last_attempt_started_at"), none("locked_by"), time("lock_expires_at"), time("updated_at"))


_Q = "select article_key as key, article_id, status, current_step, automatic_failure_count as failures, coalesce(last_error_message, '') as last_error_message, strftime(updated_at, '%Y-%m-%d %H:%M:%S') as moment, case when automatic_failure_count % 2 = 1 then 'w0' else '' end as locked_by, case when automatic_failure_count % 2 = 1 then '1999-01-01 00:00:00' else '' end as lock_expires_at, hash_same from (select *, substr(article_id, 1, 1) < '8' as hash_same from proc)"


@query(
    "F3_enqueue",
    f"with q as ({_Q}), k as (select *, case when status = 'manual_retry_requested' then 'asked' when status = 'succeeded' and hash_same then 'done' else 'restart' end as what from q) "
    "select key, article_id || '+' as article_id, case what when 'asked' then status when 'done' then 'succeeded' else 'pending' end as status, case what when 'restart' then 'await_ad_judgment' else current_step end as current_step, case what when 'restart' then 0 else failures end as failures, "
    "case what when 'restart' then '' else last_error_message end as last_error_message, case what when 'restart' then '' else moment end as last_attempt_started_at, case what when 'asked' then locked_by else '' end as locked_by, case what when 'asked' then lock_expires_at else '' end as lock_expires_at, '1998-01-01 00:00:00' as updated_at from k",
)
def _(t):
    same = F.substring("article_id", 1, 1) < "8"
    arrivals = t.processing_runs().select(F.col("article_key").alias("key"), F.concat("article_id", F.lit("+")).alias("article_id"), F.when(same, F.col("article_id")).otherwise("changed").alias("input_hash"))
    return told(control.enqueue(leased(t), arrivals, NOW))


@query("F4_claim", "select article_key as key, case when place <= 25 and status = 'manual_retry_requested' then 'running_manual_retry' when place <= 25 then 'running' else status end as status, coalesce(case when place <= 25 then 'worker-1' end, '') as locked_by from (select p.*, case when status in ('pending', 'failed_retryable', 'manual_retry_requested') then row_number() over (partition by status in ('pending', 'failed_retryable', 'manual_retry_requested') order by case status when 'manual_retry_requested' then 0 when 'pending' then 1 else 2 end, updated_at, article_key) else 999999999 end as place from proc p)")
def _(t):
    return control.claim(queue(t), "worker-1", NOW, 600, 25).select("key", "status", F.coalesce("locked_by", F.lit("")).alias("locked_by"))


@query("F5_settle_failures", "select article_key as key, case when status = 'running' and automatic_failure_count + 1 >= 2 then 'failed_terminal' when status = 'running' then 'failed_retryable' else status end as status, automatic_failure_count + case when status = 'running' then 1 else 0 end as failures from proc")
def _(t):
    q = queue(t)
    lost = q.filter("status = 'running'").select("key", F.lit("failed").alias("outcome"), F.lit("boom").alias("message"), F.lit(None).cast("string").alias("input_hash"))
    return control.settle(q, lost, NOW).select("key", "status", F.col("automatic_failure_count").cast("long").alias("failures"))


@query("F8_recover_stale", "select article_key as key, case when status = 'running' and updated_at <= timestamp '1998-01-01 00:00:00' - interval 3600 second then case when automatic_failure_count + 1 >= 2 then 'failed_terminal' else 'failed_retryable' end else status end as status from proc")
def _(t):
    return control.recover_stale(queue(t), NOW, 3600).select("key", "status")


@query(
    "F9_batch_retry",
    f"with q as ({_Q}), k as (select *, status in ('failed_retryable', 'failed_terminal') and current_step = 'await_summary' as mine from q) "
    "select key, article_id, case when mine then 'manual_retry_requested' else status end as status, current_step, failures, last_error_message, moment as last_attempt_started_at, case when mine then '' else locked_by end as locked_by, case when mine then '' else lock_expires_at end as lock_expires_at, case when mine then '1998-01-01 00:00:00' else moment end as updated_at from k",
)
def _(t):
    return told(control.request_retry(leased(t), NOW, condition=F.col("current_step") == "await_summary"))


@query("F9_one_retry", f"with q as ({_Q}) select key, article_id, case when key like '1:%' then 'manual_retry_requested' else status end as status, case when key like '1:%' then '' else locked_by end as locked_by from q")
def _(t):
    keys = [r["key"] for r in leased(t).filter("key like '1:%'").select("key").collect()]  # the few that a person picked
    return told(control.request_retry(leased(t), NOW, keys=keys)).select("key", "article_id", "status", "locked_by")


@query("F2_enqueue_once", "select document_key as key, case when document_key % 2 = 0 then 'running' else 'pending' end as status, case when document_key % 2 = 0 then 'enrich' else 'parse_persist' end as current_step from docs")
def _(t):
    docs = t.documents().select(F.col("document_key").alias("key"))
    known = docs.filter("key % 2 = 0").select("key", F.lit("running").alias("status"), F.lit("enrich").alias("current_step"), F.lit(1).alias("automatic_failure_count"), control.at(NOW).alias("updated_at"), F.lit(0).cast("long").alias("seq"))
    return control.enqueue_once(known, docs.union(docs), NOW).select("key", "status", "current_step")


@query("P12_is_due", "select article_key as key, updated_at <= timestamp '1998-01-01 00:00:00' - interval 7200 second as due from proc")
def _(t):
    return t.processing_runs().select(F.col("article_key").alias("key"), control.is_due(F.col("updated_at").cast("timestamp"), NOW, 7200).alias("due"))


@query("F14_retry_once", "select run_id as message_id, cast(1 as int) as retry_attempt_count, case when run_id % 3 = 0 then 'resolved' else 'failed_final' end as retry_state from (select distinct run_id from items where status = 'failed') where run_id % 2 = 0")
def _(t):
    failed = t.audit_items().filter("status = 'failed'").select(F.col("run_id").alias("message_id")).distinct()
    pending = failed.withColumn("retry_attempt_count", (F.col("message_id") % 2).cast("int"))
    return control.retry_messages(pending, failed.select("message_id", (F.col("message_id") % 3 == 0).alias("ok")))


_IMPORT = (
    "with m as (select doc_id, source in ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src10', 'src11', 'src12', 'src13', 'src14') as allowed, doc_id % 17 = 0 as lost, sha256(coalesce(text, '')) as h from documents), "
    "d as (select *, row_number() over (partition by h order by doc_id) = 1 as made, min(doc_id) over (partition by h) as first from m where allowed and not lost), "
    "i as (select 'message:' || doc_id as item_key, 'message' as item_type, case when allowed then 'succeeded' else 'skipped' end as status, case when allowed then 'message_selected' else 'sender_not_allowed' end as detail_code, null as same_as, doc_id from m "
    "union all select 'message:' || doc_id || ':attachment:a', 'attachment', 'skipped', 'sender_not_allowed', null, doc_id from m where not allowed and not lost "
    "union all select 'message:' || doc_id || ':attachment:a', 'attachment', case when made then 'succeeded' else 'skipped' end, case when made then 'document_created' else 'duplicate_document' end, first, doc_id from d "
    "union all select 'message:' || doc_id || ':body_link:https://e.x/' || doc_id, 'body_link', 'failed', 'link_fetch_failed', null, doc_id from m where lost) "
)


def imported(t: Tables) -> DataFrame:
    """Audit rows of an import: a message a document, its text as a PDF's bytes; every
    17th has a link that could not be fetched instead."""
    docs = t.raw("documents")
    name = F.col("doc_id").cast("string")
    messages = docs.select(name.alias("message_id"), F.col("source").alias("sender"), F.lit("1000").alias("internal_date"), F.col("doc_id").alias("seq"))
    lost = F.col("doc_id") % 17 == 0
    files = docs.filter(~lost).select(name.alias("message_id"), F.lit(0).alias("pos"), F.lit("a").alias("attachment_id"), F.concat(F.lit("doc-"), name, F.lit(".pdf")).alias("filename"), F.lit("application/pdf").alias("mime_type"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.lit(None).cast("string").alias("link_url"))
    links = docs.filter(lost).select(name.alias("message_id"), F.concat(F.lit("https://e.x/"), name).alias("link_url"), F.lit("link_fetch_failed").alias("verdict"), F.lit("404").alias("error"))
    senders = tuple(f"src{i}" for i in range(15) if i not in (7, 8, 9))
    rows = ingest.imported(messages, files, senders, 1998)
    return ingest.audit_items(messages, files, senders, rows).unionByName(ingest.link_items(links, messages))


@query("TH_import_audit", _IMPORT + "select item_key, item_type, status, detail_code from i")
def _(t):
    return imported(t).select("item_key", "item_type", "status", "detail_code")


@query("K9_run_result", _IMPORT + "select case when count(*) filter (status = 'failed') > 0 then 'partial' else 'succeeded' end as status, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'skipped') as skipped, count(*) filter (detail_code in ('document_created', 'duplicate_document')) as imported, count(*) filter (detail_code = 'document_created') as created from i")
def _(t):
    done = ingest.run_result("run", imported(t))
    return done.select("status", F.col("failed_item_count").alias("failed"), F.col("skipped_item_count").alias("skipped"), F.col("imported_attachment_count").alias("imported"), F.col("created_document_count").alias("created"))


@query("F14_pending_after_import", _IMPORT + "select doc_id::varchar as message_id, case when bool_or(status = 'failed') then 'pending' else 'resolved' end as state from i group by 1")
def _(t):
    return control.failed_messages(imported(t))


_KINDS = ("enqueued", "claimed", "failed", "succeeded", "retry_requested", "rate_limited", "claimed")


def queue_events(t: Tables) -> DataFrame:
    """Events of the queue: a key a user, in the order of event ids; every 5th was
    written by one who had seen (id % 4) events, the others don't say."""
    e = t.raw("events")
    kind = F.coalesce(*[F.when(F.col("event_id") % 7 == i, k) for i, k in enumerate(_KINDS)])
    seen = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 4)
    return e.select(F.col("user_id").cast("string").alias("key"), seen.alias("expected"), kind.alias("event"), F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("writer"), F.col("ts").cast("timestamp").alias("at"), F.lit(600).cast("long").alias("lease_seconds"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"), (F.col("event_id") % 2).cast("string").alias("input_hash"), F.lit(None).cast("string").alias("article_id"), F.lit(None).cast("string").alias("step"), F.col("event_id").alias("commit"))


#: The fold as a recursive query, a step an event of each key.
_FOLD = f"""with recursive e as (
  select user_id::varchar as key, row_number() over (partition by user_id order by event_id) as n, case when event_id % 5 = 0 then event_id % 4 end as expected, ({list(_KINDS)})[event_id % 7 + 1] as event,
    'w' || event_id % 3 as writer, ts as moment, 'm' || event_id as said, (event_id % 2)::varchar as input from events
), s as (
  select distinct key, 0::bigint as n, 0::bigint as version, null::varchar as status, null::varchar as step, null::bigint as failures, null::varchar as message, null::varchar as hash, null::timestamp as tried, null::varchar as locked_by, null::timestamp as until, null::timestamp as updated from e
  union all
  select key, n, version + taken::int,
    case when restart then 'pending' when done or good then 'succeeded' when claimed and status = 'manual_retry_requested' then 'running_manual_retry' when claimed then 'running' when asked then 'manual_retry_requested' when limited or (lost and failures + 1 < 2) then 'failed_retryable' when lost then 'failed_terminal' else status end,
    case when restart then 'await_ad_judgment' when good then 'completed' else step end,
    case when restart then 0 when lost then failures + 1 else failures end,
    case when restart or good then null when lost or limited then said else message end,
    case when good then input else hash end,
    case when restart then null when claimed then moment else tried end,
    case when restart or done or good or lost or limited or asked then null when claimed then writer else locked_by end,
    case when restart or done or good or lost or limited or asked then null when claimed then moment + interval 600 second else until end,
    case when taken then moment else updated end
  from (
    select *, taken and event = 'claimed' as claimed, taken and event = 'succeeded' as good, taken and event = 'failed' as lost, taken and event = 'rate_limited' as limited, taken and event = 'retry_requested' as asked,
      taken and event = 'enqueued' and status is not null and status <> 'manual_retry_requested' and coalesce(hash = input, false) as done,
      taken and event = 'enqueued' and (status is null or (status <> 'manual_retry_requested' and not coalesce(hash = input, false))) as restart
    from (
      select s.* exclude (n), e.* exclude (key), (expected is null or expected = version) and case
        when event = 'claimed' then coalesce(status in ('pending', 'failed_retryable', 'manual_retry_requested') and (locked_by is null or until <= moment), false) when event = 'enqueued' then true else status is not null end as taken
      from s join e on s.key = e.key and e.n = s.n + 1
    )
  )
)
"""


@query("F4_event_fold", _FOLD + "select key, version, status, step as current_step, failures, coalesce(message, '') as last_error_message, coalesce(hash, '') as input_hash, tried as attempt, coalesce(locked_by, '') as locked_by, until as lock_expires_at, updated as updated_at from s qualify row_number() over (partition by key order by n desc) = 1 and status is not null")
def _(t):
    time = lambda c, name: F.col(c).cast("timestamp_ntz").alias(name)
    none = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    s = queue_log.folded(queue_events(t))
    return s.select("key", "version", "status", "current_step", F.col("automatic_failure_count").cast("long").alias("failures"), none("last_error_message", "last_error_message"), none("last_success_input_hash", "input_hash"), time("last_attempt_started_at", "attempt"), none("locked_by", "locked_by"), time("lock_expires_at", "lock_expires_at"), time("updated_at", "updated_at"))


@query("F14_failed_messages", "select run_id, case when bool_or(status = 'failed') then 'pending' else 'resolved' end as state from items group by 1")
def _(t):
    return control.failed_messages(t.audit_items().withColumnRenamed("run_id", "message_id")).withColumnRenamed("message_id", "run_id")


@query("A12_drain_rollup", "select count(*) filter (status = 'imported') as succeeded, count(*) filter (status <> 'imported') as failed, case when count(*) filter (status <> 'imported') = 0 then 'succeeded' when count(*) filter (status = 'imported') = 0 then 'failed' else 'partial' end as status from items")
def _(t):
    return control.drain_result(t.audit_items().select(F.when(F.col("status") == "imported", "succeeded").otherwise("failed").alias("outcome")))


@query("F18_enrichment_outcomes", "select conv_id as article_id, case when conv_id % 5 = 0 then 'skipped_advertisement' when conv_id % 5 = 1 then 'failed' when conv_id % 5 = 2 then 'partial' else 'succeeded' end as status from (select distinct conv_id from conversations)")
def _(t):
    rows = t.raw("conversations").select(F.col("conv_id").alias("article_id")).distinct().select("article_id", F.concat(F.lit("title "), F.col("article_id").cast("string")).alias("title"), F.col("article_id").cast("string").alias("body_text"))
    return enrich.outcome(enrich.enrich(rows, scripted)).select("article_id", "status")


def scripted():
    """A stand-in for a chat service that answers by the article's number."""
    import json

    def send(messages: list[dict]) -> str:
        n = int(messages[0]["content"].rsplit("\n", 1)[1]) % 5
        step = len(messages) // 2
        said = [{"content_type": "advertisement" if n == 0 else "article", "reason": ""}, {} if n == 1 else {"title": "题", "body": "文"}, {} if n == 2 else {"summary": "要"}, {"tags": ["a", "b", " c ", "a"]}]
        if n == 2 and step == 2 and "tags" in messages[-1]["content"]:
            return json.dumps(said[3])
        return json.dumps(said[step])

    return send
