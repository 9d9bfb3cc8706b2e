"""State tables, dedup, identity, enrichment, mail and streams on small cases."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from pressmill.functions import text as tx
from pressmill.operators import control, enrich, identity
from pressmill.sources import mail, storage, throttle
from pressmill.streaming import imports

QUEUE = "key string, status string, current_step string, automatic_failure_count int, last_error_message string, last_success_input_hash string, last_attempt_started_at timestamp, locked_by string, lock_expires_at timestamp, updated_at timestamp, seq long"
NOW = "2026-05-06 10:00:00"


def queue(spark, rows):
    df = spark.createDataFrame([(k, s, n, h, started, lock, updated, i) for i, (k, s, n, h, started, lock, updated) in enumerate(rows)], "key string, status string, n int, h string, started string, lock string, updated string, seq long")
    return df.select("key", "status", F.lit("await_ad_judgment").alias("current_step"), F.col("n").alias("automatic_failure_count"), F.lit(None).cast("string").alias("last_error_message"), F.col("h").alias("last_success_input_hash"), F.to_timestamp("started").alias("last_attempt_started_at"), F.when(F.col("lock").isNotNull(), "w0").alias("locked_by"), F.to_timestamp("lock").alias("lock_expires_at"), F.to_timestamp("updated").alias("updated_at"), "seq")


def states(df):
    return {r.key: r.status for r in df.collect()}


def test_claims_follow_the_order(spark):
    q = queue(spark, [("a", "failed_retryable", 1, None, None, None, "2026-01-01 00:00:00"), ("b", "pending", 0, None, None, None, "2026-01-03 00:00:00"), ("c", "pending", 0, None, None, "2026-05-06 11:00:00", "2026-01-01 00:00:00"), ("d", "manual_retry_requested", 0, None, None, "2026-05-06 09:00:00", "2026-01-09 00:00:00"), ("e", "succeeded", 0, "h", None, None, "2026-01-01 00:00:00")])
    after = control.claim(q, "w1", NOW, 600, 2)
    assert states(after) == {"a": "failed_retryable", "b": "running", "c": "pending", "d": "running_manual_retry", "e": "succeeded"}
    assert control.eligible(after, NOW).count() == 1  # no second claim of b or d


def test_failures_and_recovery(spark):
    q = queue(spark, [("a", "running", 0, None, "2026-05-06 08:00:00", "2026-05-06 08:10:00", NOW), ("b", "running", 1, None, "2026-05-06 08:00:00", None, NOW), ("c", "running", 1, None, "2026-05-06 09:59:00", None, NOW)])
    assert states(control.recover_stale(q, NOW, 3600)) == {"a": "failed_retryable", "b": "failed_terminal", "c": "running"}
    out = spark.createDataFrame([("a", "succeeded", None, "h1"), ("b", "rate_limited", "429", None), ("c", "failed", "x", None)], "key string, outcome string, message string, input_hash string")
    got = {r.key: r for r in control.settle(q, out, NOW).collect()}
    assert (got["a"].status, got["a"].last_success_input_hash, got["a"].locked_by) == ("succeeded", "h1", None)
    assert (got["b"].status, got["b"].automatic_failure_count) == ("failed_retryable", 1) and got["c"].status == "failed_terminal"


def test_enqueue(spark):
    q = queue(spark, [("same", "succeeded", 0, "h", None, None, NOW), ("changed", "failed_terminal", 2, "h", None, None, NOW), ("asked", "manual_retry_requested", 1, None, None, None, NOW), ("left", "running", 0, None, None, None, NOW)])
    new = spark.createDataFrame([("same", "h"), ("changed", "i"), ("asked", "x"), ("new", "y")], "key string, input_hash string")
    after = control.enqueue(q, new, NOW)
    assert states(after) == {"same": "succeeded", "changed": "pending", "asked": "manual_retry_requested", "left": "running", "new": "pending"}
    assert after.filter("key = 'changed'").first().automatic_failure_count == 0


def test_enqueue_touches_what_arrives(spark):
    lease, begun, old = "2026-05-06 11:00:00", "2026-05-06 08:00:00", "2026-01-01 00:00:00"
    q = queue(spark, [("same", "running", 1, "h", begun, lease, old), ("changed", "failed_terminal", 2, "h", begun, lease, old), ("asked", "manual_retry_requested", 1, "h", begun, lease, old), ("left", "running", 0, None, begun, lease, old)])
    q = q.withColumn("article_id", F.concat(F.lit("old-"), "key"))
    new = spark.createDataFrame([("same", "h"), ("changed", "i"), ("asked", "h"), ("new", "y")], "key string, input_hash string").withColumn("article_id", F.concat(F.lit("new-"), "key"))
    got = {r.key: r for r in control.enqueue(q, new, NOW).collect()}
    assert {k: r.article_id for k, r in got.items()} == {"same": "new-same", "changed": "new-changed", "asked": "new-asked", "left": "old-left", "new": "new-new"}
    same, changed, asked = got["same"], got["changed"], got["asked"]
    assert (same.status, same.current_step, same.automatic_failure_count, same.locked_by, str(same.last_attempt_started_at)) == ("succeeded", "await_ad_judgment", 1, None, begun)
    assert (changed.status, changed.automatic_failure_count, changed.last_attempt_started_at, changed.lock_expires_at) == ("pending", 0, None, None)
    assert (asked.status, asked.automatic_failure_count, asked.locked_by) == ("manual_retry_requested", 1, "w0")
    assert {k for k, r in got.items() if str(r.updated_at) == NOW} == {"same", "changed", "asked", "new"}


def test_a_retry_that_is_asked_for_can_be_claimed_at_once(spark):
    q = queue(spark, [("a", "running", 1, None, NOW, "2026-05-06 11:00:00", "2026-01-01 00:00:00"), ("b", "failed_terminal", 2, None, NOW, "2026-05-06 11:00:00", "2026-01-01 00:00:00")])
    after = control.request_retry(q, NOW, keys=["a"])
    assert states(control.claim(after, "w1", NOW, 60, 5)) == {"a": "running_manual_retry", "b": "failed_terminal"}
    assert states(control.request_retry(q, NOW, condition=F.lit(True))) == {"a": "running", "b": "manual_retry_requested"}


def test_known_keys_are_not_queued_again(spark):
    q = queue(spark, [("a", "succeeded", 0, "h", None, None, NOW)])
    after = control.enqueue_once(q, spark.createDataFrame([("a",), ("b",), ("b",)], "key string"), NOW)
    assert states(after) == {"a": "succeeded", "b": "pending"} and after.filter("key = 'b'").first().current_step == "parse_persist"


def test_tick_and_worker_loop(spark):
    kept = lambda df: storage.stored(df, "t")
    work = lambda rows: rows.select("key", F.when(F.col("key") == "k1", "failed").otherwise("succeeded").alias("outcome"), F.lit("m").alias("message"), F.lit("h").alias("input_hash"))
    q = queue(spark, [(f"k{i}", "pending", 0, None, None, None, NOW) for i in range(3)])
    after, result = control.tick(q, work, "w", NOW, 60, 2, kept)
    assert result == {"waves": 2, "selected": 3, "completed": 2, "failed": 1, "status": "partial"}
    assert control.tick(after.filter("status = 'succeeded'"), work, "w", NOW, 60, 2, kept)[1] is None
    now, slept, imports_, answers = [0], [], [], [True, ConnectionError(), TimeoutError(), False, True]

    def step():
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    def sleep(n):
        slept.append(n)
        now[0] += n

    assert control.worker_loop(step, lambda: now[0], sleep, lambda: imports_.append(now[0]), import_interval=60, rounds=5) == 5
    assert slept == [10, 5, 15, 60] and imports_ == [0, 90]
    with pytest.raises(control.FatalError):
        control.worker_loop(lambda: 1 / 0, lambda: 0, sleep, rounds=2)


def test_null_hashes_are_all_kept(spark):
    rows = [(1, None, None), (2, None, None), (3, None, "i"), (4, None, "i"), (5, "h", "i"), (6, "h", None)]
    got = identity.greedy_dedup(spark.createDataFrame(rows, "seq long, content_hash string, issue_key string"))
    assert {r.seq: r.kept_seq for r in got.collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6}


def test_pdf_names(spark):
    names = {"中文-金融时报-2026.pdf": False, "translated-notes.pdf": True, "paper_zh.pdf": True, "【译】a.pdf": False, "x/【译】a.pdf": False, "a【译】.pdf": True, "中文-华尔街日报.PDF": False, "a.txt": False}
    got = spark.createDataFrame([(n,) for n in names], "f string").select("f", mail.is_pdf(F.lit("application/octet-stream"), F.col("f")).alias("ok")).collect()
    assert {r.f: r.ok for r in got} == names
    assert spark.createDataFrame([("a.txt",)], "f string").select(mail.is_pdf(F.lit("application/pdf"), F.col("f"))).first()[0]


def test_hosts_and_names_of_addresses(spark):
    cases = [("https://u:p@My_Host.com:80/a/b%20c.pdf?x=1", "my_host.com", "b c.pdf"), ("http://h.org", "h.org", "download.pdf"), ("http://h.org/a/x.html", "h.org", "x.html"), ("http://h.org/a/file/", "h.org", "file.pdf"), ("no address", None, None), ("http://[::1]:8/q", "::1", "q.pdf"), ("http://h.org/.hidden", "h.org", ".hidden.pdf"), ("http://h.org/a%zz", "h.org", "a%zz.pdf")]
    got = spark.createDataFrame([(u,) for u, *_ in cases], "u string").select(tx.host(F.col("u")), tx.filename_from_url(F.col("u"))).collect()
    for (_, host, name), r in zip(cases, got, strict=True):
        assert r[0] == host and (name is None or r[1] == name)


def test_articles_without_pages_have_keys(spark):
    rows = [("d", 1, "a", "Big News Today", "body one", None), ("d", 2, "b", "BIG  news today", "other", [1, None])]
    got = {r.article_id: r.article_key for r in identity.article_keys(spark.createDataFrame(rows, "document_key string, run_seq int, article_id string, title string, body_text string, pages array<int>")).collect()}
    assert len(got) == 2




def test_drain_ends(spark):
    q = queue(spark, [(f"k{i}", "pending", 0, None, None, None, NOW) for i in range(5)])
    work = lambda rows: rows.select("key", F.when(F.col("key") == "k3", "failed").otherwise("succeeded").alias("outcome"), F.lit("m").alias("message"), F.lit("h").alias("input_hash"))
    after, waves = control.drain(q, work, "w", NOW, 60, 2, lambda df: storage.stored(df, "t"))
    assert waves == 3 and sorted(states(after).values()) == ["failed_retryable"] + ["succeeded"] * 4
    assert [control.backoff_seconds(n) for n in (1, 2, 3, 9)] == [5, 15, 60, 60]


@pytest.mark.parametrize("seed", range(4))
def test_dedup_is_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"h{rng.randint(0, 12)}", rng.choice([None, f"i{rng.randint(0, 9)}"])) for i in range(60)]
    by_hash, by_issue, want = {}, {}, {}
    for i, h, issue in rows:
        kept = by_hash.get(h, by_issue.get(issue) if issue else None)
        if kept is None:
            kept = by_hash[h] = i
            if issue:
                by_issue[issue] = i
        want[i] = kept
    got = identity.greedy_dedup(spark.createDataFrame(rows, "seq long, content_hash string, issue_key string"))
    assert {r.seq: r.kept_seq for r in got.collect()} == want


def test_identity_passes_on(spark):
    rows = [("d", 1, "a", "Big News Today", "body one", [1]), ("d", 2, "b", "BIG  news today", "other", [1, 7]), ("d", 3, "c", "big news today!", "x", [7]), ("d", 3, "e", "Else", "y", [9]), ("f", 1, "g", "Big News Today", "body one", [1])]
    got = {r.article_id: r.article_key for r in identity.article_keys(spark.createDataFrame(rows, "document_key string, run_seq int, article_id string, title string, body_text string, pages array<int>")).collect()}
    assert got["a"] == got["b"] == got["c"] and len({got["a"], got["e"], got["g"]}) == 3


def test_conversation():
    good = ['{"content_type": "article", "reason": ""}', '{"title": "t", "body": "b"}', '{"summary": "s"}', '{"tags": ["a", "b", "c"]}']

    def sender(replies):
        left = list(replies)
        seen = []

        def send(messages):
            seen.append(len(messages))
            return left.pop(0)

        return send, seen

    send, seen = sender(good)
    out = enrich.converse(send, "t", "b")
    assert out["tagging_status"] == "succeeded" and seen == [1, 3, 5, 7]
    assert enrich.converse(sender(['{"content_type": "advertisement"}'])[0], "t", "b")["translation_status"] == "skipped"
    send, seen = sender([good[0], "no json", good[1], "{}", "{}", good[3]])
    out = enrich.converse(send, "t", "b")
    assert (out["translation_status"], out["summary_status"], out["tagging_status"], out["failed_step"]) == ("succeeded", "failed", "succeeded", "summary") and seen == [1, 3, 3, 5, 5, 5]
    assert enrich.converse(sender(["x", "y"])[0], "t", "b")["failed_step"] == "ad_judgment"


def test_reuse_comes_before_calls(spark):
    a = spark.createDataFrame([("k1", "h1"), ("k2", "h2")], "article_key string, input_hash string")
    runs = spark.createDataFrame([("k1", "h1", "r1", 1, 1), ("k1", "h1", "r2", 1, 2)], "article_key string, input_hash string, enrichment_run_id string, finished_at int, seq int")
    old, new = enrich.reusable(a, runs)
    assert [r.enrichment_run_id for r in old.collect()] == ["r2"] and [r.article_key for r in new.collect()] == ["k2"]


def test_look_ups_by_input_keep_every_article_and_input(spark):
    a = spark.createDataFrame([("k1", ["h1", "h2"]), ("k2", ["h1"]), (None, ["h1"])], "article_key string, input_hashes array<string>")
    runs = spark.createDataFrame([("k1", "h1", "r1", 1, 1), ("k1", "h1", "r2", 1, 2), ("k1", "h3", "r3", 1, 1), ("k1", None, "r4", 1, 1), (None, "h1", "r5", 1, 1)], "article_key string, input_hash string, enrichment_run_id string, finished_at int, seq int")
    assert {tuple(r) for r in enrich.looked_up(a, runs).collect()} == {("k1", "h1", "r2"), ("k1", "h2", None), ("k2", "h1", None), (None, "h1", None)}


def test_wanted_inputs_are_not_shuffled(spark):
    """J11 dealt a row an article and input, four times the articles, to two joins."""
    from pressmill.plans import registry

    plan = registry.queries()["J11_reuse_by_input"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    at = lambda what: [i for i, line in enumerate(lines) if what in line]
    assert "LeftAnti" not in plan and len(at("Join ")) == 2 and max(at("Generate explode")) < min(at("Join "))  # the plan's first lines come last


def message(parts):
    import base64

    enc = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    made = [{"filename": f, "mimeType": m, "body": {"data": enc(b)}} for f, m, b in parts]
    return json.dumps({"parts": [{"mimeType": "multipart/mixed", "parts": made}]})


def test_mail(spark):
    html = b'<a href="https://Files.Ex.com/a.pdf">Get</a><a href="https://bad.org/x">no</a><a href="https://Files.Ex.com/a.pdf">again</a>'
    rows = [("m1", "News@Ex.com", "1700000000000", message([("a.PDF", "application/x", b"%PDF1"), ("", "text/html", html)])), ("m2", "other@ex.com", "1700000000500", message([("b.pdf", "application/pdf", b"%PDF2")])), ("m3", "news@ex.com", "99", message([("中文-金融时报-2026.pdf", "application/pdf", b"x")]))]
    df = spark.createDataFrame(rows, "message_id string, sender string, internal_date string, payload string")
    pdfs = mail.attachments(df)
    assert sorted((r.message_id, bytes(r.content)) for r in pdfs.collect()) == [("m1", b"%PDF1"), ("m2", b"%PDF2"), ("m3", b"x")]
    chosen = mail.selected(df, pdfs, ("News@Ex.com",))
    assert [r.message_id for r in chosen.collect()] == ["m1"] and mail.checkpoint(chosen).first()[0] == 1700000000000
    assert mail.since(df, 1700000000400).count() == 2
    links = mail.sorted_links(mail.candidate_links(mail.bodies(df)), ("files.ex.com",)).orderBy("pos").collect()
    assert [(r.url, r.verdict) for r in links] == [("https://Files.Ex.com/a.pdf", "allowed"), ("https://bad.org/x", "link_domain_not_allowed")]
    found = spark.createDataFrame([("https://e.x/p", "", "", '<a href="https://e.x/q.pdf">PDF</a>'), ("https://e.x/z.pdf", "", "", ""), ("https://e.x/p", "", "%PDF-1", ""), ("https://e.x/p", "", "", "var u='https://e.x/s.pdf'")], "url string, landing string, head string, html string")
    assert [r[0] for r in found.select(mail.resolve(F.col("url"), F.col("landing"), F.col("head"), F.col("html"))).collect()] == ["https://e.x/q.pdf", "https://e.x/z.pdf", "https://e.x/p", "https://e.x/s.pdf"]
    assert mail.MailConfig.load('{"max_results": "7", "allowed_senders": ["a"], "include_spam_trash": "yes", "else": 1}') == mail.MailConfig(max_results=7, allowed_senders=("a",), include_spam=True)


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", 30, 20)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 5, 9) + b"\x00" * 9
    df = spark.createDataFrame([(bytearray(png),), (bytearray(jpeg),), (bytearray(b"x"),)], "c binary")
    assert [(r.s.width, r.s.height) for r in df.select(tx.image_size("c").alias("s")).collect()] == [(30, 20), (9, 5), (None, None)]
    assert df.select(tx.png_size(F.col("c")).alias("s")).first().s.width == 30


def test_storage(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert storage.migrate(spark, root) == [v for v, *_ in storage.MIGRATIONS] and storage.migrate(spark, root) == []
    assert storage.inspect(spark, root)["pending"] == []
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, seq int")
    new = spark.createDataFrame([("a", 2, 1), ("c", 3, 1)], "k string, v int, seq int")
    assert sorted((r.k, r.v) for r in storage.upsert(old, new, ["k"]).collect()) == [("a", 2), ("b", 1), ("c", 3)]
    assert [r.k for r in storage.insert_new(new, old, ["k"]).collect()] == ["c"]
    assert storage.log_line("e", b=1, a="é") == '{"a": "é", "b": 1, "event": "e"}'


def test_throttle():
    now = [0.0]
    t = throttle.Throttle(60, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(61):
        t.acquire()
    assert now[0] == pytest.approx(1)
    answers = [(429, {"Retry-After": "90"}, b""), (200, {}, b"ok")]
    assert t.call(lambda: answers.pop(0)) == b"ok" and now[0] >= 91
    with pytest.raises(throttle.RateLimitExceeded):
        t.call(lambda: (429, {}, b""))
    assert throttle.retry_after_seconds("x", 5) == 5


def test_import_stream(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = [(i, "r", f"m{i % 3}", "imported", f"2026-05-06 10:0{i % 6}:00") for i in range(6)]
    spark.createDataFrame(rows, "id long, run_id string, message_id string, status string, created_at string").write.json(src)
    for _ in range(2):  # a rerun adds nothing
        imports.import_available(imports.first_seen(imports.read_items(spark, src)), out, check).awaitTermination()
        assert spark.read.parquet(out).count() == 6
