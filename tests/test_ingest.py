"""Imports from messages, batches of pages, routing, storage of runs, view helpers."""

import json

import pytest
from pyspark.sql import functions as F

from pressmill.operators import ingest, outline, routing
from pressmill.plans import views
from pressmill.sources import ocr, storage

MESSAGES = "message_id string, sender string, internal_date string, seq long"
PARTS = "message_id string, pos int, attachment_id string, filename string, mime_type string, content binary, link_url string"


def test_messages_become_documents_and_audit_items(spark):
    messages = spark.createDataFrame([("m1", "a@x", "1700000000000", 0), ("m2", "b@x", "1700000001000", 1), ("m3", "a@x", "1700000002000", 2), ("m4", "a@x", None, 3)], MESSAGES)
    parts = [
        ("m1", 0, "p/1", "The Economist 2026-05-02.pdf", "application/pdf", b"one", None), ("m1", 1, "p2", "note.txt", "text/plain", b"no", None),
        ("m2", 0, "p3", "b.pdf", "application/pdf", b"two", None), ("m2", 1, "link:https://e.x/q", "q.pdf", "application/pdf", b"q", ""),
        ("m3", 0, "p4", "other name.pdf", "application/pdf", b"one", None), ("m3", 1, "p5", "The Economist 2026-05-02 new.pdf", "application/pdf", b"changed", None), ("m3", 2, "link:body-1", "z.pdf", "application/pdf", b"z", "https://e.x/z.pdf"),
    ]
    attachments = spark.createDataFrame(parts, PARTS)
    rows = ingest.imported(messages, attachments, ("a@x",), 2026)
    got = {r.attachment_id: r for r in rows.collect()}
    assert {k: r.was_created for k, r in got.items()} == {"p/1": True, "p4": False, "p5": False, "link:body-1": True}
    assert got["p4"].canonical_key == got["p5"].canonical_key == got["p/1"].document_key and got["p/1"].raw_path.startswith("raw/mail/m1/p_1-")
    assert ingest.new_documents(rows).count() == 2
    items = {r.item_key: r for r in ingest.audit_items(messages, attachments, ("a@x",), rows).collect()}
    assert {k: (r.status, r.detail_code) for k, r in items.items()} == {
        "message:m1": ("succeeded", "message_selected"), "message:m2": ("skipped", "sender_not_allowed"), "message:m3": ("succeeded", "message_selected"), "message:m4": ("succeeded", "message_selected"),
        "message:m2:attachment:p3": ("skipped", "sender_not_allowed"), "message:m2:body_link:https://e.x/q": ("skipped", "sender_not_allowed"), "message:m1:attachment:p/1": ("succeeded", "document_created"),
        "message:m3:attachment:p4": ("skipped", "duplicate_document"), "message:m3:attachment:p5": ("skipped", "duplicate_document"), "message:m3:body_link:https://e.x/z.pdf": ("succeeded", "document_created"),
    }
    assert items["message:m3:body_link:https://e.x/z.pdf"].link_url == "https://e.x/z.pdf"
    result = ingest.run_result("r1", ingest.audit_items(messages, attachments, ("a@x",), rows), fetched=4).first()
    assert (result.status, result.imported_attachment_count, result.created_document_count, result.skipped_document_count, result.skipped_item_count) == ("succeeded", 4, 2, 2, 5)
    known = ingest.new_documents(rows).withColumn("seq", F.lit(0))
    again = ingest.imported(messages, attachments, ("a@x",), 2026, known.select("document_key", "content_hash", "source_name", "issue_date", "seq"))
    assert not any(r.was_created for r in again.collect())
    queue = spark.createDataFrame([], "key string, status string, current_step string, automatic_failure_count int, updated_at timestamp, seq long")
    assert ingest.enqueue_documents(queue, rows, "2026-05-06 10:00:00").count() == 2


def test_run_results(spark):
    items = spark.createDataFrame([("failed", "x"), ("succeeded", "document_created")], "status string, detail_code string")
    assert ingest.run_result("r", items).first().status == "partial" and ingest.run_result("r", items, failed=True).first().status == "failed"
    assert ingest.run_result("r", items.limit(0)).first().status == "succeeded"
    links = spark.createDataFrame([("m", "https://a.b/c", "link_domain_not_allowed"), ("m", "https://a.b/d", "allowed")], "message_id string, url string, verdict string")
    assert [(r.item_key, r.detail_code) for r in ingest.link_items(links).collect()] == [("message:m:body_link:https://a.b/c", "link_domain_not_allowed")]


def test_routes(spark):
    rows = [("calibre 7", "The Economist", 3, "", ""), ("calibre 7", "x", 9, "see economist.com", ""), ("calibre", "The Economist", 2, "", ""), ("x", "", 0, "", "Bloomberg Businessweek Contents"), ("calibre", "", 0, "", "Bloomberg Businessweek Contents"), (None, None, None, None, "Bloomberg Businessweek Contents"), (None, None, None, None, None), ("x", "", 0, "", "Bloomberg Businessweek contents")]
    files = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "document_key int, producer string, title string, leaves int, outline_sample string, layout_sample string")
    want = ["outline", "outline", "markdown", "layout", "markdown", "layout", "markdown", "markdown"]
    assert [r.route for r in routing.routed(files).orderBy("document_key").collect()] == want
    done = routing.parsed(files, {k: (lambda d: d.select("document_key")) for k in routing.ROUTES})
    assert [r.route for r in done.orderBy("document_key").collect()] == want


def test_debug_text_warns(spark):
    articles = spark.createDataFrame([("d", 2, "B", "s", 3, 5, "b"), ("d", 1, "A", "s", 1, 3, "a"), ("e", 1, "C", "", 1, 2, "c")], "document_key string, article_order int, title string, section string, start_page int, end_page int, body_text string")
    got = {r.document_key: r for r in routing.debug_text(articles, spark.createDataFrame([("d", 4), ("e", 1)], "document_key string, entries int")).collect()}
    assert got["d"].suspicious and got["d"].debug_text.split("\n")[0].startswith("<!-- WARNING: 2 articles from 4 ") and not got["e"].suspicious
    assert "<!-- ARTICLE: A | section=s | pages=1-2 -->\na\n\n<!-- ARTICLE: B" in got["d"].debug_text


def test_pages_resume(spark, tmp_path):
    log = str(tmp_path / "log")

    def make():
        class Client:
            def submit(self, names):
                with open(log, "a") as f:
                    f.write(",".join(names) + "\n")
                return "b-" + names[0]

            def result(self, batch):
                first = int(batch.split("-")[-1][:4])
                return {f"page-{n:04d}.pdf": f"text {n}" for n in range(first, first + 2)}

        return Client()

    files = ocr.page_files(spark.createDataFrame([("d", 5), ("none", 0)], "document_key string, total_pages int"))
    state = spark.createDataFrame([("d", 1, "page-0001.pdf", "b-old", "done", "kept")], ocr.STATE)
    assert [(r.document_key, r.file_names) for r in ocr.unfinished(files, state).collect()] == [("d", [f"page-000{n}.pdf" for n in (2, 3, 4, 5)])]
    after = ocr.resumed(files, state, make, lambda df: storage.stored(df, "t"), size=2)
    got = {r.page_number: (r.state, r.markdown_text) for r in after.collect()}
    assert got == {1: ("done", "kept"), **{n: ("done", f"text {n}") for n in (2, 3, 4, 5)}}
    assert sorted(open(log).read().split()) == ["page-0002.pdf,page-0003.pdf", "page-0004.pdf,page-0005.pdf"]
    assert ocr.batch_ids(after).first().batch_ids == ["b-old", "b-page-0002.pdf", "b-page-0004.pdf"]
    assert ocr.unfinished(files, after).count() == 0 and ocr.submitted(files, after, make).count() == 0


def test_layout_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x_content_list.json").write_text(json.dumps([{"type": "text", "text": "é", "page_idx": 2, "bbox": [1, 2, 3, 4]}, "no object", {"type": "image", "img_path": "i.png"}]))
    (tmp_path / "c_content_list.json").write_text("[]")
    rows = ocr.layout_blocks(spark, str(tmp_path)).orderBy("block_index").collect()
    assert [(r.block_index, r.type, r.text, r.page_idx, r.bbox, r.img_path) for r in rows] == [(0, "text", "é", 2, [1, 2, 3, 4], ""), (2, "image", "", 0, [], "i.png")]
    (tmp_path / "empty").mkdir()
    assert ocr.layout_blocks(spark, str(tmp_path / "empty")).count() == 0


def test_image_paths_of_pages(spark):
    text = "a ![x](images/1.png) b\n  ../up.jpg  \n![y](https://e.x/i.png)\n![z](page-markdown/q.png)\n![o](/else/o.png)\nplain"
    got = spark.createDataFrame([(text,)], "t string").select(ocr.with_relative_images(F.col("t"), F.lit("/m/page-markdown/p1"), F.lit("/m"))).first()[0]
    assert got.split("\n") == ["a ![x](page-markdown/p1/images/1.png) b", "  page-markdown/up.jpg  ", "![y](https://e.x/i.png)", "![z](page-markdown/q.png)", "![o](/else/o.png)", "plain"]


def test_runs_open_and_close(spark, tmp_path):
    root = str(tmp_path / "lake")
    storage.migrate(spark, root)
    storage.opened(spark, root, "parse_runs", parse_run_id="r1", document_key="d", parser_name="p")
    assert storage.states(spark, root, "parse_runs", "parse_run_id").first().status == "running"
    storage.closed(spark, root, "parse_runs", "parse_run_id", parse_run_id="r1", status="succeeded")
    row = storage.states(spark, root, "parse_runs", "parse_run_id").first()
    assert (row.status, row.parser_name, row.seq) == ("succeeded", "p", 1)
    with pytest.raises(LookupError):
        storage.closed(spark, root, "parse_runs", "parse_run_id", parse_run_id="r2", status="failed")
    fragments = spark.createDataFrame([("r1", 1, "t", "b", "", "", 1)], dict((n, d) for _, n, d in storage.MIGRATIONS)["article_fragments"])
    storage.publish_run(root, storage.states(spark, root, "parse_runs", "parse_run_id").withColumn("seq", F.lit(2).cast("long")), {"article_fragments": fragments})
    assert spark.read.parquet(f"{root}/article_fragments").count() == 1


def test_blobs(spark, tmp_path):
    rows = spark.createDataFrame([("raw/a.pdf", b"1"), ("raw/b/c.pdf", b"2")], "raw_path string, content binary")
    assert [r.was_new for r in storage.write_blobs(rows, str(tmp_path)).collect()] == [True, True]
    assert [r.was_new for r in storage.write_blobs(rows, str(tmp_path)).collect()] == [False, False] and (tmp_path / "raw/b/c.pdf").read_bytes() == b"2"
    paths = spark.createDataFrame([("m", "a", "h", "x.PDF"), ("m", "a", "h", "x")], "m string, a string, h string, f string").select(storage.blob_path(F.col("m"), F.col("a"), F.col("h"), F.col("f"))).collect()
    assert [r[0] for r in paths] == ["raw/mail/m/a-h.pdf", "raw/mail/m/a-h.pdf"]
    assert [json.loads(r.json) for r in storage.as_json(spark.createDataFrame([(1, "é")], "a int, b string")).collect()] == [{"a": 1, "b": "é"}]


def test_outputs_are_validated(spark):
    rows = [("article", "succeeded", "b", "succeeded", "s", "succeeded", ["a", "b", "c"]), ("news", "failed", "", "failed", "", "failed", []), ("article", "succeeded", " ", "failed", "", "failed", []), ("article", "failed", "", "succeeded", "", "failed", []), ("article", "failed", "", "failed", "", "succeeded", ["a"])]
    good, bad = storage.validated(spark.createDataFrame(rows, "content_type string, translation_status string, translated_body string, summary_status string, summary string, tagging_status string, tags array<string>"))
    assert good.count() == 1 and sorted(r.fault for r in bad.collect()) == ["content type", "empty summary", "empty translation", "tag count"]


def test_parameters_and_lookups(spark):
    assert views.int_parameter({"page": ["3"]}, "page", 1) == 3 and views.int_parameter({"page": [" "]}, "page", 1) == 1 and views.int_parameter({}, "n") is None
    assert views.int_parameter({"page": ["-3"]}, "page", 1) == -3
    for given in ({"n": ["x"]}, {"n": ["-1"]}):
        with pytest.raises(views.BadRequest):
            views.int_parameter(given, "n")
    assert views.unknown_keys({"b": 1, "a": 2, "status": 3}, {"status"}) == ["a", "b"]
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert views.lookup(rows, k=2).v == "y" and [r.k for r in views.optional(rows, [F.desc("k")], limit=1, v=None).collect()] == [2]
    assert views.optional(rows, [F.col("k")], v="x").count() == 1
    with pytest.raises(LookupError):
        views.lookup(rows, k=3)


def test_source_addresses(spark):
    mark = "This article was downloaded by calibre from"
    cases = [(f"a\n{mark}\n\n\nhttps://e.x/lo\nng?q\n\nrest", "https://e.x/long?q"), (f"{mark} https://e.x/主菜单-x", "https://e.x/主菜单-x"), (f"{mark} https://e.x/a\n| 下一项 | 章节菜单 |\nb", "https://e.x/a"), ("no mark https://e.x", ""), (f"{mark} nothing", ""), (None, "")]
    got = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(outline.source_url("t")).collect()
    assert [r[0] for r in got] == [u for _, u in cases]


def test_messages_are_listed_and_fetched(spark):
    from pressmill.sources import mail

    def make():
        class Client:
            def list(self, query, n, labels, spam):
                assert (query, n, labels, spam) == ("from:x after:1700000000", 2, ["L"], False)
                return ["m1", "m2", "m3"]

            def get(self, key):
                return {"id": key, "internalDate": "5", "payload": {"headers": [{"name": "From", "value": "News <News@X.com>"}], "parts": []}}

        return Client()

    config = mail.MailConfig(query="from:x", max_results=2)
    rows = mail.fetched(spark, make, config, 1700000000999, ("L",)).orderBy("seq").collect()
    assert [(r.message_id, r.sender, r.internal_date) for r in rows] == [("m1", "News@X.com", "5"), ("m2", "News@X.com", "5")]
    assert mail.incremental_query("q", None) == "q"


def test_links_are_downloaded(spark):
    from pressmill.sources import mail

    def make():
        class Client:
            pages = {"https://e.x/page": '<a href="https://e.x/real.pdf">PDF</a>', "https://e.x/none": "nothing"}
            files = {"https://e.x/real.pdf": b"%PDF-1", "https://e.x/direct": b"%PDF-2"}

            def fetch_html(self, url):
                return self.pages[url]

            def download_binary(self, url):
                if url not in self.files:
                    raise mail.FetchError(f"404 {url}")
                return self.files[url]

        return Client()

    urls = ["https://e.x/page", "https://e.x/direct", "https://e.x/none", "https://e.x/lost.pdf"]
    links = spark.createDataFrame([("m", u, i) for i, u in enumerate(urls)], "message_id string, url string, pos int")
    rows = mail.downloads(mail.sorted_links(links, ("e.x",)), make).orderBy("pos").collect()
    assert [(r.filename, r.content and bytes(r.content), r.verdict) for r in rows[:2]] == [("real.pdf", b"%PDF-1", "downloaded"), ("direct.pdf", b"%PDF-2", "downloaded")]
    assert [r.verdict for r in rows[2:]] == ["link_not_importable", "link_fetch_failed"]
    assert all(r.attachment_id.startswith("link:") for r in rows)


def test_steps_end_at_the_first_error(spark):
    from pressmill.operators import control

    def failing():
        def step(key):
            if key == "b":
                raise ValueError("boom")
            if key == "c":
                e = RuntimeError("429")
                e.rate_limited = True
                raise e

        return step

    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    got = {r.key: (r.outcome, r.message, r.failed_step) for r in control.run_steps(rows, [("parse_persist", lambda: lambda key: None), ("enrich", failing)]).collect()}
    assert got == {"a": ("succeeded", None, None), "b": ("failed", "boom", "enrich"), "c": ("rate_limited", "429", "enrich")}


@pytest.mark.parametrize("name", ["S4_attachments", "C20_anchors"])
def test_long_texts_come_to_python_a_few_at_once(spark, name):
    from pressmill.plans import registry

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(key)) <= 2000
