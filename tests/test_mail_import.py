"""Whole imports: audit of links, checkpoint, retries, streams, and what a crash leaves."""

import base64
import json
import threading

import pytest
from pyspark.sql import functions as F

from pressmill.operators import mail_import
from pressmill.sources import mail, mail_stream, storage
from pressmill.streaming import imports

NOW, CONFIG = "2026-05-06 10:00:00", mail.MailConfig(allowed_senders=("News@ex.com",))
HERE = "tests.test_mail_import:made"


def enc(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def message(date, sender="News@ex.com", pdfs=(), links=()):
    parts = [{"filename": n, "mimeType": "application/pdf", "body": {"data": enc(c.encode())}} for n, c in pdfs]
    html = "".join(f'<a href="{u}">x</a>' for u in links)
    parts += [{"mimeType": "text/html", "body": {"data": enc(html.encode())}}] if links else []
    return {"internalDate": str(date), "payload": {"headers": [{"name": "From", "value": f"N <{sender}>"}], "parts": parts}}


class Client:
    """Messages and files from one JSON file: {messages, files, pages, down}."""

    def __init__(self, path):
        self.path = path
        self.data = json.load(open(path))

    def list(self, query, n, labels, spam):
        after = int(query.split("after:")[1]) if "after:" in query else 0
        found = [(int(m["internalDate"]), k) for k, m in self.data["messages"].items() if int(m["internalDate"]) // 1000 >= after]
        return [k for _, k in sorted(found, reverse=True)][:n]

    def get(self, key):
        if key in self.data.get("down", []):
            raise mail.FetchError(f"no {key}")
        with open(self.path + ".log", "a") as f:
            f.write(key + "\n")
        return {"id": key} | self.data["messages"][key]

    def date(self, key):
        return self.data["messages"][key]["internalDate"]

    def download_binary(self, url):
        if url not in self.data.get("files", {}):
            raise mail.FetchError(f"404 {url}")
        return self.data["files"][url].encode()

    def fetch_html(self, url):
        if url not in self.data.get("pages", {}):
            raise mail.FetchError(f"404 {url}")
        return self.data["pages"][url]


@pytest.fixture()
def box(tmp_path, monkeypatch):
    """Write the mailbox; gives (path, a client maker, where the lake is)."""
    path = str(tmp_path / "mail.json")

    def put(**data):
        json.dump({"messages": {}} | data, open(path, "w"))

    put()
    return put, lambda: Client(path), str(tmp_path / "lake"), path


def items(spark, root, run):
    rows = storage.published(spark, root, "import_run_items").filter(F.col("run_id") == run)
    return sorted((r.item_type, r.status, r.detail_code, r.link_url or r.attachment_id or r.message_id, r.message_internal_date if False else None) for r in rows.collect())


def told(spark, root, table):
    return sorted(map(repr, (tuple(r) for r in storage.published(spark, root, table).drop("created_at", "updated_at").collect())))


def test_links_that_fail_are_audited_and_retried_once(spark, box):
    put, make, root, _ = box
    links = ["https://a.ex/one.pdf", "https://a.ex/lost.pdf", "https://a.ex/page", "https://a.ex/plain", "https://a.ex/gone", "https://a.ex/zh"]
    zh = "【译】x.pdf"
    files = {"https://a.ex/one.pdf": "%PDF one", "https://a.ex/two.pdf": "%PDF two"}
    pages = {"https://a.ex/page": '<a href="https://a.ex/two.pdf">PDF</a>', "https://a.ex/plain": "nothing", "https://a.ex/zh": f'<a href="https://a.ex/{zh}">download</a>'}
    put(messages={"m1": message(5000, links=links), "m2": message(9000, "else@ex.com", [("b.pdf", "%PDF b")]), "m3": message(7000, pdfs=[("c.pdf", "%PDF one"), ("d.pdf", "%PDF d")])}, files=files, pages=pages)
    done = mail_import.import_mail(spark, root, "r1", CONFIG, make, NOW, 2026)
    # Two links give files; the lost and the gone one failed; c.pdf has the bytes of one.pdf.
    assert (done.status, done.fetched, done.imported, done.created) == ("partial", 3, 4, 3)
    got = items(spark, root, "r1")
    code = {k[3]: (k[1], k[2]) for k in got if k[0] == "body_link"}
    assert code == {
        "https://a.ex/one.pdf": ("skipped", "duplicate_document") if code["https://a.ex/one.pdf"][1] == "duplicate_document" else ("succeeded", "document_created"), "https://a.ex/lost.pdf": ("failed", "link_fetch_failed"), "https://a.ex/page": ("succeeded", "document_created"),
        "https://a.ex/plain": ("skipped", "link_not_importable"), "https://a.ex/gone": ("failed", "link_fetch_failed"), "https://a.ex/zh": ("skipped", "body_link_filename_filtered"),
    }
    assert storage.published(spark, root, "documents").filter("content_hash is null").count() == 0
    assert sum(k[2] == "sender_not_allowed" for k in got) == 2
    run = storage.published(spark, root, "import_runs").filter("run_id = 'r1'").first()
    assert (run.status, run.failed_item_count, run.checkpoint_after) == ("partial", 2, "7000")
    # The retry of the same run finds the links lost still, and that is final.
    assert (done.retried, done.resolved, done.failed_final) == (1, 0, 1)
    assert mail_import.failed_states(spark, root).first().retry_state == "failed_final" and mail_import.retryable(spark, root).isEmpty()
    assert mail_import.retry_failed(spark, root, "again", CONFIG, make, NOW, 2026) is None
    assert spark.read.parquet(f"{root}/import_retries").first().failed_final_message_count == 1


def test_a_retry_that_succeeds_resolves(spark, box):
    put, make, root, _ = box
    bad = {"m1": message(5000, links=["https://a.ex/one.pdf"], pdfs=[("a.pdf", "%PDF a")]), "m2": message(6000, links=["https://a.ex/two.pdf"])}
    put(messages=bad)
    first = mail_import.run_import(spark, root, "r1", mail.fetched(spark, make, CONFIG), CONFIG, make, NOW, 2026)
    assert first.status == "partial" and mail_import.checkpoint_of(spark, root) == 5000  # only m1 has a PDF of its own
    put(messages=bad, files={"https://a.ex/one.pdf": "%PDF one"}, down=["m2"])
    again = mail_import.retry_failed(spark, root, "r2", CONFIG, make, NOW, 2026)
    assert (again.retried, again.resolved, again.failed_final, again.status) == (2, 1, 1, "partial")
    states = {r.message_id: (r.retry_state, r.retry_attempt_count) for r in mail_import.failed_states(spark, root).collect()}
    assert states == {"m1": ("resolved", 1), "m2": ("failed_final", 1)}
    assert ("message", "failed", "retry_message_fetch_failed", "m2", None) in items(spark, root, "r2") and mail_import.checkpoint_of(spark, root) == 5000
    names = {r.original_filename for r in storage.published(spark, root, "documents").collect()}
    assert names == {"a.pdf", "one.pdf"}
    # A message that fails anew after it was resolved has had its retry.
    put(messages={"m1": message(5000, links=["https://a.ex/new.pdf"])})
    mail_import.run_import(spark, root, "r3", mail.fetched(spark, make, CONFIG), CONFIG, make, NOW, 2026)
    assert {r.message_id: r.retry_attempt_count for r in mail_import.failed_states(spark, root).collect()}["m1"] == 2 and mail_import.retryable(spark, root).isEmpty()


def test_domains(spark):
    links = spark.createDataFrame([("m", "https://a.ex/x.pdf", 0), ("m", "https://b.ex/y.pdf", 1)], "message_id string, url string, pos int")
    verdicts = lambda domains: [r.verdict for r in mail.sorted_links(links, domains).orderBy("pos").collect()]
    assert verdicts(()) == ["allowed", "allowed"] and verdicts(("a.ex",)) == ["allowed", "link_domain_not_allowed"]


class Killed(RuntimeError):
    pass


def test_a_batch_run_again_after_a_crash_adds_nothing(spark, box, tmp_path):
    put, make, root, _ = box
    put(messages={"m1": message(5000, pdfs=[("a.pdf", "%PDF a")], links=["https://a.ex/lost.pdf"]), "m2": message(6000, pdfs=[("b.pdf", "%PDF b"), ("c.pdf", "%PDF a")])})
    tables = (*mail_import.TABLES, "import_runs")
    messages = mail.fetched(spark, make, CONFIG)
    for at in ("documents", "failed_messages", "import_runs"):

        def killed(table, at=at):
            if table == at:
                raise Killed(table)

        with pytest.raises(Killed):
            mail_import.run_import(spark, root, "r1", messages, CONFIG, make, NOW, 2026, after=killed)
        assert all(storage.published(spark, root, t).isEmpty() for t in tables) == (at != "import_runs")
    seen = {t: told(spark, root, t) for t in tables}
    mail_import.run_import(spark, root, "r1", messages, CONFIG, make, NOW, 2026)
    assert seen == {t: told(spark, root, t) for t in tables} and all(seen.values())
    assert len(seen["document_processing_runs"]) == len(seen["documents"]) == 2 and len(seen["import_run_items"]) == 6


def test_offsets_tell_messages_of_one_moment_apart():
    found = [(5, "a"), (7, "b"), (7, "c"), (9, "d")]
    assert mail_stream.between(found, {"ms": 7, "ids": ["b"]}) == [(7, "c"), (9, "d")]
    assert mail_stream.between(found, {"ms": -1, "ids": []}, {"ms": 7, "ids": ["b"]}) == [(5, "a"), (7, "b")]


def test_stream_gives_each_message_once(spark, box, tmp_path, monkeypatch):
    put, make, root, path = box
    first = {"m1": message(5000, pdfs=[("a.pdf", "%PDF a")]), "m2": message(6000, pdfs=[("b.pdf", "%PDF b")]), "m3": message(6500, "else@ex.com")}
    put(messages=first)
    spark.dataSource.register(mail_stream.MailSource)
    reader = mail_stream.MailStreamReader({"client": HERE, "query": "q"})
    monkeypatch.setattr(mail_stream, "client_of", lambda options: Client(path))
    start = reader.initialOffset()
    end = reader.latestOffset()
    assert end == {"ms": 6500, "ids": ["m3"]}
    rows = [r for p in reader.partitions(start, end) for r in reader.read(p)]
    assert [(r[0], r[1], r[4]) for r in rows] == [("m1", "News@ex.com", 0), ("m2", "News@ex.com", 1), ("m3", "else@ex.com", 2)]
    assert reader.latestOffset() == end
    put(messages=first | {"m4": message(6500), "m5": message(8000)})
    later = reader.latestOffset()
    assert later == {"ms": 8000, "ids": ["m5"]} and [r[0] for p in reader.partitions(end, later) for r in reader.read(p)] == ["m4", "m5"]
    # A batch that is run again after a restart asks for the same range.
    again = mail_stream.MailStreamReader({"client": HERE, "query": "q"})
    assert [r[0] for p in again.partitions(start, end) for r in again.read(p)] == ["m1", "m2", "m3"]
    assert [r[0] for p in mail_stream.MailReader({"client": HERE, "afterms": "6000"}).partitions() for r in fetched_of(p)] == ["m2", "m3", "m4", "m5"]


def fetched_of(p):
    return list(mail_stream.fetch({"client": HERE}, p))


def test_two_streamed_imports(spark, box, tmp_path):
    put, make, root, path = box
    first = {"m1": message(5000, pdfs=[("a.pdf", "%PDF a")]), "m2": message(6000, pdfs=[("b.pdf", "%PDF b")]), "m3": message(6500, "else@ex.com")}
    put(messages=first)
    config = mail.MailConfig(query="q", allowed_senders=("News@ex.com",), max_results=100)
    folder = str(tmp_path / "offsets")

    def go():
        query = imports.import_stream(imports.mail_stream(spark, "tests.mail_client:from_options", config, box=path), root, config, make, folder, lambda: NOW, 2026)
        assert query.awaitTermination(120)
        assert query.exception() is None

    go()
    assert mail_import.checkpoint_of(spark, root) == 6000
    runs = storage.published(spark, root, "import_runs").count()
    go()
    assert storage.published(spark, root, "import_runs").count() == runs
    put(messages=first | {"m4": message(6500, pdfs=[("d.pdf", "%PDF d")])})
    go()
    said = storage.published(spark, root, "import_run_items").filter("item_type = 'message'").groupBy("message_id").count().collect()
    assert {r.message_id: r["count"] for r in said} == {"m1": 1, "m2": 1, "m3": 1, "m4": 1}
    assert storage.published(spark, root, "documents").count() == 3 and mail_import.checkpoint_of(spark, root) == 6500


def test_migrations_take_turns(spark, tmp_path):
    root, done, failed = str(tmp_path / "lake"), [], []

    def go():
        try:
            done.append(storage.migrate(spark, root))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=go) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(map(len, done)) == [0, 0, len(storage.MIGRATIONS)]
    versions = [r.version for r in spark.read.parquet(f"{root}/_schema_version").collect()]
    assert sorted(versions) == [v for v, _, _ in storage.MIGRATIONS]


def test_one_claim_wins_and_dead_holders_expire(spark, tmp_path):
    path, won = str(tmp_path / "c" / "1"), []
    threads = [threading.Thread(target=lambda i=i: won.append((i, storage.claim(spark, path, str(i))))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winner = [i for i, ok in won if ok]
    assert len(winner) == 1 and storage.content(spark, path) == str(winner[0])
    now, folder = [100.0], str(tmp_path / "lock")
    held = storage.locked(spark, folder, 10, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + 4))
    assert held.__enter__() == 1
    with storage.locked(spark, folder, 10, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + 4)) as turn:
        assert turn == 2 and now[0] >= 110
    with storage.locked(spark, folder, 10, clock=lambda: now[0]) as turn:
        assert turn == 3
