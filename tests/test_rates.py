"""The rate of many tasks, scheduler rows, blobs and layout files of many documents."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from pressmill.functions import dates
from pressmill.operators import control
from pressmill.sources import mail, ocr, rate_budget, settings, storage
from pressmill.sources.throttle import RateLimitExceeded


class Time:
    """A clock that sleeping moves."""

    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def test_tasks_keep_the_rate(spark, tmp_path):
    clock, log = Time(), tmp_path / "log"
    log.mkdir()
    deals = []

    class Watched(rate_budget.Ledger):
        def deal(self, wanted):
            n, wait = super().deal(wanted)
            if n:
                deals.append((self.clock(), n))
            return n, wait

    folder = str(log)

    def make():
        class Client:
            def send(self, key):
                with open(f"{folder}/{key}", "a") as f:
                    f.write("x")
                again = open(f"{folder}/{key}").read() != "x"
                return (429, {"Retry-After": "90"}, b"") if key == 12 and not again else (200, {}, str(key).encode())

        return Client()

    rows = spark.createDataFrame([(i,) for i in range(45)], "key int")
    got = rate_budget.metered(rows, make, Watched(spark, str(tmp_path / "ledger"), 20, clock), sleep=clock.sleep)
    assert sorted((r.key, r.status, bytes(r.body)) for r in got.collect()) == [(i, 200, str(i).encode()) for i in range(45)]
    sent = {p.name: len(p.read_text()) for p in log.iterdir()}
    assert sent == {str(i): 2 if i == 12 else 1 for i in range(45)} and sum(n for _, n in deals) == 46
    # A full bucket at first, then never more than what has come back since.
    for i, (start, _) in enumerate(deals):
        for end, _ in deals[i:]:
            assert sum(n for t, n in deals if start <= t <= end) <= 20 + (end - start) * 20 / 60 + 1e-6
    assert deals[1][0] - deals[0][0] >= 90  # the pause of the first wave's 429 holds for all


def test_jobs_share_a_ledger(spark, tmp_path):
    clock, got = Time(), []
    ledgers = [rate_budget.Ledger(spark, str(tmp_path / "ledger"), 30, clock) for _ in range(4)]
    threads = [threading.Thread(target=lambda b=b: got.extend(b.deal(5)[0] for _ in range(3))) for b in ledgers]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(got) == 30 and len(got) == 12
    assert ledgers[0].deal(1) == (0, 2.0)
    clock.sleep(2)
    assert ledgers[1].deal(9)[0] == 1
    ledgers[2].pause(100)
    clock.sleep(50)
    assert ledgers[3].deal(1) == (0, 50.0)


def test_a_service_that_stays_limited(spark, tmp_path):
    clock = Time()

    def make():
        class Client:
            def send(self, key):
                return 429, {}, b""

        return Client()

    with pytest.raises(RateLimitExceeded):
        rate_budget.metered(spark.createDataFrame([(1,)], "key int"), make, rate_budget.Ledger(spark, str(tmp_path / "l"), 60, clock), max_pauses=1, sleep=clock.sleep)


def test_scheduler_rows(spark, tmp_path):
    root = str(tmp_path / "lake")
    row = "key string, status string, current_step string, automatic_failure_count int, last_error_message string, last_success_input_hash string, last_attempt_started_at timestamp, locked_by string, lock_expires_at timestamp, updated_at timestamp, seq long"
    queue = spark.createDataFrame([(k, "pending", "x", 0, None, None, None, None, None, None, i) for i, k in enumerate("abc")], row).withColumn("updated_at", control.at("2026-01-01 00:00:00"))
    work = lambda rows: rows.select("key", F.when(F.col("key") == "b", "failed").otherwise("succeeded").alias("outcome"), F.lit("m").alias("message"), F.lit("h").alias("input_hash"))
    keep = lambda df: storage.stored(df, "tick")
    after, done = control.scheduled(root, "s1", "timer", queue, work, "w", "2026-01-02 00:00:00", 60, 2, keep)
    states = {r.scheduler_run_id: r for r in storage.states(spark, root, "scheduler_runs", "scheduler_run_id").collect()}
    assert (states["s1"].status, states["s1"].selected, states["s1"].completed, states["s1"].failed, states["s1"].trigger_type) == ("partial", 3, 2, 1, "timer")
    idle = queue.filter("false")
    assert control.scheduled(root, "s2", "timer", idle, work, "w", "2026-01-02 00:00:00", 60, 2, keep)[1] is None

    def broken(rows):
        raise ValueError("boom")

    with pytest.raises(ValueError):
        control.scheduled(root, "s3", "manual", queue, broken, "w", "2026-01-02 00:00:00", 60, 2, keep)
    states = {r.scheduler_run_id: r.status for r in storage.states(spark, root, "scheduler_runs", "scheduler_run_id").collect()}
    assert states == {"s1": "partial", "s3": "failed"}


def test_blobs_by_address(spark, tmp_path):
    rows = spark.createDataFrame([("raw/a.pdf", b"1"), ("raw/b/c.pdf", b"2")], "raw_path string, content binary")
    assert [r.was_new for r in storage.write_blobs(rows, f"file://{tmp_path}").collect()] == [True, True]
    assert [r.was_new for r in storage.write_blobs(rows, f"file://{tmp_path}").collect()] == [False, False]
    assert sorted(p.name for p in (tmp_path / "raw").rglob("*.pdf*")) == ["a.pdf", "c.pdf"]


def test_layout_files_of_many_documents(spark, tmp_path):
    for name, text in (("d1/b/x", "late"), ("d1/a/x", "first"), ("d2/x", "other")):
        place = tmp_path / f"{name}_content_list.json"
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(json.dumps([{"type": "text", "text": text}]))
    got = ocr.layout_blocks(spark, str(tmp_path), each=True).collect()
    assert sorted((r.document_key, r.block_index, r.text) for r in got) == [("d1", 0, "first"), ("d2", 0, "other")]


def test_dates_of_names_and_texts(spark):
    names = ["WSJ-2026-02-30.pdf", "TE_2026/1/5.pdf", "The Economist Sept 7 2025.pdf", "x January 3, 2024 y.pdf", "May 2023.pdf", "ft-3-9.pdf", "ft_2-30.pdf", "none.pdf", "a 2024-1-2 b March 5, 2020.pdf"]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "n string, i int")
    got = [r[0] for r in rows.orderBy("i").select(dates.filename_date(F.col("n"), F.lit("1767225600000"), 2020)).collect()]
    assert got == ["", "", "2025-09-07", "2024-01-03", "2023-05-01", "2026-03-09", "", "", "2024-01-02"]
    cases = [("2020-01-01", "x.pdf", "", "2020-01-01", ""), ("", "x-2026-13-01.pdf", "", "", "invalid date"), (None, "x-2-30.pdf", "on May 5, 2021 it", "2021-05-05", ""), (None, "x.pdf", "May 5 2021 but 2022-02-03", "2022-02-03", ""), (None, "x.pdf", "Feb 30, 2021", "", "invalid date"), (None, "x.pdf", None, "", "no publication date"), (None, "Jun 2021.pdf", "", "2021-06-01", "")]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, issue string, name string, body string, want string, error string")
    rows = frame.orderBy("i").select(dates.publication_date(F.col("issue"), F.col("name"), F.lit(None).cast("string"), 2026, F.col("body")).alias("d"), "want", "error").collect()
    assert [(r.d.date, r.d.error) for r in rows] == [(c[3], c[4]) for c in cases]
    sources = spark.createDataFrame([("wsj-2026-02-01.pdf", "wsj"), ("wsj-2026-02-31.pdf", "wsj-2026-02-31"), ("ft_2-29.pdf", "ft"), ("the economist USA x.pdf", "经济学人"), ("【译】TE-2026-1-3-PDF-WEB.pdf", "经济学人"), ("-2026-01-01.pdf", "-2026-01-01")], "n string, want string")
    assert all(r[0] == r.want for r in sources.select(dates.source_name(F.col("n")), "want").collect())
    stamps = spark.createDataFrame([("2026-01-02 03:04:05",), ("2026-01-02T03:04:05",), ("x",), (None,)], "t string").select(dates.stored_timestamp(F.col("t"))).collect()
    assert [r[0] is None for r in stamps] == [False, False, True, True] and stamps[0] == stamps[1]


def test_settings(spark, tmp_path):
    made = settings.load(settings.LayoutService, {"LAYOUT_API_TOKEN": " t ", "LAYOUT_ENABLE_OCR": "YES", "LAYOUT_ENABLE_TABLE": "off", "LAYOUT_POLL_TIMEOUT_SECONDS": " 7 ", "LAYOUT_MODEL_VERSION": " "})
    assert (made.token, made.ocr, made.tables, made.formulas, made.poll_timeout, made.model, made.per_minute) == ("t", True, False, True, 7, "vlm", 45)
    for kind, values in ((settings.LayoutService, {}), (settings.Engine, {"APP_ENV": "x", "STORAGE_ROOT": " "}), (settings.ChatService, {"CHAT_API_KEY": "k", "CHAT_MODEL": "m"})):
        with pytest.raises(settings.MissingSetting):
            settings.load(kind, values)
    assert settings.load(settings.ChatService, {"CHAT_API_KEY": "k", "CHAT_MODEL": "m", "CHAT_BASE_URL": "https://c.x/"}).address == "https://c.x"
    config = mail.MailConfig.load('{"allowed_link_domains": ["a.x"], "enable_body_links": false, "label_ids": ["L"], "download_link_keywords": ["get"]}')
    assert (config.allowed_domains, config.body_links, config.label_ids, config.link_words, config.max_results) == (("a.x",), False, ("L",), ("get",), 25)
    page = spark.createDataFrame([("https://e.x/p", "<a href='https://e.x/1'>PDF</a><a href='https://e.x/2'>GET it</a>")], "url string, html string")
    assert page.select(mail.resolve(F.col("url"), F.lit(""), F.lit(""), F.col("html"), ("get",))).first()[0] == "https://e.x/2"


def test_health(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert storage.inspect(spark, root)["status"] == "error"
    said = settings.health(spark, {"APP_ENV": "test", "STORAGE_ROOT": root}, "web")
    assert (said["status"], said["service"], said["environment"], said["tables"]["pending"]) == ("ok", "web", "test", [])
