"""The queue as events: the fold against the snapshot functions, writers that compete."""

import datetime
import random
import threading

import pytest
from pyspark.sql import functions as F

from pressmill.operators import control, queue_log
from pressmill.sources import storage

T0 = datetime.datetime(2026, 5, 6, 10)


def at(n):
    return str(T0 + datetime.timedelta(seconds=n))


def event(key, what, n, **more):
    return {"key": key, "event": what, "at": T0 + datetime.timedelta(seconds=n)} | more


def rows(spark, found):
    return spark.createDataFrame(found, queue_log.EVENT)


COLUMNS = ["key", "status", "current_step", "automatic_failure_count", "last_error_message", "last_success_input_hash", "last_attempt_started_at", "locked_by", "lock_expires_at", "updated_at"]
QUEUE = "key string, article_id string, status string, current_step string, automatic_failure_count int, last_error_message string, last_success_input_hash string, last_attempt_started_at timestamp, locked_by string, lock_expires_at timestamp, updated_at timestamp, seq long"


def test_fold_equals_the_snapshots(spark):
    rng, keys = random.Random(3), [f"k{i}" for i in range(12)]
    queue, log, now = spark.createDataFrame([], QUEUE), [], 0
    for commit in range(1, 26):
        now += rng.choice([5, 40, 400])
        some = rng.sample(keys, rng.randint(1, 5))
        held = {r.key: r for r in queue.collect()}
        what, some = ("enqueued", keys) if commit == 1 else (rng.choice(["enqueued", "claimed", "succeeded", "failed", "rate_limited", "stale", "retry_requested"]), some)
        if what == "enqueued":
            arrivals = [(k, rng.choice("ab"), f"art-{k}-{commit}") for k in some]
            queue = control.enqueue(queue, spark.createDataFrame(arrivals, "key string, input_hash string, article_id string"), at(now))
            log += [event(k, what, now, input_hash=h, article_id=a, commit=commit) for k, h, a in arrivals]
        elif what == "claimed":
            after = control.claim(queue, "w", at(now), 60, 3)
            log += [event(k.key, what, now, writer="w", lease_seconds=60, commit=commit) for k in after.filter(F.col("updated_at") == control.at(at(now))).collect()]
            queue = after
        elif what == "retry_requested":
            queue = control.request_retry(queue, at(now), keys=some)
            log += [event(k, what, now, commit=commit) for k in some]
        elif what == "stale":
            old = [k for k, r in held.items() if r.status in ("running", "running_manual_retry") and (T0 + datetime.timedelta(seconds=now - 100)) >= r.last_attempt_started_at]
            queue = control.recover_stale(queue, at(now), 100)
            log += [event(k, what, now, commit=commit) for k in old]
        else:
            mine = [k for k in some if k in held]
            outcomes = [(k, what, f"said {commit}", "a") for k in mine]
            queue = control.settle(queue, spark.createDataFrame(outcomes, "key string, outcome string, message string, input_hash string"), at(now))
            log += [event(k, what, now, message=f"said {commit}", input_hash="a", commit=commit) for k in mine]
        queue = storage.stored(queue, "snapshot")
    want = sorted(map(repr, map(tuple, queue.select(*COLUMNS).collect())))
    folded = queue_log.folded(rows(spark, log).repartition(3))
    assert sorted(map(repr, map(tuple, folded.select(*COLUMNS).collect()))) == want and len(want) > 8
    assert len({r.status for r in queue.collect()}) > 2
    # Half of the events upon a stored state give the same.
    early = queue_log.folded(rows(spark, [e for e in log if e["commit"] <= 12])).drop("commits")
    late = queue_log.folded(rows(spark, [e for e in log if e["commit"] > 12]), early)
    assert sorted(map(repr, map(tuple, late.select(*COLUMNS).collect()))) == want
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_of_two_that_saw_one_state_the_first_wins(spark):
    log = [event("k", "enqueued", 0, input_hash="h", commit=1)]
    log += [event("k", "claimed", 5, writer=w, lease_seconds=60, expected=1, commit=c) for c, w in ((2, "a"), (3, "b"))]
    log += [event("k", "succeeded", 9, input_hash="h", expected=1, writer="b", commit=4), event("j", "claimed", 1, writer="a", commit=5), event("j", "failed", 1, commit=6)]
    got = {r.key: r for r in queue_log.folded(rows(spark, log)).collect()}
    assert set(got) == {"k"} and (got["k"].locked_by, got["k"].version, got["k"].commits, got["k"].status) == ("a", 2, [1, 2], "running")
    # Without an expectation a claim still needs a free row.
    log = log[:2] + [event("k", "claimed", 20, writer="c", lease_seconds=60, commit=7), event("k", "claimed", 70, writer="d", lease_seconds=60, commit=8)]
    assert queue_log.folded(rows(spark, log)).first().locked_by == "a"  # running rows aren't claimable, expired or not


def test_workers_share_a_queue(spark, tmp_path):
    root = str(tmp_path / "queue")
    queue_log.append(rows(spark, [event(f"k{i}", "enqueued", i, input_hash="h") for i in range(7)]), root)
    got, failed = {}, []

    def work(name):
        try:
            got[name] = sorted(r.key for r in queue_log.claim_next(spark, root, name, at(100), 600, 3).collect())
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and not set(got["a"]) & set(got["b"]) and {"k0", "k1", "k2"} <= {*got["a"], *got["b"]}
    last = queue_log.claim_next(spark, root, "c", at(101), 600, 10)
    mine = storage.stored(last, "claimed")
    every = sorted([*got["a"], *got["b"], *(r.key for r in mine.collect())])
    assert every == [f"k{i}" for i in range(7)]
    # The lease of c is taken from it; its outcome comes too late.
    queue_log.append(queue_log.stale(spark, root, at(5000), 600), root)
    assert queue_log.compact(spark, root) == queue_log.compact(spark, root)
    outcomes = mine.select("key", F.lit("succeeded").alias("outcome"), F.lit(None).cast("string").alias("message"), F.lit("h").alias("input_hash"))
    assert queue_log.settle(spark, root, mine, outcomes, "c", at(5001)).count() == 0
    assert {(r.status, r.automatic_failure_count, r.last_error_message) for r in queue_log.state(spark, root).collect()} == {("failed_retryable", 1, control.STALE)}
    again = storage.stored(queue_log.claim_next(spark, root, "d", at(5002), 600, 2), "claimed")
    done = queue_log.settle(spark, root, again, outcomes.limit(0).unionByName(again.select("key", F.lit("succeeded").alias("outcome"), F.lit(None).cast("string").alias("message"), F.lit("h").alias("input_hash"))), "d", at(5003))
    assert {(r.status, r.current_step, r.last_success_input_hash) for r in done.collect()} == {("succeeded", "completed", "h")} and done.count() == 2


def test_files_without_a_commit_are_not_seen(spark, tmp_path):
    root = str(tmp_path / "queue")
    assert queue_log.state(spark, root).count() == 0 and queue_log.compact(spark, root) == 0
    queue_log.append(rows(spark, [event("k", "enqueued", 0)]), root)
    storage.conformed(rows(spark, [event("lost", "enqueued", 0)]), "queue_events").drop("commit").write.parquet(f"{root}/events/part=dead")
    assert [r.key for r in queue_log.state(spark, root).collect()] == ["k"]


def test_leases_expire_by_timers(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    from pressmill.streaming import imports

    source = tmp_path / "events"
    source.mkdir()
    batches = [
        [("a", "start", 0), ("b", "start", 0), ("c", "start", 0), ("e", "renew", 0)],
        [("b", "renew", 50), ("c", "end", 55), ("x", "end", 58)],
        [("x", "end", 80)],  # the watermark passes 60: a is stale
        [("a", "end", 30), ("x", "end", 125)],  # too late for a; b is stale at 110
        [("a", "start", 126), ("x", "end", 300)],
        [("x", "end", 301)],
    ]
    for i, rows_ in enumerate(batches):
        (source / f"{i}.csv").write_text("".join(f"{k},{e},{T0 + datetime.timedelta(seconds=n)}\n" for k, e, n in rows_))
        import os

        os.utime(source / f"{i}.csv", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema("key string, event string, at timestamp").option("maxFilesPerTrigger", 1).csv(str(source))
    query = imports.lease_watch(stream, 60_000).writeStream.format("memory").queryName("stale_leases").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(240) and query.exception() is None
    got = sorted((r.key, r.event, int((r.at - T0).total_seconds())) for r in spark.table("stale_leases").collect())
    assert got == [("a", "stale", 60), ("a", "stale", 186), ("b", "stale", 110)]
