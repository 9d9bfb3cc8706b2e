"""The control plane as state tables: each step maps a snapshot to the next.

Rows: (key, [article_id,] status, current_step, automatic_failure_count, last_error_message,
last_success_input_hash, last_attempt_started_at, locked_by, lock_expires_at, updated_at, seq).
A snapshot has one writer; clocks are parameters.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILURE_LIMIT = 2
CLAIMABLE = ("pending", "failed_retryable", "manual_retry_requested")
FAILED = ("failed_retryable", "failed_terminal")
FIRST_STEP = "await_ad_judgment"
STALE = "processing lease expired"


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def plus_seconds(now: str, n: int) -> Column:
    return at(now) + F.make_interval(secs=F.lit(n))


def enqueue(queue: DataFrame, arrivals: DataFrame, now: str) -> DataFrame:
    """New keys become pending; a requested retry stays, the same input is succeeded
    and keeps its step, any other change starts over.  Keys that arrive are touched.

    ``arrivals``: (key, input_hash), with an article_id where the queue has one,
    which every arrival hands on."""
    known = queue.columns
    new = arrivals.select(F.col("key").alias("new_key"), "input_hash", *([F.col("article_id").alias("new_article")] if "article_id" in known else []))
    met = queue.join(new, queue.key == new.new_key, "full_outer")
    came = F.col("new_key").isNotNull()
    asked = F.coalesce(F.col("status") == "manual_retry_requested", F.lit(False))
    same = F.coalesce(F.col("last_success_input_hash") == F.col("input_hash"), F.lit(False))
    done, restart = came & ~asked & same, came & ~asked & ~same
    pick = lambda c, fresh, when=restart: F.when(when, fresh).otherwise(F.col(c)).alias(c)
    none = lambda kind: F.lit(None).cast(kind)
    fresh = {
        "key": F.coalesce("key", "new_key").alias("key"),
        "status": F.when(restart, "pending").when(done, "succeeded").otherwise(F.col("status")).alias("status"),
        "current_step": pick("current_step", F.lit(FIRST_STEP)), "automatic_failure_count": pick("automatic_failure_count", F.lit(0)),
        "last_error_message": pick("last_error_message", none("string")), "last_attempt_started_at": pick("last_attempt_started_at", none("timestamp")),
        "locked_by": pick("locked_by", none("string"), restart | done), "lock_expires_at": pick("lock_expires_at", none("timestamp"), restart | done),
        "updated_at": pick("updated_at", at(now), came), "seq": F.coalesce("seq", F.lit(0).cast("long")).alias("seq"),
    }
    if "article_id" in known:
        fresh["article_id"] = pick("article_id", F.col("new_article"), came)
    return met.select(*[fresh.get(c, F.col(c)) for c in known])


def enqueue_once(queue: DataFrame, arrivals: DataFrame, now: str, first_step: str = "parse_persist") -> DataFrame:
    """A queue that ignores keys it knows: new ones become pending."""
    new = arrivals.select("key").distinct().join(queue.select("key"), "key", "left_anti")
    return queue.unionByName(new.select("key", F.lit("pending").alias("status"), F.lit(first_step).alias("current_step"), F.lit(0).alias("automatic_failure_count"), at(now).alias("updated_at"), F.lit(0).cast("long").alias("seq")), allowMissingColumns=True)


def free(now: str) -> Column:
    return F.col("locked_by").isNull() | (F.col("lock_expires_at") <= at(now))


def eligible(queue: DataFrame, now: str) -> DataFrame:
    return queue.filter(F.col("status").isin(*CLAIMABLE) & free(now))


def queue_order() -> list[Column]:
    rank = F.when(F.col("status") == "manual_retry_requested", 0).when(F.col("status") == "pending", 1).otherwise(2)
    return [rank, F.col("updated_at"), F.col("seq"), F.col("key")]


def claim(queue: DataFrame, worker: str, now: str, lease: int, limit: int, manual_running: bool = True) -> DataFrame:
    """The snapshot after ``worker`` takes up to ``limit`` rows: one ordered top-n."""
    taken = eligible(queue, now).orderBy(*queue_order()).limit(limit).select(F.col("key").alias("taken"))
    rows = queue.join(F.broadcast(taken), F.col("key") == F.col("taken"), "left")  # at most ``limit`` keys
    mine = F.col("taken").isNotNull()
    running = F.when((F.col("status") == "manual_retry_requested") & F.lit(manual_running), "running_manual_retry").otherwise("running")
    put = lambda c, value: F.when(mine, value).otherwise(F.col(c))
    return rows.withColumns({"locked_by": put("locked_by", F.lit(worker)), "lock_expires_at": put("lock_expires_at", plus_seconds(now, lease)), "last_attempt_started_at": put("last_attempt_started_at", at(now)), "updated_at": put("updated_at", at(now)), "status": put("status", running)}).drop("taken")


def settle(queue: DataFrame, outcomes: DataFrame, now: str, limit: int = FAILURE_LIMIT) -> DataFrame:
    """Apply outcomes (key, outcome, message, input_hash): succeeded, failed, or
    rate_limited, which retries without counting.  Leases end."""
    o = outcomes.select(F.col("key").alias("okey"), "outcome", "message", "input_hash")
    rows = queue.join(o, queue.key == o.okey, "left")
    count = F.col("automatic_failure_count") + F.when(F.col("outcome") == "failed", 1).otherwise(0)
    status = F.when(F.col("outcome") == "succeeded", "succeeded").when(F.col("outcome") == "rate_limited", "failed_retryable").when((F.col("outcome") == "failed") & (count >= limit), "failed_terminal").when(F.col("outcome") == "failed", "failed_retryable").otherwise(F.col("status"))
    hit = F.col("okey").isNotNull()
    extra = ["article_id"] if "article_id" in queue.columns else []
    return rows.select(
        "key", *extra, status.alias("status"), F.when(F.col("outcome") == "succeeded", "completed").otherwise(F.col("current_step")).alias("current_step"), count.alias("automatic_failure_count"),
        F.when(F.col("outcome") == "succeeded", F.lit(None)).when(hit, F.col("message")).otherwise(F.col("last_error_message")).alias("last_error_message"),
        F.when(F.col("outcome") == "succeeded", F.col("input_hash")).otherwise(F.col("last_success_input_hash")).alias("last_success_input_hash"), "last_attempt_started_at",
        F.when(~hit, F.col("locked_by")).alias("locked_by"), F.when(~hit, F.col("lock_expires_at")).alias("lock_expires_at"), F.when(hit, at(now)).otherwise(F.col("updated_at")).alias("updated_at"), "seq",
    )


def is_stale(now: str, after: int) -> Column:
    return F.col("status").isin("running", "running_manual_retry") & (F.col("last_attempt_started_at") <= plus_seconds(now, -after))


def recover_stale(queue: DataFrame, now: str, after: int, limit: int = FAILURE_LIMIT) -> DataFrame:
    """Rows running since ``after`` seconds or longer fail, with a fixed message."""
    old = queue.filter(is_stale(now, after))
    return settle(queue, old.select("key", F.lit("failed").alias("outcome"), F.lit(STALE).alias("message"), F.lit(None).cast("string").alias("input_hash")), now, limit)


def request_retry(queue: DataFrame, now: str, keys: list[str] | None = None, condition: Column | None = None) -> DataFrame:
    """One key, whatever its status; or all failed rows under a condition."""
    mine = F.coalesce(F.col("key").isin(*keys) if keys is not None else F.col("status").isin(*FAILED) & (condition if condition is not None else F.lit(True)), F.lit(False))
    put = lambda c, value: F.when(mine, value).otherwise(F.col(c))
    return queue.withColumns({"status": put("status", F.lit("manual_retry_requested")), "updated_at": put("updated_at", at(now)), "locked_by": F.when(~mine, F.col("locked_by")), "lock_expires_at": F.when(~mine, F.col("lock_expires_at"))})


def retry_summary(queue: DataFrame, condition: Column) -> DataFrame:
    """What a retry of all rows under a condition finds: matched, updated, skipped."""
    failed = F.count_if(F.col("status").isin(*FAILED))
    return queue.filter(condition).agg(F.count("*").alias("matched"), failed.alias("updated"), (F.count("*") - failed).alias("skipped"))


def drain_result(outcomes: DataFrame) -> DataFrame:
    """A wave's counts and status: succeeded, partial, or failed if nothing succeeded."""
    good, bad = F.count_if(F.col("outcome") == "succeeded"), F.count_if(F.col("outcome") != "succeeded")
    counts = outcomes.agg(good.alias("succeeded"), bad.alias("failed"))
    return counts.withColumn("status", F.when(F.col("failed") == 0, "succeeded").when(F.col("succeeded") == 0, "failed").otherwise("partial"))


def drain(queue: DataFrame, work, worker: str, now: str, lease: int, slots: int, stored) -> tuple[DataFrame, int]:
    """Waves of up to ``slots`` rows until nothing is eligible; ``work`` maps
    claimed rows to outcomes.  Each snapshot is written by ``stored``."""
    waves, tried = 0, None
    while True:
        left = eligible(queue, now) if tried is None else eligible(queue, now).join(tried, "key", "left_anti")
        if left.isEmpty():
            return queue, waves
        keys = left.orderBy(*queue_order()).limit(slots).select("key")
        keys = stored(keys)
        claimed = stored(claim(queue.join(keys, "key", "left_semi"), worker, now, lease, slots).unionByName(queue.join(keys, "key", "left_anti")))
        queue = stored(settle(claimed, work(claimed.join(keys, "key", "left_semi")), now))
        tried = keys if tried is None else tried.unionByName(keys)
        waves += 1


def tick(queue: DataFrame, work, worker: str, now: str, lease: int, slots: int, stored) -> tuple[DataFrame, dict | None]:
    """One round of a scheduler: (queue, result); no work, no run and no result."""
    if eligible(queue, now).isEmpty():
        return queue, None
    seen: list[DataFrame] = []

    def watched(rows: DataFrame) -> DataFrame:
        seen.append(stored(work(rows)))
        return seen[-1]

    queue, waves = drain(queue, watched, worker, now, lease, slots, stored)
    row = drain_result(reduce(DataFrame.unionByName, seen)).first()
    return queue, {"waves": waves, "selected": row["succeeded"] + row["failed"], "completed": row["succeeded"], "failed": row["failed"], "status": row["status"]}


def scheduled(root: str, run_id: str, trigger: str, queue: DataFrame, work, worker: str, now: str, lease: int, slots: int, stored) -> tuple[DataFrame, dict | None]:
    """A tick with its row in ``scheduler_runs``: running while it works, then its counts
    and status; failed, with the error passed on, if it breaks.  No work, no row."""
    from ..sources import storage

    spark = queue.sparkSession
    if eligible(queue, now).isEmpty():
        return queue, None
    when = datetime.datetime.fromisoformat(now)
    storage.opened(spark, root, "scheduler_runs", scheduler_run_id=run_id, trigger_type=trigger, started_at=when)
    try:
        queue, done = tick(queue, work, worker, now, lease, slots, stored)
    except Exception:
        storage.closed(spark, root, "scheduler_runs", "scheduler_run_id", scheduler_run_id=run_id, status="failed", finished_at=when)
        raise
    storage.closed(spark, root, "scheduler_runs", "scheduler_run_id", scheduler_run_id=run_id, finished_at=when, **{k: done[k] for k in ("status", "selected", "completed", "failed")})
    return queue, done


class FatalError(RuntimeError):
    """What a worker loop must not go on after."""


def worker_loop(step, clock, sleep, run_import=None, import_interval: int = 7200, active: int = 10, idle: int = 60, rounds: int | None = None, retryable: tuple = (ConnectionError, TimeoutError, OSError)) -> int:
    """Run ``step`` (true if it did work) again and again; the number of rounds.

    Imports run when their interval is over.  Errors of a passing kind wait by
    ``backoff_seconds`` of how many came in a row; others end the loop."""
    done, errors, imported = 0, 0, None
    while rounds is None or done < rounds:
        done += 1
        try:
            if run_import is not None and (imported is None or clock() - imported >= import_interval):
                imported = clock()
                run_import()
            wait = active if step() else idle
            errors = 0
        except retryable:
            errors += 1
            wait = backoff_seconds(errors)
        except Exception as e:
            raise FatalError(str(e)) from e
        if rounds is None or done < rounds:
            sleep(wait)
    return done


def failed_messages(items: DataFrame) -> DataFrame:
    """(message_id, state): messages with a failed item are pending, others resolved."""
    return items.groupBy("message_id").agg(F.bool_or(F.col("status") == "failed").alias("bad")).select("message_id", F.when(F.col("bad"), "pending").otherwise("resolved").alias("state"))


def retry_messages(pending: DataFrame, results: DataFrame) -> DataFrame:
    """Each pending message is tried once: resolved, or failed for good.

    ``pending``: (message_id, retry_attempt_count); ``results``: (message_id, ok)."""
    due = pending.filter("retry_attempt_count < 1").join(results, "message_id", "left")
    return due.select("message_id", (F.col("retry_attempt_count") + 1).alias("retry_attempt_count"), F.when(F.coalesce("ok", F.lit(False)), "resolved").otherwise("failed_final").alias("retry_state"))


def is_due(last: Column, now: str, interval: int) -> Column:
    return last.isNull() | (F.timestamp_diff("SECOND", last, at(now)) >= interval)


def backoff_seconds(attempt: int) -> int:
    return (5, 15, 60)[min(max(attempt, 1), 3) - 1]


def run_steps(rows: DataFrame, steps: list, key_type: str = "string") -> DataFrame:
    """Outcomes (key, outcome, message, input_hash, failed_step) of claimed rows: each
    row goes through the named steps in order until one raises.

    ``steps``: (name, make) with ``make() -> function of the key``, made once a task;
    an error whose ``rate_limited`` attribute is true asks for a retry without count."""
    import pandas as pd

    def run(batches):
        made = [(name, make()) for name, make in steps]
        for batch in batches:
            out = []
            for key in batch["key"]:
                state = (key, "succeeded", None, None, None)
                for name, step in made:
                    try:
                        step(key)
                    except Exception as e:
                        state = (key, "rate_limited" if getattr(e, "rate_limited", False) else "failed", str(e), None, name)
                        break
                out.append(state)
            yield pd.DataFrame(out, columns=["key", "outcome", "message", "input_hash", "failed_step"])

    return rows.select("key").mapInPandas(run, f"key {key_type}, outcome string, message string, input_hash string, failed_step string")
