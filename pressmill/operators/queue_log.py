"""The processing queue as an append-only log of events, folded to its state.

Events are written as files of their own and take effect in the order of commits: a
commit is one small file, which only one writer can create under its number
(``storage.claim``), naming the files it adds.  An event tells how many events of its
key its writer had seen (``expected``); the fold takes it only if that is so, so of
writers that saw one state the first wins, and the others find their events refused.
Nothing is rewritten: a claim adds a row a key, whatever the queue's size.

The fold is one aggregation by key: its events sorted by commit, and a state carried
through them by built-in functions.  ``compact`` stores the state after a commit, and
later folds start from there, so what is sorted for a key is what came since.

States have the columns of ``control`` and ``version``, the number of events taken.
Nulls: an event without ``expected`` is always taken, unless its own rule forbids it
(a claim of a row that isn't free).  An unknown event changes nothing but the version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage
from . import control

EVENT = storage.ddl("queue_events")
STATE = "version long, status string, current_step string, automatic_failure_count int, last_error_message string, last_success_input_hash string, last_attempt_started_at timestamp, locked_by string, lock_expires_at timestamp, updated_at timestamp, article_id string"


def _next(s: Column, e: Column, first_step: str, limit: int) -> Column:
    """The state after an event that is taken."""
    kind, none = e["event"], lambda t: F.lit(None).cast(t)
    new, asked = s["status"].isNull(), F.coalesce(s["status"] == "manual_retry_requested", F.lit(False))
    same = F.coalesce(s["last_success_input_hash"] == e["input_hash"], F.lit(False))
    came, claimed, retry = kind == "enqueued", kind == "claimed", kind == "retry_requested"
    done, restart = came & ~new & ~asked & same, came & (new | (~asked & ~same))
    good, limited, lost = kind == "succeeded", kind == "rate_limited", kind.isin("failed", "stale")
    over, known = good | limited | lost, came | claimed | retry | good | limited | lost
    count = F.coalesce(s["automatic_failure_count"], F.lit(0)) + F.when(lost, 1).otherwise(0)
    frees = restart | done | over | retry
    put = lambda c, *cases: _cases(cases, s[c]).alias(c)
    return F.struct(
        (s["version"] + 1).alias("version"),
        put("status", (restart, F.lit("pending")), (done | good, F.lit("succeeded")), (claimed & asked, F.lit("running_manual_retry")), (claimed, F.lit("running")), (retry, F.lit("manual_retry_requested")), (limited | (lost & (count < limit)), F.lit("failed_retryable")), (lost, F.lit("failed_terminal"))),
        put("current_step", (restart, F.lit(first_step)), (good, F.lit("completed")), (e["step"].isNotNull(), e["step"])),
        put("automatic_failure_count", (restart, F.lit(0)), (lost, count)),
        put("last_error_message", (restart | good, none("string")), (kind == "stale", F.lit(control.STALE)), (over, e["message"])),
        put("last_success_input_hash", (good, e["input_hash"])),
        put("last_attempt_started_at", (restart, none("timestamp")), (claimed, e["at"])),
        put("locked_by", (frees, none("string")), (claimed, e["writer"])),
        put("lock_expires_at", (frees, none("timestamp")), (claimed, e["at"] + F.make_interval(secs=e["lease_seconds"]))),
        put("updated_at", (known, e["at"])),
        put("article_id", (came & e["article_id"].isNotNull(), e["article_id"])),
    )


def _cases(cases: tuple, otherwise: Column) -> Column:
    found = F.when(*cases[0])
    for when, value in cases[1:]:
        found = found.when(when, value)
    return found.otherwise(otherwise)


def _taken(s: Column, e: Column) -> Column:
    """Has the writer seen this state, and may the event come upon it?"""
    free = s["locked_by"].isNull() | (s["lock_expires_at"] <= e["at"])
    fits = F.when(e["event"] == "claimed", F.coalesce(s["status"].isin(*control.CLAIMABLE) & free, F.lit(False))).when(e["event"] == "enqueued", F.lit(True)).otherwise(s["status"].isNotNull())
    return fits & (e["expected"].isNull() | (e["expected"] == s["version"]))


def folded(events: DataFrame, base: DataFrame | None = None, first_step: str = control.FIRST_STEP, limit: int = control.FAILURE_LIMIT) -> DataFrame:
    """(key, state columns, commits): every key's state after its events, in order of
    commit; ``commits`` are those whose event of the key was taken since ``base``."""
    fields = [x.split()[0] for x in EVENT.split(", ") if x.split()[0] != "key"]
    listed = events.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("commit", *[f for f in fields if f != "commit"]))).alias("events"))
    empty = F.from_json(F.lit('{"version": 0}'), STATE)
    if base is None:
        rows = listed.withColumn("base", empty)
    else:
        rows = base.select("key", F.struct(*[F.col(n).cast(t).alias(n) for n, t in (x.split() for x in STATE.split(", "))]).alias("base")).join(listed, "key", "full_outer")
        rows = rows.select("key", F.coalesce("base", empty).alias("base"), F.coalesce("events", F.from_json(F.lit("[]"), listed.schema["events"].dataType)).alias("events"))
    start = F.struct(F.col("base").alias("s"), F.array().cast("array<long>").alias("commits"))

    def step(acc: Column, e: Column) -> Column:
        after = F.struct(_next(acc["s"], e, first_step, limit).cast(f"struct<{', '.join(x.replace(' ', ': ', 1) for x in STATE.split(', '))}>").alias("s"), F.concat(acc["commits"], F.array(e["commit"])).alias("commits"))
        return F.when(_taken(acc["s"], e), after).otherwise(acc)

    done = rows.select("key", F.aggregate("events", start, step).alias("x"))
    return done.select("key", "x.s.*", "x.commits").filter("status is not null")


def append(events: DataFrame, root: str) -> int:
    """Write events and commit them; gives the commit's number.  What a writer that
    dies has written is never named by a commit, and so never seen."""
    spark, part = events.sparkSession, uuid.uuid4().hex
    storage.conformed(events, "queue_events").drop("commit").write.parquet(f"{root}/events/part={part}")
    number = _last(spark, root) + 1
    while not storage.claim(spark, f"{root}/commits/{number:012d}", part):
        number += 1
    return number


def _last(spark: SparkSession, root: str) -> int:
    return max((int(n) for n in storage.names_in(spark, f"{root}/commits") if n.isdigit()), default=0)


def events(spark: SparkSession, root: str, after: int = 0, upto: int | None = None) -> DataFrame:
    """Committed events with their commits' numbers."""
    last = _last(spark, root)
    if last <= after:
        return spark.createDataFrame([], EVENT)
    named = spark.read.text(f"{root}/commits", wholetext=True, pathGlobFilter="[0-9]*[0-9]").select(F.regexp_extract(F.input_file_name(), r"(\d+)$", 1).cast("long").alias("commit"), F.col("value").alias("part"))
    fields = [x for x in EVENT.split(", ") if x != "commit long"]
    rows = spark.read.schema(", ".join([*fields, "part string"])).parquet(f"{root}/events")
    wanted = named.filter((F.col("commit") > after) & (F.col("commit") <= (upto or last)))  # later ones may come while this is read
    return rows.join(wanted, "part").select(*[x.split()[0] for x in EVENT.split(", ")])


def _snapshot(spark: SparkSession, root: str) -> tuple[int, DataFrame | None]:
    found = [n for n in storage.names_in(spark, f"{root}/snapshots") if n.endswith(".done")]
    if not found:
        return 0, None
    number = int(found[-1].removesuffix(".done"))
    return number, spark.read.parquet(f"{root}/snapshots/state={number:012d}")


def state(spark: SparkSession, root: str, first_step: str = control.FIRST_STEP, limit: int = control.FAILURE_LIMIT) -> DataFrame:
    """The queue now."""
    number, base = _snapshot(spark, root)
    return folded(events(spark, root, number), base, first_step, limit)


def compact(spark: SparkSession, root: str) -> int:
    """Store the state after the last commit; folds start from it."""
    number, base = _snapshot(spark, root)
    last = _last(spark, root)
    if last > number:
        folded(events(spark, root, number, last), base).drop("commits").write.mode("overwrite").parquet(f"{root}/snapshots/state={last:012d}")
        storage.claim(spark, f"{root}/snapshots/{last:012d}.done")
    return last


def claim_next(spark: SparkSession, root: str, worker: str, now: str, lease: int, limit: int) -> DataFrame:
    """The rows that ``worker`` got: up to ``limit`` in queue order, less those that
    another had taken in the meantime."""
    free = control.eligible(state(spark, root), now).withColumn("seq", F.lit(0)).orderBy(*control.queue_order()).limit(limit)
    asked = free.select("key", F.col("version").alias("expected"), F.lit("claimed").alias("event"), F.lit(worker).alias("writer"), control.at(now).alias("at"), F.lit(lease).cast("long").alias("lease_seconds"))
    commit = append(asked, root)
    return state(spark, root).filter(F.array_contains("commits", F.lit(commit).cast("long")))


def settle(spark: SparkSession, root: str, claimed: DataFrame, outcomes: DataFrame, worker: str, now: str) -> DataFrame:
    """Rows whose outcome was taken; one that lost its lease to another is refused.

    ``outcomes``: (key, outcome, message, input_hash)."""
    told = outcomes.join(claimed.select("key", F.col("version").alias("expected")), "key").select("key", "expected", F.col("outcome").alias("event"), F.lit(worker).alias("writer"), control.at(now).alias("at"), "message", "input_hash")
    commit = append(told, root)
    return state(spark, root).filter(F.array_contains("commits", F.lit(commit).cast("long")))


def stale(spark: SparkSession, root: str, now: str, after: int) -> DataFrame:
    """Events for rows that run since ``after`` seconds or longer, for ``append``."""
    old = state(spark, root).filter(control.is_stale(now, after))
    return old.select("key", F.col("version").alias("expected"), F.lit("stale").alias("event"), F.lit("recovery").alias("writer"), control.at(now).alias("at"))
