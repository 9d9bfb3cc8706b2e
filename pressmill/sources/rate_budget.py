"""A rate that many tasks and jobs keep together: a ledger of permits.

Tokens come back at ``per_minute``, up to as many as one minute gives.  A job asks for
permits before each wave of requests and deals them to its tasks, so that tasks need no
word with each other: no task sends what it was not dealt.  Every deal is an entry of a
ledger in the shared folder, under a number that one writer only can create
(``storage.claim``), so jobs that share it keep one rate; a lost executor's requests
count as sent.  An answer of 429 pauses all of them.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .throttle import RateLimitExceeded, retry_after_seconds


class Ledger:
    def __init__(self, spark: SparkSession, root: str, per_minute: int, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.per_minute, self.clock = spark, root, per_minute, clock

    def _last(self) -> tuple[int, dict]:
        number = max((int(n) for n in storage.names_in(self.spark, self.root) if n.isdigit()), default=0)
        if not number:
            return 0, {"at": self.clock(), "room": float(self.per_minute), "until": 0.0}
        return number, json.loads(storage.content(self.spark, f"{self.root}/{number}"))

    def _enter(self, change: Callable[[dict, float], tuple[dict | None, object]]):
        """Add an entry made from the last one; again if another was faster."""
        while True:
            number, last = self._last()
            now = max(self.clock(), last["at"])
            room = min(float(self.per_minute), last["room"] + (now - last["at"]) * self.per_minute / 60)
            entry, answer = change({"at": now, "room": room, "until": last["until"]}, now)
            if entry is None or storage.claim(self.spark, f"{self.root}/{number + 1}", json.dumps(entry)):
                return answer

    def deal(self, wanted: int) -> tuple[int, float]:
        """(permits, seconds to wait before there may be any if there are none)."""

        def change(state: dict, now: float):
            if state["until"] > now:
                return None, (0, state["until"] - now)
            n = min(wanted, int(state["room"] + 1e-9))
            if n < 1:
                return None, (0, (1 - state["room"]) * 60 / self.per_minute)
            return state | {"room": state["room"] - n}, (n, 0.0)

        return self._enter(change)

    def pause(self, seconds: float) -> None:
        """Nobody gets a permit for so long from now on."""
        self._enter(lambda state, now: (state | {"until": max(state["until"], now + seconds)}, None))


def metered(rows: DataFrame, make: Callable, ledger: Ledger, tasks: int = 4, max_pauses: int = 3, default_wait: float = 60, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, status, body) of a request for every key, at the ledger's rate.

    ``make()`` gives, in a task, a client with ``send(key) -> (status, headers, body)``.
    Keys go in order, as many a wave as there are permits; those answered 429 go again
    after the pause.  RateLimitExceeded after more than ``max_pauses`` pauses in a row."""
    spark = rows.sparkSession

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for batch in batches:
            said = [client.send(k) for k in batch["key"]]
            waits = [retry_after_seconds(h.get("Retry-After"), default_wait) if s == 429 else None for s, h, _ in said]
            yield pd.DataFrame({"key": batch["key"], "status": [s for s, _, _ in said], "wait": waits, "body": [None if s == 429 else b for s, _, b in said]})

    kind = dict(rows.dtypes)["key"]
    left, done, pauses = storage.stored(rows.select("key"), "metered"), [], 0
    count = left.count()
    while count:
        permits, wait = ledger.deal(count)
        if not permits:
            sleep(wait)
            continue
        wave = storage.stored(left.orderBy("key").limit(permits), "metered-wave")  # what is dealt is fixed before it is sent
        answers = storage.stored(wave.repartition(tasks).mapInPandas(send, f"key {kind}, status int, wait double, body binary"), "metered-answers")
        limited = answers.agg(F.count_if(F.col("status") == 429).alias("n"), F.max("wait").alias("wait")).first()
        good = answers.filter("status != 429").select("key", "status", "body")
        done.append(good)
        pauses = pauses + 1 if limited["n"] else 0
        if pauses > max_pauses:
            raise RateLimitExceeded("still limited after every pause")
        if limited["n"]:
            ledger.pause(limited["wait"])
        before, left = left, storage.stored(left.join(good.select("key"), "key", "left_anti"), "metered")
        storage.discard(before)
        count = left.count()
    out = spark.createDataFrame([], f"key {kind}, status int, body binary")
    for part in done:
        out = out.unionByName(part)
    return out
