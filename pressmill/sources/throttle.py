"""A token bucket with a common pause, for one driver-side caller."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


class RateLimitExceeded(RuntimeError):
    """More pauses than allowed."""


def retry_after_seconds(header: str | None, default: float) -> float:
    try:
        return max(float(int(header)), default) if header is not None else default
    except ValueError:
        return default


class Throttle:
    """``per_minute`` permits; a 429 pauses every caller, at most ``max_pauses`` times a call."""

    def __init__(self, per_minute: int, max_pauses: int = 3, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.room, self.max_pauses, self.clock, self.sleep = per_minute / 60, float(per_minute), max_pauses, clock, sleep
        self.full, self.since, self.paused_until, self.lock = float(per_minute), clock(), 0.0, threading.Lock()

    def acquire(self) -> None:
        while True:
            with self.lock:
                now = self.clock()
                self.room, self.since = min(self.full, self.room + (now - self.since) * self.rate), now
                wait = max(self.paused_until - now, (1 - self.room) / self.rate if self.room < 1 else 0.0)
                if wait <= 0:
                    self.room -= 1
                    return
            self.sleep(wait)

    def pause(self, seconds: float) -> None:
        with self.lock:
            self.paused_until = max(self.paused_until, self.clock() + seconds)

    def call(self, send: Callable[[], tuple[int, dict, bytes]], default_wait: float = 60) -> bytes:
        for _ in range(self.max_pauses + 1):
            self.acquire()
            status, headers, body = send()
            if status != 429:
                return body
            self.pause(retry_after_seconds(headers.get("Retry-After"), default_wait))
        raise RateLimitExceeded("still limited after every pause")
