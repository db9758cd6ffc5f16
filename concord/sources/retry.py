"""Retries of small driver-side work (listing, state files). Spark itself retries tasks."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

FIRST, LONGEST, GIVE_UP = 1.0, 16.0, 600.0


class TransientError(Exception):
    """Work that may succeed if tried again."""


def transient(error: BaseException) -> bool:
    return isinstance(error, TransientError | ConnectionError | TimeoutError | InterruptedError)


class Retry:
    """Repeats until it works, fails for good, or for so long (or so often) nothing succeeded. Waits double, with some chance in them."""

    def __init__(self, seconds: float = GIVE_UP, attempts: int | None = None, is_transient: Callable[[BaseException], bool] = transient, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.attempts, self.is_transient, self.sleep, self.clock = seconds, attempts, is_transient, sleep, clock
        self.last_success = clock()

    def note_success(self) -> None:
        """Some progress was made: the time until giving up begins anew."""
        self.last_success = self.clock()

    def run(self, *work: Callable):
        """Results of the callables, which run side by side; all are tried again if one fails in passing."""
        self.last_success, wait, tried = self.clock(), FIRST, 0
        while True:
            tried += 1
            try:
                if len(work) == 1:
                    return work[0]()
                with ThreadPoolExecutor(len(work)) as pool:
                    return [f.result() for f in [pool.submit(w) for w in work]]
            except Exception as e:
                late = self.clock() - self.last_success > self.seconds
                if not self.is_transient(e) or late or (self.attempts is not None and tried >= self.attempts):
                    raise
                self.sleep(wait * random.uniform(0.8, 1.0))
                wait = min(LONGEST, 2 * wait)
