"""Recent samples on the driver: a window of time, and the last few of something."""

from __future__ import annotations

from collections import deque


class History:
    """(time, n) samples; those older than the window fall out."""

    def __init__(self, seconds: float = 60):
        self.seconds, self.samples = seconds, deque()

    def add(self, time: float, n: float) -> None:
        self.samples.append((time, n))
        self._expire(time)

    def _expire(self, now: float) -> None:
        while self.samples and self.samples[0][0] < now - self.seconds:
            self.samples.popleft()

    def rate(self, now: float) -> float:
        """Sum of the window over the time since its oldest sample; 0 without samples."""
        self._expire(now)
        if not self.samples or now <= self.samples[0][0]:
            return 0.0
        return sum(n for _, n in self.samples) / (now - self.samples[0][0])

    def event_rate(self) -> float | None:
        """As rate, but the oldest sample only marks the time; None with fewer than two times."""
        if len({t for t, _ in self.samples}) < 2:
            return None
        times = [t for t, _ in self.samples]
        return sum(n for t, n in self.samples if t > times[0]) / (times[-1] - times[0])


class Last:
    """The last n of something."""

    def __init__(self, n: int = 10):
        self.items: deque = deque(maxlen=n)

    def add(self, item) -> None:
        self.items.append(item)

    def mean(self) -> float | None:
        return sum(self.items) / len(self.items) if self.items else None


def split_by_size(items: list[bytes], most: int) -> list[list[bytes]]:
    """Runs of items with at most so many bytes together; a larger item stands alone."""
    out: list[list[bytes]] = []
    size = 0
    for item in items:
        if not out or size + len(item) > most:
            out.append([])
            size = 0
        out[-1].append(item)
        size += len(item)
    return out


#: Fixed value: bytes that each element of an array costs besides itself, apart from the digits of its place.
ELEMENT = 2


def array_size(sizes: list[int]) -> int:
    """Bytes of an array of elements of these sizes: four for its length, one at its end, and for each element a type, its place in digits, and a zero."""
    return 5 + sum(s + ELEMENT + len(str(i)) for i, s in enumerate(sizes))
