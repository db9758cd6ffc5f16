import pytest

from concord.functions.history import History, Last, array_size, split_by_size
from concord.plans import reports
from concord.sources.retry import Retry, TransientError


def test_history():
    h = History(10)
    assert h.rate(0) == 0.0 and h.event_rate() is None
    for t, n in ((0, 5), (4, 8), (12, 2)):
        h.add(t, n)
    assert h.rate(14) == pytest.approx(10 / 10)
    assert h.event_rate() == pytest.approx(2 / 8)
    assert h.rate(99) == 0.0
    last = Last(2)
    assert last.mean() is None
    for x in (1, 2, 3):
        last.add(x)
    assert last.mean() == 2.5


def test_sizes():
    assert split_by_size([b"aa", b"bbb", b"c", b"dddddddd", b"e"], 5) == [[b"aa", b"bbb"], [b"c"], [b"dddddddd"], [b"e"]]
    assert split_by_size([], 5) == []
    assert array_size([]) == 5 and array_size([8] * 11) == 5 + 11 * 8 + 11 * 2 + 10 + 2


def test_retry():
    waits, tries = [], []

    def work():
        tries.append(1)
        if len(tries) < 7:
            raise TransientError
        return "done"

    assert Retry(sleep=waits.append).run(work) == "done"
    assert len(waits) == 6 and waits[-1] <= 16 and waits[0] <= 1
    with pytest.raises(ValueError):
        Retry(sleep=waits.append).run(lambda: int("x"))

    def always():
        raise ConnectionError

    with pytest.raises(ConnectionError):
        Retry(attempts=3, sleep=waits.append).run(always)
    clock = iter(range(0, 10_000, 400))
    with pytest.raises(ConnectionError):
        Retry(sleep=waits.append, clock=lambda: next(clock)).run(always)
    assert Retry().run(lambda: 1, lambda: 2) == [1, 2]


def test_reports(spark):
    assert reports.workers(spark) == "Nothing runs."
    lines = reports.reader_status("source", {"processed_rows_per_second": 12.5, "saturation": 0.95}, 130, None)
    assert lines[1].startswith("⚠") and lines[2] == "⚠ source: 95% busy" and "nothing" in lines[3]
    warn = reports.SchemaWarning()
    assert warn.text(0, 0) is None and warn.text(1, 3) and warn.text(30, 3) is None and warn.text(62, 3)
    assert reports.document_counts({"a": 1}, {"a": 2, "b": 3}).count("\n") == 5
