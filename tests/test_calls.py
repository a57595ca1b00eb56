"""A task's calls: a future a thread and not a row, every row once, as many open as allowed."""
import threading
import time

import pytest

from service_insights.operators import scoring


def test_a_batch_costs_a_future_a_thread(monkeypatch):
    calls = scoring.Calls(lambda text: (text, None), 4)
    submitted, submit = [], calls.pool.submit
    monkeypatch.setattr(calls.pool, "submit", lambda *a, **b: (submitted.append(1), submit(*a, **b))[1])
    for batch in ([str(k) for k in range(5000)], [], ["x"], [None, "y"]):
        assert calls(batch) == [(text, None) for text in batch]
    assert len(submitted) <= 4 + 0 + 1 + 2
    calls.close()


def test_each_row_is_sent_once_and_some_at_a_time():
    lock, seen, now, most = threading.Lock(), [], [0], [0]

    def one(text):
        with lock:
            seen.append(text)
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.005)
        with lock:
            now[0] -= 1
        return text.upper(), None

    calls = scoring.Calls(one, 3)
    batch = [f"r{k}" for k in range(60)]
    assert [g[0] for g in calls(batch)] == [t.upper() for t in batch]
    assert sorted(seen) == sorted(batch) and most[0] == 3
    calls.close()


def test_nothing_is_sent_after_an_error_or_the_end():
    sent = []

    def one(text):
        sent.append(text)
        time.sleep(0.01)
        raise KeyboardInterrupt

    calls = scoring.Calls(one, 2)
    with pytest.raises(KeyboardInterrupt):
        calls([str(k) for k in range(100)])
    calls.close()
    time.sleep(0.1)
    assert len(sent) <= 4


def test_no_sleep_without_a_budget(monkeypatch):
    slept = []
    monkeypatch.setattr(scoring.time, "sleep", slept.append)
    pace = scoring.Pace(0.0)
    for _ in range(100):
        pace.wait()
    assert not slept
    pace.hold(5.0)  # a pause asked for holds without a budget too
    pace.wait()
    assert len(slept) == 1 and 4 < slept[0] <= 5
