"""One call of the state serves all requests of a bucket."""

from __future__ import annotations

import pandas as pd

from cadenza.streaming.attribution import PIECE, FeedbackAttribution


class ListState:
    def __init__(self, calls):
        self.calls, self.rows = calls, []

    def exists(self):
        self.calls.append("exists")
        return bool(self.rows)

    def get(self):
        self.calls.append("get")
        return iter(self.rows)

    def put(self, rows):
        self.calls.append("put")
        self.rows = list(rows)

    def appendList(self, rows):
        self.calls.append("appendList")
        self.rows += rows

    def clear(self):
        self.calls.append("clear")
        self.rows = []


class Handle:
    """A state in memory that notes its calls."""

    def __init__(self):
        self.calls, self.timers, self.states = [], set(), {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, ListState(self.calls))

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("timer")
        self.timers.discard(at)


class At:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.now


def rows(responses, feedback):
    made = [(r, 0, None, "t", "I", "G", None, 0, at) for r, at in responses]
    made += [(r, 1, f"{at}", "", None, None, kind, 1, at) for r, at, kind in feedback]
    names = ["requestId", "kind", "feedbackTime", "tie", "intentType", "intentGroup", "feedbackType", "times", "at"]
    return iter([pd.DataFrame(made, columns=names)])


def processor(**options):
    made = FeedbackAttribution(**{"wait_ms": 100, "intent_ttl_ms": None, "event_wait_seconds": None} | options)
    handle = Handle()
    made.init(handle)
    return made, handle


def call(made, frames, now):
    return [tuple(r) for part in made.handleInputRows((0,), frames, At(now)) for r in part.itertuples(index=False)]


def test_calls_of_the_state_do_not_grow_with_the_requests():
    n = 2 * PIECE + 500
    made, handle = processor()
    assert call(made, rows([], [(f"r{i}", 5, "LIKE") for i in range(n)]), 1) == []
    assert handle.timers == {101}
    out = call(made, rows([(f"r{i}", 9) for i in range(n)], []), 2)
    assert len(out) == n and set(out) == {(f"r{i}", "5", "LIKE", 1, "I", "G") for i in range(n)}
    assert handle.timers == set() and handle.states["waiting"].rows == []
    assert len(handle.states["intent"].rows) == 3 and len(handle.calls) < 20


def test_requests_of_a_bucket_wait_each_for_its_own_time():
    made, handle = processor()
    call(made, rows([], [("a", 5, "LIKE")]), 1)
    call(made, rows([], [("a", 5, "LIKE"), ("b", 5, "LIKE")]), 50)
    assert handle.timers == {101, 150}
    list(made.handleExpiredTimer((0,), At(101), At(101)))
    assert call(made, rows([("a", 9), ("b", 9)], []), 120) == [("b", "5", "LIKE", 1, "I", "G")]


def test_an_intent_is_forgotten_after_its_time():
    made, _ = processor(intent_ttl_ms=10)
    call(made, rows([("a", 1)], []), 1)
    assert len(call(made, rows([], [("a", 2, "LIKE")]), 5)) == 1
    assert call(made, rows([], [("a", 2, "LIKE")]), 20) == []
