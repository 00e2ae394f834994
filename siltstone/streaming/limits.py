"""Streaming operators: windows with watermarks, and a limiter that does not count what it rejects."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators.folds import sorted_fold


def tumbling_counts(events: DataFrame, ts: str, key: str, size: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))


def debounced(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def accept(times: list[int], recent: list[int], seconds: int, most: int) -> tuple[list[bool], list[int]]:
    """Whether each time (ordered) is under most accepted ones in the seconds before it, and the accepted ones still of interest."""
    out = []
    for t in times:
        recent = [x for x in recent if t - x < seconds]
        out.append(len(recent) < most)
        if out[-1]:
            recent.append(t)
    return out, recent


def rate_limited(events: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """events (key, event_id, t in seconds) -> (key, event_id, t, accepted), in batches or as a stream; state is a list of at most `most` times a key."""
    schema = f"{key} bigint, event_id bigint, t bigint, accepted boolean"

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["t", "event_id"])
        ok, recent = accept(rows["t"].tolist(), recent, seconds, most)
        state.update((recent,))
        yield pd.DataFrame({key: k[0], "event_id": rows["event_id"], "t": rows["t"], "accepted": ok})

    if events.isStreaming:
        return events.select(key, "event_id", "t").groupBy(key).applyInPandasWithState(fold, schema, "recent array<bigint>", "append", GroupStateTimeout.NoTimeout)

    def fresh():
        recent: list[int] = []

        def step(event_id, t):
            nonlocal recent
            ok, recent = accept([t], recent, seconds, most)
            return [(event_id, t, ok[0])]

        return step, lambda: []

    return sorted_fold(events.select(key, "event_id", "t"), key, ["t", "event_id"], ["event_id", "t"], "event_id bigint, t bigint, accepted boolean", fresh)


@dataclass(frozen=True)
class Rules:
    """Of a dispatcher: one event a cooldown (seconds) for each key, most a window, one for each visitor in keep."""

    cooldown: float = 60
    window: float = 60
    most: int = 5
    keep: float = 86_400

    def passes(self, t: float, last: float | None, visited: float | None, began: float, n: int) -> tuple[bool, float, int]:
        """Whether an event at t is let through whose key did at last and whose visitor at visited, and the global window's start and count after it.

        A window starts with the first event after the last one's end that the other rules let through.
        """
        if (visited is not None and t - visited <= self.keep) or (last is not None and t - last < self.cooldown):
            return False, began, n
        if t - began > self.window:
            began, n = t, 0
        return n < self.most, began, n + (n < self.most)


@dataclass
class Dispatches:
    """State of a dispatcher: last times by key and by visitor, oldest first, and the global window."""

    last: dict[str, float] = field(default_factory=dict)
    visitors: dict[str, float] = field(default_factory=dict)
    began: float = float("-inf")
    n: int = 0

    def take(self, t: float, key: str, visitor: str | None, rules: Rules = Rules()) -> bool:  # noqa: B008
        """Whether an event at t, no earlier than any before, is let through.

        Only what is let through is noted; a null key has no cooldown, a null visitor is nobody's. What no rule asks for any more is forgotten from the old end: state is bounded by what
        passes in that time, and each event forgets what it must and no more.
        """
        ok, self.began, self.n = rules.passes(t, self.last.get(key), self.visitors.get(visitor) if visitor is not None else None, self.began, self.n)
        if ok:
            for known, name, least in ((self.last, key, rules.cooldown), (self.visitors, visitor, rules.keep)):
                if name is not None:
                    known.pop(name, None)
                    known[name] = t
                while known and t - known[first := next(iter(known))] > least:
                    del known[first]
        return ok


def dispatched(events: DataFrame, service: str, **limits: float) -> DataFrame:
    """(service, event_id, accepted) of events (service, event_id, t in seconds, key, visitor): each service's in order of time, through Dispatches."""
    rules = Rules(**limits)

    def fresh():
        state = Dispatches()
        return lambda event_id, t, key, visitor: [(event_id, state.take(t, key, visitor, rules))], lambda: []

    own = events.select(service, "event_id", F.col("t").cast("double").alias("t"), F.col("key").cast("string").alias("key"), F.col("visitor").cast("string").alias("visitor"))
    return sorted_fold(own, service, ["t", "event_id"], ["event_id", "t", "key", "visitor"], "event_id bigint, accepted boolean", fresh)
