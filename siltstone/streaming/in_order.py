"""The limits of limits.py as streams: events wait in state until the watermark has passed them, and are judged in order of time.

State is kept by Spark in RocksDB, an entry a run of waiting events, a key and a visitor, so a micro-batch only touches what it needs, and
what no rule asks for any more is cleared by a timer in event time, whether or not its key is heard of again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siltstone.streaming.limits import Rules, accept

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """What these streams need of a session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


#: Waiting rows of one entry of the state.
RUN = 512


class InOrder(StatefulProcessor):
    """Holds back rows (event_id, t in seconds, ...) until the watermark passes t, then judges them by time and id.

    Rows wait in runs of up to RUN, sorted by time, each with a timer at its first row's. A call of the state takes as long as hundreds of rows do, so
    all rows of a key that the watermark has passed are judged at the first of its timers, merged from their runs; of a run only what is not due is written again.
    """

    #: Columns that wait, each with the values of all rows of a run.
    held = {"event_id": "bigint"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t bigint, n bigint", ", ".join(f"{c} array<{kind}>" for c, kind in {"times": "bigint", **self.held}.items()))

    def _wait(self, rows: Iterable[tuple]) -> None:
        """Puts rows (t, held...) into runs."""
        ordered = sorted(rows, key=lambda r: r[0])
        for i in range(0, len(ordered), RUN):
            some, n = ordered[i : i + RUN], 0
            t = some[0][0]
            while self.waiting.containsKey((t, n)):
                n += 1
            self.waiting.updateValue((t, n), tuple(map(list, zip(*some, strict=True))))
            self.handle.registerTimer(t * 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        self._wait((r.t, *(r[c] for c in self.held)) for r in rows)
        return iter(())

    def _due(self, now: int) -> Iterator[tuple]:
        """Rows (t, held...) up to now by time and id; runs are read as their first times come up."""
        runs = sorted((t, n) for t, n in self.waiting.keys() if t <= now)
        heap: list[tuple] = []
        read = 0
        while heap or runs:
            while runs and (not heap or runs[0][0] <= heap[0][0]):
                run = runs.pop(0)
                for row in zip(*self.waiting.getValue(run), strict=True):
                    read += 1
                    heapq.heappush(heap, (row[0], row[1] is not None, row[1] or 0, read, row))
                self.waiting.removeKey(run)
            if heap[0][0] > now:
                break
            yield heapq.heappop(heap)[-1]
        self._wait(x[-1] for x in heap)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        now = max(at, timerValues.getCurrentWatermarkInMs()) // 1000
        yield from self.judge(key, self._due(now), now)
        self.forget(at // 1000)

    def judge(self, key, due: Iterator[tuple], now: int) -> Iterator[Row]:
        """What is told of the rows that are due, of which it takes all."""
        raise NotImplementedError

    def forget(self, t: int) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class RateLimit(InOrder):
    """At most `most` accepted events in any `seconds`, as rate_limited()."""

    def __init__(self, key: str, seconds: int, most: int):
        self.told, self.seconds, self.most = Row(key, "event_id", "t", "accepted"), seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getValueState("recent", "times array<bigint>")

    def judge(self, key, due: Iterator[tuple], now: int) -> Iterator[Row]:
        recent = None
        for t, event_id in due:
            if recent is None:
                recent = list(self.recent.get()[0]) if self.recent.exists() else []
            (yes,), recent = accept([t], recent, self.seconds, self.most)
            yield self.told(*key, event_id, t, yes)
        if recent and recent[-1] + self.seconds > now:  # else no later event asks for them
            self.recent.update((recent,))
            self.handle.registerTimer((recent[-1] + self.seconds) * 1000)
        elif recent is not None and self.recent.exists():
            self.recent.clear()

    def forget(self, t: int) -> None:
        if self.recent.exists() and all(t - x >= self.seconds for x in self.recent.get()[0]):
            self.recent.clear()


class Dispatch(InOrder):
    """Cooldown by key, cap of the global window and one event a visitor, as dispatched()."""

    held = {"event_id": "bigint", "key": "string", "visitor": "string"}

    def __init__(self, key: str, rules: Rules):
        self.told, self.rules = Row(key, "event_id", "accepted"), rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getMapState("last", "name string", "t bigint")
        self.visitors = handle.getMapState("visitors", "name string", "t bigint")
        self.window = handle.getValueState("window", "began bigint, n bigint")
        #: Names to forget at a time, first letter k or v.
        self.due = handle.getMapState("due", "t bigint", "names array<string>")

    @staticmethod
    def _at(known, name: str | None) -> int | None:
        return known.getValue((name,))[0] if name is not None and known.containsKey((name,)) else None

    def _note(self, known, kind: str, name: str, t: int, least: float) -> None:
        known.updateValue((name,), (t,))
        gone = int(t + least) + 1
        names = list(self.due.getValue((gone,))[0]) if self.due.containsKey((gone,)) else []
        self.due.updateValue((gone,), ([*names, kind + name],))
        self.handle.registerTimer(gone * 1000)

    def judge(self, key, due: Iterator[tuple], now: int) -> Iterator[Row]:
        began, n, some = None, 0, False
        for t, event_id, name, visitor in due:
            if not some:
                (began, n), some = self.window.get() if self.window.exists() else (None, 0), True
            ok, started, n = self.rules.passes(t, self._at(self.last, name), self._at(self.visitors, visitor), float("-inf") if began is None else began, n)
            began = None if started == float("-inf") else started
            if ok:
                if name is not None:
                    self._note(self.last, "k", name, t, self.rules.cooldown)
                if visitor is not None:
                    self._note(self.visitors, "v", visitor, t, self.rules.keep)
            yield self.told(*key, event_id, ok)
        if began is not None:
            self.window.update((began, n))
            self.handle.registerTimer((int(began + self.rules.window) + 1) * 1000)

    def forget(self, t: int) -> None:
        if self.due.containsKey((t,)):
            for told in self.due.getValue((t,))[0]:
                known, least = (self.last, self.rules.cooldown) if told[0] == "k" else (self.visitors, self.rules.keep)
                at = self._at(known, told[1:])
                if at is not None and t - at > least:
                    known.removeKey((told[1:],))
            self.due.removeKey((t,))
        if self.window.exists() and t - self.window.get()[0] > self.rules.window:
            self.window.clear()


def rate_limited_stream(events: DataFrame, key: str, ts: str, seconds: int, most: int, late: str) -> DataFrame:
    """Stream of events (key, event_id, ts) -> (key, event_id, t, accepted) as rate_limited() has them, whatever the order and the batches they come in.

    t is ts in whole seconds. An event is told of once the watermark, late behind the latest ts, has passed it; later ones are dropped. A key that
    falls silent leaves no state after seconds of event time. Rows of null key are left out.
    """
    kind = dict(events.dtypes)[key]
    own = events.withWatermark(ts, late).where(F.col(key).isNotNull()).select(key, F.col("event_id").cast("bigint").alias("event_id"), F.unix_seconds(ts).alias("t"), ts)
    return own.groupBy(key).transformWithState(RateLimit(key, seconds, most), f"{key} {kind}, event_id bigint, t bigint, accepted boolean", "append", "eventTime")


def dispatched_stream(events: DataFrame, service: str, ts: str, late: str, **limits: float) -> DataFrame:
    """Stream of events (service, event_id, ts, key, visitor) -> (service, event_id, accepted) as dispatched() has them; the rest as rate_limited_stream()."""
    kind = dict(events.dtypes)[service]
    told = [F.col("event_id").cast("bigint").alias("event_id"), F.unix_seconds(ts).alias("t"), F.col("key").cast("string").alias("key"), F.col("visitor").cast("string").alias("visitor")]
    own = events.withWatermark(ts, late).where(F.col(service).isNotNull()).select(service, *told, ts)
    return own.groupBy(service).transformWithState(Dispatch(service, Rules(**limits)), f"{service} {kind}, event_id bigint, accepted boolean", "append", "eventTime")
