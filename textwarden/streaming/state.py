"""Processors with state: the newest events of a device, and sessions that grow over cells."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textwarden.sources.workers import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROCKS = "spark.sql.streaming.stateStore.rocksdb"
LAST_SCHEMA = "device_id string, event_ids array<string>"
SESSION_SCHEMA = "employee_id string, first bigint, last bigint, events bigint, max_risk int, tags array<string>"


def use_state_store(spark: SparkSession) -> None:
    """State on disk, with lists, timers and column families, for the streams of this session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # counting rows reads each one before it is written
    spark.conf.set(f"{ROCKS}.trackTotalNumberOfRows", "false")
    spark.conf.set(f"{ROCKS}.changelogCheckpointing.enabled", "true")
    ship(spark)


class _Timed(StatefulProcessor):
    def _wake(self, millis: int) -> None:
        """One timer per key: the next moment at which something may end."""
        for timer in list(self.handle.listTimers()):
            if timer != millis:
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(millis)

    def close(self) -> None:
        pass


class NewestEvents(_Timed):
    """At most ``keep`` ids per device, newest first, ties by id; a device idle for ``idle`` milliseconds is forgotten."""

    def __init__(self, keep: int, idle: int):
        self.keep, self.idle = keep, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getListState("newest", "timestamp bigint, event_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [tuple(r) for r in self.newest.get()] + [(r.timestamp, r.event_id) for r in rows]
        held = sorted(held, key=lambda e: (-e[0], e[1]))[:self.keep]
        self.newest.put(held)
        self._wake(held[0][0] + self.idle)
        yield Row(device_id=key[0], event_ids=[i for _, i in held])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.newest.clear()
        yield Row(device_id=key[0], event_ids=[])


class SessionsOfCells(StatefulProcessor):
    """Sessions of an employee from closed cells (as JSON); each is given once, when nothing can reach it any more.

    What is over by the time its cells come is given at once; state and a timer cost a round trip to
    Spark and a conversion of every row each, so only what is still open is kept, with one timer for
    the first moment at which some of it is over.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first bigint, last bigint, events bigint, max_risk int, tags array<string>")

    def _over(self, last: int) -> int:
        """The time in milliseconds from which no cell can reach a session: its own cells are closed by then."""
        return (last + 2 * self.gap) // 1000 + 1

    def _parted(self, sessions: list[tuple], now: int) -> tuple[list[tuple], list[tuple]]:
        """Sessions that are over, and the others."""
        over = [s for s in sessions if self._over(s[1]) <= now]
        return over, [s for s in sessions if self._over(s[1]) > now]

    def _first(self, sessions: list[tuple]) -> int | None:
        return min((self._over(s[1]) for s in sessions), default=None)

    def _rows(self, key, sessions: list[tuple]) -> Iterator[Row]:
        return iter([Row(employee_id=key[0], first=first, last=last, events=events, max_risk=risk, tags=list(tags))
                     for first, last, events, risk, tags in sessions])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [tuple(r) for r in self.open.get()]
        timer = self._first(held)
        merged: list[tuple] = []
        cells = [(c["first"], c["last"], c["events"], c.get("max_risk"), c["tags"]) for c in (json.loads(r.cell) for r in rows)]
        for first, last, events, risk, tags in sorted(held + cells, key=lambda s: s[0]):
            if merged and first - merged[-1][1] <= self.gap:
                a = merged[-1]
                risks = [x for x in (a[3], risk) if x is not None]
                merged[-1] = (a[0], max(a[1], last), a[2] + events, max(risks, default=None), sorted({*a[4], *tags}))
            else:
                merged.append((first, last, events, risk, sorted(tags)))
        over, rest = self._parted(merged, timerValues.getCurrentWatermarkInMs())
        if rest:
            self.open.put(rest)
        elif held:
            self.open.clear()
        wake = self._first(rest)
        if wake != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        return self._rows(key, over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        over, rest = self._parted([tuple(r) for r in self.open.get()], timerValues.getCurrentWatermarkInMs())
        if rest:
            self.open.put(rest)
            self.handle.registerTimer(self._first(rest))  # Spark drops the one that has expired
        else:
            self.open.clear()
        return self._rows(key, over)

    def close(self) -> None:
        pass
