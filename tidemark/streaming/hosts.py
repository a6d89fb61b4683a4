"""Hosts that unload when idle, and frames that are asked for many times and served once, as streams."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

LEASES = "user_id bigint, ts timestamp, event_id bigint, event string"
UNLOADED = "user_id bigint, generation bigint, released_at timestamp, unloaded_at timestamp"


def _us(moment: datetime) -> int:
    return round(moment.timestamp() * 1_000_000)


def _moment(us: int) -> datetime:
    return datetime.fromtimestamp(us / 1_000_000, timezone.utc).replace(tzinfo=None)


class IdleHost(StatefulProcessor):
    """Counts a host's leases; the last release arms a timer, an acquire takes it back, and when it runs out the host unloads."""

    def __init__(self, idle_seconds: int):
        self.idle_us = idle_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.host = handle.getValueState("host", "leases bigint, released_us bigint, generation bigint")

    def _unloads(self, key: tuple, released: int, generation: int) -> Row:
        return Row(user_id=key[0], generation=generation, released_at=_moment(released), unloaded_at=_moment(released + self.idle_us))

    def due(self, released: int) -> int:
        return -(-(released + self.idle_us) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        leases, released, generation = self.host.get() if self.host.exists() else (0, None, 0)
        before = released
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            at = _us(r.ts)
            if released is not None and at >= released + self.idle_us:
                yield self._unloads(key, released, generation)
                released, generation = None, generation + 1
            if r.event == "ACQUIRE":
                leases, released = leases + 1, None
            elif r.event == "RELEASE" and leases:
                leases -= 1
                released = at if not leases else None
        if before is not None and before != released:
            self.handle.deleteTimer(self.due(before))
        if released is not None and before != released:
            self.handle.registerTimer(self.due(released))
        self.host.update((leases, released, generation))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        leases, released, generation = self.host.get() if self.host.exists() else (0, None, 0)
        if released is not None and self.due(released) <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._unloads(key, released, generation)
            self.host.update((leases, None, generation + 1))

    def close(self) -> None:
        pass


def idle_unloads(events: DataFrame, idle_seconds: int, watermark: str = "0 seconds") -> DataFrame:
    """``(user_id, generation, released_at, unloaded_at)`` for every time a host has had no lease for ``idle_seconds``.

    ``events`` is a stream of LEASES. A release of nothing changes nothing; an acquire at the very moment comes after the
    unloading. State is one row a host.
    """
    return events.withWatermark("ts", watermark).groupBy("user_id").transformWithState(statefulProcessor=IdleHost(idle_seconds), outputStructType=UNLOADED, outputMode="append", timeMode="EventTime")


def coalesced_frames(requests: DataFrame, frame: str, at: str = "ts", subscriber: str = "user_id", watermark: str = "0 seconds") -> DataFrame:
    """``(frame, subscribers, requests)``: each frame once, when the watermark has passed it, with its different subscribers.

    Requests that come after their frame was served are dropped. State is a counter for each subscriber of an open frame.
    """
    timed = requests.withWatermark(at, watermark)
    each = timed.groupBy(F.window(at, frame).alias("w"), subscriber).agg(F.count("*").alias("n"))
    served = each.groupBy(F.window(F.window_time("w"), frame).alias("frame")).agg(F.count("*").alias("subscribers"), F.sum("n").alias("requests"))
    return served.select(F.col("frame.start").alias("frame"), "subscribers", "requests")
