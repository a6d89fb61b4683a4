"""The session store as keyed state: one processor for each session, with its record, its memory and its timer.

``session`` holds a session's record, ``memory`` its newest entries. A timer at the end of its time to live removes
both, unless a step or a matching feedback has moved it. An operation commits all of its changes or none: state
changes of a micro-batch are written together, and the rows it gives leave with them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.operators.store import HISTORY

OPERATIONS = "user_id bigint, ts timestamp, event_id bigint, op string, action_id string"
TOLD = "user_id bigint, event_id bigint, op string, status string, plan_step bigint, memory string"
SESSION = "created_us bigint, seen_us bigint, plan_step bigint, last_action string"
ENTRY = "action_id string, result string"


def _us(moment) -> int:
    return round(moment.timestamp() * 1_000_000)


class SessionStore(StatefulProcessor):
    """create, get, step, feedback, escalate and delete on one session.

    create begins anew, whatever was there. step issues an action, which becomes the newest of ``limit`` entries of memory;
    feedback must name that action, and gives its entry a result. Both move the timer by ``ttl_seconds``. get and
    escalate change nothing. What comes after the end of the session finds none.
    """

    def __init__(self, ttl_seconds: int, limit: int = HISTORY):
        self.ttl_us, self.limit = ttl_seconds * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION)
        self.memory = handle.getListState("memory", ENTRY)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        record = self.session.get() if self.session.exists() else None
        entries = [tuple(e) for e in self.memory.get()] if record else []
        before = record
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            at = _us(r.ts)
            if record is not None and at >= record[1] + self.ttl_us:
                record, entries = None, []
            record, entries, status = self.apply(record, entries, r.op, r.action_id, at)
            shown = ",".join(a if x is None else f"{a}={x}" for a, x in entries)
            yield Row(user_id=key[0], event_id=r.event_id, op=r.op, status=status, plan_step=record[2] if record else None, memory=shown if record else None)
        self.commit(before, record, entries)

    def apply(self, record, entries: list, op: str, action_id: str | None, at: int):
        """One operation: the record and the memory after it, and what the caller is told."""
        if op == "create":
            return (at, at, 0, None), [], "created"
        if record is None:
            return None, [], "session_expired"
        created, seen, steps, last = record
        if op == "get":
            return record, entries, "found"
        if op == "escalate":
            return record, entries, "unavailable"
        if op == "delete":
            return None, [], "ended"
        if op == "step":
            return (created, at, steps + 1, action_id), [*entries, (action_id, None)][-self.limit :], "ok"
        if op == "feedback" and action_id is not None and action_id == last:
            named = [(a, "ok" if a == action_id else x) for a, x in entries]
            return (created, at, steps, last), named, "accepted"
        return record, entries, "invalid_request"

    def commit(self, before, record, entries: list) -> None:
        if before is not None:
            self.handle.deleteTimer(self.due(before))
        if record is None:
            self.session.clear()
            self.memory.clear()
        else:
            self.session.update(record)
            self.memory.clear() if not entries else self.memory.put(entries)
            self.handle.registerTimer(self.due(record))

    def due(self, record) -> int:
        """When the session's time is over, in milliseconds, not before."""
        return -(-(record[1] + self.ttl_us) // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.session.clear()
        self.memory.clear()
        return iter([])

    def close(self) -> None:
        pass


def sessions(operations: DataFrame, ttl_seconds: int, watermark: str = "0 seconds", limit: int = HISTORY) -> DataFrame:
    """What each operation of a stream (OPERATIONS) is told; ``plan_step`` and ``memory`` are those after it, null where no session is.

    A session's operations of a micro-batch are taken in time order; those later than the watermark are dropped.
    State is one record and ``limit`` entries for each live session, and nothing for others.
    """
    processor = SessionStore(ttl_seconds, limit)
    timed = operations.withWatermark("ts", watermark)
    return timed.groupBy("user_id").transformWithState(statefulProcessor=processor, outputStructType=TOLD, outputMode="append", timeMode="EventTime")
