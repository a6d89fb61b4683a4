"""State machines as ordered folds over a key's events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

# The companion's event names, and the host's transition table.
TERMINAL = ("task-finished", "task-cancelled", "host-lost")
CAPTURE_STOPS = ("audio-capture-ended", "audio-capture-denied")
KNOWN = ("task-started", "thinking", "acting", "approval-requested", "approval-resolved", "audio-capture-confirmed", *CAPTURE_STOPS, *TERMINAL)
HOST = {
    ("idle", "ACQUIRE"): "starting", ("starting", "WORKER_READY"): "ready", ("starting", "ERROR"): "idle", ("ready", "ACQUIRE"): "active",
    ("active", "RELEASE"): "releasing", ("ready", "RELEASE"): "releasing", ("releasing", "IDLE_TIMEOUT"): "idle", ("active", "ACQUIRE"): "active", ("releasing", "ACQUIRE"): "active",
}

HOST_STATES = ("idle", "starting", "ready", "active", "releasing", "disposed")
#: Events, or maps, that are put together in one row, and how often: a key has STRETCH ** LEVELS events at most.
STRETCH, LEVELS = 4096, 3

MACHINE = "struct<state: string, generation: bigint, task: string, old_generation: bigint, old_task: string, capture: boolean, approval: boolean, action: boolean, reason: string, rejected: string>"


def fold(events: DataFrame, key: list[str], order: list[str], fields: list[str], start: Column, step) -> DataFrame:
    """``(key, state)``: ``step(state, event)`` over each key's events in order.

    Events of a key are gathered as sorted structs and folded inside the JVM. A key's events must fit
    in a row; keys without such a bound belong to ``companion_in_order``, which keeps the machine only.
    """
    listed = events.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("events"))
    return listed.select(*key, F.aggregate("events", start, step).alias("state"))


def companion_start() -> Column:
    none, no = F.lit(None), F.lit(False)
    return F.struct(
        F.lit("idle").alias("state"), none.cast("bigint").alias("generation"), none.cast("string").alias("task"), none.cast("bigint").alias("old_generation"), none.cast("string").alias("old_task"),
        no.alias("capture"), no.alias("approval"), no.alias("action"), F.lit("no provider connected").alias("reason"), none.cast("string").alias("rejected"),
    ).cast(MACHINE)


def stale(m: Column, generation: Column, task: Column) -> Column:
    """Why an event is refused, null if it is heard: older runs first, then another task of this run."""
    live = F.when(generation > m["generation"], None).when(generation < m["generation"], "stale-generation").when(task == m["task"], None).otherwise("stale-task")
    gone = F.when(m["old_generation"].isNull() | (generation > m["old_generation"]), None).when(generation < m["old_generation"], "stale-generation").when(task == m["old_task"], "stale-generation").otherwise("stale-task")
    return F.when(m["generation"].isNotNull(), live).otherwise(gone)


def shown(kind: Column, approval: Column, action: Column, capture: Column) -> Column:
    """The most urgent state that holds."""
    return (
        F.when((kind == "approval-requested") | approval, "needs-approval")
        .when((kind == "acting") | action, "acting")
        .when(kind.isin("thinking", "task-started"), "thinking")
        .when(capture, "listening")
        .otherwise("idle")
    )


def companion_step(m: Column, e: Column) -> Column:
    """One event (type, generation, task) of the companion machine; the provider is there."""
    kind, generation, task = e["type"], e["generation"], e["task"]
    usable = kind.isin(*KNOWN) & generation.isNotNull() & (F.coalesce(task, F.lit("")) != "")
    why = F.when(~F.coalesce(usable, F.lit(False)), "unknown-event").otherwise(stale(m, generation, task))

    def machine(**new: Column) -> Column:
        names = ("state", "generation", "task", "old_generation", "old_task", "capture", "approval", "action", "reason", "rejected")
        return F.struct(*(new.get(n, m[n]).alias(n) for n in names)).cast(MACHINE)

    none, no = F.lit(None).cast("string"), F.lit(False)
    refused = machine(rejected=why)
    quieter = machine(state=shown(kind, m["approval"], m["action"], no), capture=no, reason=kind, rejected=none)
    stays = (kind == "task-finished") & m["capture"]
    ended = machine(
        state=F.when(stays, "listening").otherwise("idle"), generation=F.lit(None).cast("bigint"), task=none,
        old_generation=F.coalesce(m["generation"], m["old_generation"]), old_task=F.when(m["generation"].isNotNull(), m["task"]).otherwise(m["old_task"]),
        capture=stays, approval=no, action=no, reason=kind, rejected=none,
    )
    capture = F.when(kind == "audio-capture-confirmed", True).when(kind.isin(*CAPTURE_STOPS), False).otherwise(m["capture"])
    approval = F.when(kind == "approval-requested", True).when(kind.isin("approval-resolved", "task-started"), False).otherwise(m["approval"])
    action = F.when(kind == "acting", True).when(kind.isin("thinking", "task-started"), False).otherwise(m["action"])
    heard = machine(state=shown(kind, approval, action, capture), generation=generation, task=task, capture=capture, approval=approval, action=action, reason=kind, rejected=none)
    retracts = kind.isin(*CAPTURE_STOPS) & m["capture"] & why.isin("stale-generation", "stale-task")
    return F.when(F.coalesce(retracts, no), quieter).when(why.isNotNull(), refused).when(kind.isin(*TERMINAL), ended).otherwise(heard)


def companion(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The companion's final machine for each key; events have type, generation and task."""
    return fold(events, key, order, ["type", "generation", "task"], companion_start(), companion_step).select(*key, "state.*")


class Companion:
    """The companion's machine for one key, event after event; see ``companion_step``."""

    __slots__ = ("state", "generation", "task", "old_generation", "old_task", "capture", "approval", "action", "reason", "rejected")

    def __init__(self):
        self.state, self.reason = "idle", "no provider connected"
        self.generation = self.task = self.old_generation = self.old_task = self.rejected = None
        self.capture = self.approval = self.action = False

    def _why_not(self, kind, generation, task) -> str | None:
        if kind not in KNOWN or generation is None or not task:
            return "unknown-event"
        live = self.generation is not None
        known, last = (self.generation, self.task) if live else (self.old_generation, self.old_task)
        if known is None or generation > known:
            return None
        if generation < known:
            return "stale-generation"
        if live:
            return None if task == last else "stale-task"
        return "stale-generation" if task == last else "stale-task"

    def _shown(self, kind) -> str:
        if kind == "approval-requested" or self.approval:
            return "needs-approval"
        if kind == "acting" or self.action:
            return "acting"
        return "thinking" if kind in ("thinking", "task-started") else "listening" if self.capture else "idle"

    def hear(self, kind, generation, task) -> None:
        why = self._why_not(kind, generation, task)
        if why in ("stale-generation", "stale-task") and kind in CAPTURE_STOPS and self.capture:
            self.capture, self.reason, self.rejected = False, kind, None
            self.state = self._shown(kind)
        elif why is not None:
            self.rejected = why
        elif kind in TERMINAL:
            self.capture = kind == "task-finished" and self.capture
            self.state = "listening" if self.capture else "idle"
            if self.generation is not None:
                self.old_generation, self.old_task = self.generation, self.task
            self.generation = self.task = self.rejected = None
            self.approval, self.action, self.reason = False, False, kind
        else:
            self.capture = kind == "audio-capture-confirmed" or (self.capture and kind not in CAPTURE_STOPS)
            self.approval = kind == "approval-requested" or (self.approval and kind not in ("approval-resolved", "task-started"))
            self.action = kind == "acting" or (self.action and kind not in ("thinking", "task-started"))
            self.state, self.generation, self.task, self.reason, self.rejected = self._shown(kind), generation, task, kind, None


def companion_in_order(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """As ``companion``, for keys of any number of events: a key's events pass in order, and only its machine is held.

    Events are dealt by key and sorted, which spills; no row and no list gathers them.
    """
    names = list(Companion.__slots__)
    kind = events.schema[key].dataType

    def run(batches):
        now, machine = None, None
        for b in batches:
            done = []
            for k, *event in zip(*(c.to_pylist() for c in b.columns[:4])):
                if machine is None or k != now:
                    if machine is not None:
                        done.append((now, *(getattr(machine, n) for n in names)))
                    now, machine = k, Companion()
                machine.hear(*event)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), schema)], schema=schema)
        if machine is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((now, *(getattr(machine, n) for n in names)), schema)], schema=schema)

    told = T.StructType([T.StructField(key, kind), *(T.StructField(n, T.LongType() if "generation" in n else T.BooleanType() if n in ("capture", "approval", "action") else T.StringType()) for n in names)])
    schema = to_arrow_schema(told)
    rows = events.select(key, "type", F.col("generation").cast("bigint").alias("generation"), "task", *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)))
    return rows.repartition(key).sortWithinPartitions(key, *(f"_o{i}" for i in range(len(order)))).mapInArrow(run, told)


def host_step(state: Column, event: Column) -> Column:
    """The host's next state; an event that has no transition changes nothing."""
    moves = F.create_map(*(F.lit(x) for (a, b), to in HOST.items() for x in (f"{a} {b}", to)))
    known = moves[F.concat_ws(" ", state, event)]
    return F.when(event == "DISPOSE", "disposed").when((event == "ERROR") & (state != "disposed"), "idle").otherwise(F.coalesce(known, state))


def host(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The host's final state for each key; events have event.

    The states are few, so an event is a map from each state to the next, and maps can be put together
    stretch by stretch: STRETCH events of a key make one map, as many of these the next, LEVELS times. No row
    gathers more of a key than that; numbering a key's events is a sort of them in one task, which spills. A key of
    more than STRETCH ** LEVELS events raises an error.
    """
    number = F.count("*").over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - 1
    numbered = events.withColumn("_n", F.when(number < STRETCH**LEVELS, number).otherwise(F.raise_error(F.lit("a key has too many events"))))
    moved = numbered.select(*key, "_n", F.array(*(host_step(F.lit(s), F.col("event")) for s in HOST_STATES)).alias("_map"))
    after = F.create_map(*(F.lit(x) for i, s in enumerate(HOST_STATES) for x in (s, i)))
    for _ in range(LEVELS):
        stretches = moved.groupBy(*key, F.floor(F.col("_n") / STRETCH).alias("_s")).agg(F.array_sort(F.collect_list(F.struct("_n", "_map"))).alias("_maps"))
        put = F.aggregate("_maps", F.array(*map(F.lit, HOST_STATES)), lambda now, m: F.transform(now, lambda s: F.get(m["_map"], after[s])))
        moved = stretches.select(*key, F.col("_s").alias("_n"), put.alias("_map"))
    return moved.select(*key, F.get("_map", F.lit(0)).alias("state"))


def leases(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds leases (open after each event) and releases (whether it closes the last one)."""
    w = W.partitionBy(*key).orderBy(*order)
    change = F.when(F.col("event") == "ACQUIRE", 1).when(F.col("event") == "RELEASE", -1).otherwise(0)
    total = F.sum(change).over(w.rowsBetween(W.unboundedPreceding, 0))
    # releases of nothing count as none: the lowest total so far is the floor
    floor = F.least(F.min("_t").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    return events.withColumn("_t", total).withColumn("leases", (F.col("_t") - floor).cast("bigint")).withColumn("releases", (F.col("event") == "RELEASE") & (F.col("leases") == 0)).drop("_t")
