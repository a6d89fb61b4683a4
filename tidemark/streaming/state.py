"""Streaming forms of the session operators; each gives its batch operator's rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events_stream(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def sliding_sessions(events: DataFrame, ttl_seconds: int, watermark: str = "0 seconds") -> DataFrame:
    """Closed sessions ``(user_id, started, touched, events)`` from a stream of (user_id, ts).

    A session ends when ``ttl_seconds`` or more pass without activity. The open session of a key is its
    only state; a timer at its expiry closes it once the watermark gets there. Events of a batch are
    taken in time order.
    """
    ttl = pd.Timedelta(seconds=ttl_seconds)
    out = "user_id long, started timestamp, touched timestamp, events long"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed = []
        if state.hasTimedOut:
            first, last, n = state.get
            closed.append((key[0], pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), n))
            state.remove()
        else:
            frames = list(parts)
            times = sorted(t for f in frames for t in f["ts"])
            now = list(state.get) if state.exists else None
            for t in times:
                us = t.value // 1000
                if now and us >= now[1] + ttl.value // 1000:
                    closed.append((key[0], pd.Timestamp(now[0], unit="us"), pd.Timestamp(now[1], unit="us"), now[2]))
                    now = None
                now = [us, us, 1] if now is None else [now[0], max(now[1], us), now[2] + 1]
            if now:
                state.update(tuple(now))
                due = (now[1] + ttl.value // 1000) // 1000
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(closed, columns=["user_id", "started", "touched", "events"])

    return events.withWatermark("ts", watermark).groupBy("user_id").applyInPandasWithState(step, out, "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def memory(rows: DataFrame, key: str, order: str, value: str, limit: int = 5) -> DataFrame:
    """The newest ``limit`` values of each key after each batch, oldest first; the state is those values."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for f in parts:
            held += list(zip(f[order].tolist(), f[value].tolist()))
        held = sorted(held)[-limit:]
        state.update(([o for o, _ in held], [v for _, v in held]))
        yield pd.DataFrame({key: [k[0]], "orders": [[o for o, _ in held]], "items": [[v for _, v in held]]})

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, orders array<long>, items array<string>", "orders array<long>, items array<string>", "update", GroupStateTimeout.NoTimeout)


def placeholders(values: DataFrame, entries: int = 500) -> DataFrame:
    """``(scope, pii_class, value, placeholder)`` for new values of a stream of (scope, seq, pii_class, value).

    A scope's state is its values in order of arrival, ``entries`` at most; known values keep their
    placeholder, values past the capacity have none.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        classes, known = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        held = {(c, v): n for n, (c, v) in enumerate(zip(classes, known))}
        count = {c: classes.count(c) for c in set(classes)}
        out = []
        for row in pd.concat(list(parts)).sort_values("seq").itertuples():
            k = (row.pii_class, row.value)
            if row.pii_class == "secret":
                out.append((key[0], *k, "{{SECRET}}"))
            elif k not in held:
                if len(known) < entries:
                    held[k] = len(known)
                    classes.append(k[0])
                    known.append(k[1])
                    count[k[0]] = count.get(k[0], 0) + 1
                    out.append((key[0], *k, f"{{{{{k[0].upper()}_{count[k[0]]}}}}}"))
                else:
                    out.append((key[0], *k, None))
        state.update((classes, known))
        yield pd.DataFrame(out, columns=["scope", "pii_class", "value", "placeholder"])

    return values.groupBy("scope").applyInPandasWithState(step, "scope string, pii_class string, value string, placeholder string", "classes array<string>, items array<string>", "append", GroupStateTimeout.NoTimeout)


def matched_replies(requests: DataFrame, answers: DataFrame, timeout: str, lateness: str = "1 minute") -> DataFrame:
    """Requests joined with answers of the same id and peer within ``timeout``: a stream-stream join with bounded state."""
    r = requests.withWatermark("asked", lateness)
    a = answers.select(F.col("id").alias("_id"), F.col("peer").alias("_peer"), "answered").withWatermark("answered", lateness)
    on = (F.col("id") == F.col("_id")) & (F.col("peer") == F.col("_peer")) & (F.col("answered") > F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"interval {timeout}"))
    # one event time goes on: that of the request; the answer's is from here on a plain instant
    both = r.join(a, on).drop("_id", "_peer").withColumn("answered", F.col("answered") + F.expr("interval 0 seconds"))
    return both.dropDuplicatesWithinWatermark(["id"])


def to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over all there is into an in-memory table, and waits; for tests and small outputs."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
