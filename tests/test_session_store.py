"""The session store as keyed state: against its batch form, over restarts, and what it leaves behind."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.plans import contract_queries
from tidemark.streaming import runs, session_store

START = datetime(2024, 1, 1)


def rows_of(spark, told, folder, parts, ttl):
    """Runs over each part in turn, a new query each time on the same checkpoint."""
    for part in parts:
        spark.createDataFrame(part, session_store.OPERATIONS).coalesce(1).write.mode("append").parquet(f"{folder}/operations")
        out = runs.finished(spark, f"{folder}/operations", session_store.OPERATIONS, lambda s: session_store.sessions(s, ttl), folder)
    return {r["event_id"]: tuple(r)[2:] for r in out.collect()}


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_restarted_stream_tells_what_the_batch_tells(spark, sf_dir, folder):
    ops = contract_queries._operations(spark, sf_dir).select("user_id", "ts", "event_id", "op", "action_id")
    rows = [tuple(r) for r in ops.orderBy("ts", "event_id").collect()]
    cuts = [0, len(rows) // 5, len(rows) // 2, len(rows)]
    while rows[cuts[1]][1] == rows[cuts[1] - 1][1]:
        cuts[1] += 1
    while rows[cuts[2]][1] == rows[cuts[2] - 1][1]:
        cuts[2] += 1
    found = rows_of(spark, None, folder, [rows[a:b] for a, b in zip(cuts, cuts[1:])], 2 * 86_400)
    batch = store.lifecycle(ops, "user_id", ["ts", "event_id"], "ts", "2 days").collect()
    assert len(found) == len(batch) == len(rows)
    for r in batch:
        op, status, steps, memory = found[r["event_id"]]
        assert (op, status) == (r["op"], r["status"])
        if steps is not None:
            assert steps == r["plan_step"] and len([x for x in memory.split(",") if x]) == r["remembered"]
        else:
            assert status in ("session_expired", "ended")


def at(hours, key, n, op, action=None):
    return (key, START + timedelta(hours=hours), n, op, action)


def test_memory_timers_and_late_rows(spark, folder):
    first = [at(0, 1, 1, "get"), at(1, 1, 2, "create"), *(at(2 + k / 10, 1, 3 + k, "step", f"a{k}") for k in range(7)), at(3, 1, 20, "feedback", "a6"), at(3, 1, 21, "feedback", "a5"), at(3, 1, 22, "feedback", None), at(1, 2, 30, "create"), at(1, 3, 31, "create"), at(2, 3, 32, "delete")]
    second = [at(26.9, 1, 40, "get"), at(27, 1, 41, "step", "b"), at(28, 1, 42, "create"), at(28, 1, 43, "get"), at(200, 9, 44, "create"), at(2, 1, 45, "step", "late")]
    found = rows_of(spark, None, folder, [first, second], 24 * 3600)
    assert found[1] == ("get", "session_expired", None, None) and found[2] == ("create", "created", 0, "")
    assert found[9] == ("step", "ok", 7, "a2,a3,a4,a5,a6") and found[20] == ("feedback", "accepted", 7, "a2,a3,a4,a5,a6=ok")
    assert found[21][1] == found[22][1] == "invalid_request" and found[32] == ("delete", "ended", None, None)
    assert found[40] == ("get", "found", 7, "a2,a3,a4,a5,a6=ok") and found[41] == ("step", "session_expired", None, None) and found[43] == ("get", "found", 0, "")
    assert 45 not in found  # later than the watermark
    left = runs.state_of(spark, folder, "session").select("key.user_id", "value.plan_step").collect()
    assert [tuple(r) for r in left] == [(9, 0)]  # the timers of 1 and 2 have run out, 3 was deleted
    assert runs.state_of(spark, folder, "memory").count() == 0


def test_slices_are_whole_and_in_order(spark, tmp_path):
    rows = spark.range(100).select("id", F.timestamp_seconds(F.col("id") % 37).alias("ts"))
    runs.in_slices(rows, "ts", 4, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 100 and len(list((tmp_path / "a").glob("part-*.parquet"))) == 4
    runs.in_slices(rows.where("id < 0"), "ts", 4, f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 0
