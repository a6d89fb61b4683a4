"""Streaming forms give the rows of their batch operators."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import privacy, sessions
from tidemark.streaming import state


def in_files(spark, rows, schema, folder, parts=3):
    df = spark.createDataFrame(rows, schema)
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return df


def test_closed_sessions_equal_the_batch(spark, tmp_path):
    t, rows = datetime(2026, 1, 1), []
    for i in range(60):
        rows.append((i % 3, t + timedelta(seconds=i * 20 + (900 if i >= 30 else 0))))
    rows.append((9, t + timedelta(days=2)))
    df = in_files(spark, rows, "user_id bigint, ts timestamp", tmp_path / "in")
    stream = state.sliding_sessions(state.events_stream(spark, str(tmp_path / "in"), "user_id bigint, ts timestamp"), 600)
    state.to_table(stream, "closed_sessions", str(tmp_path / "c"))
    got = {tuple(r) for r in spark.table("closed_sessions").where("user_id < 9").collect()}
    numbered = sessions.sliding(df.withColumn("n", F.monotonically_increasing_id()), "user_id", "ts", "n", "600 seconds")
    want = {(r["user_id"], r["started"], r["touched"], r["n"]) for r in numbered.where("user_id < 9").groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("touched"), F.count("*").alias("n")).collect()}
    assert got == want


def test_memory_holds_the_newest_five(spark, tmp_path):
    rows = [(i % 2, i, f"v{i}") for i in range(15)]
    in_files(spark, rows, "k bigint, n bigint, v string", tmp_path / "in")
    state.to_table(state.memory(state.events_stream(spark, str(tmp_path / "in"), "k bigint, n bigint, v string"), "k", "n", "v"), "newest_values", str(tmp_path / "c"), "update")
    last = spark.table("newest_values").groupBy("k").agg(F.max_by("items", F.array_max("orders")).alias("items"))
    assert {r["k"]: r["items"] for r in last.collect()} == {0: ["v6", "v8", "v10", "v12", "v14"], 1: ["v5", "v7", "v9", "v11", "v13"]}


def test_placeholders_equal_the_batch(spark, tmp_path):
    rows = [("s", i, "email" if i % 3 else "phone", f"v{i % 7}") for i in range(30)] + [("s", 99, "secret", "k")]
    df = in_files(spark, rows, "scope string, seq bigint, pii_class string, value string", tmp_path / "in", 1)
    state.to_table(state.placeholders(state.events_stream(spark, str(tmp_path / "in"), "scope string, seq bigint, pii_class string, value string"), entries=10), "interned_values", str(tmp_path / "c"))
    got = {(r["pii_class"], r["value"]): r["placeholder"] for r in spark.table("interned_values").collect()}
    want = {(r["pii_class"], r["value"]): r["placeholder"] for r in privacy.intern(df, ["scope"], "pii_class", "value", ["seq"], entries=10).collect()}
    assert got == want


def test_replies_match_once_and_in_time(spark, tmp_path):
    t = datetime(2026, 1, 1)
    asked = [("a", "p", t), ("b", "p", t), ("c", "p", t + timedelta(seconds=5)), ("d", "q", t)]
    answers = [("a", "p", t + timedelta(seconds=2)), ("a", "p", t + timedelta(seconds=3)), ("b", "p", t + timedelta(seconds=9)), ("c", "p", t + timedelta(seconds=5)), ("d", "p", t + timedelta(seconds=1))]
    in_files(spark, asked, "id string, peer string, asked timestamp", tmp_path / "asked", 1)
    in_files(spark, answers, "id string, peer string, answered timestamp", tmp_path / "answers", 1)
    requests = state.events_stream(spark, str(tmp_path / "asked"), "id string, peer string, asked timestamp")
    replies = state.events_stream(spark, str(tmp_path / "answers"), "id string, peer string, answered timestamp")
    state.to_table(state.matched_replies(requests, replies, "5 seconds"), "matched_replies", str(tmp_path / "c"))
    assert [r["id"] for r in spark.table("matched_replies").collect()] == ["a"]
