"""Idle hosts and coalesced frames over several runs of their streams."""

from datetime import datetime, timedelta

from tidemark.streaming import hosts, runs

START = datetime(2024, 1, 1)


def at(minutes, key, n, event):
    return (key, START + timedelta(minutes=minutes), n, event)


def test_timers_are_armed_taken_back_and_run_out(spark, tmp_path):
    first = [at(0, 1, 1, "ACQUIRE"), at(1, 1, 2, "ACQUIRE"), at(2, 1, 3, "RELEASE"), at(20, 1, 4, "RELEASE"), at(0, 2, 5, "RELEASE"), at(1, 2, 6, "ACQUIRE"), at(2, 2, 7, "RELEASE"), at(5, 2, 8, "ACQUIRE"), at(0, 3, 9, "ACQUIRE"), at(1, 3, 10, "RELEASE"), at(25, 4, 11, "OTHER")]
    second = [at(29, 1, 12, "ACQUIRE"), at(30, 1, 13, "RELEASE"), at(40, 1, 14, "ACQUIRE"), at(60, 2, 15, "RELEASE"), at(69, 4, 16, "OTHER")]
    third = [at(200, 9, 17, "OTHER")]
    for part in (first, second, third):
        spark.createDataFrame(part, hosts.LEASES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
        out = runs.finished(spark, f"{tmp_path}/rows", hosts.LEASES, lambda s: hosts.idle_unloads(s, 600), str(tmp_path))
    found = sorted((r["user_id"], r["generation"], (r["released_at"] - START).seconds // 60, (r["unloaded_at"] - START).seconds // 60) for r in out.collect())
    # 1: taken back at 29, then run out just when it is acquired; 2: taken back at 5; 3: by the watermark alone
    assert found == [(1, 0, 30, 40), (2, 0, 60, 70), (3, 0, 1, 11)]


def test_a_frame_is_served_once(spark, tmp_path):
    rows = [(1, 0), (1, 1), (2, 9), (3, 12), (1, 25)], [(9, 3), (9, 26), (1, 45)]
    for part in rows:
        spark.createDataFrame([(u, START + timedelta(minutes=m)) for u, m in part], "user_id bigint, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
        out = runs.finished(spark, f"{tmp_path}/rows", "user_id bigint, ts timestamp", lambda s: hosts.coalesced_frames(s, "10 minutes"), str(tmp_path))
    assert sorted(((r["frame"] - START).seconds // 60, r["subscribers"], r["requests"]) for r in out.collect()) == [(0, 2, 3), (10, 1, 1), (20, 2, 2)]
