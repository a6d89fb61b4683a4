"""Incremental passes: limits, unstable passes, restarts, and what they recompute."""

import pytest

from tidemark.streaming import incremental, runs

COLUMNS = [c.strip().split(" ")[0] for c in incremental.RECORDS.split(",")]


def rec(page, batch, seq, kind, node=None, **more):
    row = dict.fromkeys(COLUMNS) | {"page_id": page, "batch": batch, "seq": seq, "kind": kind, "node": node, "size": 0 if kind == "extract" else 1} | more
    return tuple(row[c] for c in COLUMNS)


def add(page, batch, seq, node, tag="button", parent=None, text="", **more):
    return rec(page, batch, seq, "add", node, tag=tag, parent=parent, text=text, disabled=False, **more)


def observed(spark, folder, parts, **limits):
    for part in parts:
        spark.createDataFrame(part, incremental.RECORDS).coalesce(1).write.mode("append").parquet(f"{folder}/records")
        out = runs.finished(spark, f"{folder}/records", incremental.RECORDS, lambda s: incremental.observations(s, **limits), folder)
    rows = out.collect()
    passes = {(r["page_id"], r["batch"]): (r["status"], r["observation"], r["is_full"], r["recomputed"]) for r in rows if r["node"] is None}
    changes = sorted((r["page_id"], r["batch"], r["node"], r["change"], r["name"]) for r in rows if r["node"] is not None)
    return passes, changes


FIRST = [add(1, 0, 1, 100, "div"), add(1, 0, 2, 1, text="Save", parent=100), add(1, 0, 3, 2, "p", text="Title", parent=100), add(1, 0, 4, 3, "a", labelled_by=2), add(1, 0, 5, 4, "input", label="Mail", parent=100), add(1, 0, 6, 5, "a", labelled_by=100), rec(1, 0, 7, "extract")]


def test_only_what_a_change_can_reach_is_looked_at(spark, tmp_path):
    later = [
        [rec(1, 1, 10, "text", 2, text="New title"), rec(1, 1, 11, "extract")],  # names 3 and 5 come from it
        [rec(1, 2, 20, "attribute", 4, field="label", label="Post"), rec(1, 2, 21, "extract", size=1)],  # unstable: nothing is committed
        [rec(1, 3, 30, "extract"), rec(1, 4, 40, "extract")],
        [rec(1, 5, 50, "remove", 100), rec(1, 5, 51, "text", 2, text="gone"), rec(1, 5, 52, "extract")],
        [rec(1, 6, 60, "attribute", 5, field="style"), rec(1, 6, 61, "extract"), rec(1, 7, 70, "layout"), rec(1, 7, 71, "extract")],
    ]
    passes, changes = observed(spark, str(tmp_path), [FIRST, *later])  # each part restarts the stream
    assert passes == {
        (1, 0): ("complete", 1, True, 4), (1, 1): ("complete", 2, False, 2), (1, 2): ("unstable", 2, False, 0), (1, 3): ("complete", 3, False, 2), (1, 4): ("complete", 4, False, 0),
        (1, 5): ("complete", 5, False, 2), (1, 6): ("complete", 6, True, 2), (1, 7): ("complete", 7, True, 2),
    }
    assert changes == [
        (1, 0, 1, "added", "Save"), (1, 0, 3, "added", "Title"), (1, 0, 4, "added", "Mail"), (1, 0, 5, "added", "Save Title"), (1, 1, 3, "changed", "New title"), (1, 1, 5, "changed", "Save New title"),
        (1, 3, 4, "changed", "Post"), (1, 5, 1, "removed", None), (1, 5, 3, "changed", ""), (1, 5, 4, "removed", None), (1, 5, 5, "changed", ""),
    ]
    left = runs.state_of(spark, str(tmp_path), "entries").count()
    assert left == 2


def test_overflow_reconcile_and_limits(spark, tmp_path):
    many = [rec(1, 1, 10 + k, "text", 2, text=f"t{k}") for k in range(5)] + [rec(1, 1, 20, "extract")]
    large = [rec(1, 2, 30, "text", 2, text="x", size=9), rec(1, 2, 31, "extract"), rec(1, 3, 32, "extract"), rec(1, 4, 33, "extract")]
    passes, _ = observed(spark, str(tmp_path), [FIRST, many + large], max_records=4, reconcile_every=4)
    assert passes == {(1, 0): ("complete", 1, True, 4), (1, 1): ("complete", 2, True, 4), (1, 2): ("complete", 3, True, 4), (1, 3): ("complete", 4, False, 0), (1, 4): ("complete", 5, True, 4)}
    passes, changes = observed(spark, f"{tmp_path}/b", [FIRST, [rec(1, 1, 10, "remove", 100), rec(1, 1, 11, "extract")]], max_entries=3)
    assert passes == {(1, 0): ("limited", 0, True, 0), (1, 1): ("complete", 1, True, 2)} and [c[2] for c in changes] == [3, 5]
    with pytest.raises(ValueError):
        incremental.observations(spark.createDataFrame([], incremental.RECORDS), max_records=0)
