"""Sessions: sliding expiry, bounded memory, steps, and requests matched with replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HISTORY = 5


def sliding(events: DataFrame, key: str, at: str, tie: str, ttl: str) -> DataFrame:
    """Adds session (from 1 for each key): a new one begins once ``ttl`` or more has passed without activity."""
    w = W.partitionBy(key).orderBy(at, tie)
    expired = F.coalesce(F.col(at) >= F.lag(at).over(w) + F.expr(f"interval {ttl}"), F.lit(True))
    return events.withColumn("_new", expired.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def summary(sessions: DataFrame, key: str, at: str, ttl: str, now: Column) -> DataFrame:
    """One row per session: first and last activity, events, when it expires, and whether it has by ``now``."""
    out = sessions.groupBy(key, "session").agg(F.min(at).alias("started"), F.max(at).alias("touched"), F.count("*").alias("events"))
    out = out.withColumn("expires", F.col("touched") + F.expr(f"interval {ttl}"))
    return out.withColumn("expired", now >= F.col("expires"))


def newest(rows: DataFrame, key: str, order: list[str], n: int = HISTORY) -> DataFrame:
    """The newest ``n`` rows of each key with position (1: the oldest kept). The limit is pushed below the shuffle by Spark."""
    back = W.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    kept = rows.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n)
    return kept.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("bigint")).drop("_back")


def newest_of(history: Column, n: int = HISTORY) -> Column:
    """The last ``n`` of an array in order, whatever its length."""
    return F.slice(history, F.greatest(F.lit(1), F.size(history) - (n - 1)), n)


def steps(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds step: 0 for a key's first row, one more for each."""
    return rows.withColumn("step", (F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1).cast("bigint"))


def replies(requests: DataFrame, answers: DataFrame, key: str, request_id: str, at: str, timeout: str) -> DataFrame:
    """Each request with its first answer of the same key, strictly later and within ``timeout``; null if it timed out.

    Requests and answers of a key are merged in time order and read once by a window, so a busy key
    costs a sort, not the product of its requests and answers.
    """
    r = requests.select(F.col(key), F.col(at), F.col(request_id).alias("id"), F.lit(1).alias("is_request"))
    a = answers.select(F.col(key), F.col(at), F.col(request_id).alias("id"), F.lit(0).alias("is_request"))
    both = r.unionByName(a)
    # latest first, so the frame only grows: of the strictly later instants it met last the answer that comes first
    later = W.partitionBy(key).orderBy(F.desc(F.unix_micros(F.col(at).cast("timestamp")))).rangeBetween(W.unboundedPreceding, -1)
    reply = F.last(F.when(F.col("is_request") == 0, F.struct(F.col(at).alias("at"), "id")), ignorenulls=True).over(later)
    smallest = both.withColumn("reply", reply).where("is_request = 1")
    in_time = F.col("reply.at") <= F.col(at) + F.expr(f"interval {timeout}")
    return smallest.select(F.col(key), F.col("id").alias("request"), F.col(at).alias("asked"), F.when(in_time, F.col("reply.at")).alias("answered"))


def attach_results(history: DataFrame, results: DataFrame, key: list[str], order: str) -> DataFrame:
    """History rows with the first result that names them; later ones change nothing."""
    first = results.groupBy(*key).agg(F.min_by("result", order).alias("result"))
    return history.join(first, key, "left")


def identity_rejects(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests with code: null if session, task and version agree, else why not."""
    known = sessions.select("session_id", F.col("task_id").alias("_task"), F.col("task_version").alias("_version"))
    code = (
        F.when(F.col("_task").isNull(), "session_not_found")
        .when(F.col("task_id") != F.col("_task"), "task_mismatch")
        .when(F.col("task_version") != F.col("_version"), "task_version_mismatch")
    )
    return requests.join(known, "session_id", "left").withColumn("code", code).drop("_task", "_version")
