"""The scripted planner: a script's step for each session, or a wait, or the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Two scripts of (task, step, command type, referenced element ids, consequential, risk).
SCRIPTS = [
    ("t_profile_upd", 0, "type", ["e_email"], False, "low"),
    ("t_profile_upd", 1, "click", ["e_save"], True, "medium"),
    ("t_profile_upd", 2, "done", [], False, "low"),
    ("t_search_demo", 0, "click", ["e_search"], False, "low"),
    ("t_search_demo", 1, "type", ["e_search"], False, "low"),
    ("t_search_demo", 2, "extract", ["e_result"], False, "low"),
    ("t_search_demo", 3, "done", [], False, "low"),
]


def scripts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCRIPTS, "task_id string, step bigint, command string, needs array<string>, consequential boolean, risk string")


def plan(sessions: DataFrame, script: DataFrame) -> DataFrame:
    """Adds command, missing, consequential and risk to sessions (task_id, step, present).

    A step whose elements are not all present waits; a known task past its script, and an unknown
    one, are done. The script is a small fixed table and is broadcast.
    """
    known = script.select("task_id").distinct().withColumn("_known", F.lit(True))
    out = sessions.join(F.broadcast(script), ["task_id", "step"], "left").join(F.broadcast(known), "task_id", "left")
    missing = F.array_sort(F.array_except(F.coalesce("needs", F.array().cast("array<string>")), "present"))
    waits = F.size(missing) > 0
    reason = F.when(waits, "target_missing").when(F.col("command").isNotNull(), "scripted").when(F.col("_known"), "steps_exhausted").otherwise("unknown_task")
    return out.select(
        *sessions.columns, F.when(waits, "wait").when(F.col("command").isNotNull(), F.col("command")).otherwise("done").alias("command"), missing.alias("missing"),
        F.when(waits, False).otherwise(F.coalesce("consequential", F.lit(False))).alias("consequential"), F.when(waits, "low").otherwise(F.coalesce("risk", F.lit("low"))).alias("risk"), reason.alias("reason"),
    )


def referenced_ids(script: DataFrame) -> DataFrame:
    """The different element ids of each task's script."""
    return script.groupBy("task_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("needs")))).alias("ids"))
