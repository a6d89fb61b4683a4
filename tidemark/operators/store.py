"""The session store as relations: strict decoding of stored memory, and the life of a session as ordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text import is_opaque_id
from tidemark.operators.messages import _is, field, is_flag, is_object, is_text, one_of, text
from tidemark.operators.sessions import HISTORY
from tidemark.operators.validation import kind, parsed

# What an issued step and its result may hold.
RISKS = ("low", "medium", "high")
RESULTS = ("ok", "failed", "mismatch", "unknown")
REASONS = ("target_missing", "target_changed", "stale_observation", "binding_denied", "unsupported_control", "expectation_failed", "timeout", "cancelled", "permission_denied", "egress_blocked", "execution_error")
MODES = ("ask", "guide", "agent", "background")
# The variants of a command and the fields of each, besides its type.
COMMANDS = {
    "click": "target", "type": "target text clear_first", "select": "target option", "scroll_amount": "direction amount", "scroll_target": "to_element", "press_key": "key", "wait_duration": "ms", "wait_until": "until", "navigate": "url", "extract": "target field",
    "ask_user": "question options", "escalate": "targets question", "done": "summary", "point": "target say style advance_on", "annotate": "shapes say", "say": "text", "answer": "text citations", "switch_tab": "tab", "report": "summary items",
}
COMMAND_KEYS = sorted({"type", *(k for fields in COMMANDS.values() for k in fields.split())})
MOST_SECONDS = 1800


def _whole(value: Column) -> Column:
    """A JSON integer: neither 1.0 nor true."""
    return _is(value, "^(BIGINT|INT|SMALLINT|TINYINT)$")


def _opaque(value: Column) -> Column:
    return is_text(value) & F.coalesce(is_opaque_id(text(value)), F.lit(False))


def _given(value: Column) -> Column:
    """Whether a key is there with another value than null."""
    return F.coalesce(kind(value) != "VOID", F.lit(False))


def entries(raw: Column) -> Column:
    """The stored list of objects as variants; empty for no memory yet, null for what can't be read as such a list."""
    listed = F.try_variant_get(parsed(raw), "$", "array<variant>")
    return F.when(raw.isNull(), F.array().cast("array<variant>")).when(F.coalesce(F.forall(listed, is_object), F.lit(False)), listed)


def result_ok(value: Column) -> Column:
    reason = field(value, "reason")
    return is_object(value) & one_of(field(value, "status"), RESULTS) & is_flag(field(value, "page_changed")) & (~_given(reason) | one_of(reason, REASONS))


def entry_ok(value: Column) -> Column:
    """Whether a stored step keeps the contract: every required key, strict integers, known vocabularies and command keys."""
    numbers = _whole(field(value, "plan_step")) & _whole(field(value, "seq")) & _whole(field(value, "observation_id"))
    keys = F.map_keys(F.try_variant_get(field(value, "action"), "$", "map<string,variant>"))
    known = F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, COMMAND_KEYS)))) == 0, F.lit(False))
    expect, result = field(value, "expect"), field(value, "result")
    return (
        is_object(value) & _opaque(field(value, "action_id")) & _opaque(field(value, "doc_id")) & numbers & is_object(field(value, "action")) & known
        & is_flag(field(value, "consequential")) & one_of(field(value, "risk"), RISKS) & (~_given(expect) | is_object(expect)) & (~_given(result) | result_ok(result))
    )


def decoded(raw: Column) -> Column:
    """The memory as an array of steps; one bad step voids the whole list (null)."""
    told = entries(raw)
    number = lambda e, k: F.try_variant_get(e, f"$.{k}", "bigint")

    def step(e: Column) -> Column:
        result = field(e, "result")
        shown = F.struct(text(field(result, "status")).alias("status"), F.try_variant_get(result, "$.page_changed", "boolean").alias("page_changed"), F.when(_given(field(result, "reason")), text(field(result, "reason"))).alias("reason"))
        return F.struct(
            text(field(e, "action_id")).alias("action_id"), *(number(e, k).alias(k) for k in ("plan_step", "seq")), text(field(e, "doc_id")).alias("doc_id"), number(e, "observation_id").alias("observation_id"),
            field(e, "action").alias("action"), F.try_variant_get(e, "$.consequential", "boolean").alias("consequential"), text(field(e, "risk")).alias("risk"),
            F.when(_given(field(e, "expect")), field(e, "expect")).alias("expect"), F.when(_given(result), shown).alias("result"),
        )

    return F.when(told.isNotNull() & F.forall(told, entry_ok), F.transform(told, step))


def stored(history: Column) -> Column:
    """A decoded memory as the JSON to store: absent keys instead of nulls; an empty memory is not stored at all."""
    return F.when(F.size(history) > 0, F.to_json(history))


def record_ok(r: Column) -> Column:
    """Whether a stored session can be read: all identity fields, right ids, a known mode, a two-valued flag, numbers that are some."""
    domains = F.try_variant_get(parsed(r["allowed_domains"]), "$", "array<variant>")
    whole = lambda c: r[c].isNull() | r[c].rlike(r"^\s*[+-]?\d+(_\d+)*\s*$")
    there = F.lit(True)
    for c in ("task_id", "task_version", "created_at", "task_text", "allowed_domains", "mode", "read_only"):
        there = there & r[c].isNotNull()
    ids = is_opaque_id(r["task_id"]) & (r["doc_id"].isNull() | is_opaque_id(r["doc_id"])) & (F.coalesce(r["last_action_id"], F.lit("")).isin("") | is_opaque_id(r["last_action_id"]))
    numbers = whole("task_version") & whole("seq") & whole("observation_id") & whole("plan_step") & F.trim(r["created_at"]).try_cast("double").isNotNull()
    good = there & ids & r["mode"].isin(*MODES) & r["read_only"].isin("0", "1") & F.forall(domains, is_text) & numbers & decoded(r["history"]).isNotNull()
    return F.coalesce(good, F.lit(False))


def prompt_context(records: DataFrame) -> DataFrame:
    """The seven fields of stored sessions that a prompt may show; sessions that can't be read are missing."""
    r = F.struct(*records.columns)
    good = records.where(record_ok(r))
    domains = F.try_variant_get(parsed(F.col("allowed_domains")), "$", "array<string>")
    return good.select("session_id", "task_id", F.trim("task_version").cast("bigint").alias("task_version"), "task_text", domains.alias("allowed_domains"), "mode", (F.col("read_only") == "1").alias("read_only"), decoded(F.col("history")).alias("history"))


def variants(commands: DataFrame) -> DataFrame:
    """Adds fits to commands (variants as ``command``): the kinds of command whose fields hold all of its keys, by name."""
    keys = F.map_keys(F.try_variant_get("command", "$", "map<string,variant>"))
    fits = [F.when(F.size(F.array_except(keys, F.array(*map(F.lit, ["type", *fields.split()])))) == 0, name) for name, fields in sorted(COMMANDS.items())]
    return commands.withColumn("fits", F.array_compact(F.array(*fits)))


def settings_ok(seconds: Column, body_bytes: Column) -> Column:
    return F.coalesce(seconds.between(1, MOST_SECONDS) & (body_bytes >= 1), F.lit(False))


def lifecycle(ops: DataFrame, session: str, order: list[str], at: str, ttl: str) -> DataFrame:
    """Adds ``(status, plan_step, remembered)`` to operations (op, action_id) on sessions, in order.

    create begins a session anew, whatever was there. step and feedback keep it alive for another
    ``ttl``; get and escalate don't. feedback must name the last issued step. A session is gone from
    the first operation that comes ``ttl`` or more after the last refresh, or after delete, until it is created again. plan_step
    counts the steps so far, remembered how many of them are kept. Every session's operations are
    sorted once and read by running windows: no operation looks at more than the state before it.
    """
    by = W.partitionBy(session).orderBy(*order)
    out = ops.withColumn("_life", F.sum(F.when(F.col("op") == "create", 1).otherwise(0)).over(by.rowsBetween(W.unboundedPreceding, 0)))
    of = W.partitionBy(session, "_life").orderBy(*order)
    before = of.rowsBetween(W.unboundedPreceding, -1)
    last_action = F.last(F.when(F.col("op") == "step", F.col("action_id")), ignorenulls=True).over(before)
    out = out.withColumn("_match", F.coalesce((F.col("op") == "feedback") & (F.col("action_id") == last_action), F.lit(False)))
    refresh = F.when(F.col("op").isin("create", "step") | F.col("_match"), F.col(at))
    out = out.withColumn("_alive_at", F.last(refresh, ignorenulls=True).over(before)).withColumn("_ended", F.coalesce(F.max(F.col("op") == "delete").over(before), F.lit(False)))
    out = out.withColumn("_late", F.coalesce(F.col(at) >= F.col("_alive_at") + F.expr(f"interval {ttl}"), F.lit(False)))
    out = out.withColumn("_gone", (F.col("_life") == 0) | F.col("_ended") | F.max("_late").over(of.rowsBetween(W.unboundedPreceding, 0)))
    op = F.col("op")
    status = (
        F.when(op == "create", "created").when(F.col("_gone"), "session_expired").when(op == "step", "ok").when(op == "get", "found").when(op == "delete", "ended")
        .when(op == "escalate", "unavailable").when(F.col("_match"), "accepted").otherwise("invalid_request")
    )
    out = out.withColumn("status", status)
    steps = F.sum(F.when((op == "step") & ~F.col("_gone"), 1).otherwise(0)).over(of.rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("plan_step", steps.cast("bigint"))
    return out.withColumn("remembered", F.least(F.col("plan_step"), F.lit(HISTORY).cast("bigint"))).drop("_life", "_match", "_alive_at", "_ended", "_late", "_gone")


def step_gate(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds code to step requests: why one is refused, in the order of the checks, or null.

    The path's id, the session, the body's id, the task and its version, and last a screen that is no full one.
    """
    known = sessions.select(F.col("session_id").alias("path_id"), F.col("task_id").alias("_task"), F.col("task_version").alias("_version"))
    code = (
        F.when(~is_opaque_id(F.col("path_id")), "invalid_request").when(F.col("_task").isNull(), "session_expired")
        .when(~F.col("session_id").eqNullSafe(F.col("path_id")), "invalid_request").when(~F.col("task_id").eqNullSafe(F.col("_task")) | ~F.col("task_version").eqNullSafe(F.col("_version")), "invalid_request")
        .when(F.col("kind") != "full", "resync_required")
    )
    return requests.join(known, "path_id", "left").withColumn("code", code).drop("_task", "_version")
