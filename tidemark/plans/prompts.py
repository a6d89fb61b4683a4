"""Deterministic text renderings of tasks, memory, elements and screens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import boolean, key_token, number, quoted
from tidemark.operators.sessions import HISTORY, newest_of
from tidemark.operators.validation import kind

# What the planner is asked for, and the headings and sentences of the sections below.
INSTRUCTION = "Return exactly one next action."
# The state flags in the order in which a line lists them.
FLAGS = ("disabled", "checked", "selected", "expanded", "required", "readonly", "focused", "invalid", "occluded")


def value_token(state: Column, value: Column) -> Column:
    """No value, an empty one, a visible one, or a placeholder."""
    return (
        F.when(state.isNull(), "=NONE")
        .when(state == "empty", "=EMPTY")
        .when(state == "filled", F.concat(F.lit("=FILLED:"), quoted(value)))
        .when(state == "redacted", F.concat(F.lit("=REDACTED:"), value))
    )


def state_flags(state: Column, flags: tuple[str, ...] = FLAGS) -> Column:
    """Only the flags that are set, true or false, in their order."""
    return F.array_join(F.array_compact(F.array(*(F.when(state[f].isNotNull(), F.concat(F.lit(f"{f}="), boolean(state[f]))) for f in flags))), ",")


def element_line(e: Column, flags: tuple[str, ...] = FLAGS) -> Column:
    """One line for an element struct; parts that are absent leave nothing."""

    def part(before: str, value: Column, shown: Column | None = None) -> Column:
        return F.when(value.isNotNull() if shown is None else shown, F.concat(F.lit(before), value)).otherwise("")

    box = F.concat_ws(",", *(number(e["bbox"][k]) for k in "xywh"))
    told = state_flags(e["state"], flags)
    return F.concat(
        F.lit("["), e["id"], F.lit("] "), e["role"], F.lit(" "), quoted(e["name"]),
        part(" input=", e["input_type"]),
        F.lit(" src="), e["src"], F.lit(" conf="), F.format_string("%.2f", e["conf"]), F.lit(" @"), box, F.lit(" "),
        value_token(e["value_state"], e["value"]),
        part(" pii=", e["pii_class"], F.coalesce(e["value_state"] == "redacted", F.lit(False))),
        part(" landmark=", quoted(e["landmark"]), e["landmark"].isNotNull()),
        part(" image=", e["image"]),
        F.when(F.coalesce(told, F.lit("")) != "", F.concat(F.lit(" state=["), told, F.lit("]"))).otherwise(""),
        F.when(F.coalesce(e["suspicious"], F.lit(False)), " !suspicious").otherwise(""),
    )


def task_section(t: Column) -> Column:
    domains = F.concat(F.lit("["), F.array_join(F.transform(t["domains"], quoted), ","), F.lit("]"))
    return F.concat_ws(
        "\n", F.lit("== TASK =="), F.concat(F.lit("task="), t["task_id"], F.lit("@"), t["task_version"].cast("string")), F.concat(F.lit("mode="), t["mode"]),
        F.concat(F.lit("read_only="), boolean(t["read_only"])), F.concat(F.lit("allowed_domains="), domains), F.concat(F.lit("task_text="), quoted(t["task_text"])),
    )


def command_line(command: Column) -> Column:
    """A command map (key to rendered scalar): ``type`` first, the others by key."""
    rest = F.transform(F.array_sort(F.filter(F.map_keys(command), lambda k: k != "type")), lambda k: F.concat(key_token(k), F.lit("="), command[k]))
    first = F.when(command["type"].isNotNull(), F.array(F.concat(F.lit("type="), command["type"]))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(first, rest), " ")


def outcome(result: Column) -> Column:
    told = F.concat(result["status"], F.lit(" page_changed="), boolean(result["page_changed"]), F.coalesce(F.concat(F.lit(" reason="), result["reason"]), F.lit("")))
    return F.when(result.isNull(), "pending").otherwise(told)


def memory_section(history: Column, line) -> Column:
    """The newest steps, oldest first and numbered from 1; ``line`` renders an entry."""
    kept = newest_of(history)
    lines = F.transform(kept, lambda e, i: F.concat((i + 1).cast("string"), F.lit(") "), line(e)))
    head = F.concat(F.lit(f"== MEMORY (last {HISTORY} steps) ==\nsteps ("), F.size(kept).cast("string"), F.lit(f" of {HISTORY})\n"))
    return F.concat(head, F.when(F.size(kept) == 0, "(no prior steps)").otherwise(F.array_join(lines, "\n")))


def page_line(p: Column) -> Column:
    v = p["viewport"]
    extra = [F.when(v[k].isNotNull(), F.concat(F.lit(f" {k}="), number(v[k]))).otherwise("") for k in ("scroll_x", "page_w")]
    return F.concat(F.lit("page url="), quoted(p["url"]), F.lit(" title="), quoted(p["title"]), F.lit(" viewport="), F.concat_ws(",", *(number(v[k]) for k in ("w", "h", "scroll_y", "page_h"))), *extra)


def listed(title: str, lines: Column) -> Column:
    """A counted list; an empty one says so."""
    head = F.concat(F.lit(f"{title} ("), F.size(lines).cast("string"), F.lit("):\n"))
    return F.concat(head, F.when(F.size(lines) == 0, "(none)").otherwise(F.array_join(lines, "\n")))


def _spaced(value: Column, depth: int) -> Column:
    """A variant as JSON with a space after each comma and colon, keys in order; ``depth`` levels deep at most."""
    plain = F.to_json(value)
    if not depth:
        return plain
    items, fields = F.try_variant_get(value, "$", "array<variant>"), F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(items, lambda v: _spaced(v, depth - 1)), ", "), F.lit("]"))
    shown = F.transform(F.array_sort(fields, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), _spaced(e["value"], depth - 1)))
    kept = F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}"))
    return F.when(kind(value).startswith("ARRAY"), listed).when(kind(value).startswith("OBJECT"), kept).otherwise(plain)


def scalar(value: Column, depth: int = 2) -> Column:
    """One value of a command: strings quoted, whole numbers without decimals, lists and objects as one line of JSON."""
    k = kind(value)
    numeric = k.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$")
    return F.when(k == "VOID", "null").when(k == "STRING", quoted(F.try_variant_get(value, "$", "string"))).when(numeric, number(F.try_variant_get(value, "$", "double"))).otherwise(_spaced(value, depth))


def action_command(command: Column) -> Column:
    """A command variant on one line: its type, then the other keys in order."""
    return command_line(F.transform_values(F.try_variant_get(command, "$", "map<string,variant>"), lambda k, v: scalar(v)))


def screen_section(s: Column, flags: tuple[str, ...] = FLAGS) -> Column:
    """A full screen as text, in the order in which it came; what it doesn't have leaves no line."""

    def line(there: Column, *parts: Column) -> Column:
        return F.when(there, F.concat(*parts))

    result, turn, act = s["last_action_result"], s["user_turn"], s["user_interaction"]
    told = F.array(
        F.lit("== SCREEN STATE =="),
        F.concat(F.lit("protocol="), s["protocol"], F.lit(" session="), s["session_id"], *(x for k, n in (("seq", "seq"), ("doc", "doc_id"), ("obs", "observation_id"), ("step", "step"), ("kind", "kind")) for x in (F.lit(f" {k}="), s[n].cast("string")))),
        page_line(s["page"]),
        F.concat(F.lit("redaction_scheme="), s["redaction_scheme"], F.lit(" mode="), s["mode"], F.lit(" suspicious="), boolean(s["suspicious"])),
        listed("elements", F.transform(s["elements"], lambda e: element_line(e, flags))),
        listed("text_context", F.transform(s["text_context"], lambda t, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), quoted(t)))),
        line(result.isNotNull(), F.lit("last_action_result action_id="), result["action_id"], F.lit(" status="), result["status"], F.lit(" page_changed="), boolean(result["page_changed"]), F.coalesce(F.concat(F.lit(" reason="), result["reason"]), F.lit(""))),
        line(turn.isNotNull(), F.lit("user_turn source="), turn["source"], F.lit(" interrupt="), boolean(turn["interrupt"]), F.lit(" text="), quoted(turn["text"])),
        line(act.isNotNull(), F.lit("user_interaction type="), act["type"], F.lit(" after_step="), act["after_step"], F.coalesce(F.concat(F.lit(" target="), act["target"]), F.lit(""))),
    )
    tabs = F.transform(F.coalesce(s["tabs"], F.array().cast("array<struct<tab:string,title:string,digest:string>>")), lambda t: F.concat(F.lit("[tab] id="), t["tab"], F.lit(" title="), quoted(t["title"]), F.lit(" digest="), quoted(t["digest"])))
    return F.array_join(F.concat(F.array_compact(told), tabs), "\n")


def user_message(screen_kind: Column, task: Column, memory: Column, screen: Column, instruction: str = INSTRUCTION) -> Column:
    """The four sections, one after the other; null for a screen that is not full: those are refused, not rendered."""
    return F.when(screen_kind == "full", F.concat_ws("\n", task, memory, screen, F.lit(f"== INSTRUCTION ==\n{instruction}")))


def messages(system: Column, user: Column) -> Column:
    """Exactly two messages, whatever the texts hold; null where there is no user message."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.when(user.isNotNull(), F.array(one("system", system), one("user", user)))


def failure_reason(name: Column) -> Column:
    """What a failed prompt is logged as: the error's name if it is a plain one, else a fixed word."""
    return F.concat(F.lit("stage=prompt detail="), F.when(name.rlike(r"\A[A-Za-z_][A-Za-z0-9_]{0,63}\z"), name).otherwise("exception"))
