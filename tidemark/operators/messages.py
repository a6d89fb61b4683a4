"""Bus messages as variants: endpoints, envelopes, payload rules by operation, and error bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import is_opaque_id
from tidemark.operators.validation import ERRORS, PROTOCOL, SAFE_INTEGER, integer, kind

# The contexts, message types, task states, result statuses and error codes of the bus.
CONTEXTS = ("background", "content", "offscreen", "worker", "ui")
TYPES = ("request", "response", "error")
TASK_STATES = ("idle", "running", "paused", "done", "failed")
STATUSES = ("ok", "empty", "unavailable")
BUS_CODES = ("TIMEOUT", "HANDLER_ERROR", "UNSUPPORTED_OPERATION", "MALFORMED_MESSAGE", "WRONG_ENDPOINT", "DISCONNECTED", "RECEIVER_NOT_FOUND", "UNSUPPORTED_PAYLOAD", "UNAUTHORIZED")
BROWSERS = ("chrome", "firefox")
INFERENCE = ("inference:runDetector", "inference:runOCR", "inference:runFaces", "inference:runIcons")
CORRELATION = ("session_id", "task_id", "task_version", "seq")


def field(message: Column, key: str) -> Column:
    """A key's value as a variant: SQL null if it is absent, a variant null if it is given as null."""
    return F.try_variant_get(message, f"$.{key}", "variant")


def _is(value: Column, pattern: str) -> Column:
    return F.coalesce(kind(value).rlike(pattern), F.lit(False))


def is_text(value: Column) -> Column:
    return _is(value, "^STRING$")


def is_flag(value: Column) -> Column:
    return _is(value, "^BOOLEAN$")


def is_number(value: Column) -> Column:
    return _is(value, r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$")


def is_object(value: Column) -> Column:
    return _is(value, "^OBJECT<")


def text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def amount(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    return is_text(value) & F.coalesce(text(value).isin(*allowed), F.lit(False))


def has_word(value: Column) -> Column:
    """A string with a character that is no white space, Unicode's included."""
    return is_text(value) & F.coalesce(text(value).rlike(r"[^\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"), F.lit(False))


def at_least(value: Column, least: float, open_end: bool = False) -> Column:
    enough = amount(value) > least if open_end else amount(value) >= least
    return is_number(value) & F.coalesce(enough, F.lit(False))


def optional(value: Column, rule: Column) -> Column:
    return value.isNull() | rule


def is_endpoint(value: Column) -> Column:
    """A known context; tab and frame, where given, are whole numbers from 0."""
    tab, frame = field(value, "tabId"), field(value, "frameId")
    return is_object(value) & one_of(field(value, "context"), CONTEXTS) & optional(tab, integer(tab)) & optional(frame, integer(frame))


def matches_endpoint(actual: Column, expected: Column) -> Column:
    """Whether two (context, tab, frame) structs are one endpoint: a content script's frame is 0 unless told."""

    def told(e: Column) -> Column:
        return F.struct(e["context"].alias("c"), e["tab"].alias("t"), F.when(e["context"] == "content", F.coalesce(e["frame"], F.lit(0).cast("bigint"))).otherwise(e["frame"]).alias("f"))

    return told(actual).eqNullSafe(told(expected))


def is_envelope(message: Column) -> Column:
    """Id, operation, type, time and both endpoints are right; an error also has a known code and a message."""
    error = field(message, "error")
    told = is_object(error) & one_of(field(error, "code"), BUS_CODES) & is_text(field(error, "message"))
    head = has_word(field(message, "id")) & has_word(field(message, "operation")) & one_of(field(message, "type"), TYPES) & is_number(field(message, "timestamp"))
    ends = is_endpoint(field(message, "source")) & is_endpoint(field(message, "destination"))
    return F.coalesce(is_object(message) & head & ends & ((text(field(message, "type")) != "error") | told), F.lit(False))


def payload_ok(operation: Column, direction: Column, payload: Column) -> Column:
    """The rules of each operation's requests and responses; an operation without rules takes any object."""
    f = {k: field(payload, k) for k in "timestamp echo context width height frame region status synthetic itemCount durationMs docId elementCount probe active taskId state consumer leaseId generation released remainingLeases activeLeases browser".split()}
    asks = direction == "request"
    items = F.try_variant_get(f["region"], "$", "array<variant>")
    region = optional(f["region"], F.coalesce((F.size(items) == 4) & F.forall(items, is_number), F.lit(False)))
    ping = is_number(f["timestamp"]) & optional(f["echo"], is_text(f["echo"])) & (asks | one_of(f["context"], CONTEXTS))
    image = at_least(f["width"], 0, True) & at_least(f["height"], 0, True) & one_of(f["frame"], ("image", "crop")) & region
    result = one_of(f["status"], STATUSES) & is_flag(f["synthetic"]) & F.coalesce(F.try_variant_get(f["synthetic"], "$", "boolean"), F.lit(False)) & at_least(f["itemCount"], 0) & at_least(f["durationMs"], 0)
    optional_doc = optional(f["docId"], is_text(f["docId"]))
    rules = {
        "ping": (ping, ping),
        **{op: (image, result) for op in INFERENCE},
        "dom:walk": (optional_doc, is_text(f["docId"]) & at_least(f["elementCount"], 0) & is_number(f["timestamp"])),
        "dom:probe": (is_flag(f["probe"]), is_flag(f["active"]) & optional_doc),
        "task:status": (has_word(f["taskId"]), has_word(f["taskId"]) & one_of(f["state"], TASK_STATES)),
        "host:acquire": (is_text(f["consumer"]), is_text(f["leaseId"]) & is_number(f["generation"])),
        "host:release": (is_text(f["leaseId"]), is_flag(f["released"]) & is_number(f["remainingLeases"])),
        "host:status": (F.lit(True), is_text(f["state"]) & is_number(f["generation"]) & is_number(f["activeLeases"]) & one_of(f["browser"], BROWSERS)),
    }
    told = F.when(~is_object(payload), False)
    for op, (request, response) in rules.items():
        told = told.when(operation == op, F.when(asks, request).otherwise(response))
    return F.coalesce(told.otherwise(True), F.lit(False))


def correlation(message: Column) -> Column:
    """The four fields that an error may repeat, each only if it is set; nothing else is copied."""
    set_ = lambda k: F.when(kind(field(message, k)) != "VOID", field(message, k))
    return F.struct(*(set_(k).alias(k) for k in CORRELATION))


def correlation_ok(told: Column) -> Column:
    """Whether the fields that are set keep the contract: opaque ids, counters from 1."""
    ids = [optional(told[k], is_text(told[k]) & F.coalesce(is_opaque_id(text(told[k])), F.lit(False))) for k in CORRELATION[:2]]
    numbers = [optional(told[k], integer(told[k], 1, SAFE_INTEGER)) for k in CORRELATION[2:]]
    return ids[0] & ids[1] & numbers[0] & numbers[1]


def error_body(code: Column, told: Column) -> Column:
    """``(status, body)`` of an error: with its correlation if that keeps the contract, else without; absent fields are left out."""
    status = F.create_map(*(F.lit(x) for c, s, _ in ERRORS for x in (c, s)))
    retry = F.create_map(*(F.lit(x) for c, _, r in ERRORS for x in (c, r)))
    kept = {k: F.when(correlation_ok(told), told[k]) for k in CORRELATION}
    shown = [F.try_variant_get(kept[k], "$", "string" if k in CORRELATION[:2] else "bigint").alias(k) for k in CORRELATION]
    body = F.to_json(F.struct(F.lit(PROTOCOL).alias("protocol"), *shown, code.alias("code"), retry[code].alias("retryable")))
    return F.struct(status[code].cast("bigint").alias("status"), body.alias("body"))


def element_ids(command: Column, keys: tuple[str, ...] = ("target", "to_element", "element", "element_id", "appear", "disappear"), lists: tuple[str, ...] = ("targets",), depth: int = 6) -> Column:
    """The different element ids that a command variant names, at any depth up to ``depth``; a bounded schema needs no more.

    A key that names an element is not searched any deeper when it holds a string, nor a list of them.
    """
    names = lambda e: e["key"].isin(*keys) & is_text(e["value"])
    listed = lambda e: e["key"].isin(*lists) & _is(e["value"], "^ARRAY<")

    def next_level(held: Column) -> Column:
        # a level is looked at several times, so it is held as a lambda's argument and not written out again
        maps = F.filter(F.transform(held["level"], lambda v: F.try_variant_get(v, "$", "map<string,variant>")), lambda m: m.isNotNull())
        entries = F.transform(F.flatten(F.transform(maps, F.map_entries)), lambda e: F.struct(e["value"].alias("value"), F.when(names(e), "names").when(listed(e), "lists").otherwise("other").alias("sort")))
        inner = F.flatten(F.filter(F.transform(held["level"], lambda v: F.try_variant_get(v, "$", "array<variant>")), lambda a: a.isNotNull()))

        def sorted_out(es: Column) -> Column:
            of = lambda sort: F.transform(F.filter(es, lambda e: e["sort"] == sort), lambda e: e["value"])
            several = F.flatten(F.transform(of("lists"), lambda v: F.try_variant_get(v, "$", "array<variant>")))
            return F.struct(F.concat(of("other"), inner).alias("level"), F.concat(held["found"], F.transform(of("names"), text), F.transform(F.filter(several, is_text), text)).alias("found"))

        return F.get(F.transform(F.array(entries), sorted_out), F.lit(0))

    start = F.struct(F.array(command).alias("level"), F.array().cast("array<string>").alias("found"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, lambda held, _: F.when(F.size(held["level"]) > 0, next_level(held)).otherwise(held), lambda held: held["found"])
    return F.array_sort(F.array_distinct(walked))
