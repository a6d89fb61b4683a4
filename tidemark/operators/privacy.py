"""Conservative redaction and stable placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text import class_placeholder

SECRET = "{{SECRET}}"
WITHHELD = "{{TEXT_WITHHELD}}"
ENTRIES, BINDINGS = 500, 50
CLASSES = {"email": "email", "tel": "phone", "password": "secret"}


def classify(input_type: Column) -> Column:
    """The class that an input type names, else ``other``."""
    known = F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv))
    return F.coalesce(known[input_type], F.lit("other"))


def decide(text: Column, input_type: Column, is_value: Column) -> Column:
    """``(outcome, pii_class, detector)`` for one text: clear if empty, redacted only if its field says what it is."""
    hinted = input_type.isin(*CLASSES)
    hinted = F.coalesce(hinted, F.lit(False))
    kind = classify(input_type)
    clear = F.struct(F.lit("clear").alias("outcome"), F.lit(None).cast("string").alias("pii_class"), F.lit(None).cast("string").alias("detector"))
    mask = F.struct(F.lit("redacted").alias("outcome"), kind.alias("pii_class"), F.lit("l1_semantic").alias("detector"))
    hold = F.struct(F.lit("withheld").alias("outcome"), kind.alias("pii_class"), F.when(hinted, "l1_semantic").otherwise("stub").alias("detector"))
    return F.when(F.coalesce(text, F.lit("")) == "", clear).when(is_value & hinted, mask).otherwise(hold)


def redacted_value(decision: Column, index: Column) -> Column:
    """The text to show instead: nothing, a placeholder, or the sign that it is withheld."""
    masked = F.when(decision["pii_class"] == "secret", SECRET).otherwise(class_placeholder(decision["pii_class"], index))
    return F.when(decision["outcome"] == "clear", "").when(decision["outcome"] == "redacted", masked).otherwise(WITHHELD)


def intern(values: DataFrame, scope: list[str], pii_class: str, value: str, order: list[str], entries: int | None = ENTRIES) -> DataFrame:
    """``(scope, class, value, first, entry, index, placeholder)``: one row per different class and value of a scope.

    Values are numbered by first use, from 1 in each class. A scope holds ``entries`` values (None: all); later
    ones have no placeholder (null), earlier ones keep theirs. Secrets share one literal and take no
    entry. Repeated values are grouped before any window, so a window sees distinct values only.
    """
    first = values.groupBy(*scope, pii_class, value).agg(F.min(F.struct(*order)).alias("first"))
    entry = F.sum(F.when(F.col(pii_class) != "secret", 1).otherwise(0)).over(W.partitionBy(*scope).orderBy("first", pii_class, value).rowsBetween(W.unboundedPreceding, 0))
    index = F.row_number().over(W.partitionBy(*scope, pii_class).orderBy("first", value))
    out = first.withColumn("entry", entry.cast("bigint")).withColumn("index", index.cast("bigint"))
    room = F.lit(True) if entries is None else F.col("entry") <= entries
    shown = F.when(F.col(pii_class) == "secret", SECRET).when(room, class_placeholder(F.col(pii_class), F.col("index")))
    return out.withColumn("placeholder", shown)


def bind(bindings: DataFrame, entry: list[str], fields: list[str], order: list[str], limit: int = BINDINGS) -> DataFrame:
    """Different bindings of each entry in order of first use, and whether each still has room."""
    first = bindings.groupBy(*entry, *fields).agg(F.min(F.struct(*order)).alias("first"))
    number = F.row_number().over(W.partitionBy(*entry).orderBy("first", *fields))
    return first.withColumn("number", number.cast("bigint")).withColumn("kept", F.col("number") <= limit)


def keep_clear(entries: Column) -> Column:
    """Of an array of (outcome, value): the clear values, and how many were held back."""
    clear = F.filter(entries, lambda e: e["outcome"] == "clear")
    return F.struct(F.transform(clear, lambda e: e["value"]).alias("kept"), (F.size(entries) - F.size(clear)).alias("withheld"))


def evidence_for(source: Column, told: Column) -> Column:
    """Where a text was read: as told, else by OCR for what a detector saw, else from the page."""
    return F.coalesce(told, F.when(source == "vision", "ocr").otherwise("dom_text"))


def redacted_element(c: Column, index: Column) -> Column:
    """``(outcome, reason, name, value_state, value, pii_class)`` of a raw element.

    ``c`` has id, role, finite (its box is), name, has_value, value and input_type. An element without id or role, or
    with a box that isn't finite, is withheld with a reason; one that claims a value and has none is invalid. A name
    shows only if it is empty, a value never.
    """
    name, value = decide(c["name"], F.lit(None).cast("string"), F.lit(False)), decide(c["value"], c["input_type"], F.lit(True))
    nothing = F.lit(None).cast("string")
    shown = redacted_value(name, index)

    def row(outcome: str, reason, text=nothing, state=nothing, told=nothing, kind=nothing) -> Column:
        return F.struct(F.lit(outcome).alias("outcome"), reason.alias("reason"), text.alias("name"), state.alias("value_state"), told.alias("value"), kind.alias("pii_class"))

    blank = lambda k: F.coalesce(c[k], F.lit("")) == ""
    return (
        F.when(blank("id") | blank("role"), row("withheld", F.lit("missing id or role")))
        .when(~c["finite"], row("withheld", F.lit("non-finite bbox")))
        .when(c["has_value"] & c["value"].isNull(), row("invalid", F.lit("no value")))
        .when(~c["has_value"], row("ok", nothing, shown))
        .when(c["value"] == "", row("ok", nothing, shown, F.lit("empty"), F.lit("")))
        .otherwise(row("ok", nothing, shown, F.lit("redacted"), redacted_value(value, index), value["pii_class"]))
    )


def withheld_crop(document: Column) -> Column:
    """A crop is always withheld, with one finding for its whole region."""
    values = {"outcome": "withheld", "evidence": "ocr", "pii_class": "other", "detector": "stub", "decision": "withhold"}
    return F.struct(*(F.lit(v).alias(k) for k, v in values.items()), document.alias("doc_id"), F.lit(1.0).alias("confidence"), F.lit(True).alias("synthetic"))


def binding_key(task: Column, origin: Column, document: Column, targets: Column, operations: Column) -> Column:
    """One text for bindings that allow the same, in whatever order they list it."""
    return F.to_json(F.array(*(F.to_json(F.struct(x.alias("v"))) for x in (task, origin, document, F.array_sort(targets), F.array_sort(operations)))))


def created_scopes(wanted: DataFrame, live: DataFrame) -> DataFrame:
    """Adds outcome to wanted scopes (scope_id, task_id, tab_id): invalid without all three ids, refused while one of that id lives."""
    there = live.select("scope_id").distinct().withColumn("_there", F.lit(True))
    empty = F.lit(False)
    for k in ("scope_id", "task_id", "tab_id"):
        empty = empty | (F.coalesce(k, F.lit("")) == "")
    out = wanted.join(there, "scope_id", "left")
    return out.withColumn("outcome", F.when(empty, "invalid").when(F.col("_there"), "scope_already_exists").otherwise("ok")).drop("_there")


def live_scopes(scopes: DataFrame, now: Column, idle: str, ended: DataFrame, closed: DataFrame) -> DataFrame:
    """Scopes (scope_id, tab_id, last_activity) that were not ended, whose tab is open, and that were not idle for ``idle``."""
    left = scopes.join(ended.select("scope_id"), "scope_id", "left_anti").join(closed.select("tab_id"), "tab_id", "left_anti")
    return left.where(now < F.col("last_activity") + F.expr(f"interval {idle}"))


def entry_counts(wanted: DataFrame, live: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds ``(has_scope, entries)`` to scope ids: what a scope that isn't there holds is 0."""
    counted = entries.groupBy("scope_id").agg(F.count("*").alias("_n"))
    there = live.select("scope_id", F.lit(True).alias("has_scope")).join(counted, "scope_id", "left")
    out = wanted.join(there, "scope_id", "left")
    return out.withColumn("has_scope", F.coalesce("has_scope", F.lit(False))).withColumn("entries", F.when(F.col("has_scope"), F.coalesce("_n", F.lit(0).cast("bigint"))).otherwise(0).cast("bigint")).drop("_n")
