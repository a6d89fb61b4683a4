"""Text expressions: white space, labels, quoting, numbers, keys and placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LABEL = 120
# The characters that a label can't show, and those that are white space in any language.
UNPRINTABLE = r"\x{0}-\x{1F}\x{7F}-\x{9F}\x{200B}-\x{200F}\x{2028}\x{2029}\x{202A}-\x{202E}\x{2060}\x{2066}-\x{2069}\x{FEFF}"
WHITE = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
ID_LIMIT = 80


def flat(text: Column) -> Column:
    """Runs of tab, line feed, form feed, return and space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"[\t\n\f\r ]+", " "))


def sanitize_label(text: Column, limit: int = MAX_LABEL) -> Column:
    """One printable line: control, bidi and zero-width characters are spaces.

    A line of more than ``limit`` UTF-16 units is cut to as many characters less one, and an ellipsis.
    """
    clean = F.regexp_replace(text, rf"[{UNPRINTABLE}]", " ")
    line = F.trim(F.regexp_replace(clean, rf"[{WHITE}]+", " "))
    units = F.length(line) + F.length(F.regexp_replace(line, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.when(units > limit, F.concat(F.substring(line, 1, limit - 1), F.lit("…"))).otherwise(line)


def quoted(text: Column) -> Column:
    """A JSON string literal; characters beyond ASCII stay."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("q"))), r"(?s)^\{\"q\":(.*)\}$", 1)


def number(value: Column) -> Column:
    """Integral values without a decimal part, others as they print."""
    return F.when(value == F.floor(value), F.floor(value).cast("bigint").cast("string")).otherwise(value.cast("string"))


def boolean(value: Column) -> Column:
    return F.when(value, "true").otherwise("false")


def key_token(key: Column) -> Column:
    """A key that is an identifier stands bare, any other is quoted."""
    return F.when(key.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), key).otherwise(quoted(key))


def class_placeholder(pii_class: Column, index: Column) -> Column:
    return F.concat(F.lit("{{"), F.upper(pii_class), F.lit("_"), index.cast("string"), F.lit("}}"))


def anchor_key(doc_id: Column, element_id: Column) -> Column:
    return F.concat_ws("/", doc_id, element_id)


def session_key(model: Column, version: Column, backend: Column) -> Column:
    return F.concat(model, F.lit("@"), version, F.lit("#"), backend)


def action_id(session: Column, step: Column) -> Column:
    """``a_{session}_{step}``; where that is too long the session is cut, the step stays whole."""
    step = step.cast("string")
    room = F.lit(ID_LIMIT - 3) - F.length(step)
    return F.concat(F.lit("a_"), F.substring(session, F.lit(1), room), F.lit("_"), step)


def is_opaque_id(value: Column) -> Column:
    return value.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_-]{0,79}\z")


def is_element_id(value: Column) -> Column:
    return value.rlike(r"\A[ev][A-Za-z0-9_-]+\z") & (F.length(value) <= ID_LIMIT)
