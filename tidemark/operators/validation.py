"""Message validation with a quarantine: raw JSON in, valid rows and reject codes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import is_opaque_id

PROTOCOL = "1.0"
SAFE_INTEGER = 2**53 - 1
# Reject code, HTTP status, whether a retry can help.
ERRORS = [
    ("invalid_request", 400, False),
    ("unsupported_version", 400, False),
    ("session_expired", 404, True),
    ("unauthorized", 401, False),
    ("rate_limited", 429, True),
    ("unavailable", 503, True),
    ("resync_required", 409, True),
]


def parsed(raw: Column) -> Column:
    """The JSON as a variant; null for text that is no JSON, has NaN or repeats a key.

    Spark's parser stops after the first value. Text with more after it is found out by reading it once
    as an array's only item and once as an object's only value: no text closes both too early.
    """
    item = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", "array<variant>")
    value = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    return F.when(F.size(item) == 1, F.try_variant_get(value, "$.v", "variant"))


def kind(value: Column) -> Column:
    """The raw type of a variant, upper case; VOID for an explicit null, SQL null for an absent key."""
    return F.upper(F.schema_of_variant(value))


def integer(value: Column, least: int = 0, most: int = SAFE_INTEGER) -> Column:
    """Whether a variant is an integral number in range: 1.0 is, true and "1" are not."""
    number = kind(value).rlike(r"^(BIGINT|INT|DECIMAL.*|DOUBLE)$")
    x = F.try_variant_get(value, "$", "double")
    return F.coalesce(number & (x == F.floor(x)) & x.between(least, most), F.lit(False))


def keys_within(value: Column, allowed: list[str]) -> Column:
    """Whether an object has no key but the allowed ones."""
    names = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.coalesce(F.size(F.array_except(names, F.array(*map(F.lit, allowed)))) == 0, F.lit(False))


def envelope_code(message: Column) -> Column:
    """The reject code of a message variant, null if its envelope is right: version first, then the ids and counters."""
    version = F.variant_get(message, "$.protocol", "variant") if hasattr(F, "variant_get") else F.try_variant_get(message, "$.protocol", "variant")
    text = F.try_variant_get(message, "$.protocol", "string")
    wrong = (kind(version) == "STRING") & (text != PROTOCOL)
    good = (
        (kind(version) == "STRING")
        & is_opaque_id(F.coalesce(F.try_variant_get(message, "$.session_id", "string"), F.lit("")))
        & (kind(F.try_variant_get(message, "$.session_id", "variant")) == "STRING")
        & integer(F.try_variant_get(message, "$.seq", "variant"), 0)
    )
    return F.when(message.isNull(), "invalid_request").when(F.coalesce(wrong, F.lit(False)), "unsupported_version").when(F.coalesce(good, F.lit(False)), None).otherwise("invalid_request")


def split(rows: DataFrame, code: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the quarantine with a code; a row's text never enters its code."""
    told = rows.withColumn("reject_code", code)
    return told.where("reject_code is null").drop("reject_code"), told.where("reject_code is not null")


def error_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERRORS, "code string, status int, retryable boolean")


def error_rows(rejects: DataFrame, spark: SparkSession) -> DataFrame:
    """Adds status and retryable to rows with a code; seven rows are broadcast."""
    return rejects.join(F.broadcast(error_table(spark)), "code")


def capped_body(raw: Column, limit: int = 5 * 1024 * 1024) -> Column:
    """Why a body is refused before it is read: too large, no UTF-8 or no JSON; null if it can be."""
    text = F.try_validate_utf8(raw.cast("string"))
    return F.when(F.octet_length(raw) > limit, "too_large").when(text.isNull(), "not_utf8").when(parsed(text).isNull(), "not_json")


def preference(value: Column) -> Column:
    """A stored preference variant: a boolean as it is, anything else is off."""
    return F.coalesce(F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")), F.lit(False))


def theme(value: Column) -> Column:
    """A known theme, else the system's."""
    return F.when(value.isin("light", "dark", "system"), value).otherwise("system")


def image_code(width: Column, height: Column, region: Column) -> Column:
    """Why an image and a region of it (x, y, w, h; null: the whole) can't be looked at, or null."""
    whole = lambda v: v.isNotNull() & (v == F.floor(v)) & (v >= 1)
    finite = F.lit(True)
    for k in "xywh":
        finite = finite & region[k].isNotNull() & ~F.isnan(region[k]) & (F.abs(region[k]) < F.lit(float("inf")))
    inside = (region["x"] >= 0) & (region["y"] >= 0) & (region["x"] + region["w"] <= width) & (region["y"] + region["h"] <= height)
    return (
        F.when(~(whole(width) & whole(height)), "image dimensions").when(region.isNull(), None).when(~finite, "region not finite")
        .when((region["w"] < 1) | (region["h"] < 1), "region without size").when(~inside, "region outside")
    )
