"""Deterministic integers: 32-bit FNV-1a, xorshift32 and draws from them, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
# Fixed values of the FNV-1a hash.
FNV_BASIS, FNV_PRIME = 0x811C9DC5, 0x01000193


def fnv1a(text: Column) -> Column:
    """FNV-1a over the text's UTF-16 code units, as a bigint in 0..2**32-1."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    count = (F.length(raw) / 4).cast("int")
    units = F.when(F.length(raw) > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.conv(F.substring(raw, i * 4 - 3, F.lit(4)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(units, F.lit(FNV_BASIS).cast("bigint"), lambda h, u: (h.bitwiseXOR(u) * FNV_PRIME).bitwiseAND(F.lit(MASK).cast("bigint")))


def next_random(state: Column) -> Column:
    """One xorshift32 step."""
    mask = F.lit(MASK).cast("bigint")
    a = state.bitwiseXOR(F.shiftleft(state, 13).bitwiseAND(mask)).bitwiseAND(mask)
    b = a.bitwiseXOR(F.shiftright(a, 17))
    return b.bitwiseXOR(F.shiftleft(b, 5).bitwiseAND(mask)).bitwiseAND(mask)


def draws(seed: Column, n: int) -> Column:
    """The first ``n`` numbers of the generator; seed 0 counts as 1."""
    start = F.array(F.when(seed == 0, F.lit(1).cast("bigint")).otherwise(seed.cast("bigint")))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda a, _: F.array_append(a, next_random(F.element_at(a, -1))))
    return F.slice(grown, 2, n)


def seed_for(operation: Column, frame: Column, width: Column, height: Column, region: Column) -> Column:
    """The seed of a synthetic vision request; region is null or four numbers joined by commas."""
    return fnv1a(F.concat(operation, F.lit("|"), frame, F.lit("|"), width.cast("string"), F.lit("x"), height.cast("string"), F.lit("|"), F.coalesce(region, F.lit("-"))))


def fraction(draw: Column) -> Column:
    return draw / F.lit(float(1 << 32))


def floor2(value: Column) -> Column:
    return F.floor(value * 100) / 100


def confidence(draw: Column) -> Column:
    return (draw % 1001) / 1000
