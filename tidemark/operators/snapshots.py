"""Keyed snapshots: difference, application, baselines and the choice between full and delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FULL_EVERY = 20
#: The collation of lists that people read.
LANGUAGE = "en"


def diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``(keys, change, before, after)`` of rows added, changed or removed.

    One full outer join on the keys; both sides keep their values as structs, compared null-safely.
    """
    old = before.select(*keys, F.struct(*values).alias("before"))
    new = after.select(*keys, F.struct(*values).alias("after"))
    both = old.join(new, keys, "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*keys, "change", "before", "after")


def order_key(change: Column, key: Column) -> Column:
    """What changes are listed by: added and changed ones as an English dictionary has them, removed ones by their characters."""
    return F.struct(F.collate(F.when(change != "removed", key), LANGUAGE).alias("by"), key.alias("key"))


def positions(changes: DataFrame, within: list[str], key: str) -> DataFrame:
    """Adds each change's position, from 1, among those of its kind in ``within``."""
    order = W.partitionBy(*within, "change").orderBy(order_key(F.col("change"), F.col(key)))
    return changes.withColumn("position", F.row_number().over(order).cast("bigint"))


def ordered(changes: DataFrame, key: str) -> DataFrame:
    """The changes in the order in which they are told: a range sort, so no task gets them all."""
    return changes.orderBy("change", order_key(F.col("change"), F.col(key)))


def apply(before: DataFrame, changes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The snapshot after ``changes``: rows they name go, and come back as they say."""
    kept = before.join(changes.select(*keys), keys, "left_anti").select(*keys, *values)
    back = changes.where("change <> 'removed'").select(*keys, *(F.col("after")[v].alias(v) for v in values))
    return kept.unionByName(back)


def with_baseline(observations: DataFrame, document: list[str], order: list[str], observation: str) -> DataFrame:
    """Adds baseline (the observation before it in its document), the running number, and mode.

    The first of a document and every FULL_EVERY-th after it is full, the others are deltas.
    """
    w = W.partitionBy(*document).orderBy(*order)
    number = F.row_number().over(w)
    out = observations.withColumn("number", number.cast("bigint")).withColumn("baseline", F.lag(observation).over(w))
    return out.withColumn("mode", full_or_delta(F.col("number")))


def full_or_delta(number: Column) -> Column:
    return F.when((number - 1) % FULL_EVERY == 0, "full").otherwise("delta")


def affected(cached: DataFrame, dirty: DataFrame) -> DataFrame:
    """Cached rows (page_id, node, path, depends_on) that a dirty node (page_id, root) contains, or on whose nodes they depend."""
    touching = F.array_union("path", F.coalesce("depends_on", F.array().cast("array<int>")))
    hit = cached.select("page_id", "node", F.explode(touching).alias("root")).join(dirty, ["page_id", "root"], "left_semi").select("page_id", "node").distinct()
    return cached.join(hit, ["page_id", "node"], "left_semi")
