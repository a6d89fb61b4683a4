"""Element registries, frame contexts, overlay statuses and pass metrics as joins and CASE chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.geometry import intersects_viewport, is_finite, is_renderable
from tidemark.sources.tables import written

# The size of the box at a pointer, and what hides a target.

POINTER_SIZE = 1.0
NOT_DRAWN = ("hidden", "collapse")


def current_contexts(contexts: DataFrame, key: str, parent: str, attached: str) -> DataFrame:
    """The contexts that are attached and whose ancestors all are, however deep.

    An unknown parent counts as detached, and so does a loop, which has no top. Every round joins a context that is still
    open to the one its link has reached so far, so links double in length; it ends when no context is open, or when a
    round settles none (what is left then hangs on loops). Rounds grow with the logarithm of the depth, and
    each is written to the shared folder, so plans stay as they are. Rows of a repeated key are the same context, which is
    attached if all of them are; a null key is no context.
    """
    spark = contexts.sparkSession
    rows = contexts.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(parent).alias("_up"), F.min(F.coalesce(F.col(attached), F.lit(False))).alias("_good"))
    told = F.when(~F.col("_good"), "detached").when(F.col("_up").isNull(), "current").otherwise("open")
    now, left = written(rows.select(key, F.when(told == "open", F.col("_up")).alias("_up"), told.alias("_told")), "contexts"), None
    while True:
        still = now.where("_told = 'open'").count()
        if not still or still == left:
            return contexts.join(now.where("_told = 'current'").select(key), key, "left_semi")
        left = still
        above = now.select(F.col(key).alias("_up"), F.col("_up").alias("_next"), F.col("_told").alias("_above"))
        moved = now.where("_told = 'open'").join(above, "_up", "left").select(key, F.col("_next").alias("_up"), F.coalesce("_above", F.lit("detached")).alias("_told"))
        now = written(now.where("_told <> 'open'").unionByName(moved), "contexts")


def roots(found: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each root once, as it was first found."""
    first = W.partitionBy(*key).orderBy(*order)
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def registered(candidates: DataFrame, document: str, node: str, order: list[str]) -> DataFrame:
    """``(document, node, id)``: each different node's id, e1, e2, ... in the order of first registration in its document."""
    first = candidates.groupBy(document, node).agg(F.min(F.struct(*order)).alias("_first"))
    number = F.row_number().over(W.partitionBy(document).orderBy("_first", node))
    return first.select(document, node, F.concat(F.lit("e"), number.cast("string")).alias("id"))


def resolved(requests: DataFrame, registry: DataFrame, document: str) -> DataFrame:
    """Adds ``(status, node)`` to requests (document, id, expected): stale if the generation moved, else missing or ok.

    ``registry`` has (document, id, node, generation, valid), ``requests`` the generation they expect; a
    document without entries has no generation, and its requests are stale.
    """
    live = registry.groupBy(document).agg(F.max("generation").alias("_generation"))
    entries = registry.where("valid").select(document, "id", "node")
    out = requests.join(live, document, "left").join(entries, [document, "id"], "left")
    status = F.when(~F.col("expected").eqNullSafe(F.col("_generation")), "stale").when(F.col("node").isNull(), "missing").otherwise("ok")
    return out.withColumn("status", status).withColumn("node", F.when(F.col("status") == "ok", F.col("node"))).drop("_generation")


def scopes_hold(before: Column, now: Column) -> Column:
    """Whether a chain of scopes is, one by one, what it was when the element was registered."""
    return F.coalesce((F.size(before) == F.size(now)) & F.forall(F.zip_with(before, now, lambda a, b: a.eqNullSafe(b)), lambda same: same), F.lit(False))


def swept(entries: DataFrame, documents: DataFrame, top: str) -> tuple[DataFrame, DataFrame]:
    """What a sweep leaves: entries (id, scopes, now, used) whose scopes hold, and documents that these use, or the top one."""
    kept = entries.where(scopes_hold(F.col("scopes"), F.col("now")))
    used = kept.select(F.explode("used").alias("document")).distinct()
    return kept, documents.where(F.col("document") == top).unionByName(documents.where(F.col("document") != top).join(used, "document", "left_semi"))


def walked(candidates: DataFrame, registry: DataFrame, document: str) -> DataFrame:
    """Candidates with their registered ids, those of the generation that the walk began with only."""
    entries = registry.where("valid").select(document, "node", "id", F.col("generation").alias("_at"))
    return candidates.join(entries, [document, "node"]).where(F.col("generation") == F.col("_at")).drop("_at")


def with_semantics(targets: DataFrame, semantics: DataFrame, document: str) -> DataFrame:
    """Registered targets with the semantics of their nodes; those of another generation are dropped."""
    told = semantics.withColumnRenamed("generation", "_at")
    return targets.join(told, [document, "node"]).where(F.col("generation") == F.col("_at")).drop("_at")


def generations(hints: DataFrame, document: str, order: list[str], moves: Column) -> DataFrame:
    """Adds generation: one more at every hint that the route has changed."""
    w = W.partitionBy(document).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return hints.withColumn("generation", F.sum(F.when(moves, 1).otherwise(0)).over(w).cast("bigint"))


def relevant(records: DataFrame, owned: DataFrame, record: str, node: str) -> DataFrame:
    """Records (one row per touched node) that touch at least one node that isn't owned."""
    return records.join(owned.select(node), node, "left_anti").select(record).distinct()


def extraction_set(candidates: DataFrame, changed: DataFrame, dependent: DataFrame, key: list[str]) -> DataFrame:
    """The nodes to extract: candidates, changed ones, and those that depend on these, once each."""
    return candidates.select(*key).unionByName(changed.select(*key)).unionByName(dependent.select(*key)).distinct()


def added_metrics(passes: DataFrame, key: list[str]) -> DataFrame:
    """Passes added up: sums of units, chunks and time, and the longest chunk."""
    return passes.groupBy(*key).agg(F.sum("units").alias("units"), F.count("*").alias("chunks"), F.sum("ms").alias("active_ms"), F.max("ms").alias("longest_ms"))


def is_vision_only(element_id: Column) -> Column:
    return element_id.startswith("v")


def anchor_resolution(a: Column) -> Column:
    """How the registry answers for an anchor: the first rule that applies.

    ``a`` has disposed, element_id, resolution (ok, missing, stale, disposed), connected, same_document, display and visibility.
    """
    hidden = (a["display"] == "none") | a["visibility"].isin(*NOT_DRAWN)
    return (
        F.when(a["disposed"], "stale").when(is_vision_only(a["element_id"]), "unsupported").when(a["resolution"] == "disposed", "stale").when(a["resolution"] != "ok", a["resolution"])
        .when(~a["connected"], "missing").when(~a["same_document"], "unsupported").when(F.coalesce(hidden, F.lit(False)), "hidden").otherwise("ok")
    )


def pointer_sample(client_x: Column, client_y: Column, scale: Column) -> Column:
    """A pointer's place by the page's visual scale; null where a coordinate is not finite, so the last one stays."""
    by = F.when(F.coalesce(scale, F.lit(1.0)) > 0, F.coalesce(scale, F.lit(1.0))).otherwise(1.0)
    return F.when(is_finite(client_x) & is_finite(client_y), F.struct((client_x / by).alias("x"), (client_y / by).alias("y")))


def companion_resolution(element_id: Column, sample: Column, base: Column, companion_id: str) -> Column:
    """``(status, rect)``: the companion's anchor is a unit box at the pointer, missing before the pointer is seen; others are ``base``."""
    rect = F.struct(sample["x"].alias("x"), sample["y"].alias("y"), F.lit(POINTER_SIZE).alias("w"), F.lit(POINTER_SIZE).alias("h"))
    seen = F.when(sample.isNull(), F.struct(F.lit("missing").alias("status"), F.lit(None).cast(_RECT).alias("rect"))).otherwise(F.struct(F.lit("ok").alias("status"), rect.alias("rect")))
    return F.when(element_id == companion_id, seen).otherwise(base)


_RECT = "struct<x: double, y: double, w: double, h: double>"


def annotation_status(doc_id: Column, current: Column, resolution: Column, rect: Column, width: Column, height: Column) -> Column:
    """What an annotation shows in a frame: stale before anything else, then the resolution, then its box against the screen."""
    return (
        F.when(current.isNull() | (doc_id != current), "stale").when(resolution != "ok", resolution).when(~F.coalesce(is_renderable(rect), F.lit(False)), "hidden")
        .when(~intersects_viewport(rect, width, height), "offscreen").otherwise("visible")
    )
