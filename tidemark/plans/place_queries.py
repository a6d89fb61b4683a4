"""Queries over geometry, registries, frames and overlays: on order lines as boxes, events as hints, and small relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as g
from tidemark.operators import folds, registry, semantics, snapshots
from tidemark.sources.inline import common_table, dealt, dealt_table, frame
from tidemark.sources.tables import table


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_linenumber").cast("double").alias("n"), F.round(F.col("l_discount") * 100).alias("d"), F.round(F.col("l_tax") * 100).alias("t"))


def _captures(spark, sf_dir):
    """Order lines as captures: quantities scroll, line numbers choose the viewport, every ninth has no scale."""
    c = F.struct(
        F.when(F.col("q") != 13, F.concat(F.lit("c"), F.col("l_linenumber").cast("string"))).alias("id"), F.col("q").alias("scroll_x"), F.col("d").alias("scroll_y"), F.lit(1280.0).alias("layout_w"), F.lit(640.0).alias("layout_h"), (F.lit(320.0) * F.col("n")).alias("visual_w"), F.lit(160.0).alias("visual_h"), F.col("t").alias("offset_x"), F.col("n").alias("offset_y"),
        F.when(F.col("q") % 9 == 0, 0.0).otherwise(2.0).alias("scale"), F.lit(1.5).alias("ratio"), F.lit(1.0).alias("zoom"), F.when(F.col("q") == 7, 640.5).otherwise(640.0).alias("image_w"), F.lit(320.0).alias("image_h"), F.when(F.col("q") == 11, "other").when(F.col("l_linenumber") % 2 == 0, "visual").otherwise("layout").alias("viewport"),
    )
    # a generator keeps its result: without one the optimiser would put each map's expression wherever a part of it is used
    told = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "q", "n", "d", "t", F.explode(F.array(c)).alias("c"))
    told = told.select("*", F.explode(F.array(g.capture_code(F.col("c")))).alias("code"))
    return told.select("*", F.explode(F.array(g.page_to_image(F.col("c"), F.col("code").isNull()))).alias("m"))


def capture_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each capture's map from page to image, or why there is none."""
    m = _captures(spark, sf_dir)
    return m.select("l_orderkey", "l_linenumber", F.coalesce("code", F.lit("ok")).alias("code"), "m.sx", "m.sy", "m.tx", "m.ty")


def mapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's point (100, 200) and the box (q, n, d, t) by each capture's map."""
    m = _captures(spark, sf_dir).where("code is null")
    p = m.select("l_orderkey", "l_linenumber", g.map_point(F.col("m"), F.lit(100.0), F.lit(200.0)).alias("p"), g.map_box(F.col("m"), g.box(F.col("q"), F.col("n"), F.col("d"), F.col("t"))).alias("b"))
    return p.select("l_orderkey", "l_linenumber", "p.x", "p.y", F.col("b.x").alias("bx"), F.col("b.w").alias("bw"))


def crop_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of a 60 by 12 image to 100 by 50."""
    m = _lines(spark, sf_dir).withColumn("m", g.image_to_crop(g.box(F.col("q"), F.col("n") - 1, F.col("d"), F.col("t")), F.lit(55.0), F.lit(12.0), F.lit(100.0), F.lit(50.0)))
    return m.select("l_orderkey", "l_linenumber", F.col("m").isNotNull().alias("good"), "m.sx", "m.sy", "m.tx", "m.ty")


def current_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose order and quantity are those of the order's first line now."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("doc"), F.col("l_quantity").alias("obs"))
    now = line.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("doc").alias("now_doc"), F.min("obs").alias("now_obs"))
    told = line.join(now, "l_orderkey", "left").withColumn("current", g.is_current(F.col("doc"), F.col("obs"), F.col("now_doc"), F.col("now_obs")))
    return told.groupBy("l_orderkey").agg(F.count_if("current").alias("n_current"), F.count("*").alias("n"))


LINK = "id bigint, pos bigint, child string, parent string, scroll double, origin double, inset double, a double, b double, perspective boolean"
_LINKS_FROM = {"origin": "origin + e_user", "id": "e_id"}
LINKS = [
    (1, 0, "f1", "top", 10.0, 100.0, 2.0, 1.0, 0.0, False), (2, 0, "f2", "f1", 5.0, 20.0, 1.0, 0.5, 0.0, False), (2, 1, "f1", "top", 10.0, 100.0, 2.0, 2.0, 0.0, False), (3, 0, "f2", "f9", 5.0, 20.0, 1.0, 0.5, 0.0, False), (3, 1, "f1", "top", 10.0, 100.0, 2.0, 2.0, 0.0, False),
    (4, 0, "f1", "top", 10.0, 100.0, 2.0, 1.0, 0.3, False), (5, 0, "f1", "top", 10.0, 100.0, 2.0, 1.0, 0.0, True), (6, 0, "f1", "f1", 0.0, 0.0, 0.0, 1.0, 0.0, False), (6, 1, "f1", "top", 0.0, 0.0, 0.0, 1.0, 0.0, False), (7, 0, "top", "top", 0.0, 0.0, 0.0, 1.0, 0.0, False), (8, 0, "f1", "top", 0.0, 0.0, -1.0, 1.0, 0.0, False), (9, 0, "f1", "top", 0.0, 0.0, 0.0, 0.0, 0.0, False),
]


def frame_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of frames into the top page, which is scrolled by (7, 3); both axes have the same measures."""
    link = F.struct("pos", "child", "parent", F.col("scroll").alias("scroll_x"), F.col("scroll").alias("scroll_y"), F.col("origin").alias("origin_x"), F.col("origin").alias("origin_y"), F.col("inset").alias("inset_x"), F.col("inset").alias("inset_y"), "a", "b", F.lit(0.0).alias("c"), F.col("a").alias("d"), "perspective")
    chains = dealt(table(spark, sf_dir, "events"), LINK, LINKS, **_LINKS_FROM).groupBy("id").agg(F.array_sort(F.collect_list(link)).alias("links"))
    m = chains.select("id", g.frame_chain(F.col("links"), F.lit("top"), F.lit(7.0), F.lit(3.0)).alias("m"))
    return m.select("id", F.coalesce("m.code", F.lit("ok")).alias("code"), "m.map.sx", "m.map.tx", "m.map.ty")


def simple_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chains folded as plain maps: those that are gapless and have no repeats."""
    link = F.struct("pos", F.col("child").alias("frame"), "parent", g.affine(F.col("a"), F.col("a"), F.col("origin"), F.col("scroll")).alias("map"))
    chains = dealt(table(spark, sf_dir, "events"), LINK, LINKS, **_LINKS_FROM).groupBy("id").agg(F.array_sort(F.collect_list(link)).alias("links"))
    return chains.select("id", g.frame_to_page(F.col("links")).alias("m")).select("id", "m.sx", "m.tx", "m.ty")


SPACE = "id bigint, kind string, name string, doc string, observation double, sx double, tx double"
_SPACES_FROM = {"tx": "tx - e_user", "observation": "observation + e_user % 2"}
SPACES = [(1, "page", "a", "d", 1.0, 1.0, 0.0), (2, "moon", "a", "d", 1.0, 1.0, 0.0), (3, "crop", "", "d", 1.0, 0.5, -3.0), (4, "image", "a", "d", 0.0, 0.0, 0.0), (5, "frame", "a", "d", 1.5, -1.0, 0.0), (6, "viewport", "a", None, 2.0, 2.0, float("inf")), (7, "viewport", "a", "d", 9007199254740992.0, float("nan"), 0.0)]


def space_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dealt(table(spark, sf_dir, "events"), SPACE, SPACES, **_SPACES_FROM)
    rect = g.is_rect(g.box(F.col("tx"), F.col("tx"), F.col("sx"), F.col("sx")))
    return s.select("id", g.is_space(F.col("kind"), F.col("name"), F.col("doc"), F.col("observation")).alias("space"), g.is_affine(g.affine(F.col("sx"), F.lit(1), F.col("tx"), F.lit(0))).alias("map"), rect.alias("rect"))


def drawn_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings, underlines, spotlights, arrows and badges of order lines."""
    target = g.box(F.col("q") / 8, F.col("n") / 4, F.col("d") / 8 - 1, F.col("t") / 8)
    s = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", g.ring(target).alias("r"), g.underline(target).alias("u"), g.spotlight(target).alias("s"), g.arrow(F.col("q"), F.lit(0.0), F.lit(0.0), F.col("n") * 4).alias("a"), g.ordinal(F.col("q") * 25.5 - 30).alias("badge"), g.eased(F.col("q") / 40).alias("eased"))
    return s.select("l_orderkey", "l_linenumber", F.col("r.x").alias("ring_x"), F.col("r.w").alias("ring_w"), F.col("u.y").alias("line_y"), F.col("u.w").alias("line_w"), F.col("s.h").alias("spot_h"), "a.length", "a.angle", "badge", F.round("eased", 6).alias("eased"))


POINTER = "id bigint, x double, y double, scale double"
_POINTERS_FROM = {"x": "x + e_user", "scale": "scale + e_user % 4"}
POINTERS = [(1, 10.0, 20.0, 2.0), (2, 10.0, 20.0, 0.0), (3, 10.0, 20.0, None), (4, float("nan"), 20.0, 2.0), (5, 10.0, float("inf"), 2.0), (6, -5.0, 1.0, 0.5)]


def pointer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dealt(table(spark, sf_dir, "events"), POINTER, POINTERS, **_POINTERS_FROM).withColumn("p", registry.pointer_sample(F.col("x"), F.col("y"), F.col("scale")))
    nowhere = F.struct(F.lit("hidden").alias("status"), F.lit(None).cast("struct<x: double, y: double, w: double, h: double>").alias("rect"))
    r = p.select("id", registry.companion_resolution(F.when(F.col("case_no") == 6, "e1").otherwise("pointer"), F.col("p"), nowhere, "pointer").alias("r"))
    return r.select("id", "r.status", "r.rect.x", "r.rect.y", "r.rect.w")


CONTEXT = "ctx bigint, parent bigint, attached boolean"
CONTEXTS = [(0, None, True), (1, 0, True), (2, 1, False), (3, 2, True), (4, 3, True), (5, 0, True), (6, 99, True), (7, 6, True), *((10 + i, 9 + i if i else 5, True) for i in range(40))]


def contexts_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are attached all the way up."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    own = users.join(F.broadcast(frame(spark, CONTEXT, CONTEXTS)), F.lit(True)).select((F.col("user_id") * 1000 + F.col("ctx")).alias("ctx"), (F.col("user_id") * 1000 + F.col("parent")).alias("parent"), (F.col("attached") & ((F.col("user_id") + F.col("ctx")) % 41 > 0)).alias("attached"))
    return registry.current_contexts(own, "ctx", "parent", "attached").select("ctx")


def context_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames, each in the one before it: chains of 5,000, some broken somewhere, every third closed to a loop, and frames beside them."""
    e = table(spark, sf_dir, "events")
    leaves = 6 - F.col("event_id") % 7  # so far behind a chain's first frame may stand one that hangs on the chain before: the loop closes ahead of it
    last = F.col("event_id") + F.when(leaves.between(1, 5), leaves - 1).otherwise(4999)
    parent = F.when(F.col("event_id") % 5000 == 0, F.when(F.floor(F.col("event_id") / 5000) % 3 == 2, last)).when(F.col("event_id") % 7 == 6, F.col("event_id") - 6).otherwise(F.col("event_id") - 1)
    contexts = e.select(F.col("event_id").alias("ctx"), parent.alias("parent"), (F.col("event_id") % 3989 != 3988).alias("attached"))
    return registry.current_contexts(contexts, "ctx", "parent", "attached").select("ctx")


def first_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event types as roots, once, as first found."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return registry.roots(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def _registry(spark, sf_dir):
    """Users as documents, their event types as nodes; one node in five is no longer there, and generations are user ids."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("node"), "ts", "event_id")
    ids = registry.registered(e, "doc", "node", ["ts", "event_id"])
    return ids.withColumn("generation", F.col("doc") % 7).withColumn("valid", (F.col("doc") + F.length("node")) % 5 > 0)


def registered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, sf_dir).select("doc", "node", "id")


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events ask for the element of their number by the generation of three users earlier in a third of the cases."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc"), F.concat(F.lit("e"), (F.col("event_id") % 6 + 1).cast("string")).alias("id"), ((F.col("user_id") + F.when(F.col("event_id") % 3 == 0, 3).otherwise(0)) % 7).alias("expected"))
    found = registry.resolved(e, _registry(spark, sf_dir), "doc")
    return found.select("event_id", "status", "node")


def walked_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with ids of the generation that a walk began with, and the semantics of their nodes of that generation."""
    r = _registry(spark, sf_dir)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("node"), (F.col("user_id") % 7 + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)).alias("generation")).distinct()
    meant = r.select("doc", "node", "generation", F.upper("node").alias("role")).where("node <> 'error'")
    found = registry.with_semantics(registry.walked(e, r, "doc"), meant, "doc")
    return found.select("doc", "node", "id", "role")


SCOPE = "id string, scopes array<string>, now array<string>, used array<string>"
_SCOPES_FROM = {"id": "concat(id, '_', cast(e_id as varchar(20)))"}
SCOPES = [("e1", ["top:1"], ["top:1"], ["top"]), ("e2", ["f1:2", "top:1"], ["f1:2", "top:1"], ["f1", "top"]), ("e3", ["f2:1", "top:1"], ["f2:2", "top:1"], ["f2", "top"]), ("e4", ["f3:1", "top:1"], ["top:1"], ["f3", "top"]), ("e5", ["f4:1"], None, ["f4"]), ("e6", ["s1:1", "f5:1", "top:1"], ["s1:1", "f5:1", "top:1"], ["f5", "top"])]
DOCUMENT = "document string"
DOCUMENTS = [("top",), ("f1",), ("f2",), ("f3",), ("f4",), ("f5",)]


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sweep leaves: elements whose scopes hold, and the documents that these use."""
    kept, documents = registry.swept(dealt(table(spark, sf_dir, "events"), SCOPE, SCOPES, **_SCOPES_FROM), frame(spark, DOCUMENT, DOCUMENTS), "top")
    return kept.select(F.lit("element").alias("kind"), "id").unionByName(documents.select(F.lit("document").alias("kind"), F.col("document").alias("id")))


def route_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hints: a purchase is a change of route."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return registry.generations(e, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "generation")


def relevant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mutation records that touch parts: those that touch a part that isn't owned (not divisible by three)."""
    records = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("node"))
    owned = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"))
    return registry.relevant(records, owned, "l_orderkey", "node")


def extraction_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to extract: the small ones, those on returned lines, and those of brands that the latter share."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size", "p_brand")
    changed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_partkey").alias("node"))
    dependent = p.where("p_size = 7").join(p.join(changed, "node", "left_semi").select("p_brand").distinct(), "p_brand", "left_semi")
    return registry.extraction_set(p.where("p_size < 3"), changed, dependent, ["node"])


def pass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks of an order's pass: the overlay's and the walker's counters."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("bigint").alias("units"), F.col("l_linenumber").cast("bigint").alias("ms"))
    return registry.added_metrics(line, ["l_orderkey"])


ANCHOR = "id bigint, disposed boolean, element_id string, resolution string, connected boolean, same_document boolean, display string, visibility string, doc string, w double, x double"
_ANCHORS_FROM = {"x": "x - e_user % 20", "w": "w * (e_user % 3)"}
ANCHORS = [
    (1, False, "e1", "ok", True, True, "block", "visible", "d", 10.0, 5.0), (2, True, "e1", "ok", True, True, "block", "visible", "d", 10.0, 5.0), (3, False, "v1", "ok", True, True, "block", "visible", "d", 10.0, 5.0), (4, False, "e1", "stale", True, True, "block", "visible", "d", 10.0, 5.0), (5, False, "e1", "missing", True, True, None, None, "d", 10.0, 5.0),
    (6, False, "e1", "disposed", True, True, None, None, "d", 10.0, 5.0), (7, False, "e1", "ok", False, True, "block", "visible", "d", 10.0, 5.0), (8, False, "e1", "ok", True, False, "block", "visible", "d", 10.0, 5.0), (9, False, "e1", "ok", True, True, "none", "visible", "d", 10.0, 5.0), (10, False, "e1", "ok", True, True, "block", "collapse", "d", 10.0, 5.0),
    (11, False, "e1", "ok", True, True, None, None, "d", 0.0, 5.0), (12, False, "e1", "ok", True, True, None, None, "d", 10.0, 100.0), (13, False, "e1", "ok", True, True, None, None, "old", 10.0, 5.0), (14, False, "e1", "ok", True, True, None, None, "d", 10.0, -10.0), (15, False, "e1", "ok", True, True, None, None, "d", float("nan"), 5.0),
]


def annotation_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each anchor resolves, and what its annotation shows on a screen of 100 by 100."""
    a = dealt(table(spark, sf_dir, "events"), ANCHOR, ANCHORS, **_ANCHORS_FROM).withColumn("resolved", registry.anchor_resolution(F.struct("disposed", "element_id", "resolution", "connected", "same_document", "display", "visibility")))
    rect = g.box(F.col("x"), F.lit(0), F.col("w"), F.lit(5))
    return a.select("id", "resolved", registry.annotation_status(F.col("doc"), F.lit("d"), F.col("resolved"), rect, F.lit(100.0), F.lit(100.0)).alias("status"))


def ordered_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two lists of customers, in order: added and changed ones by name, then removed ones."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    before, after = c.where("c_custkey % 9 <> 0"), c.where("c_custkey % 8 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    told = snapshots.ordered(snapshots.diff(before, after, ["c_name"], ["c_mktsegment"]), "c_name").withColumn("k", snapshots.order_key(F.col("change"), F.col("c_name")))
    return told.groupBy("change").agg(F.count("*").alias("n"), F.min("k")["key"].alias("first"), F.max("k")["key"].alias("last"))


def _words_said(spark, sf_dir):
    """Each conversation's different words in its even and in its odd turns, case and accents kept, and how often they come."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("word"))
    return c.groupBy("conv_id", (F.col("turn") % 2).alias("side"), "word").agg(F.count("*").alias("n"))


def collated_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the odd turns of a conversation change in the words of the even ones, each with its position in the list."""
    words = _words_said(spark, sf_dir)
    sides = [words.where(F.col("side") == k).select("conv_id", "word", "n") for k in (0, 1)]
    told = snapshots.positions(snapshots.diff(*sides, ["conv_id", "word"], ["n"]), ["conv_id"], "word")
    return told.select("conv_id", "change", "word", "position")


def collated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's words and counts as a map, its entries in a dictionary's order."""
    words = _words_said(spark, sf_dir).where("side = 0").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("word", F.col("n").cast("string")))).alias("m"))
    return words.select("conv_id", F.array_join(F.transform(semantics.in_language_order(F.col("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), " ").alias("entries"))


def _capture_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = F.create_map(*(F.lit(x) for kv in {"signup": "task-started", "view": "audio-capture-confirmed", "click": "thinking", "purchase": "task-finished", "error": "audio-capture-ended"}.items() for x in kv))
    # every stop comes from an older run, so it is heard only for what it retracts
    generation = F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id"))
    return e.select("user_id", "ts", "event_id", kinds[F.col("event_type")].alias("type"), generation.cast("bigint").alias("generation"), F.lit("t").alias("task"))


def late_capture_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture after each user's events in order of id: a late stop still ends it, and says nothing else."""
    found = folds.companion(_capture_events(spark, sf_dir).where("event_id % 20 < 6"), ["user_id"], ["event_id"])
    return found.select("user_id", "capture")


_L = "l as (select l_orderkey, l_linenumber, l_quantity as q, cast(l_linenumber as double) as n, round(l_discount * 100) as d, round(l_tax * 100) as t from lineitem)"
_CAPTURE = f"""{_L}, c as (select *, case when q = 13 then 'missing_metadata' when q % 9 = 0 or q = 7 then 'invalid_geometry' when q = 11 then 'missing_metadata' else 'ok' end as code, l_linenumber % 2 = 0 as vis from l),
    k as (select *, case when vis then 640 / (320 * n) else 0.5 end as kx, case when vis then 2.0 else 0.5 end as ky from c),
    m as (select *, case when code = 'ok' then kx end as sx, case when code = 'ok' then ky end as sy, case when code = 'ok' then -q * kx + case when vis then -t * kx else 0 end end as tx, case when code = 'ok' then -d * ky + case when vis then -n * ky else 0 end end as ty from k)"""
_TWO = "floor({} * 100 + 0.5) / 100"
_REGISTRY = """
    f as (select user_id as doc, event_type as node, min({'ts': ts, 'id': event_id}) as first from events group by all),
    r as (select doc, node, 'e' || row_number() over (partition by doc order by first, node) as id, doc % 7 as generation, (doc + length(node)) % 5 > 0 as valid from f)"""
_SAID = "w as (select conv_id, turn % 2 as side, word, count(*) as n from (select conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as word from conversations) group by all)"
_HOLDS = "len(scopes) = len(now) and scopes = now"

SQL = {
    "capture_maps": f"with {_CAPTURE} select l_orderkey, l_linenumber, code, cast(sx as double) as sx, cast(sy as double) as sy, cast(tx as double) as tx, cast(ty as double) as ty from m",
    "mapped_points": f"with {_CAPTURE} select l_orderkey, l_linenumber, cast(100 * sx + tx as double) as x, cast(200 * sy + ty as double) as y, cast(q * sx + tx as double) as bx, cast(d * sx as double) as bw from m where code = 'ok'",
    "crop_maps": f"""
        with {_L}, g as (select *, d > 0 and t > 0 and q + d <= 55 and n - 1 + t <= 12 as good from l)
        select l_orderkey, l_linenumber, good, case when good then 100 / d end as sx, case when good then 50 / t end as sy, case when good then -q * (100 / d) end as tx, case when good then -(n - 1) * (50 / t) end as ty from g""",
    "current_captures": """
        with now as (select l_orderkey, min(l_returnflag) as doc, min(l_quantity) as obs from lineitem where l_linenumber = 1 group by l_orderkey)
        select l.l_orderkey, count(*) filter (where l_returnflag = doc and l_quantity = obs) as n_current, count(*) as n from lineitem l left join now using (l_orderkey) group by l.l_orderkey""",
    "frame_maps": f"""
        with {common_table("r", "id bigint, code string, sx double, tx double, ty double", [(1, "ok", 1.0, 99.0, 95.0), (2, "ok", 1.0, 147.0, 143.0), (3, "missing_metadata", None, None, None), (4, "unsupported_transform", None, None, None), (5, "unsupported_transform", None, None, None), (6, "invalid_geometry", None, None, None), (7, "invalid_geometry", None, None, None), (8, "invalid_geometry", None, None, None), (9, "unsupported_transform", None, None, None)])},
        -- a chain's origins move by the user's number, the outer frame of the second one is twice as large
        e as (select event_id, user_id * case event_id % 9 when 0 then 1 when 1 then 3 end as moved, event_id % 9 + 1 as case_no from events)
        select event_id as id, code, sx, tx + moved as tx, ty + moved as ty from e join r on r.id = case_no""",
    "simple_frames": f"""
        with {dealt_table("r", LINK, LINKS, **_LINKS_FROM)}, a as (select * from r where pos = 0), b as (select * from r where pos = 1), c as (select a.id, b.id is null or (a.parent = b.child and a.child <> b.child) as good, a.a * coalesce(b.a, 1) as sx, a.origin * coalesce(b.a, 1) + coalesce(b.origin, 0) as tx, a.scroll * coalesce(b.a, 1) + coalesce(b.scroll, 0) as ty from a left join b on a.id = b.id)
        select id, case when good then sx end as sx, case when good then tx end as tx, case when good then ty end as ty from c""",
    "space_rules": f"""
        with {dealt_table("r", SPACE, SPACES, **_SPACES_FROM)}
        select id, coalesce(kind in ('page', 'viewport', 'image', 'crop', 'frame') and name <> '' and doc <> '' and observation >= 1 and observation <= 9007199254740991 and observation = floor(observation), false) as space,
            isfinite(sx) and isfinite(tx) and sx > 0 as map, isfinite(sx) and isfinite(tx) and sx >= 0 as rect from r""",
    "drawn_shapes": f"""
        with {_L}, b as (select *, q / 8 as x, n / 4 as y, d / 8 - 1 as w, t / 8 as h, q * 25.5 - 30 as i, least(q / 40, 1) as p from l)
        select l_orderkey, l_linenumber, {_TWO.format("(x - 4)")} as ring_x, {_TWO.format("greatest(w + 8, 1)")} as ring_w, {_TWO.format("(y + h + 2)")} as line_y, {_TWO.format("greatest(w, 1)")} as line_w, {_TWO.format("greatest(h + 16, 1)")} as spot_h,
            {_TWO.format("greatest(sqrt(q * q + n * n * 16), 18)")} as length, {_TWO.format("degrees(atan2(n * 4, -q))")} as angle, cast(least(greatest(trunc(i), 1), 999) as bigint) as badge, round(1 - (1 - p) * (1 - p) * (1 - p), 6) as eased from b""",
    "pointer_places": f"""
        with {dealt_table("r", POINTER, POINTERS, **_POINTERS_FROM)}, k as (select *, isfinite(x) and isfinite(y) as seen, case when coalesce(scale, 1) > 0 then coalesce(scale, 1) else 1 end as s from r)
        select id, case when case_no = 6 then 'hidden' when seen then 'ok' else 'missing' end as status, case when case_no < 6 and seen then x / s end as x, case when case_no < 6 and seen then y / s end as y, cast(case when case_no < 6 and seen then 1 end as double) as w from k""",
    "contexts_current": f"""
        with recursive {common_table("c", CONTEXT, CONTEXTS)}, r as (select user_id * 1000 + ctx as ctx, user_id * 1000 + parent as parent, attached and (user_id + ctx) % 41 > 0 as attached from c, (select distinct user_id from events)), m as (select ctx from r where parent is null and attached union all select r.ctx from r join m on r.parent = m.ctx where r.attached) select ctx from m""",
    "context_chains": """
        with recursive e as (select event_id as ctx, event_id // 5000 as chain, case when event_id % 5000 > 0 and event_id % 7 = 6 then event_id - 6 when event_id % 5000 > 0 then event_id - 1 end as parent, event_id % 3989 <> 3988 as attached from events),
        -- frames with a frame in them are those of the chain's line; what hangs beside it hangs on one of them
        walk as (select ctx, 0 as depth from e where parent is null and chain % 3 <> 2 and attached union all select e.ctx, depth + 1 from walk join e on e.parent = walk.ctx where e.attached)
        select ctx from walk""",
    "first_roots": "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1",
    "registered_ids": f"with {_REGISTRY} select doc, node, id from r",
    "resolutions": f"""
        with {_REGISTRY}, q as (select event_id, user_id as doc, 'e' || (event_id % 6 + 1) as id, (user_id + case when event_id % 3 = 0 then 3 else 0 end) % 7 as expected from events)
        select event_id, case when expected <> q.doc % 7 then 'stale' when node is null then 'missing' else 'ok' end as status, case when expected = q.doc % 7 then node end as node from q left join (select * from r where valid) r on r.doc = q.doc and r.id = q.id""",
    "walked_targets": f"""
        with {_REGISTRY} select distinct r.doc, r.node, id, upper(r.node) as role from r join events e on e.user_id = r.doc and e.event_type = r.node where valid and event_id % 10 <> 0 and r.node <> 'error'""",
    "sweep": f"""
        with {dealt_table("r", SCOPE, SCOPES, **_SCOPES_FROM)}, {common_table("d", DOCUMENT, DOCUMENTS)}, k as (select * from r where {_HOLDS}), u as (select distinct unnest(used) as document from k)
        select 'element' as kind, id from k union all select 'document', document from d where document = 'top' or document in (select document from u)""",
    "route_generations": "select event_id, cast(sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as generation from events",
    "relevant_records": "select distinct l_orderkey from lineitem where l_partkey % 3 <> 0",
    "extraction_sets": """
        with c as (select distinct l_partkey as node from lineitem where l_returnflag = 'R' and l_quantity > 49)
        select p_partkey as node from part where p_size < 3 union select node from c union select p_partkey from part where p_size = 7 and p_brand in (select p_brand from part join c on node = p_partkey)""",
    "pass_metrics": "select l_orderkey, cast(sum(cast(l_quantity as bigint)) as bigint) as units, count(*) as chunks, cast(sum(l_linenumber) as bigint) as active_ms, cast(max(l_linenumber) as bigint) as longest_ms from lineitem group by l_orderkey",
    "annotation_statuses": f"""
        with {dealt_table("r", ANCHOR, ANCHORS, **_ANCHORS_FROM)}, k as (select *, case when disposed then 'stale' when starts_with(element_id, 'v') then 'unsupported' when resolution = 'disposed' then 'stale' when resolution <> 'ok' then resolution when not connected then 'missing'
            when not same_document then 'unsupported' when display = 'none' or visibility in ('hidden', 'collapse') then 'hidden' else 'ok' end as resolved from r)
        select id, resolved, case when doc <> 'd' then 'stale' when resolved <> 'ok' then resolved when isnan(w) or w <= 0 then 'hidden' when x >= 100 or x + w <= 0 then 'offscreen' else 'visible' end as status from k""",
    "ordered_diff": """
        with b as (select c_name, c_mktsegment as s from customer where c_custkey % 9 <> 0), a as (select c_name, case when c_custkey % 5 = 0 then 'MOVED' else c_mktsegment end as s from customer where c_custkey % 8 <> 0),
        d as (select coalesce(a.c_name, b.c_name) as name, case when b.c_name is null then 'added' when a.c_name is null then 'removed' when a.s <> b.s then 'changed' end as change from a full join b using (c_name))
        select change, count(*) as n, min(name) as first, max(name) as last from d where change is not null group by change""",
    "collated_changes": f"""
        with {_SAID}, b as (select * from w where side = 0), a as (select * from w where side = 1),
        d as (select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.word, b.word) as word, case when b.word is null then 'added' when a.word is null then 'removed' when a.n <> b.n then 'changed' end as change from a full join b on a.conv_id = b.conv_id and a.word = b.word)
        select conv_id, change, word, row_number() over (partition by conv_id, change order by case when change <> 'removed' then icu_sort_key(word, 'en') end, word) as position from d where change is not null""",
    "collated_entries": f"with {_SAID} select conv_id, string_agg(word || '=' || n, ' ' order by icu_sort_key(word, 'en'), word) as entries from w where side = 0 group by conv_id",
    "late_capture_stops": """
        with e as (select user_id, event_id, event_type from events where event_id % 20 < 6), s as (select user_id, max(event_id) filter (where event_type = 'view') as on_at, max(event_id) filter (where event_type = 'error') as off_at from e group by user_id),
        f as (select s.*, max(event_id) filter (where event_type = 'view') as v from s join e using (user_id) group by all)
        select user_id, on_at is not null and coalesce(off_at < on_at, true) as capture from f""",
}

QUERIES = {name: globals()[name] for name in SQL}
