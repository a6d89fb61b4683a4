"""Boxes and affine maps (scale and translation) as structs of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of coordinate spaces, and the paddings and least sizes of drawn shapes.
SPACES = ("page", "viewport", "image", "crop", "frame")
RING_PADDING, UNDERLINE_GAP, SPOTLIGHT_PADDING = 4.0, 2.0, 8.0
SHORTEST_ARROW, MOST_ORDINAL = 18.0, 999
MARGIN = 4.0
OPPOSITE = {"top": "bottom", "bottom": "top", "left": "right", "right": "left"}


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def is_valid_box(b: Column) -> Column:
    """Finite numbers, no negative size; the origin may be negative."""
    return is_finite(b["x"]) & is_finite(b["y"]) & is_finite(b["w"]) & is_finite(b["h"]) & (b["w"] >= 0) & (b["h"] >= 0)


def is_renderable(b: Column) -> Column:
    return is_valid_box(b) & (b["w"] > 0) & (b["h"] > 0)


def intersects_viewport(b: Column, width: Column, height: Column) -> Column:
    """Open overlap with (0, 0, width, height)."""
    return (b["x"] < width) & (b["y"] < height) & (b["x"] + b["w"] > 0) & (b["y"] + b["h"] > 0)


def clip(b: Column, bounds: Column) -> Column:
    """The common part of two boxes, null if it has no area."""
    x, y = F.greatest(b["x"], bounds["x"]), F.greatest(b["y"], bounds["y"])
    right, bottom = F.least(b["x"] + b["w"], bounds["x"] + bounds["w"]), F.least(b["y"] + b["h"], bounds["y"] + bounds["h"])
    return F.when((right > x) & (bottom > y), box(x, y, right - x, bottom - y))


def round_out(b: Column) -> Column:
    """Whole-number box around ``b``; an empty side stays empty."""
    x, y = F.floor(b["x"]), F.floor(b["y"])
    right = F.when(b["w"] == 0, x).otherwise(F.ceil(b["x"] + b["w"]))
    bottom = F.when(b["h"] == 0, y).otherwise(F.ceil(b["y"] + b["h"]))
    return box(x, y, right - x, bottom - y)


def affine(sx: Column, sy: Column, tx: Column, ty: Column) -> Column:
    return F.struct(sx.cast("double").alias("sx"), sy.cast("double").alias("sy"), tx.cast("double").alias("tx"), ty.cast("double").alias("ty"))


def compose(first: Column, second: Column) -> Column:
    """``first``, then ``second``."""
    return affine(first["sx"] * second["sx"], first["sy"] * second["sy"], first["tx"] * second["sx"] + second["tx"], first["ty"] * second["sy"] + second["ty"])


def invert(t: Column) -> Column:
    return affine(1 / t["sx"], 1 / t["sy"], -t["tx"] / t["sx"], -t["ty"] / t["sy"])


def map_box(t: Column, b: Column) -> Column:
    return box(b["x"] * t["sx"] + t["tx"], b["y"] * t["sy"] + t["ty"], b["w"] * t["sx"], b["h"] * t["sy"])


def frame_to_page(links: Column) -> Column:
    """Folds frame links, leaf first, into one map; null where a link is not connected to the next.

    A link is a struct (frame, parent, map); the chain must be gapless and without repeats.
    """
    joined = F.forall(F.sequence(F.lit(1), F.size(links) - 1), lambda i: F.get(links, i - 1)["parent"] == F.get(links, i)["frame"])
    distinct = F.size(F.array_distinct(F.transform(links, lambda x: x["frame"]))) == F.size(links)
    whole = F.aggregate(links, affine(F.lit(1), F.lit(1), F.lit(0), F.lit(0)), lambda t, x: compose(t, x["map"]))
    return F.when((F.size(links) == 0) | (((F.size(links) == 1) | joined) & distinct), whole)


def is_space(kind: Column, name: Column, document: Column, observation: Column) -> Column:
    """Whether a coordinate space is named and belongs to an observation, a whole number from 1."""
    named = (F.length(name) > 0) & (F.length(document) > 0)
    return F.coalesce(kind.isin(*SPACES) & named & (observation >= 1) & (observation <= 2**53 - 1) & (observation == F.floor(observation)), F.lit(False))


def is_rect(b: Column) -> Column:
    """Finite corners and no negative size."""
    ends = is_finite(b["x"] + b["w"]) & is_finite(b["y"] + b["h"])
    return F.coalesce(is_valid_box(b) & ends, F.lit(False))


def is_affine(t: Column) -> Column:
    """Positive finite scales and finite shifts."""
    finite = is_finite(t["sx"]) & is_finite(t["sy"]) & is_finite(t["tx"]) & is_finite(t["ty"])
    return F.coalesce(finite & (t["sx"] > 0) & (t["sy"] > 0), F.lit(False))


def map_point(t: Column, x: Column, y: Column) -> Column:
    return F.struct((x * t["sx"] + t["tx"]).alias("x"), (y * t["sy"] + t["ty"]).alias("y"))


def _whole(value: Column) -> Column:
    return is_finite(value) & (value == F.floor(value)) & (value > 0)


def capture_code(c: Column) -> Column:
    """Why a capture can't be used, or null.

    ``c`` has id, scroll_x, scroll_y, layout_w, layout_h, visual_w, visual_h, offset_x, offset_y, scale,
    ratio, zoom, image_w, image_h and viewport (layout or visual). The device's pixel ratio is checked, never used.
    """
    missing = F.greatest(*(c[k].isNull() for k in ("id", "scroll_x", "layout_w", "visual_w", "image_w")))
    free, positive = (F.array(*(c[k] for k in names.split())) for names in ("scroll_x scroll_y offset_x offset_y", "layout_w layout_h visual_w visual_h scale ratio zoom image_w image_h"))
    wrong = (F.length(c["id"]) == 0) | F.exists(free, lambda x: ~is_finite(x)) | F.exists(positive, lambda x: ~is_finite(x) | (x <= 0)) | (c["image_w"] != F.floor(c["image_w"])) | (c["image_h"] != F.floor(c["image_h"]))
    return F.when(missing, "missing_metadata").when(wrong, "invalid_geometry").when(~F.coalesce(c["viewport"].isin("layout", "visual"), F.lit(False)), "missing_metadata")


def page_to_image(c: Column, good: Column) -> Column:
    """A capture's map from page to image: minus the scroll, then by the image's size over the captured viewport's.

    ``good`` tells that ``capture_code`` found nothing wrong; a column of its own is checked once, not for every part of the map.
    """
    visual = c["viewport"] == "visual"
    sx, sy = (c[f"image_{k}"] / F.when(visual, c[f"visual_{k}"]).otherwise(c[f"layout_{k}"]) for k in "wh")
    to_view = affine(F.lit(1), F.lit(1), -c["scroll_x"], -c["scroll_y"])
    to_image = affine(sx, sy, F.when(visual, -c["offset_x"] * sx).otherwise(0.0), F.when(visual, -c["offset_y"] * sy).otherwise(0.0))
    return F.when(good, compose(to_view, to_image))


def is_current(document: Column, observation: Column, now_document: Column, now_observation: Column) -> Column:
    return F.coalesce((document == now_document) & (observation == now_observation), F.lit(False))


def image_to_crop(region: Column, image_w: Column, image_h: Column, out_w: Column, out_h: Column) -> Column:
    """The map from an image to a crop of one of its regions, null unless the region lies inside and all sizes are positive."""
    inside = (region["x"] >= 0) & (region["y"] >= 0) & (region["x"] + region["w"] <= image_w) & (region["y"] + region["h"] <= image_h)
    good = is_rect(region) & (region["w"] > 0) & (region["h"] > 0) & _whole(out_w) & _whole(out_h) & inside
    sx, sy = out_w / region["w"], out_h / region["h"]
    return F.when(F.coalesce(good, F.lit(False)), affine(sx, sy, -region["x"] * sx, -region["y"] * sy))


def frame_chain(links: Column, document: Column, scroll_x: Column, scroll_y: Column) -> Column:
    """``(code, map)`` of frame links, leaf first and ending in ``document``, from the leaf's page to the document's.

    A link has child, parent, scroll_x, scroll_y (the child's), origin_x, origin_y, inset_x, inset_y, a, b, c, d and
    perspective. A repeated frame is invalid, a gap is missing, anything but scaling and moving unsupported. Scroll is
    taken off a child and added for its parent, so the next link starts from its page.
    """
    n = F.size(links)
    last = F.sequence(F.lit(1), n)
    children = F.transform(links, lambda x: x["child"])
    repeats = (F.size(F.array_distinct(children)) != n) | F.array_contains(children, document)
    gap = F.exists(last, lambda i: ~F.get(links, i - 1)["parent"].eqNullSafe(F.coalesce(F.get(links, i)["child"], document)))
    odd = F.exists(links, lambda x: x["perspective"] | (x["b"] != 0) | (x["c"] != 0) | (x["a"] <= 0) | (x["d"] <= 0))
    unfinished = F.exists(links, lambda x: ~(is_finite(x["scroll_x"]) & is_finite(x["scroll_y"]) & is_finite(x["origin_x"]) & is_finite(x["origin_y"])) | (x["inset_x"] < 0) | (x["inset_y"] < 0))
    code = F.when(n <= 0, "missing_metadata").when(repeats | unfinished, "invalid_geometry").when(gap, "missing_metadata").when(odd, "unsupported_transform")

    def step(t: Column, i: Column) -> Column:
        x, above = F.get(links, i - 1), F.get(links, i)
        up_x, up_y = F.coalesce(above["scroll_x"], scroll_x), F.coalesce(above["scroll_y"], scroll_y)
        tx = (t["tx"] - x["scroll_x"] + x["inset_x"]) * x["a"] + x["origin_x"] + up_x
        ty = (t["ty"] - x["scroll_y"] + x["inset_y"]) * x["d"] + x["origin_y"] + up_y
        return affine(t["sx"] * x["a"], t["sy"] * x["d"], tx, ty)

    whole = F.aggregate(last, affine(F.lit(1), F.lit(1), F.lit(0), F.lit(0)), step)
    return F.struct(code.alias("code"), F.when(code.isNull(), whole).alias("map"))


def two_places(value: Column) -> Column:
    """To hundredths, halves upward."""
    return F.floor(value * 100 + 0.5) / 100


def ring(target: Column, padding: float = RING_PADDING) -> Column:
    return _drawn(target["x"] - padding, target["y"] - padding, target["w"] + 2 * padding, target["h"] + 2 * padding)


def underline(target: Column, gap: float = UNDERLINE_GAP) -> Column:
    return _drawn(target["x"], target["y"] + target["h"] + gap, target["w"], F.lit(1.0))


def spotlight(target: Column, padding: float = SPOTLIGHT_PADDING) -> Column:
    return _drawn(target["x"] - padding, target["y"] - padding, target["w"] + 2 * padding, target["h"] + 2 * padding)


def _drawn(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A drawn box: to hundredths, each side 1 at least."""
    return box(two_places(x), two_places(y), two_places(F.greatest(w, F.lit(1.0))), two_places(F.greatest(h, F.lit(1.0))))


def arrow(from_x: Column, from_y: Column, to_x: Column, to_y: Column) -> Column:
    """``(length, angle)``: never shorter than SHORTEST_ARROW, in degrees clockwise from the right."""
    length = F.greatest(F.hypot(to_x - from_x, to_y - from_y), F.lit(SHORTEST_ARROW))
    return F.struct(two_places(length).alias("length"), two_places(F.degrees(F.atan2(to_y - from_y, to_x - from_x))).alias("angle"))


def ordinal(index: Column) -> Column:
    """A badge's number: cut to a whole one from 1 to 999; nothing for what is no number."""
    cut = F.when(index < 0, F.ceil(index)).otherwise(F.floor(index))
    return F.when(is_finite(index), F.least(F.greatest(cut, F.lit(1)), F.lit(MOST_ORDINAL)).cast("bigint"))


def eased(progress: Column) -> Column:
    """Ease-out cubic over 0 to 1."""
    t = F.least(F.greatest(progress, F.lit(0.0)), F.lit(1.0))
    return 1 - (1 - t) * (1 - t) * (1 - t)


def clamp(value: Column, extent: Column, room: Column) -> Column:
    most = room - extent - MARGIN
    return F.when(most < MARGIN, F.lit(MARGIN)).otherwise(F.least(F.greatest(value, F.lit(MARGIN)), most))


def fits(value: Column, extent: Column, room: Column) -> Column:
    return (value >= MARGIN) & (value + extent <= room - MARGIN)


def position_for(side: str, target: Column, view: Column, offset: Column, size: Column) -> Column:
    """Where a marker goes on one side of its target, its cross axis kept on screen."""
    lean = (view["h"] - F.when(view["w"] > 0, view["w"] / 2).otherwise(0.0)) * 0.05
    if side in ("top", "bottom"):
        x = clamp(target["x"] + (target["w"] - size["w"]) / 2, size["w"], view["w"])
        y = target["y"] - size["h"] - offset if side == "top" else target["y"] + target["h"] + offset
    else:
        x = target["x"] - size["w"] - offset if side == "left" else target["x"] + target["w"] + offset
        y = clamp(target["y"] + (target["h"] - size["h"]) / 2 - lean, size["h"], view["h"])
    return F.struct(x.alias("x"), y.alias("y"), F.lit(side).alias("side"))


def placement(target: Column, view: Column, offset: Column, size: Column, preferred: str = "bottom") -> Column:
    """The first of the preferred, the opposite and the fallback side that fits, else the preferred one, clamped."""
    sides = (preferred, OPPOSITE[preferred], "bottom" if preferred in ("left", "right") else "right")
    tried = [position_for(s, target, view, offset, size) for s in sides]
    room = [fits(p["x"], size["w"], view["w"]) & fits(p["y"], size["h"], view["h"]) for p in tried]
    first = tried[0]
    x, y = clamp(first["x"], size["w"], view["w"]), clamp(first["y"], size["h"], view["h"])
    told = F.struct(x.alias("x"), y.alias("y"), F.lit(preferred).alias("side"), ((x != first["x"]) | (y != first["y"])).alias("clamped"))
    for p, good in zip(reversed(tried), reversed(room)):
        told = F.when(good, F.struct(p["x"].alias("x"), p["y"].alias("y"), p["side"].alias("side"), F.lit(False).alias("clamped"))).otherwise(told)
    return told


def hundredths(value: Column) -> Column:
    return F.floor(value * 100 + 0.5).cast("bigint")
