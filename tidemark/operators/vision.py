"""Synthetic detector rows, coverage of detector results and OCR confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geometry import hundredths
from tidemark.functions.hashing import confidence, draws, floor2, fraction, seed_for

# Fixed values of the synthetic detector.
CLASSES = ("button", "input", "link", "icon", "text_block")
MAX_ITEMS = 3
OFFSET, LEAST = 0.6, 0.3


def draw_box(d: list[Column], x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box inside an area from four draws, rounded down to hundredths."""
    left, top = x + fraction(d[0]) * w * OFFSET, y + fraction(d[1]) * h * OFFSET
    width = (x + w - left) * (LEAST + fraction(d[2]) * (1 - LEAST))
    height = (y + h - top) * (LEAST + fraction(d[3]) * (1 - LEAST))
    return F.struct(floor2(left).alias("x"), floor2(top).alias("y"), floor2(width).alias("w"), floor2(height).alias("h"))


def detections(images: DataFrame, operation: str = "runDetector") -> DataFrame:
    """``(id, n, item, x, y, w, h, class, conf)``: one to three deterministic items of each image (id, frame, width, height).

    The first draw gives the number of items; each item takes four draws for its box, one for its class
    and one for its confidence. Items are in page order, top first, then left.
    """
    seeded = images.withColumn("d", draws(seed_for(F.lit(operation), F.col("frame"), F.col("width"), F.col("height"), F.lit(None).cast("string")), 1 + 6 * MAX_ITEMS))
    seeded = seeded.withColumn("n", (F.get("d", F.lit(0)) % MAX_ITEMS + 1).cast("int"))

    def item(k: Column) -> Column:
        d = [F.get("d", 1 + k * 6 + i) for i in range(6)]
        b = draw_box(d, F.lit(0.0), F.lit(0.0), F.col("width").cast("double"), F.col("height").cast("double"))
        name = F.get(F.array(*map(F.lit, CLASSES)), (d[4] % len(CLASSES)).cast("int"))
        return F.struct(b["y"].alias("y"), b["x"].alias("x"), b["w"].alias("w"), b["h"].alias("h"), name.alias("class"), confidence(d[5]).alias("conf"))

    items = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("n") - 1), item))
    out = seeded.select("id", "n", F.posexplode(items).alias("item", "i"))
    return out.select("id", "n", "item", "i.x", "i.y", "i.w", "i.h", "i.class", "i.conf")


def covers(status: Column, synthetic: Column) -> Column:
    return ~synthetic & status.isin("ok", "empty")


def restricted(status: Column) -> Column:
    return status == "unavailable"


def unavailable_reason(status: Column, reason: Column) -> Column:
    return F.when(status == "unavailable", reason)


def word_confidence(characters: Column) -> Column:
    """The rounded integer mean of a word's character confidences in thousandths."""
    total = F.aggregate(characters, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return F.floor(total / F.size(characters) + 0.5).cast("bigint")


def line_confidence(words: Column) -> Column:
    """The same over all characters of a line, not over its words' means."""
    return word_confidence(F.flatten(words))


def hulls(boxes: DataFrame, key: list[str]) -> DataFrame:
    """The smallest box around each key's boxes (x, y, w, h), in whole hundredths."""
    x, y = hundredths(F.col("x")), hundredths(F.col("y"))
    ends = boxes.groupBy(*key).agg(F.min(x).alias("l"), F.min(y).alias("t"), F.max(x + hundredths(F.col("w"))).alias("r"), F.max(y + hundredths(F.col("h"))).alias("b"))
    return ends.select(*key, (F.col("l") / 100).alias("x"), (F.col("t") / 100).alias("y"), ((F.col("r") - F.col("l")) / 100).alias("w"), ((F.col("b") - F.col("t")) / 100).alias("h"))


def region_summary(results: DataFrame, key: list[str]) -> DataFrame:
    """Per region: results, items, any face, all covered, any restricted."""
    return results.groupBy(*key).agg(
        F.count("*").alias("results"), F.sum("items").alias("items"), F.bool_or((F.col("kind") == "face") & (F.col("items") > 0)).alias("any_face"),
        F.bool_and(covers(F.col("status"), F.col("synthetic"))).alias("all_covered"), F.bool_or(restricted(F.col("status"))).alias("any_restricted"),
    )
