"""Page scans. ``tags`` is the built-in fast path, ``nodes`` the general parser for any HTML.

The fast path reads start and end tags by regular expressions inside the JVM. It is exact where
attribute values hold no ``>``; the general path has no such limit and also gives parents, text and
frames, at the price of a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

IGNORED = ("script", "style", "template", "noscript")
SECTIONS = ("article", "aside", "main", "nav", "section")
# Which open elements a start tag ends, and the elements that keep it from ending any outside.
IMPLIED = {"p": ("p",), "li": ("li",), "option": ("option",), "optgroup": ("option", "optgroup"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
WITHIN = {"p": ("div", "td", "li", "section", "article", "body"), "li": ("ul", "ol"), "option": ("select", "optgroup"), "optgroup": ("select",), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: The row that stands for a shadow root, between its host and the nodes in it.
SHADOW = "#shadow-root"
# The elements of HTML that may have a shadow root, besides those with a hyphen in their names.
SHADOW_HOSTS = frozenset("article aside blockquote body div footer h1 h2 h3 h4 h5 h6 header main nav p section span".split())
TAG = r"(?i)<(/?[a-z][a-z0-9]*\b[^>]*)>"

NODE_DDL = "page_id bigint, node int, parent int, ord int, tag string, attrs map<string,string>, path array<int>, ancestors array<string>, text string, context int"
NODE = pa.schema(
    [("page_id", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("ord", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("path", pa.list_(pa.int32())), ("ancestors", pa.list_(pa.string())), ("text", pa.string()), ("context", pa.int32())]
)


def without_ignored(html: Column) -> Column:
    """The page without comments and without subtrees whose content never counts."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in IGNORED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def tags(pages: DataFrame) -> DataFrame:
    """``(page_id, ord, tag, closes, attrs, sections)`` for every tag outside ignored subtrees.

    sections is the number of sectioning elements open before the tag.
    """
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(without_ignored(F.col("html")), F.lit(TAG), F.lit(1))).alias("ord", "raw"))
    named = found.select("page_id", "ord", F.lower(F.regexp_extract("raw", r"^/?([A-Za-z][A-Za-z0-9]*)", 1)).alias("tag"), F.col("raw").startswith("/").alias("closes"), F.col("raw").alias("attrs"))
    inside = F.when(F.col("tag").isin(*SECTIONS), F.when(F.col("closes"), -1).otherwise(1)).otherwise(0)
    before = W.partitionBy("page_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return named.withColumn("sections", F.coalesce(F.sum(inside).over(before), F.lit(0)))


def has_attr(attrs: Column, name: str) -> Column:
    return attrs.rlike(rf"(?i)\s{name}(\s|=|/|$)")


class _Walker(HTMLParser):
    """Document-order rows of one page; frames with inline documents and open shadow roots have contexts of their own.

    An element's first ``template`` with shadowrootmode open is its shadow root: a row of its own, below which
    the template's content stands. Other templates, closed roots among them, are left out with all they hold.
    """

    def __init__(self, rows: list | None = None, numbers: Iterator[int] | None = None):
        super().__init__(convert_charrefs=True)
        self.rows = rows if rows is not None else []
        self.numbers = numbers if numbers is not None else count()
        self.context, self.stack, self.mute, self.frames = next(self.numbers), [], 0, []
        self.outside: list[tuple[int, int]] = []  # open shadow roots, and the context around each
        self.hosts: set[int] = set()

    def _row(self, tag, attrs, text):
        node = len(self.rows)
        above = [n for n, _ in self.stack]
        self.rows.append((node, above[-1] if above else None, node, tag, attrs, [*above, node], [t for _, t in self.stack], text, self.context))
        return node

    def handle_starttag(self, tag, attrs):
        if tag == "template" and not self.mute and self._opens_shadow(dict(attrs)):
            return
        if tag in IGNORED:
            self.mute += 1
            return
        if self.mute:
            return
        for ended in IMPLIED.get(tag, ()):
            self._close(ended, stop=WITHIN[tag])
        held = {k: v or "" for k, v in reversed(attrs)}
        node = self._row(tag, held, None)
        if tag == "iframe" and "srcdoc" in held:
            self.frames.append((node, held["srcdoc"]))
        if tag not in VOID:
            self.stack.append((node, tag))

    def _opens_shadow(self, attrs) -> bool:
        host, name = self.stack[-1] if self.stack else (None, "")
        if (attrs.get("shadowrootmode") or "").lower() != "open" or host in self.hosts or not ("-" in name or name in SHADOW_HOSTS):
            return False
        self.hosts.add(host)
        around, self.context = self.context, next(self.numbers)
        node = self._row(SHADOW, {}, None)
        self.outside.append((node, around))
        self.stack.append((node, SHADOW))
        return True

    def handle_endtag(self, tag):
        if tag == "template" and not self.mute and self.outside:
            node, self.context = self.outside.pop()
            del self.stack[next(k for k, (n, _) in enumerate(self.stack) if n == node) :]
            return
        if tag in IGNORED:
            self.mute = max(0, self.mute - 1)
        elif not self.mute:
            self._close(tag)

    def _close(self, tag, stop=()):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][1] == tag:
                del self.stack[k:]
                return
            if self.stack[k][1] in stop or self.stack[k][1] == SHADOW:
                return

    def handle_data(self, data):
        if not self.mute and data:
            self._row("#text", {}, data)


def walk(html: str | None) -> list[tuple]:
    """All node rows of a page, its inline frames after it, breadth first."""
    rows: list[tuple] = []
    queue, numbers = [html or ""], count()
    while queue:
        w = _Walker(rows, numbers)
        w.feed(queue.pop(0))
        w.close()
        queue += [doc for _, doc in w.frames]
    return rows


def nodes(pages: DataFrame) -> DataFrame:
    """One row per element or text node, in document order; see NODE_DDL."""

    def run(batches):
        for b in batches:
            for page, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = walk(html)
                if rows:
                    columns = list(zip(*((page, *r) for r in rows)))
                    columns[5] = [list(a.items()) for a in columns[5]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE)], schema=NODE)

    return pages.select(F.col("page_id").cast("bigint"), "html").mapInArrow(run, NODE_DDL)


def roots(all_nodes: DataFrame) -> DataFrame:
    """``(page_id, context, kind, host, n_nodes)``: each document and open shadow root that holds a node.

    host is the element that has the shadow root.
    """
    inner = all_nodes.where(F.col("tag") != SHADOW).groupBy("page_id", "context").agg(F.count("*").alias("n_nodes"))
    shadows = all_nodes.where(F.col("tag") == SHADOW).select("page_id", "context", F.col("parent").alias("host"))
    found = inner.join(shadows, ["page_id", "context"], "full")
    return found.select("page_id", "context", F.when(F.col("host").isNull(), "document").otherwise("shadow").alias("kind"), "host", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))


def slot_name(attrs: Column) -> Column:
    return F.coalesce(F.coalesce(attrs, F.create_map().cast("map<string,string>"))["slot"], F.lit(""))


def assigned(all_nodes: DataFrame) -> DataFrame:
    """``(page_id, node, slot)``: the light children of shadow hosts and the slots that show them.

    A child goes to the first slot, in tree order, of its host's shadow root that has its name; text goes to the slot without a name.
    """
    shadows = all_nodes.where(F.col("tag") == SHADOW).select("page_id", "context", F.col("parent").alias("host"))
    slots = all_nodes.where("tag = 'slot'").select("page_id", "context", F.coalesce(F.col("attrs")["name"], F.lit("")).alias("name"), "node")
    slots = slots.join(shadows, ["page_id", "context"]).groupBy("page_id", "host", "name").agg(F.min("node").alias("slot"))
    light = all_nodes.where(F.col("tag") != SHADOW).select("page_id", "node", F.col("parent").alias("host"), slot_name(F.col("attrs")).alias("name"))
    return light.join(slots, ["page_id", "host", "name"]).select("page_id", "node", "slot")


def flattened(all_nodes: DataFrame) -> DataFrame:
    """``(page_id, node, parent)``, the tree that is shown: a host's children are those of its shadow root, a slot's the nodes assigned to it.

    Children of a host that no slot takes, and a slot's own children where others are assigned to it, aren't in it.
    """
    a = assigned(all_nodes)
    shadows = all_nodes.where(F.col("tag") == SHADOW).select("page_id", F.col("node").alias("shadow"), F.col("parent").alias("host"))
    out = all_nodes.where(F.col("tag") != SHADOW).select("page_id", "node", "parent").join(a, ["page_id", "node"], "left")
    out = out.join(shadows.select("page_id", F.col("host").alias("parent"), F.lit(True).alias("_hosted")), ["page_id", "parent"], "left")
    out = out.join(shadows.select("page_id", F.col("shadow").alias("parent"), "host"), ["page_id", "parent"], "left")
    out = out.join(a.select("page_id", F.col("slot").alias("parent"), F.lit(True).alias("_filled")).distinct(), ["page_id", "parent"], "left")
    shown = F.col("slot").isNotNull() | (F.col("_hosted").isNull() & F.col("_filled").isNull())
    return out.where(shown).select("page_id", "node", F.coalesce("slot", "host", "parent").alias("parent"))


def subtree(all_nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes at or below ``roots`` (page_id, root): a join on the exploded path, not a scan per root."""
    below = all_nodes.select("page_id", "node", F.explode("path").alias("root"))
    return all_nodes.join(below.join(roots, ["page_id", "root"]).select("page_id", "node").distinct(), ["page_id", "node"], "left_semi")


def covering(roots: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """The roots that no other root contains."""
    placed = all_nodes.join(roots.select("page_id", F.col("root").alias("node")), ["page_id", "node"])
    above = placed.select("page_id", "node", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("root"))
    return roots.join(above.join(roots, ["page_id", "root"], "left_semi").select("page_id", F.col("node").alias("root")).distinct(), ["page_id", "root"], "left_anti")


def frames(all_nodes: DataFrame) -> DataFrame:
    """``(page_id, node, access)``: what a static page tells of each frame."""
    f = all_nodes.where("tag = 'iframe'")
    access = F.when(F.col("attrs")["srcdoc"].isNotNull(), "same-origin").when(F.coalesce(F.col("attrs")["src"], F.lit("")) == "", "unloaded").otherwise("opaque")
    return f.select("page_id", "node", access.alias("access"))
