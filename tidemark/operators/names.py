"""Accessible names, descriptions and fallbacks of page elements.

A name may rest on nodes anywhere in its page, so a page's rows go through one Python helper together.
The rows need no shuffle for that: ``pages.nodes`` gives a page's nodes one after the other, roles are
built-in expressions beside them, and ``in_order`` reads whole pages off that stream. A node that would
take too deep a walk, too much text, too many visits or an index of too large a document is ``limited``, and says nothing else.
Each of these bounds may be None, and is none then; with UNBOUNDED no node is limited.

Names follow the tree that is shown: a shadow host has its shadow root's children, a slot the nodes assigned to it. Ids
and labels belong to one document or shadow root each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.pages import SHADOW
from tidemark.operators.semantics import LABELABLE, NAMED_BY_CONTENT, NEVER_NAMED, explicit_role, implicit_role

DEEPEST, MOST_VISITS, LONGEST, MOST_NODES = 128, 20_000, 8_192, 100_000
UNBOUNDED = {"longest": None, "most_nodes": None, "deepest": None, "most_visits": None}
# HTML elements that stand in a line of text, that never speak, and that a child names.
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em i img input ins kbd label map mark object output q s samp select slot small span strong sub sup svg textarea time u var button meter progress".split())
SILENT = ("script", "style", "template", "noscript")
NAMING_CHILD = {"svg": "title", "fieldset": "legend", "table": "caption", "figure": "figcaption"}
NATIVE_VALUES = {"button": "", "submit": "Submit", "reset": "Reset"}

NAME = pa.schema([("page_id", pa.int64()), ("node", pa.int32()), *((k, pa.string()) for k in ("tag", "role", "name", "name_source", "description", "description_source", "fallback", "fallback_source", "status"))])
NAME_DDL = "page_id bigint, node int, tag string, role string, name string, name_source string, description string, description_source string, fallback string, fallback_source string, status string"
NOTHING = ("", "none")


class Limited(Exception):
    """A name would take more than the limits allow."""


def _one_line(text: str) -> str:
    for c in "\t\n\f\r":
        text = text.replace(c, " ")
    return " ".join(x for x in text.split(" ") if x)


def _tokens(text: str | None) -> list[str]:
    return list(dict.fromkeys(_one_line(text or "").split(" "))) if _one_line(text or "") else []


class Page:
    """One page's nodes, with what names need to find: children, ids and labels of each frame context."""

    def __init__(self, rows: list[dict], longest: int | None = LONGEST, most_nodes: int | None = MOST_NODES, deepest: int | None = DEEPEST, most_visits: int | None = MOST_VISITS):
        self.longest, self.most_nodes, self.deepest, self.most_visits = (inf if x is None else x for x in (longest, most_nodes, deepest, most_visits))
        self.sizes: dict[int, int] = {}
        self.shadows: dict[int, int] = {}
        self.rows = {r["node"]: r for r in rows}
        self.children: dict[int | None, list[int]] = {}
        self.ids: dict[tuple[int, str], int] = {}
        self.labels: dict[int, list[int]] = {}
        self.own_hidden: dict[int, bool] = {}
        for r in rows:
            self.sizes[r["context"]] = self.sizes.get(r["context"], 0) + 1
            if r["tag"] == SHADOW:
                self.shadows[r["parent"]] = r["node"]
                continue
            self.children.setdefault(r["parent"], []).append(r["node"])
            if r["attrs"].get("id"):
                self.ids.setdefault((r["context"], r["attrs"]["id"]), r["node"])
        waiting: dict[int, int] = {}  # labels without "for": the first labelable node below them
        for r in rows:
            if r["tag"] == "label":
                if "for" in r["attrs"]:
                    target = self.ids.get((r["context"], r["attrs"]["for"]))
                    if target is not None and self.labelable(target):
                        self.labels.setdefault(target, []).append(r["node"])
                else:
                    waiting[r["node"]] = -1
            elif waiting and self.labelable(r["node"]):
                for above in r["path"]:
                    if waiting.get(above) == -1:
                        waiting[above] = r["node"]
        for label, target in waiting.items():
            if target >= 0:
                self.labels.setdefault(target, []).append(label)
        for found in self.labels.values():
            found.sort()
        self.assigned = self._assigned(rows) if self.shadows else {}
        self.visits = 0

    def _assigned(self, rows: list[dict]) -> dict[int, list[int]]:
        """Each slot's nodes: its host's children of its name, if it is the first of that name."""
        hosts = {self.rows[shadow]["context"]: host for host, shadow in self.shadows.items()}
        slots: dict[tuple[int, str], int] = {}
        for r in rows:
            if r["tag"] == "slot" and r["context"] in hosts:
                slots.setdefault((hosts[r["context"]], r["attrs"].get("name", "")), r["node"])
        out: dict[int, list[int]] = {}
        for host in self.shadows:
            for c in self.children.get(host, []):
                if (slot := slots.get((host, self.rows[c]["attrs"].get("slot", "")))) is not None:
                    out.setdefault(slot, []).append(c)
        return out

    def shown(self, node: int) -> list[int]:
        """The children that a node is shown with."""
        return self.assigned.get(node) or self.children.get(self.shadows.get(node, node), [])

    def indexed(self, node: int) -> None:
        """Ids and labels of a document of too many nodes aren't looked up."""
        if self.sizes[self.rows[node]["context"]] > self.most_nodes:
            raise Limited

    def kind(self, node: int) -> str:
        """The type of an input; empty for other elements."""
        r = self.rows[node]
        return (r["attrs"].get("type") or "text").lower() if r["tag"] == "input" else ""

    def labelable(self, node: int) -> bool:
        return self.rows[node]["tag"] in LABELABLE or self.kind(node) not in ("", "hidden")

    def visit(self, depth: int) -> None:
        self.visits += 1
        if depth > self.deepest or self.visits > self.most_visits:
            raise Limited

    def text(self, text: str) -> str:
        if len(text) > self.longest:
            raise Limited
        return text

    def attr(self, node: int, name: str) -> str | None:
        value = self.rows[node]["attrs"].get(name)
        return None if value is None else self.text(value)

    def hides(self, node: int) -> bool:
        """Whether a node's own attributes hide it and what is below."""
        if node not in self.own_hidden:
            a = self.rows[node]["attrs"]
            style = "".join(a.get("style", "").lower().split())
            self.own_hidden[node] = "hidden" in a or a.get("aria-hidden") == "true" or any(part in ("display:none", "content-visibility:hidden") for part in style.split(";"))
        return self.own_hidden[node]

    def hidden(self, node: int) -> bool:
        path = self.rows[node]["path"]
        if len(path) > self.deepest:
            raise Limited
        style = "".join(self.rows[node]["attrs"].get("style", "").lower().split()).split(";")
        return any(self.hides(n) for n in path) or any(x in ("visibility:hidden", "visibility:collapse") for x in style)

    def references(self, node: int, attribute: str) -> list[int]:
        """The nodes that an attribute names, within the node's own frame."""
        context, wanted = self.rows[node]["context"], _tokens(self.attr(node, attribute))
        if wanted:
            self.indexed(node)
        return [self.ids[context, i] for i in wanted if (context, i) in self.ids]

    def content(self, node: int, seen: set[int], shown: bool, referred: bool, depth: int, target: int) -> str:
        out, length = [], 0
        for c in self.shown(node):
            r = self.rows[c]
            self.visit(depth)
            if r["tag"] == "#text":
                out.append(r["text"])
            else:
                own = self.name(c, seen, shown, referred, True, depth + 1, target)[0]
                out.append(own if r["tag"] in INLINE and r["tag"] != "br" else f" {own} ")
            length += len(out[-1])
            if length > self.longest:
                raise Limited
        return "".join(out)

    def name(self, node: int, seen: set[int], shown: bool, referred: bool, inside: bool, depth: int, target: int) -> tuple[str, str]:
        """``(text, source)`` by the first rule that applies.

        shown: hidden nodes count; referred: an id list led here; inside: it is part of another's name.
        """
        self.visit(depth)
        r = self.rows[node]
        if node in seen or r["tag"] in SILENT or (not shown and self.hidden(node)):
            return NOTHING
        if not inside and not referred and r["role"] in NEVER_NAMED:
            return NOTHING
        if not referred and (refs := self.references(node, "aria-labelledby")):
            parts = [self.name(x, seen, self.hidden(x), True, False, depth + 1, target)[0] for x in refs]
            return _one_line(self.text(" ".join(parts))), "aria-labelledby"  # found but empty: the name is empty
        seen.add(node)
        part_of = inside or referred
        for rule in (self._embedded, self._aria_label, self._label, self._alternative, self._button, self._naming_child):
            if (found := rule(node, seen, shown, referred, inside, depth, target)) is not None:
                return found
        if part_of or r["role"] in NAMED_BY_CONTENT:
            if text := _one_line(self.content(node, seen, shown, referred, depth, target)):
                return text, "contents"
        if title := _one_line(self.attr(node, "title") or ""):
            return title, "title"
        return ("Submit Query", "native") if self.kind(node) == "image" else NOTHING

    def _embedded(self, node, seen, shown, referred, inside, depth, target):
        """Inside another's name a control stands for its value; a password never does."""
        if not (inside or referred) or node == target:
            return None
        r, a = self.rows[node], self.rows[node]["attrs"]
        if self.kind(node) == "password":
            return NOTHING
        if r["role"] in ("textbox", "searchbox") and r["tag"] in ("input", "textarea"):
            return self.value(node), "contents"
        if r["role"] in ("slider", "spinbutton"):
            return a.get("aria-valuetext", a.get("aria-valuenow", self.value(node) if r["tag"] == "input" else "")), "contents"
        if r["tag"] == "select":
            picked = self.options(node)
            return _one_line(" ".join([self.content(o, seen, shown, referred, depth + 1, target) for o in picked])), "contents"
        return None

    def _aria_label(self, node, *_):
        text = _one_line(self.attr(node, "aria-label") or "")
        return (text, "aria-label") if text and self.rows[node]["tag"] != "slot" else None

    def _label(self, node, seen, shown, referred, inside, depth, target):
        if not self.labelable(node):
            return None
        self.indexed(node)
        if node not in self.labels:
            return None
        parts = [self.name(x, seen, self.hidden(x), referred, True, depth + 1, target)[0] for x in self.labels[node]]
        return _one_line(self.text(" ".join(parts))), "label"

    def _alternative(self, node, *_):
        takes = self.rows[node]["tag"] in ("img", "area") or self.kind(node) == "image"
        alt = self.attr(node, "alt") if takes else None
        return None if alt is None else (_one_line(alt), "alt")

    def _button(self, node, *_):
        kind = self.kind(node)
        if kind not in NATIVE_VALUES:
            return None
        value = self.attr(node, "value")
        return _one_line(NATIVE_VALUES[kind] if value is None else value), "native"

    def _naming_child(self, node, seen, shown, referred, inside, depth, target):
        tag = self.rows[node]["tag"]
        child = next((c for c in self.children.get(node, []) if self.rows[c]["tag"] == NAMING_CHILD.get(tag)), None)
        if child is None:
            return None
        return _one_line(self.content(child, seen, shown, referred, depth + 1, target)), "svg-title" if tag == "svg" else "native"

    def value(self, node: int) -> str:
        if self.rows[node]["tag"] == "textarea":
            return self.text("".join(self.rows[c]["text"] or "" for c in self.children.get(node, [])))
        return self.attr(node, "value") or ""

    def options(self, node: int) -> list[int]:
        """The selected options; of a select that takes one, the first if none is marked."""
        found, below = [], list(self.children.get(node, []))
        while below:
            c = below.pop(0)
            if self.rows[c]["tag"] == "option":
                found.append(c)
            below[:0] = self.children.get(c, []) if self.rows[c]["tag"] == "optgroup" else []
        marked = [o for o in found if "selected" in self.rows[o]["attrs"]]
        return marked if "multiple" in self.rows[node]["attrs"] else (marked[-1:] or found[:1])

    def told(self, node: int) -> tuple:
        """``(name, source, description, source, fallback, source, status)`` of one element."""
        self.visits = 0
        try:
            r, hidden = self.rows[node], self.hidden(node)
            name, source = self.name(node, set(), False, False, False, 0, node)
            name = _one_line(name)
            if hidden:
                return name, source, "", "none", None, None, "complete"
            description, from_ = self.description(node, source)
            fallback = (None, None)
            if not name and source == "none" and r["role"] not in NEVER_NAMED:
                hint = self.attr(node, "placeholder") if r["tag"] in ("input", "textarea") else None
                for text, kind in ((hint, "placeholder"), (self.attr(node, "alt"), "alt")):
                    if fallback[0] is None and _one_line(text or ""):
                        fallback = (_one_line(text), kind)
            return name, source, description, from_, *fallback, "complete"
        except Limited:
            return "", "none", "", "none", None, None, "limited"

    def description(self, node: int, name_source: str) -> tuple[str, str]:
        if refs := self.references(node, "aria-describedby"):
            seen: set[int] = set()
            parts = [self.name(x, seen, self.hidden(x), True, False, 0, node)[0] for x in refs]
            return _one_line(self.text(" ".join(parts))), "aria-describedby"
        if (told := self.attr(node, "aria-description")) is not None:
            return _one_line(told), "aria-description"
        if self.rows[node]["tag"] == "svg":
            child = next((c for c in self.children.get(node, []) if self.rows[c]["tag"] == "desc"), None)
            if child is not None:
                return _one_line(self.content(child, set(), False, True, 0, node)), "svg-desc"
        title = self.attr(node, "title") if name_source != "title" else None
        return NOTHING if title is None else (_one_line(title), "title")


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Whole pages off a stream of their nodes, one after the other."""
    page, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            r["attrs"] = dict(r["attrs"] or [])
            if r["page_id"] != page and rows:
                yield page, rows
                rows = []
            page = r["page_id"]
            rows.append(r)
    if rows:
        yield page, rows


def in_order(nodes: DataFrame, longest: int | None = LONGEST, most_nodes: int | None = MOST_NODES, deepest: int | None = DEEPEST, most_visits: int | None = MOST_VISITS) -> DataFrame:
    """``accessible_names`` of nodes that come page by page, as ``pages.nodes`` gives them: nothing is shuffled."""
    told = nodes.withColumn("role", F.when(F.col("tag") != "#text", F.coalesce(explicit_role(), implicit_role())))

    def run(batches):
        for page, rows in _pages(batches):
            held = Page(rows, longest, most_nodes, deepest, most_visits)
            if deepest is None:  # a name within a name takes three calls, and each node is named once on the way down
                sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000 + 8 * len(rows)))
            out = [(page, n, r["tag"], *((None,) if found[-1] == "limited" else (r["role"],)), *found) for n, r in held.rows.items() if not r["tag"].startswith("#") for found in (held.told(n),)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), NAME)], schema=NAME)

    return told.select("page_id", "node", "parent", "tag", "attrs", "path", "text", "context", "role").mapInArrow(run, NAME_DDL)


def accessible_names(nodes: DataFrame, longest: int | None = LONGEST, most_nodes: int | None = MOST_NODES, deepest: int | None = DEEPEST, most_visits: int | None = MOST_VISITS) -> DataFrame:
    """``(page_id, node, tag, role, name, name_source, description, description_source, fallback, fallback_source, status)`` of all elements.

    Takes nodes in any order: a page's are brought together and sorted first. status is complete or
    limited; a limited element has no role, name or description. ``longest`` bounds a text, ``most_nodes`` a
    document or shadow root whose ids and labels are looked up, ``deepest`` the levels of a walk, ``most_visits`` its nodes.
    """
    return in_order(nodes.repartition("page_id").sortWithinPartitions("page_id", "node"), longest, most_nodes, deepest, most_visits)
