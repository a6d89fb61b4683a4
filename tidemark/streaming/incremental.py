"""Incremental extraction: the candidates of a page kept up to date from the records of its changes.

A page is one key. Its state holds the live nodes, the snapshot of each candidate that the last pass committed, the records
since then, and where the passes stand. Records only queue; a pass looks at what they can have touched: the
nodes themselves, all below and above them, and candidates that take their name from one of these. Too many
records, too large a one, or one that moves the whole page's looks (class, style, hidden, slot, name) make the next pass a
full one, as does every ``reconcile_every``-th. A pass during which the page changed is unstable and commits nothing; what was
queued stays queued. A pass over more than ``max_entries`` candidates is limited and leaves a full one to do.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

NODE = "parent bigint, tag string, text string, label string, labelled_by bigint, disabled boolean"
RECORDS = f"page_id bigint, batch bigint, seq bigint, kind string, node bigint, {NODE}, field string, size bigint"
TOLD = (
    "page_id bigint, batch bigint, status string, observation bigint, baseline bigint, is_full boolean, recomputed bigint, added bigint, changed bigint, removed bigint, "
    "node bigint, change string, name string, disabled boolean"
)
SNAPSHOT = "name string, disabled boolean, labelled_by bigint"
CANDIDATES = frozenset({"a", "button", "input"})
WHOLE_PAGE = frozenset({"class", "style", "hidden", "slot", "name"})
MAX_RECORDS, MAX_ENTRIES, RECONCILE_EVERY = 1024, 20_000, 20


class Page:
    """The live nodes of a page while its records of a micro-batch are taken in."""

    def __init__(self, nodes: dict[int, tuple]):
        self.nodes = nodes
        self.children: dict[int | None, set[int]] = {}
        for n, v in nodes.items():
            self.children.setdefault(v[0], set()).add(n)
        self.touched: set[int] = set()

    def put(self, node: int, value: tuple) -> None:
        old = self.nodes.get(node)
        if old is not None:
            self.children[old[0]].discard(node)
        self.nodes[node] = value
        self.children.setdefault(value[0], set()).add(node)
        self.touched.add(node)

    def below(self, node: int) -> list[int]:
        """The node and all below it."""
        out, todo = [], [node]
        while todo:
            now = todo.pop()
            out.append(now)
            todo += self.children.get(now, ())
        return out

    def drop(self, node: int) -> list[int]:
        gone = [n for n in self.below(node) if n in self.nodes]
        for n in gone:
            self.children.get(self.nodes.pop(n)[0], set()).discard(n)
            self.touched.add(n)
        return gone

    def above(self, node: int | None) -> Iterator[int]:
        """The node and all above it."""
        while node is not None:
            yield node
            node = self.nodes[node][0] if node in self.nodes else None

    def text(self, node: int) -> str:
        """The text of a node and what is below it, in order."""
        parts, todo = [], [node]
        while todo:
            now = todo.pop()
            if now in self.nodes:
                parts.append(self.nodes[now][2])
                todo += sorted(self.children.get(now, ()), reverse=True)
        return " ".join(p for p in parts if p)

    def candidates(self) -> list[int]:
        return [n for n, v in self.nodes.items() if v[1] in CANDIDATES]

    def snapshot(self, node: int) -> tuple:
        _, _, _, label, by, disabled = self.nodes[node]
        name = self.text(by) if by is not None and by in self.nodes else label if label is not None else self.text(node)
        return (name, bool(disabled), by)

    def to_look_at(self, affected: set[int]) -> list[int]:
        """The candidates whose snapshot an affected node can have changed."""
        over = {n for a in affected for n in self.above(a)}  # affected ones and those that contain one
        touches = lambda n: n in over or any(m in affected for m in self.above(n))
        return [n for n in self.candidates() if touches(n) or (self.nodes[n][4] is not None and touches(self.nodes[n][4]))]


class Incremental(StatefulProcessor):
    def __init__(self, max_records: int, max_entries: int, reconcile_every: int):
        self.max_records, self.max_entries, self.reconcile_every = max_records, max_entries, reconcile_every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getMapState("nodes", "node bigint", NODE)
        self.entries = handle.getMapState("entries", "node bigint", SNAPSHOT)
        self.queue = handle.getListState("queue", "nodes array<bigint>")
        self.passes = handle.getValueState("passes", "observation bigint, whole boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        page = Page({k[0]: tuple(v) for k, v in self.nodes.iterator()})
        entries = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        queue = [list(q[0]) for q in self.queue.get()]
        observation, whole = self.passes.get() if self.passes.exists() else (0, True)
        stored = dict(entries)
        for r in sorted(rows, key=lambda r: r.seq):
            if r.kind != "extract":
                whole |= self.accept(page, queue, r)
                continue
            full = whole or (observation > 0 and observation % self.reconcile_every == 0)
            some = page.candidates() if full else page.to_look_at({n for q in queue for n in q})
            base = {"page_id": key[0], "batch": r.batch, "observation": observation, "baseline": None, "is_full": full, "recomputed": 0, "added": 0, "changed": 0, "removed": 0, "node": None, "change": None, "name": None, "disabled": None}
            if r.size:
                yield Row(**_told(base | {"status": "unstable"}))
                continue
            fresh = {n: page.snapshot(n) for n in some}
            after = fresh if full else {n: e for n, e in entries.items() if n in page.nodes} | fresh
            if len(after) > self.max_entries:
                whole = True
                yield Row(**_told(base | {"status": "limited"}))
                continue
            changes = [(n, "added" if n not in entries else "changed", *after[n][:2]) for n in sorted(after) if after[n] != entries.get(n)]
            changes += [(n, "removed", None, None) for n in sorted(entries) if n not in after]
            base |= {"status": "complete", "observation": observation + 1, "baseline": observation or None, "recomputed": len(fresh)} | {c: sum(x[1] == c for x in changes) for c in ("added", "changed", "removed")}
            yield Row(**_told(base))
            for n, change, name, disabled in changes:
                yield Row(**_told(base | {"node": n, "change": change, "name": name, "disabled": disabled}))
            entries, observation, whole = after, observation + 1, False
            queue.clear()
        self.commit(page, stored, entries, queue, (observation, whole))

    def accept(self, page: Page, queue: list, r: Row) -> bool:
        """Takes a record into the page and the queue; whether the next pass has to be a full one."""
        known = page.nodes.get(r.node)
        affected = [r.node]
        size = r.size or 1
        if r.kind == "add":
            page.put(r.node, (r.parent, r.tag, r.text, r.label, r.labelled_by, r.disabled))
            affected += [] if r.parent is None else [r.parent]
        elif r.kind == "remove":
            parent = known[0] if known else None
            affected += ([] if parent is None else [parent]) + page.drop(r.node)
            size = max(size, len(affected))
        elif known is not None:
            names = ("parent", "tag", "text", "label", "labelled_by", "disabled")
            field = "text" if r.kind == "text" else r.field
            if field in names[2:]:
                page.put(r.node, tuple(r[n] if n == field else v for n, v in zip(names, known)))
        if size > self.max_records or len(queue) >= self.max_records:
            queue.clear()
            return True
        queue.append(affected)
        return r.kind == "layout" or (r.kind == "attribute" and r.field in WHOLE_PAGE)

    def commit(self, page: Page, stored: dict, entries: dict, queue: list, passes: tuple) -> None:
        for n in page.touched:
            if n in page.nodes:
                self.nodes.updateValue((n,), page.nodes[n])
            else:
                self.nodes.removeKey((n,))
        for n in entries.keys() | stored.keys():
            if n not in entries:
                self.entries.removeKey((n,))
            elif entries[n] != stored.get(n):
                self.entries.updateValue((n,), entries[n])
        self.queue.put([(q,) for q in queue]) if queue else self.queue.clear()
        self.passes.update(passes)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        return iter([])

    def close(self) -> None:
        pass


_ORDER = [c.strip().split(" ")[0] for c in TOLD.split(",")]


def _told(row: dict) -> dict:
    return {c: row[c] for c in _ORDER}


def observations(records: DataFrame, max_records: int = MAX_RECORDS, max_entries: int = MAX_ENTRIES, reconcile_every: int = RECONCILE_EVERY) -> DataFrame:
    """What each pass over each page finds (TOLD): a row without a node for the pass, and one for each change that it commits.

    ``records`` is a stream of RECORDS: ``add``, ``remove``, ``text``, ``attribute`` and ``layout`` change a page, in the order
    of ``seq``; ``extract`` asks for a pass, and its size tells (1) that the page changed meanwhile. State for each page is its nodes, at most
    ``max_entries`` snapshots and ``max_records`` records.
    """
    if min(max_records, max_entries, reconcile_every) < 1:
        raise ValueError("limits are at least 1")
    return records.groupBy("page_id").transformWithState(statefulProcessor=Incremental(max_records, max_entries, reconcile_every), outputStructType=TOLD, outputMode="append", timeMode="None")
