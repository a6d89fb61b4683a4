"""Source divergence audit: how far the term shares of each source lie from those of its language's others.

Tasks count the terms of their texts in byte tries (``byte_tries``) whose leaves hold a counter for each source. Tries
merge: a task puts what it has counted together whenever it holds ``HELD`` leaves, and hands on one row a leaf, with
its sources' counters. These rows are dealt by ranges of language and term, so each range of prefixes is one task's;
walking its rows in the order of their UTF-8 bytes, the task adds up equal leaves as they pass and holds one at a time.

A second walk, in blocks of at most ``BLOCK`` terms, has the sums of every group at hand: it adds up the divergence
of each pair of a language's sources and keeps each group's ten best terms; ties stand in the order of the walk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.byte_tries import as_binary, gathered, leaves, runs, stretches
from tidemark.llm.shared import give_back, shuffle_width, staged

LEAST_DOCS = 10
TOP = 10
#: Leaves that a task holds before it hands them on, terms of a block, and cells of a table of shares in a task.
HELD, BLOCK, CELLS = 1 << 20, 1 << 16, 1 << 21
SCALE_STEPS = 3  # shares are in units of 1000 ** -3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
COUNTED = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("sources", pa.list_(pa.string())), ("ns", pa.list_(pa.int64())), ("docs", pa.int64())])
COUNTED_DDL = "lang string, term binary, sources array<string>, ns array<bigint>, docs bigint"


class Leaves:
    """Counted terms: bytes, the group (language and source), occurrences and documents of each leaf."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, data, starts, lens, group, n, docs):
        self.parts.append((*_compact(data, starts, lens), group, n, docs))
        self.size += len(group)

    def merged(self, one_document: bool = False):
        """All parts as one trie; ``one_document``: they are parts of the same text, which counts once."""
        if not self.parts:
            return None
        base = np.cumsum([0, *(len(p[0]) for p in self.parts[:-1])])
        data = np.concatenate([p[0] for p in self.parts])
        starts = np.concatenate([p[1] + b for p, b in zip(self.parts, base)])
        lens, group, n, docs = (np.concatenate([p[k] for p in self.parts]) for k in (2, 3, 4, 5))
        leaf, place = leaves(data, starts, lens)
        width = int(group.max(initial=0)) + 1
        key, at = np.unique(leaf * width + group, return_inverse=True)
        total, seen = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        np.add.at(total, at, n)
        np.add.at(seen, at, docs)
        first = place[key // width]
        self.parts, self.size = [], 0
        self.add(data, starts[first], lens[first], key % width, total, np.minimum(seen, 1) if one_document else seen)
        return self.parts[0]


def _compact(data, starts, lens):
    own, offsets = gathered(data, starts, lens)
    return own, offsets[:-1], lens


def _counted(data, offsets, groups):
    """The leaves of some whole texts: term bytes, the group, occurrences and documents of each."""
    low = _LOWER[data]
    starts, lens = runs(_LETTER[data], offsets[1:-1])
    leaf, place = leaves(low, starts, lens)
    text = np.searchsorted(offsets[1:], starts, "right")
    in_text, n = np.unique(leaf * len(groups) + text, return_counts=True)
    leaf, group = in_text // len(groups), groups[in_text % len(groups)]
    width = int(groups.max(initial=0)) + 1
    key, at, docs = np.unique(leaf * width + group, return_inverse=True, return_counts=True)
    total = np.bincount(at, n, len(key)).astype(np.int64)
    first = place[key // width]
    return low, starts[first], lens[first], key % width, total, docs


def _counter(held: int):
    def rows(found: Leaves, names: list[tuple[str, str]]):
        part = found.merged()
        if part is None or not len(part[3]):
            return
        data, starts, lens, group, n, docs = part
        leaf, _ = leaves(data, starts, lens)
        langs = sorted({x[0] for x in names})
        lang_of = np.array([langs.index(x[0]) for x in names])
        order = np.lexsort((group, lang_of[group], leaf))
        key = leaf[order] * len(langs) + lang_of[group[order]]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        offsets = pa.array(np.append(first, len(key)), pa.int32())
        lead = order[first]
        sources = pa.array([x[1] for x in names], pa.string()).take(pa.array(group[order]))
        columns = [
            pa.array(langs, pa.string()).take(pa.array(lang_of[group[lead]])), as_binary(data, starts[lead], lens[lead]),
            pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, pa.array(n[order])), pa.array(np.add.reduceat(docs[order], first)),
        ]
        yield from pa.Table.from_arrays(columns, schema=COUNTED).to_batches(max_chunksize=65_536)

    def run(batches):
        found, names, number, long = Leaves(), [], {}, Leaves()
        for b in batches:
            groups = np.array([number.setdefault(x, len(number)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
            names = list(number)
            for first, to, data, offsets, whole in stretches(b.column(2), ~_LETTER):
                one = _counted(data, offsets, groups[first:to])
                if not whole or long.size:
                    long.add(*one)
                    if whole or long.size > held:
                        long.merged(one_document=True)
                    if whole and long.size:
                        found.add(*long.parts[0])
                        long = Leaves()
                else:
                    found.add(*one)
                if found.size > held:
                    found.merged()
                    if found.size > held // 2:
                        yield from rows(found, names)
                        found = Leaves()
            if not found.size:
                number, names = {}, []
        yield from rows(found, names)
        give_back()

    return run


def _merger(least: int, block: int):
    """Adds up equal leaves that follow each other; gives those of enough documents, in blocks of one language."""

    def settle(t: pa.Table) -> pa.Table:
        lang, term = t["lang"].combine_chunks(), t["term"].combine_chunks()
        new = np.ones(len(t), bool)
        new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        lists, ns = t["sources"].combine_chunks(), t["ns"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        row = np.repeat(np.cumsum(new) - 1, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        width = max(1, len(coded.dictionary))
        key, at = np.unique(row * width + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, ns)
        offsets = pa.array(np.searchsorted(key // width, np.arange(len(first) + 1)), pa.int32())
        columns = [lang.take(pa.array(first)), term.take(pa.array(first)), pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(key % width))), pa.ListArray.from_arrays(offsets, pa.array(total)), pa.array(np.add.reduceat(t["docs"].to_numpy(), first))]
        return pa.Table.from_arrays(columns, schema=COUNTED)

    def run(batches):
        base, at, in_block, last, rest = TaskContext.get().partitionId() << 32, 0, 0, None, None

        def out(t: pa.Table):
            nonlocal at, in_block, last
            t = t.filter(pc.greater_equal(t["docs"], least))
            numbers = np.empty(len(t), np.int64)
            for k, lang in enumerate(t["lang"].to_pylist()):
                if lang != last or in_block == block:
                    at, in_block, last = at + 1, 0, lang
                in_block += 1
                numbers[k] = base + at
            return t.append_column("block", pa.array(numbers)).to_batches()

        for b in batches:
            t = pa.Table.from_batches([b]).cast(COUNTED)
            t = settle(t if rest is None else pa.concat_tables([rest, t])) if len(t) else rest
            if t is not None:
                rest = t.slice(len(t) - 1)
                yield from out(t.slice(0, len(t) - 1))
        if rest is not None:
            yield from out(rest)

    return run


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * count / total), in whole numbers throughout: digits come three at a time."""
    share, rest = np.divmod(count, total)
    for _ in range(SCALE_STEPS):
        digits, rest = np.divmod(rest * 1000, total)
        share = share * 1000 + digits
    return share + 1


def _distances(top: int, cells: int):
    """One block of a language's kept terms against all its groups: parts of pair sums, and the best terms of each group."""
    schema = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(kept: pa.Table, groups: pa.Table) -> pa.Table:
        if not len(groups):
            return schema.empty_table()
        groups = groups.sort_by("source")
        lang, sources = groups["lang"][0].as_py(), groups["source"].combine_chunks()
        n_sources, terms = len(sources), len(kept)
        out, sums = [], np.zeros((n_sources, n_sources), np.int64)
        if terms:
            kept = kept.sort_by("term")
            v = groups["v"][0].as_py()
            size = groups["total"].to_numpy() + 2 * v
            size_all = groups["lang_total"][0].as_py() + 2 * v
            lists = kept["sources"].combine_chunks()
            own = pc.index_in(lists.flatten(), sources).to_numpy(zero_copy_only=False)
            ns = kept["ns"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(terms), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            q = shares(_sums(row, ns, terms) + 2, np.full(terms, size_all))
            step = max(1, cells // n_sources)
            for at in range(0, terms, step):
                here = slice(*np.searchsorted(row, [at, min(terms, at + step)]))
                count = np.full((min(step, terms - at), n_sources), 2, np.int64)
                count[row[here] - at, own[here]] += ns[here]
                p = shares(count, size[None, :])
                for g in range(n_sources - 1):
                    d = p[:, g + 1 :] - p[:, g : g + 1]
                    sums[g, g + 1 :] += (d * d // (p[:, g + 1 :] + p[:, g : g + 1])).sum(0)
            p = shares(ns + 2, size[own])
            d = p - q[row]
            value = d * d // (p + q[row])
            more = np.flatnonzero((ns > 0) & (d > 0))
            order = more[np.lexsort((row[more], -value[more], own[more]))]
            rank = np.arange(len(order)) - np.searchsorted(own[order], own[order])
            best = order[rank < top]
            names = kept["term"].combine_chunks().take(pa.array(row[best])).cast(pa.string())
            out.append(pa.Table.from_arrays([pa.array(["term"] * len(best), pa.string()), pa.array([lang] * len(best), pa.string()), sources.take(pa.array(own[best])), names, pa.array(value[best])], schema=schema))
        sums += sums.T
        one, other = np.nonzero(~np.eye(n_sources, dtype=bool))
        out.append(pa.Table.from_arrays([pa.array(["pair"] * len(one), pa.string()), pa.array([lang] * len(one), pa.string()), sources.take(pa.array(one)), sources.take(pa.array(other)), pa.array(sums[one, other])], schema=schema))
        return pa.concat_tables(out)

    return run


def _sums(row: np.ndarray, ns: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, row, ns)
    return out


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", held: int = HELD, block: int = BLOCK) -> DataFrame:
    """``(lang, term, sources, ns, docs, block)``: each language's terms of ``least_docs`` documents or more, and their occurrences by source."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counted = staged(rows.mapInArrow(_counter(held), COUNTED_DDL), "divergence-leaves")
    ranged = counted.repartitionByRange(shuffle_width(docs.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    return staged(ranged.mapInArrow(_merger(least_docs, block), COUNTED_DDL + ", block bigint"), "divergence-terms")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", held: int = HELD, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: the divergence of each group from the others of its language.

    Terms are runs of A-Z, a-z and characters past ASCII, A-Z lower-cased; a language keeps those in ``least_docs``
    of its documents. ``part`` is ``pair`` (item: another source of the language, value: the divergence summed
    over the kept terms) or ``term`` (item: a term more frequent here than in the language, its ``top`` best).
    Null language, source and text are ''. Groups without terms have their pairs all the same; a language's only
    source has none. Repeated rows count as often as they come; equal values rank by the item's bytes; an empty
    table gives no rows; other columns are ignored. A language's sources stand in one square table in a task, so
    their number is bounded by its memory (5,000: 200 MB); terms and documents are not.
    """
    kept = kept_terms(docs, least_docs, lang_col, source_col, text_col, held, block)
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source")))).distinct()
    zipped = kept.select("lang", F.explode(F.arrays_zip("sources", "ns")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.ns").alias("total"))
    each = groups.join(zipped, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    whole = each.groupBy("lang").agg(F.sum("total").alias("lang_total")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    blocks = kept.select("lang", "block").distinct()
    asked = staged(each.join(whole, "lang").join(blocks, "lang", "left").select("lang", F.coalesce("block", F.lit(-1)).alias("block"), "source", "total", "lang_total", F.coalesce("v", F.lit(0)).alias("v")), "divergence-groups")
    parts = kept.select("lang", "block", "term", "sources", "ns").groupBy("lang", "block").cogroup(asked.groupBy("lang", "block")).applyInArrow(_distances(top, cells), "part string, lang string, source string, item string, value bigint")
    parts = staged(parts, "divergence-parts")
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    # a pair has a row for each block; a term is in one block only, and tasks keep their own best before they are dealt
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", rank)
    terms = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
