"""SentencePiece encoding and decoding as relations.

A space stands before each text, and a text is cut into units wherever no piece could cross: between two
characters that stand side by side in no piece of the model. So a unit is mostly the space before a word and
the word, or a mark after it. Every task lists the distinct units of its texts, and owners, a hash range of units each, list those
of the whole table once. A unit's substrings of at most the longest piece's length are exploded and
equi-joined to the piece table, which gives the edges of its lattice; a character that is no piece gets an
edge of its bytes' pieces. The edges are grouped by unit, and a fold over the positions keeps the least cost
and the edge that reached it; a second fold walks back. Owners answer the tasks' lists in order, and each
list's texts read their ids off the answers.

A unit of more than SPAN characters is folded span by span; what a span hands on are the least costs of
its last positions, as many as the longest piece is long, so no piece is kept from crossing into the next.

The cost of a segmentation is the sum of its pieces' costs, as in a unigram model. A BPE model's
file has merge ranks for scores; ``piece_table`` turns rank r into log(r + 10), in steps of 1 / COSTS, as
the piece's cost: a Zipf estimate of how likely it is. So the ids are the best segmentation into the model's pieces; BPE merging
may choose another one. Ties go to the edge with the earliest start.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import bucketed, from_planes, give_back, planes, shuffle_width
from tidemark.llm.tokens import chunks_of_text, spread
from tidemark.llm.wordkeys import bytes_of, segment_keys

SPACE = "▁"
#: Costs are whole numbers, so many to a unit of log probability; a byte costs as much as 20 units.
COSTS = 1 << 16
BYTE_COST = 20 * COSTS
#: An edge is one number: where it ends in its span, its size, its cost, and its id or, if it has none, its character.
TO, SIZE, COST, NO_PIECE = 1 << 52, 1 << 46, 1 << 22, 1 << 21
SPAN = 256
CHUNK_BYTES = 3_000_000
#: A task begins a new list of units after so many bytes of text.
LIST_BYTES = 48_000_000
DOCS_PER_OWNER = 2_000

BLOCK = pa.schema([("shard", pa.int64()), ("block", pa.int64()), *((k, pa.binary()) for k in ("units", "sizes", "index", "meta"))])
BLOCK_DDL = "shard bigint, block bigint, units binary, sizes binary, index binary, meta binary"
ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int64()), *((k, pa.binary()) for k in ("sizes", "ids", "exact"))])
ANSWER_DDL = "block bigint, shard bigint, sizes binary, ids binary, exact binary"
UNIT = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("unit", pa.string())])
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.int32()))])
ENCODED_DDL = "doc_id bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean, ids array<int>"


def _pieces(path: str) -> tuple[list[tuple[str, int, float]], int]:
    """``(piece, id, rank score)`` of the model's ordinary pieces, and the first byte piece's id."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    first_byte = next((i for i in range(n) if m.is_byte(i)), -1)
    return [(m.id_to_piece(i), i, m.get_score(i)) for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))], first_byte


def piece_table(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """``(piece, id, cost)`` of the model's ordinary pieces, the longest piece's length, the first byte piece's id."""
    rows, first_byte = _pieces(path)
    costs = [round(float(np.log(10 - score)) * COSTS) for _, _, score in rows]
    table = pa.table({"piece": [r[0] for r in rows], "id": pa.array([r[1] for r in rows], pa.int32()), "cost": pa.array(costs, pa.int64())})
    return spark.createDataFrame(table), max(len(r[0]) for r in rows), first_byte


def glued(path: str) -> np.ndarray:
    """Which two characters some piece has side by side: a table by ASCII code, 128 for all others; U+2581 counts as a space."""
    out = np.zeros((129, 129), dtype=bool)
    out[128, 128] = True  # not told apart, so never cut
    for piece, _, _ in _pieces(path)[0]:
        codes = [min(ord(c), 128) if c != SPACE else 32 for c in piece]
        out[codes[:-1], codes[1:]] = True
    return out


def _packed(raw: bytes) -> bytes:
    return zstandard.compress(raw, 3)


def _unpacked(raw: bytes) -> bytes:
    return zstandard.decompress(raw)


def _strings(data: bytes, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def _units(texts: pa.Array, together: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All units of the texts in turn, their keys, and each text's number of them."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    data, offsets = bytes_of(spaced)
    kind = np.minimum(data, 128)
    mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
    for i in range(3):
        kind[mark + i] = 32
    begins = np.ones(len(data), dtype=bool)
    begins[1:] = ~together[kind[:-1], kind[1:]] & ((data[1:] & 0xC0) != 0x80)
    begins[offsets[:-1]] = True
    starts = np.flatnonzero(begins)
    return _strings(data.tobytes(), np.diff(np.append(starts, len(data)))), segment_keys(data, starts), np.diff(np.searchsorted(starts, offsets))


class _List:
    """The distinct units of some texts, by key, and the texts' units as numbers among those listed so far."""

    def __init__(self, together: np.ndarray):
        self.together = together
        self.keys, self.at, self.units, self.index, self.docs, self.bytes = np.zeros(0, np.uint64), np.zeros(0, np.uint32), [], [], [], 0

    def add(self, texts: pa.Array, ids: pa.Array) -> None:
        units, keys, counts = _units(texts, self.together)
        order = np.argsort(keys)
        keys = keys[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        distinct = keys[new]
        found = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = found < len(self.keys)
        known[inside] = self.keys[found[inside]] == distinct[inside]
        number = np.zeros(len(distinct), dtype=np.uint32)
        number[known] = self.at[found[known]]
        fresh = np.flatnonzero(~known)
        number[fresh] = len(self.keys) + np.arange(len(fresh), dtype=np.uint32)
        self.units.append(units.take(pa.array(order[new][fresh])))
        self.keys = np.insert(self.keys, found[fresh], distinct[fresh])
        self.at = np.insert(self.at, found[fresh], number[fresh])
        of = np.empty(len(order), dtype=np.uint32)
        of[order] = number[np.cumsum(new) - 1]
        self.index.append(_packed(planes(of)))
        no_id = pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        self.docs.append(np.stack([pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), no_id, counts]))
        self.bytes += len(units)

    def rows(self, block: int, shards: int):
        """The list as questions to its units' owners, and its texts for itself; units go in alphabetical order.

        The texts' units are told by rank of frequency: a byte for the commonest, more for the others.
        """
        units = pa.concat_arrays(self.units)
        shard = np.empty(len(units), dtype=np.int64)
        shard[self.at] = (((self.keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
        order = pc.sort_indices(pa.table({"s": shard, "u": units}), [("s", "ascending"), ("u", "ascending")]).to_numpy()
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        used = np.zeros(len(units), dtype=np.int64)
        for x in self.index:
            used += np.bincount(from_planes(_unpacked(x), np.uint32), minlength=len(units))
        by_use = np.argsort(-used, kind="stable")
        rank = np.empty(len(units), dtype=np.uint32)
        rank[by_use] = np.arange(len(units), dtype=np.uint32)
        index = b"".join(_ranks_out(rank[from_planes(_unpacked(x), np.uint32)]) for x in self.index)
        meta = np.concatenate(self.docs, axis=1)
        yield -1, block, None, _packed(planes(place[by_use])), index, _packed(planes(meta.ravel()))
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        units = units.take(pa.array(order))
        for s in np.flatnonzero(np.diff(ends)):
            data, offsets = bytes_of(units.slice(ends[s], ends[s + 1] - ends[s]))
            yield int(s), block, _packed(data.tobytes()), _packed(planes(np.diff(offsets).astype(np.uint32))), None, None


def _ranks_out(rank: np.ndarray) -> bytes:
    """The lengths of two parts, then each packed: a byte for every rank, and what goes beyond a byte."""
    parts = [_packed(np.minimum(rank, 255).astype(np.uint8).tobytes()), _packed(planes(rank[rank >= 255] - np.uint32(255)))]
    return b"".join(len(p).to_bytes(8, "little") for p in parts) + b"".join(parts)


def _ranks_in(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    """The ranks that begin at a place, and where they end."""
    low, high = (int.from_bytes(raw[at + i : at + i + 8], "little") for i in (0, 8))
    rank = np.frombuffer(_unpacked(raw[at + 16 : at + 16 + low]), np.uint8).astype(np.uint32)
    rank[rank == 255] += from_planes(_unpacked(raw[at + 16 + low : at + 16 + low + high]), np.uint32)
    return rank, at + 16 + low + high


def _blocks(path: str, shards: int, list_bytes: int):
    def run(batches):
        together = glued(path)
        block, mine, size = TaskContext.get().partitionId() << 24, _List(together), 0
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), BLOCK)], schema=BLOCK)
        for b in batches:
            for first, to, texts in chunks_of_text(b.column(1), CHUNK_BYTES):
                mine.add(texts, b.column(0).slice(first, to - first))
                size += texts.nbytes
                if size >= list_bytes:
                    yield as_batch(mine.rows(block, shards))
                    block, mine, size = block + 1, _List(together), 0
        if mine.docs:
            yield as_batch(mine.rows(block, shards))
        give_back()

    return run


def _asked_units(table: pa.Table) -> pa.Array:
    """The units that the rows of one shard ask for, in turn."""
    return pa.concat_arrays([_strings(_unpacked(u), from_planes(_unpacked(s), np.uint32)) for u, s in zip(table["units"].to_pylist(), table["sizes"].to_pylist())])


def _listed(table: pa.Table) -> pa.Table:
    """Owner: the distinct units of its shard in alphabetical order, numbered."""
    units = _asked_units(table).unique()
    units = units.take(pc.array_sort_indices(units))
    out = pa.Table.from_arrays([pa.array(np.full(len(units), table["shard"][0].as_py())), pa.array(np.arange(len(units))), units.cast(pa.string())], schema=UNIT)
    give_back()
    return out


def _answered(asked: pa.Table, solved: pa.Table) -> pa.Table:
    """Owner: each list's units of this shard as ids, in the order asked; whether decoding gives each unit back."""
    if not asked.num_rows:
        return ANSWER.empty_table()
    solved = solved.sort_by("place")
    ids = pa.concat_arrays(solved["ids"].chunks)
    sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, starts = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    units = _asked_units(asked)
    distinct = units.unique()
    distinct = distinct.take(pc.array_sort_indices(distinct))
    exact = pc.equal(solved["again"].combine_chunks().cast(pa.large_string()), distinct).to_numpy(zero_copy_only=False)
    at = pc.index_in(units, distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    rows, begin = [], 0
    for block, shard, packed in zip(asked["block"].to_pylist(), asked["shard"].to_pylist(), asked["sizes"].to_pylist()):
        n = len(_unpacked(packed)) // 4
        mine = at[begin : begin + n]
        begin += n
        rows.append((block, shard, planes(sizes[mine].astype(np.uint32)), _packed(planes(flat[spread(starts[mine], sizes[mine])].astype(np.uint32))), np.packbits(exact[mine]).tobytes()))
    out = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ANSWER)], schema=ANSWER)
    give_back()
    return out


def _reader(with_ids: bool):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        """The texts of one list, read off the answers to it."""
        own = blocks.to_pylist()[0]
        rows = answers.sort_by("shard").to_pylist()
        sizes = np.concatenate([from_planes(r["sizes"], np.uint32) for r in rows]).astype(np.int64)
        flat = np.concatenate([from_planes(_unpacked(r["ids"]), np.uint32) for r in rows]).astype("<u4")
        exact = np.concatenate([np.unpackbits(np.frombuffer(r["exact"], np.uint8), count=len(r["sizes"]) // 4) for r in rows]).astype(bool)
        starts = np.cumsum(sizes) - sizes
        place = from_planes(_unpacked(own["sizes"]), np.uint32)
        doc_ids, no_id, counts = from_planes(_unpacked(own["meta"]), np.int64).reshape(3, -1)
        out, doc, at = [], 0, 0
        while at < len(own["index"]):
            rank, at = _ranks_in(own["index"], at)
            words, upto = place[rank], 0
            while upto < len(words):
                some = words[upto : upto + counts[doc]]
                ids = flat[spread(starts[some], sizes[some])]
                out.append((None if no_id[doc] else doc_ids[doc], len(ids), zlib.crc32(ids.tobytes()), exact[some].all(), ids.astype(np.int32) if with_ids else None))
                upto, doc = upto + counts[doc], doc + 1
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ENCODED)], schema=ENCODED)
        give_back()
        return table

    return run


def lattice_edges(units: DataFrame, keys: list[str], pieces: DataFrame, longest: int) -> DataFrame:
    """``(keys, span, e)``: the substrings of each unit that are pieces, by the span they end in.

    ``e`` is one number, see TO; places count from 1 within the span. A span's substrings may begin as far
    before it as a piece reaches. The piece table is broadcast: its size is the vocabulary's, whatever the input.
    """
    before = F.when(F.col("span") > 0, F.lit(longest - 1)).otherwise(F.lit(0))
    cut = units.select(*keys, F.replace("unit", F.lit(" "), F.lit(SPACE)).alias("marked"), F.explode(F.sequence(F.lit(0), F.floor((F.length("unit") - 1) / SPAN).cast("int"))).alias("span"))
    cut = cut.select(*keys, "span", before.alias("before"), F.substring("marked", F.col("span") * SPAN - before + 1, before + SPAN).alias("text"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("before"))).alias("to"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("to") + F.col("before")))).alias("size"))
    cut = cut.select(*keys, "span", "to", "size", F.substring("text", F.col("to") + F.col("before") - F.col("size") + 1, F.col("size")).alias("piece"))
    joined = cut.join(F.broadcast(pieces), "piece", "left").where("id is not null or size = 1")
    edge = F.col("to").cast("bigint") * TO + F.col("size") * F.lit(SIZE) + F.coalesce(F.col("cost"), F.lit(BYTE_COST) * F.octet_length("piece")) * COST + F.coalesce(F.col("id"), F.lit(NO_PIECE) + F.ascii("piece"))
    return joined.select(*keys, "span", edge.alias("e"))


_STATE = "struct<cost: bigint, less: bigint, id: bigint>"


def _bits(edge: Column, above: int, least: int) -> Column:
    """The part of an edge's number between two of its factors."""
    return F.shiftright(edge, least.bit_length() - 1).bitwiseAND(F.lit(above // least - 1).cast("bigint"))


def _span_costs(tail: Column, edges: Column, n: Column) -> Column:
    """Viterbi over one span: ``tail``, the best of the positions before it, and that of each position in it.

    An entry is the least cost, then 64 less the last edge's size (of equal costs the longest edge is least), then its id.
    """

    def step(best: Column, at: Column) -> Column:
        here = F.filter(edges, lambda e: F.shiftright(e, 52) == at)

        def reach(e: Column) -> Column:
            size = _bits(e, TO, SIZE)
            cost = F.get(best, (F.size(best) - size).cast("int"))["cost"] + _bits(e, SIZE, COST)
            return F.struct(cost.alias("cost"), (F.lit(64) - size).alias("less"), _bits(e, COST, 1).alias("id"))

        return F.array_append(best, F.array_min(F.transform(here, reach)))

    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), n), tail, step)


def _utf8(code: Column) -> Column:
    """The bytes of a character, from its code."""
    rest = lambda shift: F.shiftright(code, shift).bitwiseAND(F.lit(63)) + 128
    several = F.when(code < 0x800, F.array(F.shiftright(code, 6) + 192, rest(0))).when(code < 0x10000, F.array(F.shiftright(code, 12) + 224, rest(6), rest(0))).otherwise(F.array(F.shiftright(code, 18) + 240, rest(12), rest(6), rest(0)))
    return F.when(code < 0x80, F.array(code)).otherwise(several)


def _span_ids(best: Column, first_byte: int, skip: Column) -> Column:
    """Walks back over one span: ``(skip, out)``, how many positions before it the last edge leaps, and its ids."""

    def back(state: Column, here: Column) -> Column:
        raw = F.transform(_utf8((here["id"] - NO_PIECE).cast("int")), lambda b: b + first_byte)
        ids = F.when(here["id"] < NO_PIECE, F.array(here["id"].cast("int"))).otherwise(raw)
        taken = F.struct((F.lit(63) - here["less"]).alias("skip"), F.concat(ids, state["out"]).alias("out"))
        return F.when(state["skip"] == 0, taken).otherwise(F.struct((state["skip"] - 1).alias("skip"), state["out"].alias("out")))

    return F.aggregate(F.reverse(best), F.struct(skip.cast("bigint").alias("skip"), F.array().cast("array<int>").alias("out")), back)


def _whole_path(spans: Column, longest: int, first_byte: int) -> Column:
    """The ids of the best path over a unit's spans, each a struct ``(span, edges)``, in order."""
    entry = lambda cost: F.struct(F.lit(cost).cast("bigint").alias("cost"), F.lit(0).cast("bigint").alias("less"), F.lit(0).cast("bigint").alias("id"))
    begin = F.array(*(entry(1 << 60) for _ in range(longest - 1)), entry(0))

    def forward(state: Column, span: Column) -> Column:
        n = F.shiftright(F.array_max(span["edges"]), 52)
        best = _span_costs(state["tail"], span["edges"], n)
        return F.struct(F.slice(best, -longest, longest).alias("tail"), F.array_append(state["done"], F.slice(best, F.lit(longest + 1), n.cast("int"))).alias("done"))

    none = F.array().cast(f"array<array<{_STATE}>>")
    done = F.aggregate(spans, F.struct(begin.alias("tail"), none.alias("done")), forward, lambda s: s["done"])

    def backward(state: Column, best: Column) -> Column:
        found = _span_ids(best, first_byte, state["skip"])
        return F.struct(found["skip"].alias("skip"), F.array_append(state["out"], found["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("skip"), F.array().cast("array<array<int>>").alias("out"))
    return F.aggregate(F.reverse(done), start, backward, lambda s: F.flatten(F.reverse(s["out"])))


def encode_units(units: DataFrame, keys: list[str], pieces: DataFrame, longest: int, first_byte: int) -> DataFrame:
    """``(keys, ids)`` for non-empty units; where rows are hash-partitioned by some of the keys, it shuffles nothing."""
    spans = lattice_edges(units, keys, pieces, longest).groupBy(*keys, "span").agg(F.collect_list("e").alias("edges"))
    whole = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("span", "edges"))).alias("spans"))
    return whole.select(*keys, _whole_path(F.col("spans"), longest, first_byte).alias("ids"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, list_bytes: int = LIST_BYTES) -> DataFrame:
    """``(doc_id, n_ids, ids_crc32, round_trip, ids)``, one row per input row; ids is null unless asked for.

    round_trip tells whether decoding the ids gives the text back; ids_crc32 is over the ids as unsigned
    little-endian 32-bit integers. Whole texts, white space kept. Equal units are those of equal 64-bit keys within a
    task's list, and of equal characters across lists. Defined results: a null or empty text is one dummy
    space; repeated rows come out as often as they come; null ids stay null; an empty table gives no
    rows; other columns are ignored. Memory of a task is bounded by one list (or the longest text) and by one owner's
    units; owners grow in number with the rows.
    """
    spark = docs.sparkSession
    pieces, longest, first_byte = piece_table(spark, path)
    shards = max(shuffle_width(spark), docs.count() // DOCS_PER_OWNER)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = bucketed(rows.mapInArrow(_blocks(path, shards, list_bytes), BLOCK_DDL), "unit-lists", "block")
    width = max(shuffle_width(spark), shards)
    # a shard stays whole from here on: its lattices are grouped and its answers read without another shuffle
    asked = blocks.where("shard >= 0").select("shard", "block", "units", "sizes").repartition(width, "shard")
    units = asked.groupBy("shard").applyInArrow(_listed, "shard bigint, place bigint, unit string").repartition(width, "shard")
    solved = encode_units(units, ["shard", "place"], pieces, longest, first_byte)
    solved = decode(solved, path, "ids", "again", drop_dummy=False, keys=["shard", "place"])
    answers = asked.groupBy("shard").cogroup(solved.groupBy("shard")).applyInArrow(_answered, ANSWER_DDL)
    own = blocks.where("shard < 0").select("block", "sizes", "index", "meta")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_reader(with_ids), ENCODED_DDL)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text", drop_dummy: bool = True, keys: list[str] | None = None) -> DataFrame:
    """``encoded`` with ``out_col``, the text of a list of ids, by a join of the ids with the piece table.

    Every row returns, whatever its id or ids; null ids give null. Byte pieces give their bytes, U+2581
    becomes a space, unknown ids give nothing, and the dummy space goes if asked. ``keys`` names columns
    that tell rows apart, if there are such; else rows are numbered.
    """
    spark = encoded.sparkSession
    pieces, _, first_byte = piece_table(spark, path)
    byte = spark.range(256).select((F.col("id") + first_byte).cast("int").alias("id"), F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("raw"))
    table = pieces.select("id", F.encode("piece", "utf-8").alias("raw")).unionByName(byte).select(F.col("id").alias("_id"), "raw")
    own = keys or ["_row"]
    rows = encoded if keys else encoded.withColumn("_row", F.monotonically_increasing_id())
    listed = rows.select(*own, F.struct(*encoded.columns).alias("_kept"), F.posexplode_outer(ids_col).alias("_at", "_id"))
    # the row itself goes along once, with its first id
    listed = listed.withColumn("_kept", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_kept"))).join(F.broadcast(table), "_id", "left")
    parts = listed.groupBy(*own).agg(F.first("_kept", ignorenulls=True).alias("_kept"), F.array_sort(F.collect_list(F.when(F.col("raw").isNotNull(), F.struct("_at", "raw")))).alias("_parts"))
    text = F.replace(F.decode(F.aggregate("_parts", F.lit(b""), lambda a, p: F.concat(a, p["raw"])), "utf-8"), F.lit(SPACE), F.lit(" "))
    if drop_dummy:
        text = F.when(text.startswith(" "), F.substr(text, F.lit(2))).otherwise(text)
    return parts.select(*own, *(F.col("_kept")[c].alias(c) for c in encoded.columns if c not in own), F.when(F.col("_kept")[ids_col].isNotNull(), text).alias(out_col)).select(*encoded.columns, out_col)
