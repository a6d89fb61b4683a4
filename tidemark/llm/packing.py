"""Hierarchical best-fit packing of token sequences.

Pieces are dealt evenly over tasks. Each task packs its own best-fit, longest first. After that no
two bins of a task fit together, so at most one of them is half full or less: that one and the
emptiest others go up the tree, everything else is finished. On the next level, tasks are merged and
the bins that came up are items themselves, packed best-fit again, until one task is left. A task
sends up a fixed number of bins at most, so no level gathers more than that times its fan-in.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import give_back, staged
from tidemark.llm.tokens import chunks_of_text, word_encoder

END_ID = 1
FAN_IN = 8
ITEMS_PER_TASK = 20_000
RECEIVERS = 64

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = pa.schema([("open", pa.bool_()), ("salt", pa.int64()), ("total", pa.int64()), ("members", pa.list_(MEMBER))])
BIN_DDL = "open boolean, salt bigint, total bigint, members array<struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint>>"


def token_pieces(docs: DataFrame, path: str, room: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: every text's ids and the end id, cut at ``room``."""

    def run(batches):
        encoder = word_encoder(path)
        for b in batches:
            for first, to, texts in chunks_of_text(b.column(1)):
                ids, counts = encoder.encode(texts)
                docs_in, rows, at = b.column(0).slice(first, to - first).to_pylist(), [], 0
                for doc, n in zip(docs_in, counts.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(END_ID)).astype("<u4")
                    at += n
                    for piece, start in enumerate(range(0, len(own), room)):
                        part = own[start : start + room]
                        rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes()), part if with_ids else None))
                cols = list(zip(*rows))
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def best_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Best-fit decreasing: the item numbers of each bin. A bit mask tells which free spaces exist."""
    free: dict[int, list[int]] = {}
    mask, bins = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = mask >> n
        if fits:
            space = (fits & -fits).bit_length() - 1 + n
            k = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
            bins[k].append(i)
        else:
            space, k = room, len(bins)
            bins.append([i])
        if space > n:
            free.setdefault(space - n, []).append(k)
            mask |= 1 << (space - n)
    return bins


def _packer(room: int, last: bool):
    def run(batches):
        totals, members = [], []
        for b in batches:
            totals += b.column(0).to_pylist()
            members += b.column(1).to_pylist()
        if not totals:
            return
        packed = []
        for one in best_fit(totals, room):
            inside, at = [], 0
            for i in one:
                inside += [m | {"offset": at + m["offset"]} for m in members[i]]
                at += totals[i]
            packed.append((at, inside))
        packed.sort(key=lambda x: x[0])
        part = TaskContext.get().partitionId() << 32
        up = 0 if last else sum(1 for k, (n, _) in enumerate(packed) if n < room and (2 * n <= room or k <= RECEIVERS))
        for at in range(0, len(packed), 2000):
            some = packed[at : at + 2000]
            yield pa.RecordBatch.from_arrays([pa.array([at + k < up for k in range(len(some))]), pa.array(np.arange(part + at, part + at + len(some))), pa.array([n for n, _ in some], pa.int64()), pa.array([m for _, m in some], pa.list_(MEMBER))], schema=BIN)

    return run


def pack(pieces: DataFrame, room: int, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """``pieces`` with ``(sequence_id, offset)``: each piece's sequence and its place there.

    ``pieces`` has doc_id, piece, start, length (1 to ``room``) and ids_crc32. Offsets are gapless
    from 0 and no sequence is longer than ``room``. An empty table gives no rows.
    """
    # rows are dealt by a number of their own, so that repeated and null ids don't meet in one task
    pieces = staged(pieces.withColumn("salt", F.monotonically_increasing_id()), "pieces")
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("bigint").alias("offset"))
    full = pieces.where(F.col("length") == room).select(F.lit(False).alias("open"), F.col("length").alias("total"), F.array(member).alias("members"))
    items = pieces.where(F.col("length") < room).select("salt", F.col("length").alias("total"), F.array(member).alias("members"))
    width = max(1, -(-items.count() // items_per_task))
    done = full
    while True:
        level = staged(items.repartition(width, "salt").select("total", "members").mapInArrow(_packer(room, width == 1), BIN_DDL), f"bins-{width}")
        done = done.unionByName(level.where(~F.col("open")).drop("salt"))
        if width == 1:
            break
        items, width = level.where("open").select("salt", "total", "members"), max(1, width // FAN_IN)
    numbered = done.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.explode("members").alias("m"))
    return numbered.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def pack_documents(docs: DataFrame, path: str, room: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document's tokens (ids by the tokenizer file at ``path``, then id 1).

    Only documents longer than ``room`` are cut, into full pieces and a rest. Defined results: null
    or empty text is the end id alone; repeated rows are packed as often as they come; null ids stay
    null; an empty table gives no rows; other columns are ignored. A text's ids are held one chunk of
    texts at a time, so memory is bounded by the longest text.
    """
    return pack(token_pieces(docs, path, room, id_col, text_col), room)
