"""Exact duplicates through an extendible-hash index on shared files.

The index keeps one entry per document (64-bit key of the normalised text, id, digest) in buckets,
each named by a prefix of the key. The directory starts with one bucket and doubles while a bucket
is overfull, so a bucket is a range of keys that one owner task processes. A bucket that is still
overfull at the deepest directory (many copies of one text) is chained over overflow pages, dealt by
row, so that no task gets a hot group whole.

Every entry goes to the owner of its page, who walks it in key order: a key met once is settled. For
keys met again the texts are fetched, and the owner of a page chains the different texts met under one
key, comparing bytes; heads of the chains of paged buckets are compared once more, by their bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import ascii_lower, staged

#: Leading bits of a key that the directory may tell apart at most: a million pointers, broadcast at 24 bytes each.
MAX_DEPTH = 20
#: The directory is told apart by so many bits more than its buckets need.
SPARE_BITS = 2
BUCKET_ENTRIES = 512


def directory(spark: SparkSession, entries: DataFrame, bucket_entries: int = BUCKET_ENTRIES, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """The pointers ``(prefix, bucket, pages)`` and the global depth.

    Works on a histogram of the key's first bits: as many as the entries need and SPARE_BITS more,
    ``max_depth`` at most. A bucket holds ``bucket_entries``; beyond what the deepest directory can
    tell apart it holds more, in pages.
    """
    max_depth = min(max_depth, max(1, int(entries.count() // bucket_entries).bit_length() + SPARE_BITS))
    rows = entries.groupBy(F.shiftrightunsigned("h", 64 - max_depth).alias("p")).agg(F.count("*").alias("n")).collect()
    counts = np.zeros(1 << max_depth, dtype=np.int64)
    for r in rows:
        counts[r["p"]] = r["n"]
    room = bucket_entries
    depth = 0
    local = np.zeros(1, dtype=np.int64)  # local depth of the bucket behind each pointer
    while depth < max_depth:
        sizes = counts.reshape(1 << depth, -1).sum(1)
        whole = np.bincount(_bucket(depth, local), weights=sizes, minlength=1 << depth)
        overfull = (whole[_bucket(depth, local)] > room) & (local == depth)
        if not overfull.any():
            break
        local = np.repeat(np.where(overfull, local + 1, local), 2)  # the directory doubles; overfull buckets split
        depth += 1
    bucket = _bucket(depth, local)
    sizes = np.bincount(bucket, weights=counts.reshape(1 << depth, -1).sum(1), minlength=1 << depth)
    pages = np.maximum(1, np.ceil(sizes[bucket] / room)).astype(np.int64)
    pointers = pd.DataFrame({"prefix": np.arange(1 << depth, dtype=np.int64), "bucket": bucket, "pages": pages})
    return spark.createDataFrame(pointers, "prefix bigint, bucket bigint, pages bigint"), depth


def _bucket(depth: int, local: np.ndarray) -> np.ndarray:
    """The first pointer of each pointer's bucket."""
    at = np.arange(len(local), dtype=np.int64)
    return at >> (depth - local) << (depth - local)


def _settled(batches):
    """Owner task: entries come ordered by page and key; how often its page has each one's key."""
    names = ["doc_id", "sha", "h", "pages", "met"]
    held: list[pa.RecordBatch] = []

    def told(rows: pa.Table) -> pa.RecordBatch:
        place = np.stack([rows[c].to_numpy() for c in ("bucket", "page", "h")], axis=1)
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1]).any(axis=1)
        met = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in names[:-1]), pa.array(met)], names=names)

    for b in batches:  # the last key of a batch may go on in the next: it waits
        rows = pa.Table.from_batches([*held, b])
        last = rows.slice(rows.num_rows - 1).to_pylist()[0] if rows.num_rows else None
        if last is None:
            continue
        same = np.ones(rows.num_rows, dtype=bool)
        for c in ("bucket", "page", "h"):
            same &= rows[c].to_numpy() == last[c]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield told(rows.slice(0, cut))
        held = rows.slice(cut).to_batches()
    if held:
        yield told(pa.Table.from_batches(held))


def _chains(batches):
    """Owner task: rows come ordered by page and key; gives each row its chain slot, and each slot its head.

    A head names the row that stays of its page: the first one of the largest id, or of none if no row has an id.
    """
    key, chain = None, []
    names = ["kind", "doc_id", "number", "sha", "h", "bucket", "page", "slot", "keep", "keep_number", "n", "head"]
    kinds = [pa.int8(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def heads():
        return [(1, None, None, None, key[2], key[0], key[1], k, keep, number, n, text if paged else None) for k, (text, keep, number, n, paged) in enumerate(chain)] if key else []

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for b in batches:
        out = []
        for doc, number, sha, h, bucket, page, pages, text in zip(*(b.column(i).to_pylist() for i in range(8))):
            if key != (bucket, page, h):
                out += heads()
                key, chain = (bucket, page, h), []
            slot = next((k for k, c in enumerate(chain) if c[0] == text), len(chain))
            if slot == len(chain):
                chain.append([text, doc, number, 0, pages > 1])
            c = chain[slot]
            if doc is not None and (c[1] is None or doc > c[1]):
                c[1:3] = doc, number
            c[3] += 1
            out.append((0, doc, number, sha, h, bucket, page, slot, None, None, None, None))
        if out:
            yield batch(out)
    if key:
        yield batch(heads())


def equal_text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Texts are equal when identical after lower-casing A-Z; keep_id is the largest id of the equal
    ones, and of each group exactly one row is ``kept``: one with that id. Whole texts are hashed, and compared where a
    key repeats. Defined results: null text counts as empty; repeated rows each come out and each count in group_size,
    and one of them at most is kept; a row with a null id is the one that stays only while its group has no id; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), ascii_lower(F.col(text_col).cast("string")).alias("norm"))
    rows = rows.withColumn("h", F.xxhash64("norm"))
    entries = staged(rows.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("number")), "index-entries")
    pointers, depth = directory(spark, entries, bucket_entries)
    prefix = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("bigint")
    # rows are dealt to pages by a number that is written with them: repeated and null ids spread, and a task that is run again deals alike
    page = F.pmod(F.xxhash64("number"), F.col("pages")).alias("page")
    dealt = entries.withColumn("prefix", prefix).join(F.broadcast(pointers), "prefix").select("doc_id", "sha", "h", "bucket", page, "pages")
    owned = dealt.repartition("bucket", "page").sortWithinPartitions("bucket", "page", "h")
    owned = staged(owned.mapInArrow(_settled, "doc_id bigint, sha binary, h bigint, pages bigint, met bigint"), "index-owned")
    alone = owned.where("pages = 1 and met = 1").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha")
    # a table of its own: the join below then meets plain exchanges, whose hot keys Spark splits
    repeated = staged(owned.where("pages > 1 or met > 1").select("h").distinct(), "index-repeated")

    met = staged(rows.join(repeated, "h", "left_semi").select("doc_id", "h", "norm", F.monotonically_increasing_id().alias("number")), "index-met")
    met = met.withColumn("prefix", prefix).join(F.broadcast(pointers), "prefix")
    met = met.select("doc_id", "number", F.unhex(F.sha2("norm", 256)).alias("sha"), "h", "bucket", page, "pages", F.col("norm").cast("binary").alias("text"))
    paged = met.repartition("bucket", "page").sortWithinPartitions("bucket", "page", "h")
    walked = staged(paged.mapInArrow(_chains, "kind tinyint, doc_id bigint, number bigint, sha binary, h bigint, bucket bigint, page bigint, slot bigint, keep bigint, keep_number bigint, n bigint, head binary"), "index-chains")
    heads = walked.where("kind = 1").select("h", "page", "slot", "keep", "keep_number", "n", "head")
    own = heads.where("head is null").select("h", "page", "slot", F.col("keep").alias("keep_id"), F.col("keep_number").alias("stays"), F.col("n").alias("group_size"))
    shared = heads.where("head is not null")
    # a null id comes below all others
    merged = shared.groupBy("h", "head").agg(F.max(F.struct("keep", "keep_number")).alias("k"), F.sum("n").alias("group_size"))
    across = shared.join(merged, ["h", "head"]).select("h", "page", "slot", F.col("k.keep").alias("keep_id"), F.col("k.keep_number").alias("stays"), "group_size")
    members = walked.where("kind = 0").join(own.unionByName(across), ["h", "page", "slot"]).withColumn("kept", F.col("number") == F.col("stays"))
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    return alone.unionByName(members.select(*columns, "sha")).select(*columns, F.lower(F.hex("sha")).alias("text_sha256"))
