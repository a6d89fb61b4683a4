"""Near-duplicate lines by an exact set-similarity join.

A line is its set of words (A-Z lower-cased). Words are ordered by rarity; two sets of Jaccard
similarity t or more share a word among the rarest ``n - ceil(t n) + 1`` of each, so only these go
into the index. Owner tasks take ranges of words. In a word's list, a line meets the earlier ones and
the pair must pass a length, a positional and a bitmap filter, all of them safe; what passes is
verified on the whole sets. A line goes when an earlier one matches it.

For the decision one match is enough. A list that gives a line up to ``FEW`` earlier candidates sends
them all to verification; of more, only the best of the nearest ``TRIES`` goes, by the bound on common
words, and the owner tells that whole list too. A line for which all fail is joined to these lists in
a second, exact pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name, from_planes, give_back, mix64, planes, shuffle_width, staged
from tidemark.llm.tokens import chunks_of_text
from tidemark.llm.wordkeys import line_word_keys, word_keys

THRESHOLD = 0.8
TRIES = 16
FEW = 4
COUNTERS = 1 << 20
DOCS_PER_OWNER = 2_000
#: 64-bit words of a set's bitmap. Long lines fill a short bitmap, and a full one tells nothing.
BITMAP = 4
#: A set on one of so many lines, or more of them, counts as common.
COMMON_LINES = 4096
CHUNK_BYTES = 3_000_000
#: Bits that mark the lines to verify: so many for each document, and the most of all, which more lines fill up but don't pass.
MARKS_PER_DOC, MOST_MARKS = 8, 1 << 26

POSTING = [("token", np.uint64), ("sig", np.uint64), ("size", np.uint32), ("pos", np.uint32), ("doc", np.int64), ("line", np.uint32), *((f"b{i}", np.uint64) for i in range(BITMAP))]
NUMBERED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("sigs", pa.list_(pa.int64()))])
NUMBERED_DDL = "doc_id bigint, text_key bigint, sigs array<bigint>"
#: A message goes to an owner (shard >= 0) with index rows, or passes it by with its block's documents.
MESSAGE = pa.schema([("shard", pa.int64()), *((k, pa.binary()) for k, _ in POSTING), ("docs", pa.list_(pa.struct(NUMBERED)))])
MESSAGE_DDL = "shard bigint, " + ", ".join(f"{k} binary" for k, _ in POSTING) + f", docs array<struct<{NUMBERED_DDL.replace(' ', ': ', 1).replace(', text_key ', ', text_key: ').replace(', sigs ', ', sigs: ')}>>"
#: One of each for a worker: making them costs more than packing a message.
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
PAIR = ["sig", "doc", "line", "other", "other_doc", "other_line", "token", "size"]
FOUND = pa.schema([*((k, pa.int64()) for k in PAIR), ("more", pa.bool_()), ("bits", pa.list_(pa.int64())), *NUMBERED])
FOUND_DDL = ", ".join(f"{k} bigint" for k in PAIR) + ", more boolean, bits array<bigint>, " + NUMBERED_DDL


def least_words(threshold: float) -> int:
    """The fewest words of a set that a different set can match: n words against the same and one more."""
    return max(1, int(np.ceil(threshold / (1 - threshold) - 1e-9))) if threshold < 1 else 1


def least_overlap(total, threshold: float):
    """The fewest common words with which sets of ``total`` words together reach the threshold."""
    return np.ceil(total * threshold / (1 + threshold) - 1e-9).astype(np.int64)


def _staged(df: DataFrame, name: str) -> DataFrame:
    """Of a table once written, no shuffle files stay: those of the index rows are the largest there are."""
    return staged(df, name, drop_shuffles=True)


def _rank_of(counters: np.ndarray) -> np.ndarray:
    """How common each hash class is, on a logarithmic scale below 4096."""
    return np.minimum(4095, np.log2(counters + 1.0) * 127).astype(np.uint64)


def _word_sets(keys: np.ndarray, line: np.ndarray, n_lines: int, rank: np.ndarray | None):
    """Distinct words of each line, rarest first: ``(line of each, word, set size of each line)``.

    One integer holds a line's number, its word's rank and half of the word's key, so that one sort
    does; where two different words of a line share all that, the rows are sorted by the whole key.
    """
    common = np.zeros(len(keys), np.uint64) if rank is None else rank[(keys & np.uint64(COUNTERS - 1)).view(np.int64)].astype(np.uint64)
    place = (line.astype(np.uint64) << np.uint64(44)) | (common << np.uint64(32)) | (keys >> np.uint64(32))
    order = np.argsort(place)
    place, sorted_keys = place[order], keys[order]
    same = place[1:] == place[:-1]
    if n_lines >= 1 << 20 or (same & (sorted_keys[1:] != sorted_keys[:-1])).any():
        order = np.lexsort((keys, common, line))
        sorted_keys = keys[order]
        same = (sorted_keys[1:] == sorted_keys[:-1]) & (line[order][1:] == line[order][:-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = ~same
    line = line[order[new]]
    return line, sorted_keys[new], np.bincount(line, minlength=n_lines)


def _signatures(line: np.ndarray, token: np.ndarray, n_lines: int) -> np.ndarray:
    """An order-free 64-bit key of each set."""
    mixed = mix64(token, token)
    sums = np.zeros(n_lines, dtype=np.uint64)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    if len(first):
        sums[line[first]] = np.add.reduceat(mixed, first)
    return mix64(sums, np.bincount(line, minlength=n_lines).astype(np.uint64))


def _bitmaps(line: np.ndarray, token: np.ndarray, n_lines: int, words: int = BITMAP) -> list[np.ndarray]:
    """Each set as ``words`` words of 64 bits, a bit for each hash class of its members."""
    first = np.flatnonzero(np.diff(line, prepend=-1))
    bit = (token >> np.uint64(40)) & np.uint64(64 * words - 1)
    out = []
    for part in range(words):
        m = np.where((bit >> np.uint64(6)) == part, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
        sums = np.zeros(n_lines, dtype=np.uint64)
        if len(first):
            sums[line[first]] = np.bitwise_or.reduceat(m, first)
        out.append(sums)
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def _indexed(texts: pa.Array, rank: np.ndarray):
    """``((line of each word, word, size, signature and bitmaps of each line), text of each line, number of each line)``."""
    keys, line, of, number = line_word_keys(texts)
    line, token, size = _word_sets(keys, line, len(of), rank)
    return (line, token, size, _signatures(line, token, len(size)), _bitmaps(line, token, len(size))), of, number


def _postings(indexed, of: np.ndarray, number: np.ndarray, ids: np.ndarray, threshold: float, min_words: int) -> dict[str, np.ndarray]:
    """The index rows of a chunk's lines; a set that the chunk has twice is posted for its first line."""
    line, token, size, sig, bitmaps = indexed
    prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    order = np.lexsort((number, ids[of], sig))
    chosen = np.zeros(len(size), dtype=bool)
    new = np.ones(len(order), dtype=bool)
    new[1:] = sig[order][1:] != sig[order][:-1]
    chosen[order[new]] = True
    chosen &= size >= min_words
    pos = np.arange(len(line)) - (np.cumsum(size) - size)[line]
    use = chosen[line] & (pos < prefix[line])
    line, token, pos = line[use], token[use], pos[use]
    values = (token, sig[line], size[line], pos, ids[of[line]], number[line], *(b[line] for b in bitmaps))
    return {k: v.astype(t) for (k, t), v in zip(POSTING, values)}


def _packing(column: str):
    """How a column's numbers are written and read: words and signatures are random bits, the high bytes of others mostly zero, and bitmaps hold few bits."""
    if column in ("token", "sig"):
        return bytes, np.frombuffer
    if column in ("size", "pos", "doc", "line"):
        return planes, from_planes
    return (lambda x: _PACK.compress(planes(x))), (lambda x, kind: from_planes(_UNPACK.decompress(x), kind))


def _shards_out(rows: dict[str, np.ndarray], shards: int) -> pa.RecordBatch:
    shard = (rows["token"] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    if shards <= 1 << 16:
        shard = shard.astype(np.uint16)  # short numbers are sorted by their digits
    order = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[order], np.arange(shards + 1))
    there = np.flatnonzero(np.diff(at))
    columns = [pa.array(there, pa.int64())]
    for k, _ in POSTING:
        v = rows[k][order]
        packed = _packing(k)[0]
        columns.append(pa.array([packed(v[at[s] : at[s + 1]]) for s in there], pa.binary()))
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(there), MESSAGE.field("docs").type)], schema=MESSAGE)


def _candidates(threshold: float, tries: int):
    """Owner task: the nearest earlier candidates of every line in the lists of one range of words."""

    def run(table: pa.Table) -> pa.Table:
        if table["shard"][0].as_py() < 0:
            own = pa.Table.from_batches([pa.RecordBatch.from_struct_array(c.flatten()) for c in table["docs"].chunks])
            return pa.Table.from_arrays([*(pa.nulls(len(own), f.type) for f in FOUND if f.name not in own.column_names), *own.columns], schema=FOUND)
        r = {k: np.concatenate([_packing(k)[1](x, t) for x in table[k].to_pylist()]) for k, t in POSTING}
        order = np.lexsort((r["sig"], r["line"], r["doc"], r["token"]))
        # of a set's rows in a list the first stays; sorted by set, they follow each other list by list
        token, sig = r["token"][order], r["sig"][order]
        by_set = np.argsort(sig, kind="stable")
        token, sig = token[by_set], sig[by_set]
        new = np.ones(len(order), dtype=bool)
        new[by_set[1:]] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
        order = order[new]
        r = {k: v[order] for k, v in r.items()}
        token, size, pos = r["token"], r["size"].astype(np.int64), r["pos"].astype(np.int64)
        found, few = np.zeros(len(token), dtype=np.int64), min(FEW, tries)
        best, bound = np.zeros(len(token), dtype=np.int64), np.full(len(token), -1, dtype=np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        active, k = np.arange(1, len(token)), 1
        while len(active):
            active = active[active >= k]
            active = active[token[active] == token[active - k]]
            a, b = active, active - k
            both = size[a] + size[b]
            need = least_overlap(both, threshold)
            # some common word leaves each set as many words from its place on as the two must share
            ok = np.minimum(size[a] - pos[a], size[b] - pos[b]) >= need
            a, b, both, need = a[ok], b[ok], both[ok], need[ok]
            apart = sum(np.bitwise_count(r[f"b{i}"][a] ^ r[f"b{i}"][b]).astype(np.int64) for i in range(BITMAP))
            most = (both - apart) // 2
            ok = most >= need
            a, b, share = a[ok], b[ok], (1_000_000 * most[ok]) // both[ok]
            found[a] += 1
            better = share > bound[a]
            best[a[better]], bound[a[better]] = b[better], share[better]
            early = found[a] <= few
            out.append((a[early], b[early]))
            active = active[found[active] <= tries]  # one past the tries: it is known that there are more
            k += 1
        # few candidates go as they are, of many the best one
        a, b = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, dtype=np.int64) for i in (0, 1))
        a, b = a[found[a] <= few], b[found[a] <= few]
        many = np.flatnonzero(found > few)
        a, b = np.concatenate([a, many]), np.concatenate([b, best[many]])
        signed = lambda k, at: pa.array(r[k][at].view(np.int64) if r[k].dtype == np.uint64 else r[k][at].astype(np.int64))
        columns = [signed("sig", a), signed("doc", a), signed("line", a), signed("sig", b), signed("doc", b), signed("line", b), signed("token", a), signed("size", a), pa.array(found[a] > few), pa.nulls(len(a), FOUND.field("bits").type)]
        pairs = pa.Table.from_arrays([*columns, *(pa.nulls(len(a), f.type) for f in NUMBERED)], schema=FOUND)
        # a list that has more candidates for a line than these goes along whole, for the second pass
        at = np.flatnonzero(np.isin(token, token[many]))
        bits = pa.array(list(np.stack([r[f"b{i}"][at].view(np.int64) for i in range(BITMAP)], axis=1)), FOUND.field("bits").type)
        nothing = pa.nulls(len(at), pa.int64())
        listed = [signed("sig", at), signed("doc", at), signed("line", at), nothing, nothing, nothing, signed("token", at), signed("size", at), pa.nulls(len(at), pa.bool_()), bits]
        lists = pa.Table.from_arrays([*listed, *(pa.nulls(len(at), f.type) for f in NUMBERED)], schema=FOUND)
        del r, order, new, sig, by_set, size, pos, best, bound, out
        give_back()
        return pa.concat_tables([pairs, lists])

    return run


def _count_words(docs: DataFrame) -> np.ndarray:
    """How often the words of each of COUNTERS hash classes occur; of a fixed size. Any order of words is right, a rare-first one is fast."""

    def run(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for b in batches:
            for _, _, texts in chunks_of_text(b.column(0), CHUNK_BYTES):
                total += np.bincount((word_keys(texts)[0] & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(0, COUNTERS, 4096)), pa.array(list(total.reshape(-1, 4096)), pa.list_(pa.int64()))], names=["at", "n"])

    parts = docs.select("text").mapInArrow(run, "at bigint, n array<bigint>")

    def add(table: pa.Table) -> pa.Table:
        n = np.concatenate([c.flatten().to_numpy() for c in table["n"].chunks]).reshape(-1, 4096).sum(0)
        return pa.Table.from_arrays([table["at"].slice(0, 1), pa.array([n.tolist()], pa.list_(pa.int64()))], names=["at", "n"])

    out = np.zeros(COUNTERS, dtype=np.int64)
    for row in parts.groupBy("at").applyInArrow(add, "at bigint, n array<bigint>").toLocalIterator():
        out[row["at"] : row["at"] + 4096] = row["n"]
    return out


def _mark(doc: np.ndarray, line: np.ndarray | int, marks: int) -> np.ndarray:
    """The hash class of a line's address, below ``marks``, a power of two; line -1 stands for the whole document."""
    return (mix64(doc.astype(np.int64).view(np.uint64), np.asarray(line, np.int64).view(np.uint64)) & np.uint64(marks - 1)).astype(np.int64)


def _is_marked(bits: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return (bits[mark >> 6] >> (mark & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _marks_of(wanted: DataFrame, marks: int) -> np.ndarray:
    """``marks`` bits, one set for each address ``(doc, line)`` and one for each of their documents; of a bounded size."""

    def run(batches):
        for b in batches:
            doc = b.column(0).to_numpy()
            mark = np.unique(np.concatenate([_mark(doc, -1, marks), _mark(doc, b.column(1).to_numpy(), marks)]))
            bit = np.uint64(1) << (mark & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(mark >> 6), pa.array(bit.view(np.int64))], names=["at", "bits"])

    found = wanted.select("doc", "line").mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(marks // 64, dtype=np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _sets_of(docs: DataFrame, wanted: DataFrame, marks: int) -> DataFrame:
    """``(sig, words)``, sorted word hashes, of the lines at the wanted addresses ``(doc, line)``, and of some others.

    Texts stay where they are read: the addresses go to them, as marks, and only the sets of marked lines
    go on. A line that shares a mark by chance comes along and meets no candidate.
    """
    marked = docs.sparkSession.sparkContext.broadcast(_marks_of(wanted, marks))

    def run(batches):
        bits = marked.value
        for b in batches:
            b = b.filter(pa.array(_is_marked(bits, _mark(_ids(b.column(0)), -1, marks))))
            for first, to, texts in chunks_of_text(b.column(1), CHUNK_BYTES):
                keys, line, of, number = line_word_keys(texts)
                chosen = _is_marked(bits, _mark(_ids(b.column(0).slice(first, to - first))[of], number, marks))
                use = chosen[line]
                if use.any():
                    there, line = np.unique(line[use], return_inverse=True)
                    line, token, size = _word_sets(keys[use], line, len(there), None)
                    own, place = np.unique(_signatures(line, token, len(size)).view(np.int64), return_index=True)
                    parts = np.split(token, np.cumsum(size)[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([parts[i].tobytes() for i in place], pa.binary())], names=["sig", "words"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "sig bigint, words binary").dropDuplicates(["sig"])


def _verified(docs: DataFrame, pairs: DataFrame, threshold: float, marks: int) -> DataFrame:
    """The ``sig`` that have a true match among the candidate pairs."""
    wanted = pairs.select("doc", "line").unionByName(pairs.select(F.col("other_doc").alias("doc"), F.col("other_line").alias("line")))
    sets = _staged(_sets_of(docs, wanted, marks), "line-sets")
    both = pairs.select("sig", "other").distinct().join(sets, "sig").withColumnRenamed("words", "a")
    both = both.join(sets.select(F.col("sig").alias("other"), F.col("words").alias("b")), "other")

    def run(batches):
        for batch in batches:
            true = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                true.append(n >= threshold * (len(a) // 8 + len(b) // 8 - n) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(true))], names=["sig"])

    return both.select("sig", "a", "b").mapInArrow(run, "sig bigint").distinct()


def _all_candidates(lists: DataFrame, rest: DataFrame, threshold: float) -> DataFrame:
    """Every earlier candidate of the lines in ``rest`` (token, sig), from the lists of these words, by a join on the word."""
    rows = _staged(lists.join(rest.select("token").distinct(), "token", "left_semi"), "line-lists")
    mine = rows.join(rest.select("token", "sig").distinct(), ["token", "sig"], "left_semi")
    other = rows.select(*(F.col(k).alias(k if k == "token" else f"o_{k}") for k in rows.columns))
    both = mine.join(other, "token").where("struct(o_doc, o_line) < struct(doc, line) and sig <> o_sig")
    both = both.where(F.least("size", "o_size") >= F.ceil(F.greatest("size", "o_size") * threshold - 1e-9))
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("o_bits")[i])) for i in range(BITMAP)), F.lit(0))
    total = F.col("size") + F.col("o_size")
    both = both.where(total - apart >= 2 * F.ceil(total * threshold / (1 + threshold) - 1e-9))
    return both.select("sig", "doc", "line", F.col("o_sig").alias("other"), F.col("o_doc").alias("other_doc"), F.col("o_line").alias("other_line")).distinct()


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, min_words: int | None = None, tries: int = TRIES) -> DataFrame:
    """``(doc_id, text_key, n_lines, dropped)``, one row per input row: the numbers, from 0, of the lines to drop.

    Lines are parted by ``\\n``. A line is dropped when an earlier one, by id and then by place, has
    Jaccard similarity ``threshold`` or more of word sets (a line dropped itself counts as earlier
    too). ``min_words`` leaves shorter lines to equal sets alone; by default it is the fewest with which the
    threshold can be met at all (4 at 0.8), so none is lost.
    Lines without a word always stay. Sets are equal when their 64-bit keys and sizes are. Defined
    results: null text is one empty line; rows repeated in id and text are one document, told once for each row;
    null ids come first; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    min_words = least_words(threshold) if min_words is None else min_words
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counters = spark.sparkContext.broadcast(_rank_of(_count_words(docs)).astype(np.uint16))
    n_docs = docs.count()
    shards = max(shuffle_width(spark), n_docs // DOCS_PER_OWNER)
    marks = min(MOST_MARKS, 1 << max(16, (MARKS_PER_DOC * n_docs).bit_length()))

    def post(batches):
        part, serial, rank = TaskContext.get().partitionId(), 0, counters.value
        for b in batches:
            for first, to, texts in chunks_of_text(b.column(1), CHUNK_BYTES):
                indexed, of, number = _indexed(texts, rank)
                ids = b.column(0).slice(first, to - first)
                yield _shards_out(_postings(indexed, of, number, _ids(ids), threshold, min_words), shards)
                ends = np.cumsum(np.bincount(of, minlength=to - first))
                sigs = np.where(indexed[2] > 0, indexed[3].view(np.int64), 0)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(sigs))
                docs_in = pa.StructArray.from_arrays([ids, b.column(2).slice(first, to - first), listed], fields=list(NUMBERED))
                serial += 1
                row = [pa.array([-1 - (part << 24) - serial]), *(pa.nulls(1, pa.binary()) for _ in POSTING), pa.ListArray.from_arrays(pa.array([0, len(docs_in)], pa.int32()), docs_in)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(row, MESSAGE)], schema=MESSAGE)
        give_back()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    found = _staged(rows.mapInArrow(post, MESSAGE_DDL).groupBy("shard").applyInArrow(_candidates(threshold, tries), FOUND_DDL), "line-pairs")
    numbered = found.where("sigs is not null").groupBy("doc_id", "text_key").agg(F.first("sigs").alias("sigs"), F.count("*").alias("times"))
    pairs = found.where("other is not null")
    matched = _staged(_verified(docs, pairs.select("sig", "doc", "line", "other", "other_doc", "other_line").distinct(), threshold, marks), "line-matches")
    rest = _staged(pairs.where("more").select("token", "sig").distinct().join(matched, "sig", "left_anti"), "line-rest")
    if rest.take(1):
        more = _staged(_all_candidates(found.where("bits is not null").select("token", "sig", "size", "doc", "line", "bits"), rest, threshold), "line-rest-pairs")
        matched = matched.unionByName(_verified(docs, more, threshold, marks)).distinct()
    lines = numbered.select("doc_id", "text_key", F.posexplode("sigs").alias("line", "sig")).where("sig <> 0")
    place = F.struct("doc_id", "text_key", "line")
    first = lines.groupBy("sig").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(matched.withColumn("matched", F.lit(True)), "sig", "left").where("n > 1 or matched")
    first = _staged(first, "line-firsts")
    # at most COMMON_LINES sets can be this common: they are broadcast, and no task gets all the places of one
    total = numbered.agg(F.sum(F.size("sigs")).alias("n")).first()["n"] or 0
    often = F.col("n") * COMMON_LINES >= total
    told = lines.join(F.broadcast(first.where(often).withColumn("often", F.lit(True))), "sig", "left")
    drop = told.where("often").drop("often").unionByName(told.where("often is null").select("doc_id", "text_key", "line", "sig").join(first.where(~often), "sig"))
    drop = drop.where(F.col("matched") | ~F.col("first").eqNullSafe(place))
    dropped = drop.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("line")).alias("dropped"))
    dropped = dropped.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "dropped")
    out = numbered.join(dropped, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    out = out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
    return out.select("doc_id", "text_key", F.size("sigs").cast("bigint").alias("n_lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the duplicate lines taken out of the text; documents of which no line with a word is left go.

    A document that loses no line keeps its text as it was, null and empty ones too. Of rows repeated
    in id and text each is treated alike.
    """
    found = duplicate_lines(docs, id_col, text_col, **options).where(F.size("dropped") > 0).dropDuplicates(["doc_id", "text_key"])
    own = free_name(docs, "_line_dedup_found")
    found = found.select(F.struct("doc_id", "text_key", "n_lines", "dropped").alias(own))
    f = F.col(own)
    same = F.col(id_col).cast("bigint").eqNullSafe(f["doc_id"]) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == f["text_key"])
    joined = docs.join(found, same, "left")
    kept = F.filter(F.split(text_col, "\n", -1), lambda line, i: ~F.array_contains(f["dropped"], i))
    text = F.when(f.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.where(f.isNull() | (F.size(f["dropped"]) < f["n_lines"])).withColumn(text_col, text).where(f.isNull() | F.col(text_col).rlike(r"\S")).select(*docs.columns)
