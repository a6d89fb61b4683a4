"""SimHash near-duplicates through pivot distance tables.

Every fingerprint gets a table row: its Hamming distances to many reference fingerprints (pivots).
Two fingerprints that differ in k bits have distances to any pivot that differ by at most k, so a
pair with a larger difference at any coordinate is discarded without comparing it. The pivots are
the zero fingerprint, the 32 that have two neighbouring bits set, and 15 spread ones.

Candidates come from an equi-join, not from all pairs. The difference between the distances to the
zero pivot and to a two-bit pivot tells how many of these two bits are set. k differing bits touch
the coordinates of at most k of the ``k + 3`` pivot groups, so a linked pair agrees on every
coordinate of some three groups: each choice of three groups gives a join key.

The groups are as many as keep a key's expected number of unrelated members small, whatever the number
of fingerprints. A key that many near copies share all the same is not expanded into pairs. Its members go
the neighbour way, which is exact for two bits and linear: each names itself and the 64 fingerprints one
bit away, and all members that name the same fingerprint are linked to the smallest of them.

The pipeline's stage needs more: texts of shingle Jaccard 0.8 differ in 9.7 of 64 bits on average, a
radius at which pivot keys tell next to nothing apart. ``similar_groups`` takes its candidates from BANDS
keys of ROWS minima of the shingles each, which meet a pair of Jaccard 0.8 with probability
1 - (1 - 0.8^ROWS)^BANDS = 0.999997; pairs whose distances to a pivot, or whose fingerprints, differ by
more than FAR_BITS are discarded, and a pair is linked when the shingle sets themselves confirm it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.graph import components
from tidemark.llm.shared import free_name, give_back, mix64, shuffle_width, staged
from tidemark.llm.tokens import chunks_of_text, spread
from tidemark.llm.wordkeys import word_keys

ZERO_PIVOT = 0
PAIR_PIVOTS = tuple(3 << (2 * i) for i in range(32))
SPREAD_PIVOTS = tuple(int(x) for x in np.random.default_rng(7).integers(0, 2**63, 15, dtype=np.int64))
BUCKET_PAIRS = 64
#: Unrelated fingerprints that may share a pivot key on average.
KEY_MEMBERS = 4
#: Least Jaccard similarity of shingle sets that ``similar_groups`` links.
SIMILAR = 0.8
CHUNK_BYTES = 1_500_000
#: Candidates further apart are discarded; five standard deviations above the mean at Jaccard 0.8.
FAR_BITS = 26
#: Keys of a shingle set, and the minima that make one.
BANDS, ROWS = 24, 4
#: Fixed odd factors that give as many orders of the shingles as the keys need.
FACTORS = np.random.default_rng(23).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bucket centres that a shingle set is compared to in a round of stars, and the rounds.
CENTRES, STAR_ROUNDS = 4, 2


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of one text's word shingles, unsigned."""
    return _majority(_shingles(text, width))


def _shingles(text: str | None, width: int) -> np.ndarray:
    """The hashes of a text's word shingles, repeats kept; one of all words if they are fewer than ``width``."""
    words = (text or "").encode().lower().split()
    parts = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words] if words else []
    return np.array([xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts], dtype="<u8")


def _majority(h: np.ndarray) -> int:
    if not len(h):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        total += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)``, one row per input row; fp is the fingerprint as a signed long.

    Null and wordless texts have fingerprint zero. Works through Arrow batches, a text at a time,
    so memory is bounded by a batch and by the longest text.
    """

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint_of(t.as_py(), width) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def distance_table(fp: Column) -> Column:
    """Hamming distances to all pivots: zero, 32 two-bit ones, then the spread ones."""
    return F.array(*(F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)).cast("bigint"))).cast("tinyint") for p in (ZERO_PIVOT, *PAIR_PIVOTS, *SPREAD_PIVOTS)))


def _groups(n: int, bits: int) -> int:
    """How many pivot groups a key takes, of ``bits`` more: enough that few of ``n`` random fingerprints share one."""
    chosen = 3
    while chosen < 12 and n > KEY_MEMBERS * 2 ** (48 * chosen / (chosen + bits)):  # a two-bit pivot tells 1.5 bits
        chosen += 1
    return chosen


def _keys(table: Column, bits: int, chosen: int = 3) -> Column:
    """The join keys: for every ``chosen`` of ``bits`` more pivot groups, a hash of their coordinates against the zero pivot's."""
    groups = np.array_split(np.arange(1, 33), bits + chosen)
    keys = []
    for n, some in enumerate(combinations(groups, chosen)):
        keys.append(F.xxhash64(F.lit(n), *(table[int(i)] - table[0] for g in some for i in g)))
    return F.array(*keys)


def _furthest(a: str, b: str) -> Column:
    """The largest difference of two distance tables at any pivot."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda m, x: F.greatest(m, x))


def links(fps: DataFrame, bits: int = 2, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of all pairs of distinct ``fp`` within ``bits`` bits.

    ``fps`` has distinct non-null ``fp``. Keys with at most ``bucket_pairs`` members are joined to
    pairs, filtered by the largest coordinate difference and verified; members of larger ones take
    the neighbour way, which needs ``bits`` to be 2.
    """
    if bits != 2:
        raise ValueError("the neighbour way for large buckets is exact for two bits")
    n = fps.count()
    # dealt anew by the row: the keys of a fingerprint are many, and merged partitions would be few
    table = fps.repartition(max(1, min(8 * shuffle_width(fps.sparkSession), n // 20_000)), "fp").select("fp", distance_table(F.col("fp")).alias("far"))
    keyed = staged(table.select("fp", F.explode(_keys(F.col("far"), bits, _groups(n, bits))).alias("key")), "pivot-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = staged(keyed.join(sizes, "key"), "pivot-buckets")
    cold = met.where(F.col("members") <= bucket_pairs).withColumn("far", distance_table(F.col("fp")))
    a, b = cold.select("key", F.col("fp").alias("u"), F.col("far").alias("fu")), cold.select("key", F.col("fp").alias("v"), F.col("far").alias("fv"))
    pairs = a.join(b, "key").where("v < u").where(_furthest("fu", "fv") <= bits).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits).select("u", "v")
    hot = met.where(F.col("members") > bucket_pairs).select("fp").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("bigint")) for i in range(64)))
    named = hot.select("fp", F.explode(flips).alias("near"))
    stars = named.select(F.col("fp").alias("u"), F.min("fp").over(W.partitionBy("near")).alias("v")).where("u <> v")
    return pairs.unionByName(stars).distinct()


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row.

    component_id is the smallest doc_id that fingerprint links of at most ``bits`` bits reach.
    Equal fingerprints are joined once, whatever their number. Defined results: null or empty text
    has fingerprint zero and links like any other; repeated rows come out as often as they came in;
    rows with a null id keep it and take the smallest id of their group (null if it has none); an
    empty table gives no rows; other columns are ignored.
    """
    fps = staged(fingerprints(docs, id_col, text_col, width), "fingerprints")
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(own.select("fp"), bits), "simhash")
    rooted = own.join(roots, own.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def _shingle_keys(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each distinct word shingle of each text, sorted within the text, and each text's number of them.

    A text of fewer than ``width`` words has one shingle, of all its words; one without words has none.
    """
    words, counts = word_keys(texts)
    starts = np.cumsum(counts) - counts
    size = np.minimum(counts, width)
    n = np.where(counts > 0, counts - size + 1, 0)
    at = spread(starts, n)
    keys = np.zeros(len(at), dtype=np.uint64)
    for i in range(width):
        inside = i < np.repeat(size, n)
        keys = np.where(inside, mix64(keys, words[np.minimum(at + i, len(words) - 1)] + np.uint64(i)), keys)
    of = np.repeat(np.arange(len(counts)), n)
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return keys[new], np.bincount(of[new], minlength=len(counts))


def _sketching(width: int):
    """``(doc_id, node, fp, size, keys)``: node is a hash of the shingle set, fp its SimHash; keys are those of its minima."""

    def run(batches):
        for b in batches:
            for first, to, texts in chunks_of_text(b.column(1), CHUNK_BYTES):
                shingles, n = _shingle_keys(texts, width)
                full = np.flatnonzero(n > 0)
                begins = (np.cumsum(n) - n)[full]
                node, fp = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
                minima = np.zeros((len(n), BANDS * ROWS), dtype=np.uint64)
                if len(full):
                    node[full] = mix64(np.add.reduceat(mix64(shingles, shingles), begins), n[full].astype(np.uint64))
                    for bit in range(64):
                        set_in = np.add.reduceat(((shingles >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), begins)
                        fp[full] |= (2 * set_in > n[full]).astype(np.uint64) << np.uint64(bit)
                    for k, factor in enumerate(FACTORS):
                        turned = shingles * factor
                        minima[full, k] = np.minimum.reduceat(turned ^ (turned >> np.uint64(29)), begins)
                keys = np.zeros((len(n), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    keys = mix64(keys, minima[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
                signed = lambda x: pa.array(x.view(np.int64))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * BANDS + 1, BANDS), pa.int32()), signed(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, to - first), signed(node), signed(fp), pa.array(n, pa.int32()), listed], names=["doc_id", "node", "fp", "size", "keys"])
        give_back()

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            for first, to, texts in chunks_of_text(b.column(1), CHUNK_BYTES):
                shingles, n = _shingle_keys(texts, width)
                parts = np.split(shingles, np.cumsum(n)[:-1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, to - first), pa.array([p.tobytes() for p in parts], pa.binary())], names=["node", "hashes"])
        give_back()

    return run


def _similar(batches):
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(5 * both >= 4 * (len(x) + len(y) - both))
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _near(a: str, b: str) -> Column:
    """Whether two structs (fp, size) can be of sets of Jaccard SIMILAR or more."""
    sizes = [F.col(f"{x}.size") for x in (a, b)]
    pivots = (ZERO_PIVOT, *SPREAD_PIVOTS)
    far = [F.array(*(F.bit_count(F.col(f"{x}.fp").bitwiseXOR(F.lit(_signed(p)).cast("bigint"))) for p in pivots)) for x in (a, b)]
    near = (_furthest(*far) <= FAR_BITS) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= FAR_BITS)
    return (5 * F.least(*sizes) >= 4 * F.greatest(*sizes)) & near


def similar_links(nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``(node, root)`` of the components of the candidate pairs whose shingle sets have Jaccard SIMILAR or more.

    ``nodes`` has distinct ``node`` with ``fp``, ``size``, ``keys`` and the key ``t`` of a text, ``texts``
    the texts by ``t``. Members of a bucket (a key) are first compared to the centres of their buckets, which joins up
    large groups of near copies by few comparisons. Then the members of a bucket that are still in other
    components than its commonest one are compared to the rest of the bucket.
    """
    keyed = nodes.select(F.explode("keys").alias("key"), F.struct("node", "fp", "size").alias("m"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    met = staged(keyed.join(shared, "key"), "shingle-buckets")
    some = met.select(F.col("m.node").alias("node")).distinct()
    wanted = nodes.select("t", "node").join(some, "node", "left_semi")
    rows = texts.join(wanted, "t").select("node", "text").mapInArrow(_sets(width), "node bigint, hashes binary")
    sets = staged(rows.groupBy("node").agg(F.first("hashes").alias("hashes")), "shingle-sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        x, y = (sets.select(F.col("node").alias(k), F.col("hashes").alias(f"h{k}")) for k in "uv")
        both = pairs.join(x, "u").join(y, "v").select("u", "v", "hu", "hv")
        return staged(both.mapInArrow(_similar, "u bigint, v bigint"), name)

    edges = met.sparkSession.createDataFrame([], "u bigint, v bigint")
    roots = None
    for k in range(STAR_ROUNDS + 1):
        now = met.withColumn("root", F.col("m.node"))
        if roots is not None:
            now = now.drop("root").withColumn("node", F.col("m.node")).join(roots, "node", "left").select("key", "m", F.coalesce("root", "node").alias("root"))
            mixed = now.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.mode("root").alias("main")).where("a <> b").select("key", "main")
            now = staged(now.join(mixed, "key"), "shingle-mixed")
        if k < STAR_ROUNDS:
            centres = now.groupBy("key").agg(F.min_by(F.struct("m", "root"), F.xxhash64("key", "m.node", F.lit(k))).alias("c"))
            met_c = now.join(centres, "key").withColumn("cm", F.col("c.m")).where(F.col("root") != F.col("c.root")).where(_near("m", "cm"))
            few = met_c.select(F.col("m.node").alias("u"), F.col("cm.node").alias("v")).distinct().groupBy("u").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("v").alias("h"), "v"))), 1, CENTRES).alias("c"))
            pairs = few.select("u", F.explode("c.v").alias("v"))
        else:
            minor = now.where("root <> main").select("key", F.col("m").alias("a"), F.col("root").alias("ra"))
            other = now.select("key", F.col("m").alias("b"), F.col("root").alias("rb"), "main")
            pairs = minor.join(other, "key").where("ra <> rb and (rb = main or a.node < b.node)").where(_near("a", "b"))
            pairs = pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()
        edges = edges.unionByName(verified(pairs, f"shingle-links-{k}"))
        roots = components(edges, f"shingles-{k}")
    return roots


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``(doc_id, t, root)``, one row per input row: a key of its text, and of the group that links of SIMILAR or more reach."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a text's own key, to find one text for each set of shingles again without moving the others
    named = rows.select(_text_key(F.col("text")).alias("t"), "text", "doc_id")
    sketched = named.select(F.struct("doc_id", "t").alias("doc_id"), "text").mapInArrow(_sketching(width), "doc_id struct<doc_id: bigint, t: bigint>, node bigint, fp bigint, size int, keys array<bigint>")
    sketched = staged(sketched.select("doc_id.*", "node", "fp", "size", "keys"), "sketches")
    nodes = sketched.groupBy("node").agg(F.first(F.struct("fp", "size", "keys")).alias("f"), F.min("t").alias("t")).select("node", "f.*", "t")
    roots = similar_links(staged(nodes, "shingle-nodes"), named.select("t", "text"), width)
    return staged(sketched.select("doc_id", "t", "node").join(roots, "node", "left").select("doc_id", "t", F.coalesce("root", "node").alias("root")), "shingle-roots")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``(doc_id, component_id)``, one row per input row.

    component_id is the smallest doc_id reached by links of shingle Jaccard SIMILAR or more. Texts with
    the same shingles are one, wordless and null ones too; ids that are null or repeated are dealt with
    as in ``near_duplicate_groups``.
    """
    rows = similar_rows(docs, id_col, text_col, width)
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with one row of every group that ``similar_rows`` tells: that of the smallest id, rows without one last.

    Of rows repeated in id and text one stays. Only what goes, and the few repeated rows, are shuffled by key.
    """
    rows = similar_rows(docs, id_col, text_col, width)
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t")).alias("b")).select("root", F.col("b.doc_id").alias("doc_id"), F.col("b.t").alias("t"))
    kinds = rows.groupBy("root", "doc_id", "t").agg(F.count("*").alias("times"))
    told = staged(kinds.join(best.select("root", F.col("doc_id").alias("_b"), F.col("t").alias("_t")), "root").select("doc_id", "t", "times", (F.col("doc_id").eqNullSafe(F.col("_b")) & (F.col("t") == F.col("_t"))).alias("stays")), "shingle-kinds")
    own = free_name(docs, "_near_key")
    keyed = docs.withColumn(own, F.struct(F.col(id_col).cast("bigint").alias("doc_id"), _text_key(F.col(text_col).cast("string")).alias("t")))
    named = lambda some: some.select(F.struct("doc_id", "t").alias(own)).distinct()
    left = keyed.join(named(told.where("not stays")), own, "left_anti")
    often = named(told.where("stays and times > 1"))
    once = left.join(often, own, "left_anti").unionByName(left.join(often, own, "left_semi").dropDuplicates([own]))
    return once.select(*docs.columns)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
