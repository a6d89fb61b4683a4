"""Exact and near duplicates against brute force."""

import hashlib
import itertools
import random
import re

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, simhash_dedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    return sorted((str(i), str(max((x for x in groups[n] if x is not None), default=None)), len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, t in rows for n in [(t or "").translate(UPPER)])


def test_exact_groups(docs_of, edge_rows):
    rows = edge_rows + [(100 + i, f"Copy {i % 3}") for i in range(60)] + [(None, "nobody"), (None, "Nobody")]
    for entries in (2, 4096):  # two: the directory doubles and hot buckets are paged
        found = exact_dedup.equal_text_groups(docs_of(rows), bucket_entries=entries)
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in found.collect()) == brute_exact(rows)


def test_keys_are_settled_across_batches():
    import pyarrow as pa

    rows = [(i, b"s", h, 0, p, 1) for i, (p, h) in enumerate([(0, 1), (0, 2), (0, 2), (0, 2), (0, 3), (1, 3), (1, 4), (1, 4)])]
    table = pa.table(dict(zip(("doc_id", "sha", "h", "bucket", "page", "pages"), zip(*rows))))
    for size in (1, 2, 3, 8):
        found = [r for b in exact_dedup._settled(table.to_batches(max_chunksize=size)) for r in b.to_pylist()]
        assert [(r["doc_id"], r["met"]) for r in found] == list(enumerate([1, 3, 3, 3, 1, 1, 2, 2]))


def test_directory_splits_until_buckets_fit(spark):
    entries = spark.range(4000).select(F.xxhash64("id").alias("h"))
    pointers, depth = exact_dedup.directory(spark, entries, bucket_entries=100)
    found = pointers.toPandas()
    assert len(found) == 1 << depth and found["prefix"].is_unique and (found["pages"] == 1).all()
    assert found["bucket"].nunique() >= 40


def test_colliding_keys_are_told_apart_by_their_bytes():
    import pyarrow as pa

    cols = {"doc_id": [1, 2, 3], "number": [10, 11, 12], "sha": [b"a", b"b", b"a"], "h": [7, 7, 7], "bucket": [0, 0, 0], "page": [0, 0, 0], "pages": [1, 1, 1], "text": [b"x", b"y", b"x"]}
    rows = [r for b in exact_dedup._chains([pa.RecordBatch.from_pydict(cols)]) for r in b.to_pylist()]
    assert [(r["keep"], r["keep_number"], r["n"]) for r in rows if r["kind"] == 1] == [(3, 12, 2), (2, 11, 1)]


def test_one_row_of_each_group_is_kept_whatever_the_ids(docs_of):
    rows = [(None, "no id"), (None, "No id"), (7, "same row"), (7, "same row"), (3, "Same row"), (None, "same row"), (9, "alone"), (None, "alone too"), *[(5, "hot")] * 300, *[(None, "hot")] * 300]
    for entries in (4, 512):
        found = exact_dedup.equal_text_groups(docs_of(rows), bucket_entries=entries).where("kept").collect()
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in found) == [("5", "5", 600), ("7", "7", 4), ("9", "9", 1), ("None", "None", 1), ("None", "None", 2)]


def test_repeated_rows_spread_over_the_pages(docs_of, spark, monkeypatch):
    kept = {}
    real = exact_dedup.staged
    monkeypatch.setattr(exact_dedup, "staged", lambda df, name: kept.setdefault(name, real(df, name)))
    assert exact_dedup.equal_text_groups(docs_of([(1, "one row")] * 2000), bucket_entries=100).where("kept").count() == 1
    pages = [r["count"] for r in kept["index-chains"].where("kind = 0").groupBy("page").count().collect()]
    assert len(pages) == 20 and max(pages) < 200


def brute_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return 0
    parts = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, prints):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(rows))]


def near_copies():
    rng, rows = random.Random(4), []
    for group in range(25):
        base = [rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 60)) for _ in range(rng.choice([30, 200, 400]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((1000 + len(rows), " ".join(copy)))
    return rows


def test_fingerprints_and_components(docs_of, edge_rows):
    rows = edge_rows + near_copies()
    prints = [brute_fingerprint(t) for _, t in rows]
    want = sorted((str(i), f"{p:016x}", str(c)) for (i, _), p, c in zip(rows, prints, brute_components(rows, prints)))
    found = simhash_dedup.near_duplicate_groups(docs_of(rows)).select("doc_id", simhash_dedup.fingerprint_hex(F.col("fp")).alias("f"), "component_id")
    assert sorted(tuple(map(str, r)) for r in found.collect()) == want


def test_hot_keys_give_the_same_links(spark):
    rng = random.Random(1)
    prints = {0, *(1 << i for i in range(20)), *((1 << i) | (1 << j) for i in range(12) for j in range(i))}
    prints |= {rng.getrandbits(64) for _ in range(50)}
    rows = [(simhash_dedup._signed(p),) for p in sorted(prints)]
    fps = spark.createDataFrame(rows, "fp bigint")

    def parted(pairs):
        root = {r[0]: r[0] for r in rows}
        for u, v in pairs:
            a, b = root[u], root[v]
            root = {k: min(a, b) if x in (a, b) else x for k, x in root.items()}
        return root

    want = parted((a[0], b[0]) for a, b in itertools.combinations(rows, 2) if ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= 2)
    for limit in (1, 64):
        assert parted((r["u"], r["v"]) for r in simhash_dedup.links(fps, 2, limit).collect()) == want


def edited_copies():
    """Texts of 100, 300 and 1000 words and their copies with one to five in a hundred words changed."""
    rng, rows = random.Random(8), []
    for n in (100, 300, 1000):
        for _ in range(4):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            rows.append((len(rows), " ".join(base)))
            for share in (0.01, 0.02, 0.03, 0.05):
                copy = list(base)
                for at in rng.sample(range(n), max(1, int(n * share))):
                    copy[at] = f"new{rng.randrange(10**6)}"
                rows.append((len(rows), " ".join(copy)))
    # one repeated shingle outweighs the rest: equal fingerprints, unlike sets
    rows += [(len(rows) + k, "again " * 400 + " ".join(f"own{k}x{i}" for i in range(20))) for k in range(2)]
    # a group of near copies larger than the others
    base = [f"h{rng.randrange(10**6)}" for _ in range(200)]
    for k in range(150):
        rows.append((len(rows), " ".join([*base[: 1 + k % 190], f"edit{k}", *base[1 + k % 190 :]])))
    return rows


def brute_similar(rows):
    """The smallest id that each row reaches by links of Jaccard 0.8 or more of five-word shingles."""
    sets, first = {}, []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        first.append(sets.setdefault(frozenset({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}), len(sets)))
    sets, root = list(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for (i, _), k in zip(rows, first):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in first]


def test_stage_links_by_jaccard(docs_of, edge_rows):
    rows = [(i if i is None else 10_000 + i, t) for i, t in edge_rows if len(t or "") < 10_000] + edited_copies() + near_copies()[:80]
    want = sorted((str(i), str(c)) for (i, _), c in zip(rows, brute_similar(rows)))
    found = simhash_dedup.similar_groups(docs_of(rows), width=5)
    assert sorted(tuple(map(str, r)) for r in found.collect()) == want


def test_empty_tables(docs_of):
    none = docs_of([(1, "x")]).limit(0)
    assert exact_dedup.equal_text_groups(none).count() == 0 and simhash_dedup.near_duplicate_groups(none).count() == 0
    assert simhash_dedup.similar_groups(none).count() == 0
