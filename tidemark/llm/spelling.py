"""Spelling variant grouping: words one insertion, deletion or replacement apart, by hashes of deletions.

A word without its i-th letter has a hash made of two polynomial hashes of the word, that of the prefix before i and
that of the suffix after it, so all deletions of all words of a batch are a few array operations on integers. Words
that differ in one letter share the deletion at that place; a word with a letter more shares a deletion with the
whole of the shorter word. The 64-bit keys are dealt by their leading bits to tasks, which sort them, and letters
themselves are compared where keys agree.

Words with the same deletion at the same place are all near each other, and there can be no more of them than the
alphabet has letters (116); so a task never makes pairs, it only needs each run's size and its two most frequent
words. Every pair of near words meets in exactly one run.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.byte_tries import as_binary, from_binary, gathered, leaves, runs, stretches
from tidemark.llm.shared import give_back, staged

LEAST_LETTERS, LEAST_COUNT = 7, 2
SPOILT = 31
FACTOR = 10
#: Distinct words that a task holds before it hands their counts on; keys of a radix bucket on average.
HELD, BUCKET_KEYS = 1 << 20, 200_000
#: Keys of words of up to so many letters carry the word.
LONG = 64
#: Up to so many bytes the checksums of all words go on together, byte by byte; longer ones go alone.
TOGETHER = 64

_LEAD = 0xC3  # of U+00C0 to U+00FF, and never a second byte
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_OUTSIDE = ~_ASCII
_OUTSIDE[0x80:0xC0] = _OUTSIDE[_LEAD] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _BASE_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """The crc32 of each word, going on from the crc32 ``begun``."""
    order = np.argsort(-lens, kind="stable")
    now = ~begun.astype(np.uint32)[order]
    at, size = starts[order], lens[order]
    long = int(np.searchsorted(-size, -TOGETHER, "left"))
    for k in range(int(size[long]) if long < len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))
        some = slice(long, n)
        now[some] = _CRC[(now[some] ^ data[at[some] + k]) & np.uint32(255)] ^ now[some] >> np.uint32(8)
    out = np.empty(len(starts), np.uint32)
    out[order] = ~now
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[starts[k] : starts[k] + lens[k]], int(begun[k]))
    return out


def _words(data: np.ndarray, offsets: np.ndarray, ids: list, least: int, spoilt: int):
    """``(data, starts, lens)`` of the words of some texts, each occurrence, letters spoilt where its checksum says so."""
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == _LEAD
    second[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts, lens = runs(_ASCII[data] | (data == _LEAD) | second, offsets[1:-1])
    before = np.concatenate([[0], np.cumsum(second)])
    letters = lens - (before[starts + lens] - before[starts])
    keep = letters >= least
    starts, lens, letters = starts[keep], lens[keep], letters[keep]
    low = _LOWER[data]
    begun = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids], np.uint32)
    crc = checksums(low, starts, lens, begun[np.searchsorted(offsets[1:], starts, "right")])
    hit = np.flatnonzero(crc % spoilt == 0)
    whole = np.ones(len(starts), bool)
    whole[hit] = False
    if not len(hit):
        return low, starts, lens
    # the spoilt ones are written anew, without the bytes of one letter
    own, at = gathered(low, starts[hit], lens[hit])
    word = np.repeat(np.arange(len(hit)), lens[hit])
    letter_begins = ~np.concatenate([second[s : s + n] for s, n in zip(starts[hit].tolist(), lens[hit].tolist())])
    ordinal = np.cumsum(letter_begins) - 1
    ordinal -= ordinal[at[:-1]][word]
    stays = ordinal != (crc[hit].astype(np.int64) % letters[hit])[word]
    sizes = np.bincount(word[stays], minlength=len(hit))
    joined = np.concatenate([low, own[stays]])
    new_starts = len(low) + np.cumsum(sizes) - sizes
    enough = letters[hit] - 1 >= least
    return joined, np.concatenate([starts[whole], new_starts[enough]]), np.concatenate([lens[whole], sizes[enough]])


def _counter(least: int, spoilt: int, held: int):
    def run(batches):
        parts, size = [], 0

        def merged():
            nonlocal parts, size
            base = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
            data, lens, n = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3))
            starts = np.concatenate([p[1] + b for p, b in zip(parts, base)])
            leaf, place = leaves(data, starts, lens)
            own, offsets = gathered(data, starts[place], lens[place])
            parts = [(own, offsets[:-1], lens[place], np.bincount(leaf, n, len(place)).astype(np.int64))]
            size = len(place)
            return parts[0]

        def rows():
            data, starts, lens, n = merged()
            words = as_binary(data, starts, lens).cast(pa.string())
            yield from pa.Table.from_arrays([words, pa.array(n)], names=["word", "n"]).to_batches(max_chunksize=65_536)

        for b in batches:
            ids = b.column(0).to_pylist()
            for first, to, data, offsets, _ in stretches(b.column(1), _OUTSIDE):
                data, starts, lens = _words(data, offsets, ids[first:to], least, spoilt)
                leaf, place = leaves(data, starts, lens)
                own, at = gathered(data, starts[place], lens[place])
                parts.append((own, at[:-1], lens[place], np.bincount(leaf, minlength=len(place))))
                size += len(place)
                if size > held:
                    merged()
                    if size > held // 2:
                        yield from rows()
                        parts, size = [], 0
        if size:
            yield from rows()
        give_back()

    return run


def frequent_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, spoilt: int = SPOILT, held: int = HELD) -> DataFrame:
    """``(word, n)``: the words of ``least_letters`` letters and ``least_count`` occurrences or more."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = rows.mapInArrow(_counter(least_letters, spoilt, held), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(letters, starts, lens)``, a byte (its code point) for each letter."""
    data, starts, lens = from_binary(words)
    lead = data == _LEAD
    second = np.zeros(len(data), bool)
    second[1:] = lead[:-1]
    before = np.concatenate([[0], np.cumsum(lead)])
    ends = starts + lens
    return np.where(second, data + np.uint8(0x40), data)[~lead], starts - before[starts], lens - (before[ends] - before[starts])


def deletion_keys(letters: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, word, place)`` of each word whole (place -1) and without each of its letters; words stand one after the other.

    With H(i) the hash of the first i letters, letter k counting its value times base^k, the word without letter i
    has H(i) + (H(n) - H(i + 1)) / base; all modulo 2^64, where base is odd and so can be divided by.
    """
    place = np.arange(len(letters)) - np.repeat(starts, lens)
    values = (letters.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(29)
    keys = []
    with np.errstate(over="ignore"):
        for base in (_BASE, _BASE_2):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lens.max(initial=0)), base)]))
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[place])])
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            whole = upto[starts + lens] - upto[starts]
            prefix = upto[:-1] - np.repeat(upto[starts], lens)
            suffix = np.repeat(upto[starts + lens], lens) - upto[1:]
            keys.append(np.concatenate([whole, prefix + suffix * inverse]))
        # low bits of a product know low bits only: the two hashes meet in one, high bits folded into low ones
        key = keys[0] ^ (keys[1] >> np.uint64(32) | keys[1] << np.uint64(32))
        key = (key ^ key >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(33)
    word = np.arange(len(lens))
    return key, np.concatenate([word, np.repeat(word, lens)]), np.concatenate([np.full(len(lens), -1), place])


def _keyed(buckets: int, size: int = 1 << 18):
    """Each key's row, with its radix bucket (its leading bits, as a share of the number of buckets) and the columns after the word.

    ``first``: the letter left out is the first of its equals in a row; leaving out another gives the same word.
    """

    def run(batches):
        for b in batches:
            letters, starts, lens = _letters(b.column(0))
            ends = np.cumsum(lens)
            at = 0
            while at < len(lens):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
                some = letters[starts[at] : starts[to - 1] + lens[to - 1]]
                key, word, place = deletion_keys(some, starts[at:to] - starts[at], lens[at:to])
                again = np.concatenate([[False], some[1:] == some[:-1]])
                first = np.concatenate([np.ones(to - at, bool), ~again | (place[to - at :] == 0)])
                bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                of = pa.array(at + word)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(first), *(c.take(of) for c in b.columns[1:])], names=["bucket", "key", "place", "first", *b.schema.names[1:]])
                at = to

    return run


NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])


def _without(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, place: np.ndarray):
    """The words' letters without the one at ``place`` (-1: all of them), as ``(letters, starts, lens)``."""
    own, at = gathered(data, starts, lens)
    keep = np.ones(len(own), bool)
    cut = place >= 0
    keep[at[:-1][cut] + place[cut]] = False
    left = lens - cut
    return own[keep], np.cumsum(left) - left, left


def _owner(_: tuple, table: pa.Table) -> pa.Table:
    """A bucket of keys: for each word in a run of words near each other, how many and which is the most frequent."""
    table = table.combine_chunks()
    order = np.argsort(table["key"].to_numpy(), kind="stable")
    key = table["key"].to_numpy()[order]
    same = key[1:] == key[:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    if not len(order):
        return NEAR.empty_table()
    some = table.take(pa.array(order)).combine_chunks()
    words, place, n = some["word"].combine_chunks(), some["place"].to_numpy().astype(np.int64), some["n"].to_numpy()
    letters, starts, lens = _letters(words)
    group, _ = leaves(*_without(letters, starts, lens, place))  # equal letters, not equal keys
    # a deletion of one of several equal letters in a row is the same word: only the first tells of a letter more
    first = np.ones(len(place), bool)
    later = place > 0
    first[later] = letters[starts[later] + place[later]] != letters[starts[later] + place[later] - 1]
    coded = words.dictionary_encode()
    names = coded.dictionary
    of = coded.indices.to_numpy(zero_copy_only=False)
    alphabetical = np.empty(len(names), np.int64)
    alphabetical[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))

    # replacements: the same deletion at the same place
    cut = np.flatnonzero(place >= 0)
    found = [_runs_of(group[cut] * (int(place.max(initial=0)) + 1) + place[cut], of[cut], n[cut], alphabetical)]
    # a letter more: the whole of the shorter word against the deletions of the longer
    whole = np.flatnonzero(place < 0)
    short = np.full(int(group.max()) + 1, -1)
    short[group[whole]] = whole
    longer = np.flatnonzero((place >= 0) & first & (short[group] >= 0))
    if len(longer):
        own = short[group[longer]]
        found.append((of[longer], np.ones(len(longer), np.int64), of[own], n[own]))
        rank = longer[np.lexsort((alphabetical[of[longer]], -n[longer], own))]
        lead = np.flatnonzero(np.concatenate([[True], short[group[rank[1:]]] != short[group[rank[:-1]]]]))
        found.append((of[short[group[rank[lead]]]], np.diff(np.append(lead, len(rank))), of[rank[lead]], n[rank[lead]]))
    word, near, best, best_n = (np.concatenate(c) for c in zip(*found))
    return pa.Table.from_arrays([names.take(pa.array(word)), pa.array(near.astype(np.int64)), names.take(pa.array(best)), pa.array(best_n)], schema=NEAR)


def _runs_of(run: np.ndarray, of: np.ndarray, n: np.ndarray, alphabetical: np.ndarray):
    """Members of runs of two or more words, all near each other: the others' number and the most frequent other."""
    order = np.lexsort((alphabetical[of], -n, run))
    run, of, n = run[order], of[order], n[order]
    begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    size = np.diff(np.append(begins, len(run)))
    begins, size = begins[size > 1], size[size > 1]
    at = np.repeat(begins, size)
    member = at + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    best = np.where(member == at, at + 1, at)
    return of[member], np.repeat(size - 1, size), of[best], n[best]


def _long_keys(words: DataFrame, buckets: int, ddl: str) -> DataFrame:
    """The keys that words of over ``LONG`` letters share with another word.

    A row for each letter can't carry a long word: the keys meet without them first, and only those that
    meet get their words back. A word of ``LONG`` letters comes as the whole of a longer one's deletion only.
    """
    long = staged(words.where(F.length("word") >= LONG).select("word", "n", F.monotonically_increasing_id().alias("id")), "spelling-long")
    short = F.length("word") == LONG
    keyed = staged(long.select("word", "id", short.alias("short")).mapInArrow(_keyed(buckets), f"{ddl}, id bigint, short boolean").where("place < 0 or not short"), "spelling-long-keys")
    replaced = keyed.where("place >= 0").groupBy("key", "place").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    inserted = keyed.where("first").groupBy("key").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a < 0 and b >= 0")
    both = keyed.join(replaced, ["key", "place"], "left_semi").unionByName(keyed.where("first").join(inserted, "key", "left_semi").select(keyed.columns)).distinct()
    return both.join(long, "id").select("bucket", "key", "place", "first", "word", "n")


def near_words(words: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """``(word, n_near, best, best_n)`` of the words of ``(word, n)`` that have a near word; ``best`` is the most frequent one.

    Words are of A-Z, a-z and U+00C0 to U+00FF and stand there once each; of equal frequencies the first in
    code-point order counts.
    """
    told = words.agg(F.coalesce(F.sum(F.when(F.length("word") <= LONG, F.length("word") + 1)), F.lit(0)).alias("k"), F.coalesce(F.max(F.length("word")), F.lit(0)).alias("longest")).first()
    buckets = max(1, -(-told["k"] // bucket_keys))
    ddl = "bucket bigint, key bigint, place int, first boolean"
    keyed = words.where(F.length("word") <= LONG).select("word", F.col("word").alias("w"), "n").mapInArrow(_keyed(buckets), f"{ddl}, word string, n bigint")
    if told["longest"] > LONG:
        keyed = keyed.unionByName(_long_keys(words, buckets, ddl))
    met = keyed.select("bucket", "key", "place", "word", "n").groupBy("bucket").applyInArrow(_owner, "word string, near bigint, best string, best_n bigint")
    # most frequent first, then in code-point order, which is the order of UTF-8 bytes
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best")))
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = FACTOR, bucket_keys: int = BUCKET_KEYS, held: int = HELD) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: each frequent word, its far more frequent near word and where that leads.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, one letter taken out where 31 divides the
    crc32 of ``<id>:<word>``; those of 7 letters and 2 occurrences count. ``form`` is the near word of largest
    n (ties: the first in code-point order) if it occurs ``factor`` times as often; ``root`` follows forms to the last.
    Null texts have no words, a null id reads as the empty text; repeated rows count as often as they come; an
    empty table gives no rows; other columns are ignored; words and texts have any length.
    """
    words = staged(frequent_words(docs, id_col, text_col, held=held), "spelling-words")
    near = near_words(words, bucket_keys)
    formed = F.when(F.col("best_n") >= factor * F.col("n"), F.col("best"))
    told = staged(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), formed.alias("form"), F.when(formed.isNotNull(), F.col("best_n")).alias("form_n")), "spelling-forms")
    # each step at least multiplies n by the factor, so chains are short and every round halves them
    links = told.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        links = staged(links, "spelling-links")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = links.join(further, "root", "left")
        if joined.where("next is not null").isEmpty():
            break
        links = joined.select("word", F.coalesce("next", "root").alias("root"))
    return told.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
