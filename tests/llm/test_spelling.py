"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import byte_tries, spelling

LETTERS = "[A-Za-zÀ-ÿ]+"


def words_of(rows, least=7):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(LETTERS, text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, factor=10):
    n = words_of(rows)
    form, near = {}, {}
    for w in n:
        others = [x for x in n if is_near(w, x)]
        near[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], near[w], n[form[w]] if form[w] else None) for w in n}


def rows_of_test():
    rng = np.random.default_rng(8)
    stems = ["example", "exampel", "sampling", "aaaaaaa", "aaaaaaaa", "aaaaaaab", "naïveté", "straßen", "ÀÉÎÕÜàé", "mississippi", "été×÷été"]
    pool = []
    for s in stems:
        for _ in range(14):
            w, k = list(s), rng.integers(len(s))
            kind = rng.integers(4)
            if kind == 0:
                del w[k]
            elif kind == 1:
                w.insert(k, rng.choice(list("abéx")))
            elif kind == 2:
                w[k] = rng.choice(list("abéXs"))
            pool += ["".join(w)] * int(rng.choice([1, 2, 3, 30]))
    long = ["q" * 64, "q" * 65, "q" * 66, "q" * 40 + "z" + "q" * 24, "q" * 63 + "z", "ab" * 40, "ab" * 39 + "ac", "ab" * 40 + "a", "é" * 70, "é" * 69 + "e", "é" * 64, "é" * 63 + "e"]
    rows = [(i, " ".join(rng.choice(pool + long, 60))) for i in range(60)]
    rows += [(1000 + i, w) for i, w in enumerate(["chainaa"] * 4 + ["chainab"] * 80 + ["chainbb"] * 1200)]
    rows += [(None, "example, examples; Example!"), (7, None), (8, ""), (9, "1234 日本語 ー")] + [(10, "Example exampel sampling")] * 40
    return rows + [(11, "x".join(["repeated"] * 400) + " " + "x".join(["repeated"] * 400)), (12, "x".join(["repeated"] * 400) + "y " + "x".join(["repeated"] * 400) + "y")]


def test_groups_equal_all_pairs(spark):
    rows = rows_of_test()
    want = brute(rows)
    assert any(f and r != f for _, f, r, *_ in want) and any(k > 3 for *_, k, _ in want)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id bigint, text string, n int, word string, key int").repartition(4)
    for bucket_keys, held in ((200_000, 1 << 20), (100, 20)):
        found = spelling.variant_groups(df, bucket_keys=bucket_keys, held=held).collect()
        assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_equal_keys_of_different_letters_do_not_meet():
    words, n = pa.array(["example", "exbmple", "another", "anotherr"]), pa.array([5, 4, 3, 2])
    of = np.array([0, 1, 2, 3, 0, 2])
    table = pa.table({"bucket": pa.array([0] * 6), "key": pa.array([1] * 6), "place": pa.array([2, 2, -1, 6, 3, 2], pa.int32()), "word": words.take(pa.array(of)), "n": n.take(pa.array(of))})
    found = {(r["word"], r["near"], r["best"]) for r in spelling._owner((), table).to_pylist()}
    assert found == {("example", 1, "exbmple"), ("exbmple", 1, "example"), ("another", 1, "anotherr"), ("anotherr", 1, "another")}


def test_keys_are_those_of_the_words_without_the_letter():
    words = ["abcdefg", "aab", "é" * 9, "mississippi"]
    key, word, place = spelling.deletion_keys(*spelling._letters(pa.array(words)))
    cut = [words[w] if p < 0 else words[w][:p] + words[w][p + 1 :] for w, p in zip(word, place)]
    again, *_ = spelling.deletion_keys(*spelling._letters(pa.array(cut)))
    assert key.tolist() == again[: len(cut)].tolist() and len(set(zip(key.tolist(), cut))) == len(set(cut)) == len(set(key.tolist()))


def test_checksums_go_on_byte_by_byte():
    terms = ["a", "bc", "x" * 63, "y" * 64, "z" * 65, "é" * 500, "word"]
    data, starts, lens = byte_tries.from_binary(pa.array(terms))
    begun = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(terms))], np.uint32)
    assert spelling.checksums(data, starts, lens, begun).tolist() == [zlib.crc32(f"{i}:{t}".encode()) for i, t in enumerate(terms)]


def test_empty_table_and_no_pairs(spark):
    assert spelling.variant_groups(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    alone = spark.createDataFrame([(1, "solitary"), (2, "solitary")], "doc_id bigint, text string")
    assert [tuple(r) for r in spelling.variant_groups(alone).collect()] == [("solitary", None, "solitary", 2, 0, None)]
