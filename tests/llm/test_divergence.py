"""Source divergence audit against a plain count, and the tries below it."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tidemark.llm import byte_tries, divergence


def test_leaves_tell_terms_apart_whatever_their_length():
    rng = np.random.default_rng(3)
    terms = ["".join(rng.choice(list("abé"), rng.integers(1, 30))) for _ in range(3000)] + ["a" * 8, "a" * 9, "a" * 8, "a" * 16, "a" * 17, "a" * 100_000, "a" * 100_000]
    leaf, place = byte_tries.leaves(*byte_tries.from_binary(pa.array(terms)))
    assert len({*zip(leaf.tolist(), terms)}) == len(set(terms)) == len(place) and [terms[p] for p in place] == [next(t for t, x in zip(terms, leaf) if x == k) for k in range(len(place))]
    assert all(len(x) == 0 for x in byte_tries.leaves(*byte_tries.from_binary(pa.array([], pa.string()))))


def test_stretches_cut_no_term():
    outside = ~divergence._LETTER
    texts = ["ab cd " * 50, "", "x" * 500, "one two"]
    parts = list(byte_tries.stretches(pa.array(texts), outside, 40))
    assert b"".join(bytes(p[2]) for p in parts) == "".join(texts).encode()
    assert [t for p in parts for t in re.findall("[a-z]+", bytes(p[2]).decode())] == re.findall("[a-z]+", " ".join(texts))
    assert [p[4] for p in parts if p[0] == 0][-1] and max(len(p[2]) for p in parts) == 500


def test_shares_are_exact():
    count = np.array([2, 3, 7 * 10**14, 1, 10**15])
    total = np.array([9, 4_000_000_007, 9 * 10**14 + 1, 10**15 - 1, 10**15])
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total)]


def brute(rows, least, top):
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
    n, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        group = (lang or "", source or "")
        langs[group[0]].add(group[1])
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))
        n[group].update(found)
        docs[group[0]].update(set(found))
    out = set()
    for lang, sources in langs.items():
        kept = sorted((t for t, k in docs[lang].items() if k >= least), key=str.encode)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(n[lang, s]) for s in sources}, share(sum((n[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1) if part == "pair" or k <= top}
    return out


def test_audit_equals_a_plain_count(spark):
    rng = np.random.default_rng(5)
    words = ["the", "The", "of", "été", "ÉTÉ", "日本語", "x", "averylongwordthatgoesdown", "averylongwordthatgoesup", "a1b", "tie", "eit", "ite"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 40))), rng.choice(["en", "fr"]), rng.choice(["s1", "s2", "é", "S"])) for _ in range(120)]
    rows += [(None, None, None), ("", "none", "a"), ("42 -- 17", "none", "b"), (None, "alone", "a"), ("the the", None, "s1")] + [("the same row", "en", "s1")] * 300
    rows += [("w " + " ".join(f"long{i % 700} été" for i in range(3000)), "en", "s2")]
    want = brute(rows, 3, 4)
    df = spark.createDataFrame([(*map(lambda x: None if x is None else str(x), r), 1, 2, 3) for r in rows], "text string, lang string, source string, total int, block int, ns int").repartition(5)
    old, byte_tries.stretches.__defaults__ = byte_tries.stretches.__defaults__, (1 << 12,)  # the driver's: tasks cut by their own size
    try:
        for held, block, cells in ((1 << 20, 1 << 16, 1 << 21), (50, 3, 8)):
            found = divergence.audit(df, least_docs=3, top=4, held=held, block=block, cells=cells).collect()
            assert len(found) == len(want) and {tuple(r) for r in found} == want
    finally:
        byte_tries.stretches.__defaults__ = old


def test_long_text_in_parts_is_one_document(spark):
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(1_500_000))
    df = spark.createDataFrame([(text, "en", "a"), ("wordaa", "en", "b")], "text string, lang string, source string")
    found = {bytes(r["term"]).decode(): (r["docs"], sum(r["ns"])) for r in divergence.kept_terms(df, 1).collect()}
    n = Counter(text.split()) + Counter(["wordaa"])
    assert found == {w: (2 if w == "wordaa" else 1, k) for w, k in Counter(re.findall("[a-z]+", text + " wordaa")).items()} and n


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(df).collect() == []
