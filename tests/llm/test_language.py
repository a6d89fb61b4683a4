"""Language identification and language-model scoring."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid, lm_scoring, queries
from tidemark.llm.tokens import default_path

PIECES = default_path("piece_bpe_32k.model")


def segmentations(text, pieces):
    if not text:
        yield 1.0
    for k in range(1, len(text) + 1):
        p = pieces.get(text[:k], langid.UNKNOWN if k == 1 else 0)
        if p:
            for rest in segmentations(text[k:], pieces):
                yield p * rest


def test_forward_pass_sums_all_segmentations():
    pieces = {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.3, "▁a": 0.05, "▁ab": 0.02, "bab": 0.07}
    vocabulary = langid.Vocabulary([*pieces])
    table = np.zeros((vocabulary.size + 1, 1))
    for p, x in pieces.items():
        at = vocabulary.find(np.array([langid._hash_of(p)], dtype=np.uint64))[0]
        if at < vocabulary.size:
            table[at] = x
    kept = {p: x for p, x in pieces.items() if vocabulary.find(np.array([langid._hash_of(p)], dtype=np.uint64))[0] < vocabulary.size}
    runs = pa.array(["ab", "babab", "zab", "a"], pa.large_string())
    got = langid.log_probabilities(vocabulary, table, runs)[:, 0]
    want = [math.log(sum(segmentations("▁" + r.as_py(), kept))) for r in runs]
    assert np.allclose(got, want)
    weights = np.array([1.0, 2.0, 0.0, 3.0])
    counts = langid.expected_counts(vocabulary, table[:, 0], runs, weights)
    for p in kept:  # how often each piece stands in the segmentations, by their probability
        at = vocabulary.find(np.array([langid._hash_of(p)], dtype=np.uint64))[0]
        want = sum(w * sum(x * parts.count(p) for x, parts in listed) / sum(x for x, _ in listed) for r, w in zip(runs, weights) for listed in ([*listings("▁" + r.as_py(), kept)],))
        assert abs(counts[at] - want) < 1e-9, p


def listings(text, pieces):
    """The probability and the pieces of each segmentation."""
    if not text:
        yield 1.0, []
    for k in range(1, len(text) + 1):
        p = pieces.get(text[:k], langid.UNKNOWN if k == 1 else 0)
        if p:
            yield from ((p * x, [text[:k], *parts]) for x, parts in listings(text[k:], pieces))


def test_runs_of_any_length_are_scored_whole():
    pieces = {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.3, "bab": 0.07}
    vocabulary = langid.Vocabulary([*pieces])
    kept = {p: vocabulary.find(np.array([langid._hash_of(p)], dtype=np.uint64))[0] for p in pieces}
    table = np.zeros((vocabulary.size + 1, 1))
    for p, at in kept.items():
        table[at] = pieces[p] if at < vocabulary.size else 0
    runs = ["ab", "a" * 39 + "b" * 3, "ba" * 25, "abbab" * 40, "xa" * 60, "abab" * 1000, "b" * 41, "aab" * 17]
    got = langid.log_probabilities(vocabulary, table, pa.array(runs, pa.large_string()))[:, 0]
    for run, found in zip(runs, got):
        text, logs = "▁" + run, [0.0]
        for j in range(1, len(run) + 2):
            reach = [logs[i] + math.log(pieces[text[i:j]] if kept.get(text[i:j], vocabulary.size) < vocabulary.size else langid.UNKNOWN) for i in range(max(0, j - 3), j) if j == i + 1 or kept.get(text[i:j], vocabulary.size) < vocabulary.size]
            logs.append(max(reach) + math.log(sum(math.exp(x - max(reach)) for x in reach)))
        assert abs(found - logs[-1]) < 1e-6 * abs(logs[-1]) + 1e-9, len(run)


def test_long_unknown_runs_stay_in_range(spark, docs_of):
    lao = "".join(chr(0x0E81 + k % 2) for k in range(300))
    vocabulary = langid.Vocabulary(["a", "b", "ab"])
    table = np.array([[0.5], [0.3], [0.2], [0.0]])
    runs = pa.array([lao[:39] + "a", lao[:40], "a" + lao[:39]], pa.large_string())
    assert np.isfinite(langid.log_probabilities(vocabulary, table, runs)).all()
    counts = langid.expected_counts(vocabulary, table[:, 0], runs, np.ones(3))
    at = vocabulary.find(np.array([langid._hash_of("a")], dtype=np.uint64))[0]
    assert np.isfinite(counts).all() and abs(counts[at] - 2) < 1e-6

    english, german = "the cat and the dog sat on the mat with the hat ", "der hund und die katze liegen auf der matte mit dem hut "
    told = docs_of([(1, english * 9, "en"), (2, german * 9, "de"), (3, f"{german} {lao[:36]}x", "de")])
    model = langid.fit(told, PIECES)
    assert np.isfinite(model.table).all() and np.isfinite(model.per_letter).all()
    asked = docs_of([(4, f"{english * 3} {lao}"), (5, f"{lao} {german * 3}"), (6, lao), (7, english)])
    found = {r["doc_id"]: r["p"] for r in asked.select("doc_id", langid.predicted(F.col("text"), model, spark).alias("p")).collect()}
    assert [found[k]["lang"] for k in (4, 5, 7)] == ["en", "de", "en"] and all(0 <= p["score"] <= 1 for p in found.values())
    assert found[6]["below"] > corpus_pipeline.MOST_BELOW > found[7]["below"]

    none = corpus_pipeline.language_id(spark, docs_of([(8, english), (9, "12 34"), (10, None)]), "")
    assert [r["doc_id"] for r in none.collect()] == [8]


def test_held_out_languages(spark):
    found = queries.op1_language_id(spark, "/root/testdata/sf0.01").alias("p")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").select("doc_id", "lang", "text")
    r = found.where("held_out").join(docs.where("length(text) > 40"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert r["n"] > 200 and r["right"] > 0.95
    assert found.count() == 1000 and found.where("score < 0 or score > 1 or lang_pred is null").count() == 0


def test_rows_without_letters_or_labels(spark, docs_of, edge_rows):
    told = [(i, t, "aa" if k % 2 else "bb") for k, (i, t) in enumerate(edge_rows)] + [(90, "123 456", None), (91, "!!! ---", "aa")]
    docs = docs_of(told)
    model = langid.fit(docs, PIECES)
    found = docs.select("doc_id", "text", langid.predicted(F.col("text"), model, spark).alias("p")).collect()
    assert len(found) == len(told)
    for r in found:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["p"]["lang"] in ("aa", "bb")) == lettered and 0 <= r["p"]["score"] <= 1
    nothing = langid.fit(docs.where("false"), PIECES)
    assert {r["p"]["lang"] for r in docs.select(langid.predicted(F.col("text"), nothing, spark).alias("p")).collect()} == {"und"}


def brute_scores(rows, strength):
    tokens = lambda t: [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [""]
    train = [tokens(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    uni, bi, contexts = Counter(w for ws in train for w in ws), Counter(), Counter()
    for ws in train:
        for u, w in zip([" ", *ws], ws):
            bi[u, w] += 1
            contexts[u] += 1
    # a token is a context for what may follow it, so its count as one is its count
    contexts = Counter(uni)
    contexts[" "] = len(train)
    n, v = sum(uni.values()), len(uni)
    p = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10(p(w)) for w in ws)
        score = sum(math.log10((bi[u, w] + strength * p(w)) / (contexts[u] + strength)) for u, w in zip([" ", *ws], ws))
        yield str(i), len(ws), sum(uni[w] > 0 for w in ws), n, round(base, 6), round(score, 6)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_scores_equal_brute_force(docs_of, edge_rows):
    rows = [r for r in edge_rows if len(r[1] or "") < 1000] + [(i, f"the cat {i % 4} sat on The mat {i % 9}") for i in range(50, 110)]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    found = lm_scoring.score(docs_of(rows), held, block_bytes=400).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in found)
    assert got == sorted(brute_scores(rows, found[0]["strength"]))
    assert lm_scoring.score(docs_of(rows).limit(0), held).count() == 0


def test_the_model_beats_the_base_on_held_out_texts(spark):
    r = queries.op9_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_long_runs_teach_as_their_segmentations_say(monkeypatch):
    """Edges made anew in stretches give the counts that edges kept from the forward pass give."""
    vocabulary = langid.Vocabulary([langid.BOUNDARY, "a", "b", "ab", "ba", "aba", langid.BOUNDARY + "a"])
    rng = np.random.default_rng(2)
    table = np.append(rng.dirichlet(np.ones(vocabulary.size)), 0.0)
    runs, weights = pa.array(["ab" * 300, "aab" * 150 + "x", "abba" * 90, "ab"], pa.large_string()), np.array([1.0, 2.0, 3.0, 4.0])
    at_once = langid.expected_counts(vocabulary, table, runs, weights)
    for size in (7, 64, 5000):
        monkeypatch.setattr(langid, "AT_ONCE", size)
        assert np.allclose(langid.expected_counts(vocabulary, table, runs, weights), at_once, rtol=1e-9)
    assert at_once.sum() > 600


def test_marks_stay_on_their_letters():
    runs, of = langid.letter_runs(pa.array(["हिन्दी", "a\u0301b", "\u0301", "x-y"], pa.large_string()))
    assert runs.to_pylist() == ["हिन्दी", "a\u0301b", "x", "y"] and of.tolist() == [0, 1, 3, 3]
