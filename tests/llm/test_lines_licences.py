"""Line dedup and licence scans against brute force."""

import math
import random
import re
import textwrap
import time
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import licences, line_dedup, wordkeys


def brute_lines(rows, threshold=0.8):
    seen, out = [], {}
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = []
        for k, line in enumerate(t.split("\n")):
            words = frozenset(w for w in line.encode().lower().split())
            if words and any(words == o or len(words & o) >= threshold * len(words | o) - 1e-9 for o in seen):
                gone.append(k)
            if words:
                seen.append(words)
        out[i, len(t)] = gone
    return out


def made(n, seed=3):
    rng, rows = random.Random(seed), []
    base = [[f"w{rng.randint(0, 80)}" for _ in range(rng.randint(3, 14))] for _ in range(40)]
    for i in range(n):
        lines = []
        for _ in range(rng.randint(1, 5)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randint(0, 80)}"
            rng.shuffle(words)
            lines.append(" ".join(words))
        rows.append((200 + i, "\n".join(lines)))
    return rows


def test_lines_equal_brute_force(docs_of, edge_rows):
    rows = edge_rows + made(120)
    want = brute_lines(rows)
    for tries in (16, 1):  # one: many lines need the second, exact pass
        found = {}
        for r in line_dedup.duplicate_lines(docs_of(rows), tries=tries).collect():
            text = next(len(t or "") for i, t, *_ in rows if i == r["doc_id"])
            found[r["doc_id"], text] = r["dropped"]
        assert found == want
    assert sum(map(len, want.values())) > 50


def test_lines_of_few_words_match_as_the_threshold_says(docs_of):
    """Four words are four fifths of five; three are less of four."""
    assert [line_dedup.least_words(t) for t in (0.5, 0.75, 0.8, 0.9)] == [1, 3, 4, 9]
    lines = ["alpha beta gamma delta", "alpha beta gamma delta epsilon", "one two three", "one two three four", "four three two one", "a b c d e", "d c b a", "p q r s t u", "p q r s t u v", "p q r"]
    rows = [(i, t) for i, t in enumerate(lines)] + [(100 + i, f"word{i % 7} x y z" + " w" * (i % 2) + f" v{i % 5}" * (i % 3)) for i in range(60)]
    found = {(r["doc_id"], len(dict(rows)[r["doc_id"]])): r["dropped"] for r in line_dedup.duplicate_lines(docs_of(rows)).collect()}
    assert found == brute_lines(rows) and found[1, len(lines[1])] == [0] == found[6, 7] and found[3, 18] == []


def test_every_row_of_a_repeated_document_is_told(docs_of):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "x y\nx y"), (3, None)]
    found = sorted((r["doc_id"], r["dropped"]) for r in line_dedup.duplicate_lines(docs_of(rows)).collect())
    assert found == [(1, []), (1, []), (2, [1]), (3, [])]


def test_texts_without_their_duplicate_lines(docs_of, edge_rows):
    docs = docs_of(edge_rows)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_duplicate_lines(docs).collect()}
    assert kept[10] == "a b c d e f g\n\nshort" and kept[2] is None and kept[3] == "" and 7 not in kept
    assert line_dedup.without_duplicate_lines(docs).columns == docs.columns
    assert line_dedup.without_duplicate_lines(docs.limit(0)).count() == 0


def test_written_tables_leave_no_shuffle_files_and_texts_are_not_moved(spark, docs_of, monkeypatch):
    """The index rows' files must go once their table is written; the lines to verify are found without moving the texts."""
    dirs = [Path(d.getPath()) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in d.rglob("shuffle_*")}
    plain, left, plans = line_dedup.staged, {}, {}

    def staged(df, name, **options):
        plans[name], before = df._jdf.queryExecution().executedPlan().toString(), files()
        out, ends = plain(df, name, **options), time.time() + 5
        while files() - before and time.time() < ends:  # Spark deletes them in the background
            time.sleep(0.1)
        left[name] = len(files() - before)
        return out

    monkeypatch.setattr(line_dedup, "staged", staged)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    assert any(r["dropped"] for r in line_dedup.duplicate_lines(docs_of(made(40)), tries=1).collect())
    assert left["line-pairs"] == 0 and set(left.values()) == {0} and spark.conf.get(setting) == was
    assert "Join" not in plans["line-sets"] and "Join" in plans["line-firsts"]


def test_lines_that_share_a_mark_by_chance_change_nothing(docs_of, monkeypatch):
    rows = made(60, seed=5) + [(1, "a b c d e"), (1, "p q r s t\nu v w x y z"), (2, "a b c d e f"), (3, "u v w x y z zz\nq")]
    want = sorted((i, n, gone) for (i, n), gone in brute_lines(rows).items())
    for most in (64, line_dedup.MOST_MARKS):  # so few that every line is marked
        monkeypatch.setattr(line_dedup, "MOST_MARKS", most)
        docs = docs_of(rows)
        found = line_dedup.duplicate_lines(docs).join(docs.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("k"), F.length("text").alias("size")), F.expr("doc_id = i and text_key = k"))
        assert sorted((r["doc_id"], r["size"], r["dropped"]) for r in found.collect()) == want
    assert (2, 11, [0]) in want and (3, 16, [0]) in want


def test_word_keys_do_not_depend_on_the_blocks(monkeypatch):
    texts = ["Alpha beta", "", "x" * 200 + " y\n\nz ", "  \t", "äÖ\u0085 B", "b" + "x" * 70, "c", " tail " * 40]
    column = pa.array(texts, pa.large_string())
    plain = [wordkeys.word_keys(pa.array([w], pa.large_string()))[0][0] for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
    for size in (1, 7, wordkeys._BLOCK):
        monkeypatch.setattr(wordkeys, "_BLOCK", size)
        assert wordkeys.word_keys(column)[0].tolist() == plain


def test_licences_and_their_inheritance(spark):
    rows = [
        (1, "src/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (2, "src/a/b/x.py", "print(1)\nx = 2"), (3, "src/a/y.py", "# SPDX-License-Identifier: Apache-2.0\nx = 1\ny = 2\nz = 3"),
        (4, "src/a/COPYING", "This work is licensed under the GNU General Public License, version 3."), (5, "other/z.py", "nothing here"), (6, None, None), (7, "src/q.py", ""), (7, "src/q.py", ""), (None, "src/a/b/c/d/e.py", "deep"), (8, "src/w.py", "licensed under no license at all, we like cake"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    found = {r["path"]: (r["licence"], r["origin"], r["inherited_from"]) for r in licences.licences(df).collect()}
    assert found["src/LICENSE"][:2] == ("MIT", "own") and found["src/a/y.py"][:2] == ("Apache-2.0", "own")
    assert found["src/a/b/x.py"] == ("GPL-3.0", "inherited", "src/a") == found["src/a/b/c/d/e.py"]
    assert found["src/q.py"] == ("MIT", "inherited", "src") == found["src/w.py"]
    assert found["other/z.py"] == (None, "none", None) == found[""]
    assert licences.licences(df.limit(0)).count() == 0


def dense(rows, threshold=licences.THRESHOLD):
    """Every part of every text against every template, by whole vectors."""
    words_of = lambda t: re.sub(r"[^\w.]+|_|\.(\s|$)|[.]{2,}", " ", t.lower()).split()
    names = [n for n, texts in licences.TEMPLATES.items() for _ in texts]
    templates = [Counter(words_of(t)) for texts in licences.TEMPLATES.values() for t in texts]
    lines = [line for _, _, t in rows for line in (t or "").split("\n")]
    known = {w for t in templates for w in t}
    df = Counter(w for line in lines for w in set(words_of(line)))
    total = len(lines) + len(templates) + 1
    idf = lambda w: math.log(total / (df[w] + sum(w in t for t in templates))) if w in known else math.log(total)
    norm = lambda c: math.sqrt(sum((n * idf(w)) ** 2 for w, n in c.items()))
    out = []
    for i, _, text in rows:
        split = (text or "").split("\n")
        full = [bool(words_of(x)) for x in split]
        parts, run = [[k] for k in range(len(split)) if full[k]], []
        for k in [*range(len(split)), None]:
            if k is not None and full[k]:
                run.append(k)
            else:
                parts, run = parts + ([run] if len(run) > 1 else []), []
        head = []
        for k, line in enumerate(split):
            if not re.match(licences.COMMENT, line, re.I):
                break
            head += [k] if full[k] else []
        parts += [p for p in (head, [k for k in range(len(split)) if full[k]]) if len(p) > 1]
        best = (0.0, None)
        for part in parts:
            c = Counter(w for k in part for w in words_of(split[k]))
            for name, t in zip(names, templates):
                cosine = sum(n * t[w] * idf(w) ** 2 for w, n in c.items()) / (norm(c) * norm(t))
                if cosine >= threshold and cosine > best[0] + 1e-12:
                    best = (cosine, name)
        out.append((str(i), str(best[1]), round(best[0], 9)))
    return out


def test_licences_equal_dense_vectors(spark):
    mit = "\n".join(["MIT License", "", "Copyright (c) 2020 Some One", "", *licences._MIT.split("\n"), "", licences._MIT_END, "", *licences._MIT_AS_IS.split("\n")])
    gpl = "\n".join(f"# {x}" for x in textwrap.wrap(licences._gnu("General Public License", "3")[1], 60)) + "\nimport os\nprint(1)"
    rows = [
        (1, "a/LICENSE", mit), (2, "a/x.py", gpl), (3, "a/b/c.py", "/*\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n */\nint x;"), (4, "b/y", "all rights\nreserved here"), (5, "b/z", None), (6, "b/z", ""),
        (7, "c/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"), (8, "c/d/e/f.c", "word " * 4000), (9, "d", "SPDX-License-Identifier: BSD-2-Clause"), (10, "d", "// SPDX-License-Identifier: Zlib\n// more words of another kind entirely"), (11, "e", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"),
        (12, "f/g", "x y"), (12, "f/g", "x y"), (None, None, licences._BSD),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string").withColumn("score", F.lit(1)).withColumn("file", F.lit("clash"))
    found = licences.licences(df).collect()
    own = [(str(r["doc_id"]), str(r["licence"] if r["origin"] == "own" else None), round(r["score"], 9)) for r in found]
    assert sorted(own) == sorted(dense(rows))
    told = {r["doc_id"]: r["licence"] for r in found}
    assert [told[k] for k in (1, 2, 3, 7, 8, 9, 11)] == ["MIT", "GPL-3.0", "Apache-2.0", "GPL-2.0", "GPL-2.0", "BSD-2-Clause", "Apache-2.0"]
